"""Stand-in views over the driver tables. The same text runs in Spark SQL and in the checking engine."""

from __future__ import annotations

import re
from collections.abc import Collection
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CUTOFF, RATIO, SEED = "2001/07/01", 0.4, 42
BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)

VIEWS = {
    "scores": """
SELECT c.c_name AS entity, p.p_brand AS item,
  round(avg(l.l_quantity) * CASE p.p_brand WHEN 'Brand#1' THEN 56.0 WHEN 'Brand#2' THEN 2.4 ELSE 2.0 END, 4) AS score
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
JOIN part p ON l.l_partkey = p.p_partkey
WHERE l.l_returnflag = 'R' GROUP BY c.c_name, p.p_brand""",
    "ranges": """
SELECT 'Brand#1' AS item, CAST(0.0 AS DOUBLE) AS lo, CAST(2800.0 AS DOUBLE) AS hi
UNION ALL SELECT 'Brand#2', CAST(0.0 AS DOUBLE), CAST(120.0 AS DOUBLE)""",
    "entities": """
SELECT c.c_name AS entity,
  concat(cast(cast(floor(abs(c.c_acctbal) / 100) AS int) AS string), CASE WHEN c.c_custkey % 3 = 0 THEN 'M' ELSE 'B' END) AS parameters,
  concat('LM-', c.c_mktsegment, CASE WHEN c.c_custkey % 5 = 0 THEN '<br>x' ELSE '' END) AS language_model,
  concat('VM-', r.r_name) AS vision_model, n.n_name AS organization,
  concat(n.n_name, '-', c.c_mktsegment) AS family, (c.c_custkey % 2 = 0) AS open_source, t.release_date,
  c.c_custkey AS ord
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
LEFT JOIN (SELECT o_custkey, concat(cast(year(max(o_orderdate)) AS string), '/',
    lpad(cast(month(max(o_orderdate)) AS string), 2, '0'), '/', lpad(cast(day(max(o_orderdate)) AS string), 2, '0')) AS release_date
  FROM orders GROUP BY o_custkey) t ON t.o_custkey = c.c_custkey""",
    "items": """
SELECT p_brand AS item, min(p_type) AS category, count(*) AS num_samples, count(DISTINCT p_type) AS n_subcategories
FROM part GROUP BY p_brand""",
    "test_cells": """
SELECT entity, item, score FROM (
  SELECT s.entity, s.item, s.score,
    row_number() OVER (PARTITION BY s.entity ORDER BY md5(concat_ws(':', '42', s.entity, s.item)), s.item) AS rn,
    count(*) OVER (PARTITION BY s.entity) AS n
  FROM scores s JOIN (SELECT entity FROM entities WHERE release_date >= '2001/07') e ON s.entity = e.entity) x
WHERE rn <= greatest(1, cast(floor(n * 0.4) AS int))""",
    "train": """
SELECT s.entity, s.item, s.score FROM scores s
WHERE NOT EXISTS (SELECT 1 FROM test_cells t WHERE t.entity = s.entity AND t.item = s.item)""",
    "predictions": """
SELECT t.entity, t.item, t.score AS truth,
  round(((SELECT avg(score) FROM train) + coalesce(e.m, 0) + coalesce(i.m, 0))
    / (1 + CASE WHEN e.m IS NULL THEN 0 ELSE 1 END + CASE WHEN i.m IS NULL THEN 0 ELSE 1 END), 2) AS prediction,
  round(i.s, 2) AS uncertainty
FROM test_cells t
LEFT JOIN (SELECT entity, avg(score) AS m FROM train GROUP BY entity) e ON e.entity = t.entity
LEFT JOIN (SELECT item, avg(score) AS m, stddev_pop(score) AS s FROM train GROUP BY item) i ON i.item = t.item""",
    "replies": """
SELECT entity, item, CASE WHEN k % 17 = 0 THEN 'no answer'
  WHEN k % 23 = 0 THEN 'Result ```json [1, 2] ``` end' WHEN k % 23 = 1 THEN 'Result ```json 5 ``` end'
  WHEN k % 23 = 2 THEN 'Result ```json {"delta": "NaN", "credibility_weight": "Infinity"} ``` end'
  WHEN k % 23 = 3 THEN 'Result ```json {"delta": null, "adjustment": 4} ``` end'
  WHEN k % 5 = 0 THEN concat('Result: {"adjustment": ', cast(k % 11 - 5 AS string), '} end')
  ELSE concat('Result ```json {"delta": ', cast(k % 11 - 5 AS string), ', "credibility_weight": ', cast(k % 13 AS string),
              'e-1, "confidence": "low"} ``` end') END AS text
FROM (SELECT s.entity, s.item, (cast(right(s.entity, 6) AS int) * 31 + cast(replace(s.item, 'Brand#', '') AS int) * 7) AS k
  FROM test_cells s) x""",
    "hub": """
SELECT concat('org', cast(p_partkey % 7 AS string), '/', replace(p_name, ' ', '-'),
  CASE WHEN p_size % 3 = 0 THEN concat('-', cast(p_size AS string), 'B') ELSE '' END) AS repo, max(p_partkey) AS downloads
FROM part GROUP BY 1""",
    "web": """
SELECT page_id, url, CASE WHEN page_id % 10 = 3 THEN '<html><body><p>403 Forbidden: Access Denied to this resource, please try again later on</p></body></html>'
  WHEN page_id % 10 = 7 THEN 'gone' ELSE html END AS html FROM pages""",
    "papers": """
SELECT doc_id, CASE doc_id % 4
  WHEN 0 THEN concat('---', chr(10), 'tag: x', chr(10), '---', chr(10), text, ' https://arxiv.org/abs/', lpad(cast(doc_id % 10000 AS string), 4, '0'), '.', lpad(cast(doc_id AS string), 5, '0'), 'v2')
  WHEN 1 THEN concat(text, ' [', lpad(cast(doc_id % 10000 AS string), 4, '0'), '.', lpad(cast(doc_id AS string), 5, '0'), ']')
  ELSE text END AS text FROM documents""",
    "links": """
SELECT entity, open_source, CASE WHEN open_source THEN 'Yes' ELSE 'No' END AS opened, CASE ord % 4
  WHEN 0 THEN concat('https://huggingface.co/', organization, '/', entity, '/?tab=1')
  WHEN 1 THEN concat('https://github.com/', organization, '/', entity, '.git/tree')
  WHEN 2 THEN 'https://huggingface.co/' ELSE NULL END AS url FROM entities""",
}


def needed(text: str, tables: Collection[str] = ()) -> list[str]:
    """Views a text uses, in an order in which they can be defined; those that are ``tables`` already are not among them."""
    wanted: list[str] = []

    def visit(body: str) -> None:
        for name in VIEWS:
            if name not in wanted and name not in tables and re.search(rf"\b{name}\b", body):
                visit(VIEWS[name])
                if name not in wanted:
                    wanted.append(name)

    visit(text)
    return sorted(wanted, key=list(VIEWS).index)


def with_views(text: str, keyword: str = "", tables: Collection[str] = ()) -> str:
    """The text with the views it uses in front; the checking engine evaluates each once (``MATERIALIZED``)."""
    names = needed(text, tables)
    if not names:
        return text
    heads = ",\n".join(f"{name} AS {keyword} ({VIEWS[name]})" for name in names)
    body = text.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {heads},\n{body[5:]}"
    return f"WITH {heads}\n{body}"


class Tables:
    """The driver tables of one folder and the views over them, as DataFrames."""

    _schemas: dict[str, StructType] = {}  # of files already seen, so that footers are read once

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._kept: dict[str, DataFrame] = {}

    def _define(self, name: str) -> None:
        path = f"{self.folder}/{name}.parquet"
        if path in self._schemas:
            table = self.spark.read.schema(self._schemas[path]).parquet(path)
        else:
            table = self.spark.read.parquet(path)
            self._schemas[path] = table.schema
        table.createOrReplaceTempView(name)

    def sql(self, text: str) -> DataFrame:
        whole = with_views(text, tables=self._kept)
        for name in BASE_TABLES:
            if re.search(rf"\b{name}\b", whole):
                self._define(name)
        for name, table in self._kept.items():
            table.createOrReplaceTempView(name)
        return self.spark.sql(whole)

    def keep(self, *names: str) -> Tables:
        """Write these views once; what reads them from now on, views included, reads the written tables."""
        from scoreweave.session import cut_lineage

        for name in names:
            if name not in self._kept:
                self._kept[name] = cut_lineage(getattr(self, name))
        return self

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS or name in BASE_TABLES:
            return self.sql(f"SELECT * FROM {name}")
        raise AttributeError(name)

    @cached_property
    def parts(self) -> DataFrame:
        from scoreweave.operators.split import holdout_split
        from scoreweave.session import cut_lineage

        self.keep("scores", "entities")  # the split reads both more than once, and so do most queries after it
        return cut_lineage(holdout_split(self.scores, self.entities, CUTOFF, RATIO, SEED))

    @property
    def held_out(self) -> DataFrame:
        return self.parts.filter("part = 'test'").drop("part")

    @property
    def training(self) -> DataFrame:
        return self.parts.filter("part = 'train'").drop("part")

    @cached_property
    def predicted(self) -> DataFrame:
        """Held-out cells with a plain prediction: ``(entity, item, truth, prediction, uncertainty)``."""
        from scoreweave.operators.factorize import mean_of_means
        from scoreweave.session import cut_lineage

        cells = self.held_out
        spread = self.training.groupBy("item").agg(F.round(F.stddev_pop("score"), 2).alias("uncertainty"))
        guess = mean_of_means(cells.select("entity", "item"), self.training)
        rows = cells.withColumnRenamed("score", "truth").join(guess, ["entity", "item"]).join(spread, "item", "left")
        return cut_lineage(
            rows.select("entity", "item", "truth", F.round("prediction", 2).alias("prediction"), "uncertainty")
        )
