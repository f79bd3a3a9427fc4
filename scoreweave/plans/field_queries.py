"""Projections, filters, buckets, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoreweave.functions import fields
from scoreweave.operators import dimensions, matching, split, stats
from scoreweave.operators.spread import first_per_key
from scoreweave.plans.registry import query, rounded
from scoreweave.plans.views import CUTOFF


@query(
    "P1_parse_parameters",
    "SELECT entity, coalesce(try_cast(nullif(regexp_extract(parameters, '([0-9.]+)', 1), '') AS DOUBLE), 0.0) AS size FROM entities",
)
def _(t):
    return t.entities.select("entity", fields.parse_parameters(F.col("parameters")).alias("size"))


@query(
    "P2_parse_size_billion",
    """SELECT entity, round(CASE WHEN parameters LIKE '%M' THEN try_cast(replace(parameters, 'M', '') AS DOUBLE) / 1000
    ELSE try_cast(replace(parameters, 'B', '') AS DOUBLE) END, 6) AS size FROM entities""",
)
def _(t):
    return t.entities.select("entity", rounded(fields.parse_size_billion(F.col("parameters"))).alias("size"))


@query(
    "P3_parse_year_month",
    """SELECT entity, CAST(substr(release_date, 1, 4) AS INT) AS year, CAST(substr(release_date, 6, 2) AS INT) AS month FROM entities""",
)
def _(t):
    return t.entities.select("entity", fields.year_month(F.col("release_date")).alias("m")).select("entity", "m.year", "m.month")


@query("P4_is_recent", "SELECT entity, coalesce(release_date >= '2001/07', false) AS recent FROM entities")
def _(t):
    return t.entities.select("entity", fields.is_recent(F.col("release_date"), CUTOFF).alias("recent"))


@query("P5_digits_only", "SELECT item, CAST(num_samples AS BIGINT) AS n FROM items")
def _(t):
    text = F.concat(F.lit("ca. "), F.col("num_samples").cast("string"), F.lit(" samples"))
    return t.items.select("item", fields.digits_only(text).alias("n"))


_PERCENT = """SELECT s.entity, s.item, round(greatest(0, least(100, (s.score - coalesce(r.lo, 0)) / (coalesce(r.hi, 100) - coalesce(r.lo, 0)) * 100)), 6) AS percent
FROM scores s LEFT JOIN ranges r ON s.item = r.item"""


@query("P6_normalize_to_100", _PERCENT)
def _(t):
    rows = fields.with_range(t.scores, t.ranges)
    return rows.select("entity", "item", rounded(fields.to_percent(F.col("score"), F.col("lo"), F.col("hi"))).alias("percent"))


@query(
    "P7_denormalize",
    """SELECT p.entity, p.item, r.item IS NOT NULL AS own_range,
    round(prediction / 100 * (coalesce(hi, 100) - coalesce(lo, 0)) + coalesce(lo, 0), 6) AS score,
    round(uncertainty / (coalesce(hi, 100) - coalesce(lo, 0)) * 100, 6) AS uncertainty
    FROM predictions p LEFT JOIN ranges r ON p.item = r.item""",
)
def _(t):
    rows = fields.with_range(t.predicted, t.ranges)
    lo, hi = F.col("lo"), F.col("hi")
    return rows.select(
        "entity", "item", "own_range",
        rounded(fields.from_percent(F.col("prediction"), lo, hi)).alias("score"),
        rounded(F.col("uncertainty") / (hi - lo) * 100).alias("uncertainty"),
    )


@query(
    "P8_drop_empty_fields",
    """SELECT entity, field, value FROM (
      SELECT entity, 'release_date' AS field, release_date AS value FROM entities
      UNION ALL SELECT entity, 'open_source', CASE WHEN open_source THEN 'true' END FROM entities
      UNION ALL SELECT entity, 'rest', CASE WHEN ord % 5 <> 0 THEN cast(ord % 5 AS string) END FROM entities) x WHERE value IS NOT NULL""",
)
def _(t):
    rows = t.entities.select("entity", "release_date", "open_source", (F.col("ord") % 5).alias("rest"))
    kept = fields.drop_empty_fields(rows, ["release_date", "open_source", "rest"])
    return rows.select("entity", F.explode(kept).alias("field", "value"))


@query(
    "P9_entity_links",
    """SELECT entity, CASE WHEN opened = 'Yes' AND url LIKE '%huggingface.co/%' THEN nullif(rtrim(split_part(split_part(url, 'huggingface.co/', 2), '?', 1), '/'), '') END AS huggingface,
    CASE WHEN url LIKE '%github.com%' THEN url END AS code_url,
    CASE WHEN opened = 'Yes' AND url LIKE '%huggingface.co/%' AND rtrim(split_part(split_part(url, 'huggingface.co/', 2), '?', 1), '/') <> ''
      THEN concat('https://huggingface.co/', rtrim(split_part(split_part(url, 'huggingface.co/', 2), '?', 1), '/')) END AS main_url FROM links""",
)
def _(t):
    return t.links.select("entity", fields.entity_links(F.col("url"), F.col("opened")).alias("l")).select("entity", "l.*")


@query(
    "P10_readme_raw_url",
    """SELECT l.entity, CASE WHEN url LIKE '%github.com%' THEN concat('https://raw.githubusercontent.com/', e.organization, '/', e.entity, '/main/README.md') END AS readme
    FROM links l JOIN entities e ON l.entity = e.entity""",
)
def _(t):
    return t.links.select("entity", fields.readme_raw_url(F.col("url")).alias("readme"))


@query("P11_family_fallback", "SELECT entity, split_part(family, '-', 1) AS head FROM entities")
def _(t):
    return t.entities.select("entity", fields.family_fallback(F.col("family")).alias("head"))


@query("P12_first_component", "SELECT entity, trim(split_part(language_model, '<br>', 1)) AS component FROM entities")
def _(t):
    rows = t.entities.select("entity", fields.first_component(F.col("language_model")).alias("component"))
    return rows.filter("component IS NOT NULL")


@query(
    "P13_buckets",
    """SELECT c.c_name AS entity, CASE WHEN n < 5 THEN 'low' WHEN n < 20 THEN 'medium' ELSE 'high' END AS hype,
    round(least(n / 30.0, 1.0), 6) AS family_confidence, round(least(n / 50.0, 1.0), 6) AS entity_confidence,
    CASE WHEN days <= 30 THEN 1.0 WHEN days <= 90 THEN 0.75 WHEN days <= 180 THEN 0.5 ELSE 0.25 END::DOUBLE AS decay,
    CASE WHEN n / 30.0 >= 0.7 THEN 'Positive' WHEN n / 30.0 >= 0.4 THEN 'Neutral' ELSE 'Negative' END AS sentiment,
    CASE WHEN (n - 10) / 4.0 > 0.5 THEN 'up' WHEN (n - 10) / 4.0 < -0.5 THEN 'down' ELSE 'keep' END AS direction
    FROM (SELECT o_custkey, count(*) AS n, date_diff('day', max(CAST(o_orderdate AS DATE)), DATE '2001-08-01') AS days FROM orders GROUP BY o_custkey) o
    JOIN customer c ON c.c_custkey = o.o_custkey""",
)
def _(t):
    rows = t.sql("""SELECT c.c_name AS entity, count(*) AS n, max(cast(o_orderdate AS date)) AS last
        FROM orders JOIN customer c ON c_custkey = o_custkey GROUP BY c.c_name""")
    n = F.col("n")
    return rows.select(
        "entity",
        fields.hype_level(n).alias("hype"),
        rounded(fields.mention_confidence(n, 30)).alias("family_confidence"),
        rounded(fields.mention_confidence(n, 50)).alias("entity_confidence"),
        fields.time_decay(F.col("last"), F.lit("2001-08-01").cast("date")).alias("decay"),
        fields.sentiment_label(n / 30).alias("sentiment"),
        fields.direction((n - 10) / 4).alias("direction"),
    )


@query(
    "P14_merge_by_source_priority",
    """SELECT d.doc_id AS subject, CASE WHEN l.doc_id IS NOT NULL THEN concat('q', cast(l.quality AS string)) ELSE d.lang END AS task,
    d.source AS metric FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def _(t):
    rows = t.sql("""
SELECT doc_id AS subject, 1 AS place, concat('q', cast(quality AS string)) AS task, '' AS metric, cast(NULL AS string) AS evaluation_metric FROM labels
UNION ALL SELECT doc_id, 2, lang, source, ' ' FROM documents
UNION ALL SELECT doc_id, 3, 'late', 'late', 'late' FROM documents""")
    return dimensions.merge_by_source_priority(
        rows, "subject", F.col("place"), {"task": ["task"], "metric": ["evaluation_metric", "metric"]}
    )


@query(
    "P15_parse_release_date",
    "SELECT entity, coalesce(CAST(replace(release_date, '/', '-') AS DATE), DATE '2001-08-01' - INTERVAL 30 DAY)::DATE AS released FROM entities",
)
def _(t):
    mixed = F.when(F.col("open_source"), F.replace("release_date", F.lit("/"), F.lit("-"))).otherwise(F.col("release_date"))
    return t.entities.select("entity", fields.parse_release_date(mixed, F.lit("2001-08-01").cast("date")).alias("released"))


@query(
    "P16_entity_profiles",
    """SELECT entity AS id, 'size' AS feature, round(try_cast(regexp_extract(parameters, '([0-9.]+)', 1) AS DOUBLE) / 100, 6) AS value FROM entities
    UNION ALL SELECT entity, concat('organization=', organization), 1.0 FROM entities WHERE open_source""",
)
def _(t):
    known = t.entities.filter("open_source")  # closed ones are "unknown": size from their own row, no organization
    rows = dimensions.entity_profiles(dimensions.profile_fields(t.entities, known))
    return rows.select("id", "feature", rounded("value").alias("value"))


@query(
    "P17_item_profiles",
    """SELECT item AS id, 'samples' AS feature, round(num_samples / 50000.0, 6) AS value FROM items
    UNION ALL SELECT item, 'subcategories', round(n_subcategories / 50.0, 6) FROM items
    UNION ALL SELECT item, concat('category=', category), 1.0 FROM items""",
)
def _(t):
    return dimensions.item_profiles(t.items).select("id", "feature", rounded("value").alias("value"))


_STATS = """SELECT item, count(*) AS n, CASE WHEN count(*) < 3 THEN (SELECT avg(score) FROM scores) ELSE avg(score) END AS mu,
  CASE WHEN count(*) < 3 THEN (SELECT stddev_pop(score) FROM scores) ELSE stddev_pop(score) END AS sigma FROM scores GROUP BY item"""


@query(
    "P18_standardize",
    f"""WITH st AS ({_STATS}) SELECT s.entity, s.item, round((s.score - st.mu) / CASE WHEN st.sigma = 0 THEN 1 ELSE st.sigma END, 5) AS z
    FROM scores s JOIN st ON s.item = st.item""",
)
def _(t):
    rows = t.scores.join(stats.item_stats(t.scores), "item")
    return rows.select("entity", "item", rounded(fields.standardize(F.col("score"), F.col("mu"), F.col("sigma")), 5).alias("z"))


@query("O1_preview", "SELECT entity, organization, parameters FROM entities ORDER BY entity LIMIT 20")
def _(t):
    return dimensions.preview(t.entities, ["entity", "organization", "parameters"])


@query(
    "O2_sort_by_size",
    """SELECT name, coalesce(try_cast(nullif(regexp_extract(name, '(?i)([0-9]+([.][0-9]+)?)\\s*B', 1), '') AS DOUBLE), 0.0) AS size
    FROM (SELECT DISTINCT concat(family, ' ', parameters) AS name FROM entities) x""",
)
def _(t):
    names = t.entities.select(F.concat("family", F.lit(" "), "parameters").alias("name")).distinct()
    return dimensions.sort_by_size(names, "name").select("name", "size")


@query(
    "O3_first_members",
    "SELECT family, entity FROM (SELECT family, entity, row_number() OVER (PARTITION BY family ORDER BY entity) AS rn FROM entities) x WHERE rn <= 5",
)
def _(t):
    return first_per_key(t.entities.select("family", "entity"), ["family"], [F.col("entity")], 5)


@query(
    "O4_best_per_item",
    "SELECT item, entity, score FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, entity) AS rn FROM scores) x WHERE rn = 1",
)
def _(t):
    return first_per_key(t.scores, ["item"], [F.col("score").desc(), F.col("entity")]).select("item", "entity", "score")


@query("U1_union_train", "SELECT entity, item, score FROM train")
def _(t):
    recent = t.entities.filter(fields.is_recent(F.col("release_date"), CUTOFF)).select("entity")
    rest = t.training.join(recent, "entity", "left_semi")
    return t.scores.join(recent, "entity", "left_anti").unionByName(rest).select("entity", "item", "score")


@query("U2_unique_hits", "SELECT source AS subject, lang AS id, min(doc_id) AS position FROM documents WHERE lang <> '' GROUP BY 1, 2")
def _(t):
    return matching.unique_hits(t.documents.select(F.col("source").alias("subject"), F.col("lang").alias("id"), F.col("doc_id").alias("position")))


@query("U3_merge_results", "SELECT entity, item, truth, CASE WHEN item < 'Brand#2' THEN 'earlier' ELSE 'new' END AS run FROM predictions")
def _(t):
    earlier = t.predicted.filter("item < 'Brand#2'").withColumn("run", F.lit("earlier"))
    fresh = split.resume(t.predicted, earlier).withColumn("run", F.lit("new"))
    return earlier.unionByName(fresh).select("entity", "item", "truth", "run")


@query("U4_category_domain", "SELECT category AS value, CAST(row_number() OVER (ORDER BY category) - 1 AS BIGINT) AS idx FROM (SELECT DISTINCT category FROM items) x")
def _(t):
    return stats.category_domain(t.items, "category")
