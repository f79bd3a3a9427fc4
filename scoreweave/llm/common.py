"""What several operators of this subpackage share."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreweave.session import new_table_path

#: White space of the word rule: space, and tab to carriage return.
SPACES = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` computed once per row, whatever the optimizer inlines."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def filled(text: str | Column) -> Column:
    """A null text has no characters."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: str | Column) -> Column:
    """The words of a text: what white space separates."""
    return F.filter(F.split(filled(text), SPACES), lambda w: w != "")


def text_key(text: str | Column) -> Column:
    """16 bytes that name a text; null and empty texts share theirs."""
    return F.unhex(F.md5(filled(text).cast("binary")))


def span_list(spans: Column) -> Column:
    """``kind:start:end`` of spans ``(start, place, end, kind)``, comma-joined in their order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def matches(text: Column, pattern: str, group: str | None = None) -> Column:
    """Leftmost non-overlapping matches as ``(start, end, word)``, in code points, end exclusive.

    Spark's regular expressions return the matched words only; the pieces between them, from ``split`` with the
    same pattern, give their places. ``pattern`` has no capturing group and never matches the empty string.
    ``group`` is the same pattern with one group: its words are added as ``part``.
    """

    def placed(found: Column, gaps: Column, parts: Column | None) -> Column:
        lengths = F.transform(found, lambda w, i: F.length(F.get(gaps, i)) + F.length(w))

        def one(ends: Column):
            def row(w: Column, i: Column) -> Column:
                columns = [(F.get(ends, i) - F.length(w)).alias("start"), F.get(ends, i).alias("end"), w.alias("word")]
                return F.struct(*columns, *([F.get(parts, i).alias("part")] if parts is not None else []))

            return row

        return let(running(lengths), lambda ends: F.transform(found, one(ends)))

    def located(found: Column) -> Column:
        if group is None:
            return let(F.split(text, pattern), lambda gaps: placed(found, gaps, None))
        pair = F.struct(F.split(text, pattern).alias("gaps"), F.regexp_extract_all(text, F.lit(group), F.lit(1)).alias("parts"))
        return let(pair, lambda x: placed(found, x["gaps"], x["parts"]))

    return let(F.regexp_extract_all(text, F.lit("(" + pattern + ")"), F.lit(1)), located)


def running(values: Column, block: int = 256) -> Column:
    """Running sums of an array of ints, block by block, so that long arrays aren't copied once per element."""

    def plain(part: Column) -> Column:
        start = F.struct(F.lit(0).alias("total"), F.array().cast("array<int>").alias("sums"))
        return F.aggregate(
            part,
            start,
            lambda a, v: F.struct((a["total"] + v).alias("total"), F.concat(a["sums"], F.array(a["total"] + v)).alias("sums")),
            lambda a: a["sums"],
        )

    def joined(parts: Column) -> Column:
        totals = plain(F.transform(parts, lambda p: F.element_at(p, -1)))
        shifted = lambda sums: F.flatten(
            F.transform(parts, lambda p, k: F.transform(p, lambda v: v + F.when(k > 0, F.get(sums, k - 1)).otherwise(0)))
        )
        return let(totals, shifted)

    def blocks(v: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / F.lit(block)).cast("int"))
        return let(F.transform(numbers, lambda k: plain(F.slice(v, k * block + 1, F.lit(block)))), joined)

    return let(values, lambda v: F.when(F.size(v) <= block, plain(v)).otherwise(blocks(v)))


def few_at_once(column: pa.Array, few: int = 256) -> Iterator:
    """The values of a column, few of them as Python objects at a time: a batch may hold 10,000 texts."""
    for k in range(0, len(column), few):
        yield from column.slice(k, few).to_pylist()


def tasks_find_library(spark: SparkSession) -> None:
    """Let Python tasks import this library from where the driver has it, whatever folder the driver started in."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def scratch(df: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """``df`` written to the shared folder and read back, and what deletes it when no later job needs it."""
    spark, path = df.sparkSession, new_table_path(df.sparkSession, "scratch")
    df.write.parquet(path)

    def forget() -> None:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)

    return spark.read.schema(df.schema).parquet(path), forget
