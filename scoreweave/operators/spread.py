"""Positions, running counts and tie spans of groups that may be too big for one task.

``Window.partitionBy(key)`` sends a whole key to one task. Here rows are range-partitioned on
(key, order) instead, so a hot key is cut over many partitions; each partition numbers its own rows,
and a table with one row per (key, partition) carries the offsets. The numbered rows are checkpointed
once, because range bounds come from a sample and must not change between the two passes.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreweave.session import cut_lineage

_LOCAL_BITS = 33  # monotonically_increasing_id: partition in the upper bits, position in the lower 33


def _numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    sort = [F.col(k).asc() for k in keys] + list(order)
    rows = df.repartitionByRange(*sort).sortWithinPartitions(*sort)
    rows = cut_lineage(rows.withColumn("_pos", F.monotonically_increasing_id()))
    return rows.withColumn("_part", F.shiftright("_pos", _LOCAL_BITS))


def _before(keys: Sequence[str]):
    return Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)


def _whole(keys: Sequence[str]):
    return Window.partitionBy(*(keys or [F.lit(0)]))


def ranked(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    rank: str = "rank",
    total: str | None = None,
    ties: tuple[str, str, str] | None = None,
) -> DataFrame:
    """Add the 1-based position of each row within ``keys`` under ``order`` (keys must not be null).

    ``total`` names an extra column with the group size. ``ties=(value, first, last)`` adds the lowest and
    highest position held by rows of the same group with an equal ``value``; ``value`` must lead ``order``.
    """
    keys = list(keys)
    rows = _numbered(df, keys, order)
    spans = rows.groupBy(*keys, "_part").agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_n"))
    offset = F.coalesce(F.sum("_n").over(_before(keys)), F.lit(0)) - F.col("_first") + 1
    columns = [*keys, "_part", offset.alias("_offset")]
    if total:
        columns.append(F.sum("_n").over(_whole(keys)).alias(total))
    spans = spans.select(*columns)
    # Without keys there is one row per partition.
    out = rows.join(spans if keys else F.broadcast(spans), [*keys, "_part"])
    out = out.withColumn(rank, F.col("_pos") + F.col("_offset"))
    if ties:
        value, first, last = ties
        group = [*keys, value]
        edges = out.groupBy(*group, "_part").agg(F.min(rank).alias(first), F.max(rank).alias(last))
        same = Window.partitionBy(*group)
        edges = edges.select(
            *group, "_part", F.min(first).over(same).alias(first), F.max(last).over(same).alias(last)
        )
        out = out.join(edges, [*group, "_part"])
    return out.drop("_pos", "_part", "_offset")


def running_counts(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], counts: Mapping[str, Column]
) -> DataFrame:
    """Add, per name in ``counts``, how many rows up to and including this one satisfy the condition."""
    return running_sums(df, keys, order, {name: F.when(c, 1).otherwise(0) for name, c in counts.items()})


def running_sums(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], sums: Mapping[str, Column]
) -> DataFrame:
    """Add, per name in ``sums``, the sum of a whole number over the rows up to and including this one."""
    keys = list(keys)
    rows = _numbered(df, keys, order)
    flags = {name: number.cast("long") for name, number in sums.items()}
    sums = rows.groupBy(*keys, "_part").agg(*[F.sum(flag).alias(f"_s_{name}") for name, flag in flags.items()])
    carried = sums.select(
        *keys, "_part", *[F.coalesce(F.sum(f"_s_{n}").over(_before(keys)), F.lit(0)).alias(f"_b_{n}") for n in flags]
    )
    within = Window.partitionBy(*keys, "_part").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.select("*", *[F.sum(flag).over(within).alias(f"_w_{n}") for n, flag in flags.items()])
    out = out.join(carried, [*keys, "_part"])
    for n in flags:
        out = out.withColumn(n, F.col(f"_w_{n}") + F.col(f"_b_{n}")).drop(f"_w_{n}", f"_b_{n}")
    return out.drop("_pos", "_part")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1) -> DataFrame:
    """The first ``k`` rows per key. Spark limits each group before the shuffle, so a hot key stays small."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).filter(F.col("_place") <= k).drop("_place")
