"""Prediction quality: error and rank metrics over ``results(entity, item, truth, prediction)``.

Scores are pooled over all cells. Ranks come from range-partitioned positions, so neither the pooled ranks
nor those of a hot item need one task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreweave.functions.fields import to_percent, with_range
from scoreweave.operators.spread import ranked, running_sums
from scoreweave.session import cut_lineage

_BLOCK = 200_000  # rows of one block of positions in the count of discordant pairs
HIGHER_IS_BETTER = ("srcc", "krcc", "mae3")
METRICS = ("mae", "rmse", "srcc", "krcc", "mae3", "n_samples", "n_items", "n_entities")


def errors(results: DataFrame, ranges: DataFrame) -> DataFrame:
    """One row: ``mae`` and ``rmse`` on the 0 to 100 scale of each item."""
    on = with_range(results, ranges)
    d = to_percent(F.col("prediction"), F.col("lo"), F.col("hi")) - to_percent(F.col("truth"), F.col("lo"), F.col("hi"))
    return on.select(d.alias("d")).agg(F.avg(F.abs("d")).alias("mae"), F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rmse"))


def masked_rmse(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """RMSE over the cells of ``truth(entity, item, score)``, on the scale of the scores."""
    both = truth.join(predictions.select("entity", "item", "prediction"), ["entity", "item"])
    d = F.col("prediction") - F.col("score")
    return both.agg(F.sqrt(F.avg(d * d)).alias("rmse"))


def pooled_positions(results: DataFrame) -> DataFrame:
    """Positions by prediction and by truth: ``px`` and ``py`` number the rows without ties (each breaks its
    ties by the other value, then by cell)."""
    cell = [F.col("entity"), F.col("item")]
    rows = results.select("entity", "item", "prediction", "truth")
    x = ranked(rows, [], [F.col("prediction"), F.col("truth"), *cell], "px").drop("entity", "item")
    y = ranked(x, [], [F.col("truth"), F.col("px")], "py")  # among equal truths px is the order by prediction and cell
    return cut_lineage(y)  # several aggregates read the positions


def value_ranks(results: DataFrame) -> DataFrame:
    """``(side, value, c, rank)``: per distinct value of ``prediction`` (side x) and ``truth`` (side y) its number of rows
    and their average rank.

    Rows are counted by value before anything is ordered; then the distinct values of both sides are numbered in one
    range partitioning. A frequent value is one row.
    """
    each = F.array(F.struct(F.lit("x").alias("side"), F.col("prediction").alias("value")), F.struct(F.lit("y").alias("side"), F.col("truth").alias("value")))
    counts = results.select(F.explode(each).alias("v")).groupBy("v.side", "v.value").agg(F.count(F.lit(1)).alias("c"))
    upto = running_sums(counts, ["side"], [F.col("value")], {"upto": F.col("c")})
    return upto.select("side", "value", "c", (F.col("upto") - (F.col("c") - 1) / 2).alias("rank"))


def srcc(results: DataFrame) -> DataFrame:
    """Spearman correlation: that of the average ranks, from the distinct pairs of values. Rows without a prediction or
    a truth don't count; null where one side has a single value."""
    pairs = results.filter("prediction IS NOT NULL AND truth IS NOT NULL").select("prediction", "truth")
    ranks = cut_lineage(value_ranks(pairs))
    side = lambda s, c, r: ranks.filter(F.col("side") == s).select(F.col("value").alias(c), F.col("rank").alias(r))
    rows = pairs.groupBy("prediction", "truth").agg(F.count(F.lit(1)).alias("c"))
    rows = rows.join(side("x", "prediction", "rx"), "prediction").join(side("y", "truth", "ry"), "truth")
    middle = (ranks.filter("side = 'x'").select(F.sum("c")).scalar() + 1) / 2  # the mean of all ranks
    x, y, c = F.col("rx") - middle, F.col("ry") - middle, F.col("c")
    sums = rows.agg(F.sum(c * x * y).alias("xy"), F.sum(c * x * x).alias("xx"), F.sum(c * y * y).alias("yy"))
    return sums.select(F.try_divide("xy", F.sqrt(F.col("xx") * F.col("yy"))).alias("srcc"))


def _inversions(order: np.ndarray) -> int:
    """Pairs of distinct numbers that stand in descending order, one bit of the rank at a time."""
    rank = np.argsort(np.argsort(order, kind="stable"), kind="stable")
    count = 0
    for bit in range(max(len(rank) - 1, 0).bit_length() - 1, -1, -1):
        prefix, ones = rank >> (bit + 1), (rank >> bit) & 1
        seen = np.cumsum(ones)
        starts = np.flatnonzero(np.r_[True, prefix[1:] != prefix[:-1]])
        base = np.repeat(np.r_[0, seen[starts[1:] - 1]], np.diff(np.r_[starts, len(rank)]))
        count += int(((seen - base)[ones == 0]).sum())
        rank = rank[np.argsort(rank >> bit, kind="stable")]
    return count


def discordant_pairs(positions: DataFrame, block: int | None = None) -> DataFrame:
    """One row ``discordant``: pairs whose order by ``px`` and by ``py`` differ.

    Both positions are cut into blocks of equal length. Pairs in different blocks on both sides are counted
    from the table of block sizes; pairs that share a block are counted inside that block, whose length is
    fixed (at most the square root of all rows beyond 200,000), so no task grows with ties or hot values.
    """
    rows = positions.select("px", "py")
    n = rows.count()
    size = block or max(_BLOCK, math.isqrt(n) + 1)
    blocks = max(1, -(-n // size))
    cell = rows.select(
        "px", "py", F.expr(f"(px - 1) div {size}").alias("a"), F.expr(f"(py - 1) div {size}").alias("b")
    )

    def inside_a(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"d": [_inversions(pdf.sort_values("px")["py"].to_numpy())]})

    def inside_b(pdf: pd.DataFrame) -> pd.DataFrame:  # rows sharing both blocks ascend, so only others count
        return pd.DataFrame({"d": [_inversions(pdf.sort_values(["a", "py"])["py"].to_numpy())]})

    parts = cell.groupBy("a").applyInPandas(inside_a, "d long")
    if blocks > 1:
        parts = parts.unionByName(cell.groupBy("b").applyInPandas(inside_b, "d long"))
        grid = rows.sparkSession.range(blocks * blocks).select(
            F.expr(f"id div {blocks}").alias("a"), F.expr(f"id % {blocks}").alias("b")
        )
        filled = grid.join(cell.groupBy("a", "b").count(), ["a", "b"], "left").fillna(0, ["count"])
        earlier = Window.partitionBy("b").orderBy("a").rowsBetween(Window.unboundedPreceding, -1)
        later = Window.partitionBy("a").orderBy(F.col("b").desc()).rowsBetween(Window.unboundedPreceding, -1)
        filled = filled.withColumn("left", F.sum("count").over(earlier))
        filled = filled.withColumn("above", F.sum("left").over(later))
        parts = parts.unionByName(filled.select((F.col("count") * F.coalesce("above", F.lit(0))).alias("d")))
    return parts.agg(F.coalesce(F.sum("d"), F.lit(0).cast("long")).alias("discordant"))


def krcc(positions: DataFrame, block: int | None = None) -> DataFrame:
    """Kendall tau-b: concordant less discordant pairs over the pairs not tied on either side."""

    def tied(*values: str) -> Column:
        """Pairs of rows that agree in the values."""
        counts = positions.groupBy(*values).agg(F.count(F.lit(1)).cast("double").alias("c"))
        return counts.agg(F.coalesce(F.sum(F.col("c") * (F.col("c") - 1) / 2), F.lit(0.0))).scalar()

    all_pairs = positions.agg((F.count(F.lit(1)).cast("double") * (F.count(F.lit(1)) - 1) / 2)).scalar()
    ties = {"n0": all_pairs, "n1": tied("prediction"), "n2": tied("truth"), "n3": tied("prediction", "truth")}
    n0, n1, n2, n3 = (F.col(c) for c in ties)
    counts = discordant_pairs(positions, block).select(F.col("discordant").cast("double").alias("d"), *[c.alias(n) for n, c in ties.items()])
    concordant = n0 - n1 - n2 + n3 - F.col("d")
    return counts.select(F.try_divide(concordant - F.col("d"), F.sqrt((n0 - n1) * (n0 - n2))).alias("krcc"))


def item_ranks(results: DataFrame) -> DataFrame:
    """Ordinal ranks per item, best first, by prediction and by truth; ties go to the entity name."""
    rows = results.select("entity", "item", "prediction", "truth")
    one = ranked(rows, ["item"], [F.col("prediction").desc(), F.col("entity")], "prediction_rank", total="n")
    return ranked(one, ["item"], [F.col("truth").desc(), F.col("entity")], "true_rank")


def mae_at_3(results: DataFrame) -> DataFrame:
    """Share of cells, over items with two cells or more, whose ranks differ by at most three; 0 if none."""
    near = F.when(F.abs(F.col("prediction_rank") - F.col("true_rank")) <= 3, 1.0).otherwise(0.0)
    return item_ranks(results).filter("n >= 2").agg(F.coalesce(F.avg(near), F.lit(0.0)).alias("mae3"))


def metrics_long(results: DataFrame, ranges: DataFrame) -> DataFrame:
    """``(metric, value)`` rows of the full report."""
    results = cut_lineage(results.select("entity", "item", "truth", "prediction"))
    positions = pooled_positions(results)  # for the count of discordant pairs only
    counts = results.agg(
        F.count(F.lit(1)).cast("double").alias("n_samples"),
        F.countDistinct("item").cast("double").alias("n_items"),
        F.countDistinct("entity").cast("double").alias("n_entities"),
    )
    out = None
    for table in (errors(results, ranges), srcc(results), krcc(positions), mae_at_3(results), counts):
        part = table.unpivot([], table.columns, "metric", "value")
        out = part if out is None else out.unionByName(part)
    return out


def metrics_report(results: DataFrame, ranges: DataFrame, empty: float | None = 0.0) -> DataFrame:
    """The report as one row; on empty input the metrics are ``empty`` (0, or null for none)."""
    wide = metrics_long(results, ranges).groupBy().pivot("metric", list(METRICS)).agg(F.first("value"))
    wide = wide.select(*[F.coalesce(m, F.lit(0.0)).alias(m) if m.startswith("n_") else m for m in METRICS])
    fill = F.lit(empty).cast("double")
    return wide.select(*[m if m.startswith("n_") else F.when(F.col("n_samples") == 0, fill).otherwise(F.col(m)).alias(m) for m in METRICS])


def improvement(base: DataFrame, new: DataFrame) -> DataFrame:
    """Percent gain per metric from two long reports; positive is better, 0 when the base is 0."""
    names = [m for m in METRICS if not m.startswith("n_")]
    both = base.filter(F.col("metric").isin(*names)).select("metric", F.col("value").alias("base"))
    both = both.join(new.select("metric", F.col("value").alias("new")), "metric")
    sign = F.when(F.col("metric").isin(*HIGHER_IS_BETTER), 1.0).otherwise(-1.0)
    gain = sign * (F.col("new") - F.col("base")) / F.abs("base") * 100
    return both.withColumn("gain", F.when(F.abs("base") < 1e-9, F.lit(0.0)).otherwise(gain))


def direction_distribution(results: DataFrame) -> DataFrame:
    """Count and share of adjustments up, down and kept."""
    kept = results.filter(F.col("direction").isin("up", "down", "keep"))
    total = kept.agg(F.count(F.lit(1))).scalar()
    return kept.groupBy("direction").agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.col("n") * 100.0 / total)
