"""Hold-out, batches, resume."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreweave.functions.fields import is_recent
from scoreweave.operators.spread import ranked


def holdout_split(scores: DataFrame, entities: DataFrame, cutoff: str, ratio: float = 0.4, seed: int = 42) -> DataFrame:
    """Add ``part``: for recent entities, ``max(1, floor(n * ratio))`` of their scores are ``test``.

    The draw is a hash of (seed, entity, item), so it does not depend on partitioning. Scores of old
    entities, and of entities without a release date, are ``train``. A repeated row of ``entities`` changes nothing.
    """
    recent = entities.filter(is_recent(F.col("release_date"), cutoff)).select("entity", F.lit(True).alias("recent")).distinct()
    flagged = scores.join(recent, "entity", "left")
    old = flagged.filter("recent IS NULL").select("entity", "item", "score", F.lit("train").alias("part"))
    lot = F.md5(F.concat_ws(":", F.lit(str(seed)), "entity", "item").cast("binary"))
    drawn = ranked(flagged.filter("recent"), ["entity"], [lot, F.col("item")], "rank", total="n")
    quota = F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(ratio)).cast("int"))
    part = F.when(F.col("rank") <= quota, "test").otherwise("train")
    return old.unionByName(drawn.select("entity", "item", "score", part.alias("part")))


def align_targets(test: DataFrame, train: DataFrame) -> DataFrame:
    """Test cells of entities that occur in train."""
    return test.join(train.select("entity").distinct(), "entity", "left_semi")


def batch_slice(targets: DataFrame, total: int, max_samples: int | None = None) -> DataFrame:
    """Add ``batch``: contiguous slices, in order of (entity, item), of ``ceil(n / total)`` targets each."""
    rows = ranked(targets, [], [F.col("entity"), F.col("item")], "rank", total="n")
    if max_samples:
        rows = rows.filter(F.col("rank") <= max_samples).withColumn("n", F.least("n", F.lit(max_samples)))
    size = F.ceil(F.col("n") / F.lit(total))
    return rows.withColumn("batch", F.floor((F.col("rank") - 1) / size).cast("int")).drop("rank", "n")


def resume(targets: DataFrame, done: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Targets whose key is not among the finished ones."""
    keys = keys or ["entity", "item"]
    return targets.join(done.select(*keys).distinct(), keys, "left_anti")


def described(dimension: DataFrame, summary: str, longer_than: int = 0) -> DataFrame:
    """Rows that already have a summary, for ``resume`` over families or components."""
    return dimension.filter(F.length(summary) > longer_than)
