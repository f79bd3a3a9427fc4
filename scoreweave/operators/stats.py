"""Aggregates over scores and dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreweave.functions.fields import first_component
from scoreweave.operators.spread import first_per_key

_MIN_OBSERVATIONS = 3  # items with fewer observations use the statistics of the whole table

# Sub-score names that are bookkeeping.
NOT_SUBCATEGORIES = ("Dir Name", "Final Score")


def item_stats(scores: DataFrame) -> DataFrame:
    """Mean and population deviation per item; the whole table's when fewer than three scores; 0 becomes 1."""
    mean_all = scores.select(F.avg("score")).scalar()
    std_all = scores.select(F.stddev_pop("score")).scalar()
    per_item = scores.groupBy("item").agg(
        F.count("score").alias("n"), F.avg("score").alias("m"), F.stddev_pop("score").alias("s")
    )
    few = F.col("n") < _MIN_OBSERVATIONS
    out = per_item.select(
        "item",
        "n",
        F.when(few, mean_all).otherwise(F.col("m")).alias("mu"),
        F.when(few, std_all).otherwise(F.col("s")).alias("sigma"),
    )
    return out.withColumn("sigma", F.when(F.col("sigma") == 0, F.lit(1.0)).otherwise(F.col("sigma")))


def describe_items(scores: DataFrame) -> DataFrame:
    return scores.groupBy("item").agg(
        F.count("score").alias("n"),
        F.avg("score").alias("mean"),
        F.max("score").alias("max"),
        F.min("score").alias("min"),
        F.stddev_samp("score").alias("std"),
    )


def matrix_summary(parts: dict[str, DataFrame]) -> DataFrame:
    """Entities, items and observations of each named table (train, test, ...)."""
    tagged = [df.select(F.lit(name).alias("part"), "entity", "item") for name, df in parts.items()]
    rows = tagged[0]
    for more in tagged[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy("part").agg(
        F.countDistinct("entity").alias("n_entities"),
        F.countDistinct("item").alias("n_items"),
        F.count(F.lit(1)).alias("n_observations"),
    )


def collect_subcategories(raw: DataFrame) -> DataFrame:
    """Sub-score names per item from ``raw(item, sub_item)``, one row each, without totals and bookkeeping."""
    kept = ~F.col("sub_item").startswith("Overall") & ~F.col("sub_item").isin(*NOT_SUBCATEGORIES)
    return raw.filter(kept).select("item", "sub_item").distinct()


def component_usage(entities: DataFrame, column: str, examples: int = 5) -> DataFrame:
    """Per component: how many entities use it, and the first few by name."""
    used = entities.select(first_component(F.col(column)).alias("component"), "entity").filter("component IS NOT NULL")
    counts = used.groupBy("component").agg(F.count(F.lit(1)).alias("used_by_count"))
    first = (
        first_per_key(used, ["component"], [F.col("entity")], examples)
        .groupBy("component")
        .agg(F.sort_array(F.collect_list("entity")).alias("used_by_examples"))
    )
    return counts.join(first, "component")


def dimension_counts(entities: DataFrame) -> DataFrame:
    """Long table of counts: families per organization, entities per family, coverage of links and components."""
    families = (
        entities.select("organization", "family").distinct().groupBy("organization").agg(F.count(F.lit(1)).alias("n"))
    )
    members = entities.groupBy("family").agg(F.count(F.lit(1)).alias("n"))
    totals = entities.agg(
        F.count(F.lit(1)).alias("entities"),
        F.count_if(F.col("open_source")).alias("open_source"),
        F.count("release_date").alias("release_date"),
        F.countDistinct("language_model").alias("language_models"),
        F.countDistinct("vision_model").alias("vision_models"),
    )
    return (
        families.select(F.lit("families_of").alias("kind"), F.col("organization").alias("name"), "n")
        .unionByName(members.select(F.lit("entities_of").alias("kind"), F.col("family").alias("name"), "n"))
        .unionByName(
            totals.unpivot([], totals.columns, "name", "n").select(F.lit("total").alias("kind"), "name", "n")
        )
    )


def category_domain(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct values with a dense index from 0; the domain may be of any size."""
    from scoreweave.operators.spread import ranked

    values = df.select(F.col(column).alias("value")).filter("value IS NOT NULL").distinct()
    return ranked(values, [], [F.col("value")], "idx").withColumn("idx", F.col("idx") - 1)
