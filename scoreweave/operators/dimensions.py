"""Entity, family and item dimensions: lookups, trees, source priority, listings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreweave.functions import fields
from scoreweave.functions.layout import Block, Field, rendered
from scoreweave.operators.spread import ranked

_PAGE = 1000  # members in one row of a nested tree; larger families take several rows


def entity_family(names: DataFrame, tree: DataFrame, order: str = "ord") -> DataFrame:
    """Join the tree's row of each entity (organization, family, fields); the first by ``order`` if repeated."""
    others = [c for c in tree.columns if c not in ("entity", order)]
    first = tree.groupBy("entity").agg(F.min_by(F.struct(*others), F.col(order)).alias("info"))
    return names.join(first, "entity", "left").select(*names.columns, "info.*")


def profile_fields(entities: DataFrame, features: DataFrame) -> DataFrame:
    """Size and organization of each entity from the feature table; entities it lacks take the size from
    their own row and no organization."""
    known = features.select(
        "entity",
        fields.parse_parameters(F.col("parameters")).alias("_size"),
        F.coalesce("organization", F.lit("Unknown")).alias("_organization"),
    )
    own = fields.parse_parameters(F.col("parameters"))
    return (
        entities.select("entity", "parameters")
        .join(known, "entity", "left")
        .select("entity", F.coalesce("_size", own).alias("size"), F.col("_organization").alias("organization"))
    )


def entity_profiles(profiled: DataFrame) -> DataFrame:
    """Long feature table ``(id, feature, value)`` of ``(entity, size, organization)``."""
    values = F.array(
        F.struct(F.lit("size").alias("feature"), (F.col("size") / fields.SIZE_SCALE).alias("value")),
        F.struct(F.concat(F.lit("organization="), "organization").alias("feature"), F.lit(1.0).alias("value")),
    )
    out = profiled.select(F.col("entity").alias("id"), F.explode(values).alias("f")).select("id", "f.*")
    return out.filter("feature IS NOT NULL")


def item_profiles(items: DataFrame) -> DataFrame:
    """Long feature table of ``(item, category, num_samples, n_subcategories)``."""
    values = F.array(
        F.struct(F.lit("samples").alias("feature"), (F.col("num_samples") / fields.SAMPLES_SCALE).alias("value")),
        F.struct(
            F.lit("subcategories").alias("feature"),
            (F.col("n_subcategories") / fields.SUBCATEGORY_SCALE).alias("value"),
        ),
        F.struct(
            F.concat(F.lit("category="), F.coalesce("category", F.lit("unknown"))).alias("feature"),
            F.lit(1.0).alias("value"),
        ),
    )
    return items.select(F.col("item").alias("id"), F.explode(values).alias("f")).select("id", "f.*")


def dense_profiles(profiles: DataFrame, features: Sequence[str]) -> DataFrame:
    """Fixed-length vectors ``(id, vec)`` over a given, bounded list of features; unseen values are zeros."""
    at = {name: i for i, name in enumerate(features)}
    index = F.create_map(*[F.lit(x) for pair in at.items() for x in pair])
    pairs = profiles.select("id", F.try_element_at(index, F.col("feature")).alias("i"), "value")
    maps = pairs.groupBy("id").agg(
        F.map_from_entries(F.filter(F.collect_list(F.struct("i", "value")), lambda e: e["i"].isNotNull())).alias("m")
    )
    vec = F.transform(
        F.sequence(F.lit(0), F.lit(len(features) - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))
    )
    return maps.select("id", vec.alias("vec"))


def restrict_to_leaderboard(entities: DataFrame, scores: DataFrame) -> DataFrame:
    """Entities that have a score; families without any such entity vanish with them."""
    return entities.join(scores.select("entity").distinct(), "entity", "left_semi")


def item_subcategories(items: DataFrame, listed: DataFrame, variants: DataFrame, found: DataFrame) -> DataFrame:
    """Sub-score names per item: from the item list, else the list of variants, else the leaderboard itself.
    The three tables are ``(item, subcategories)``; an empty list counts as missing."""
    out = items.select("item")
    for i, table in enumerate((listed, variants, found)):
        filled = table.filter(F.size("subcategories") > 0)
        out = out.join(filled.select("item", F.col("subcategories").alias(f"_{i}")), "item", "left")
    empty = F.array().cast("array<string>")
    return out.select("item", F.coalesce("_0", "_1", "_2", empty).alias("subcategories"))


def merge_by_source_priority(
    rows: DataFrame, key: str, priority: Column, columns: Mapping[str, Sequence[str]]
) -> DataFrame:
    """One row per key; each field comes from the first source that has it non-empty.

    ``columns`` maps a field to the names it may have in a source, preferred name first.
    """
    picked = []
    for name, names in columns.items():
        value = F.coalesce(*[F.when(F.trim(F.col(n).cast("string")) != "", F.col(n)) for n in names])
        picked.append(F.min_by(value, F.when(value.isNotNull(), priority)).alias(name))
    return rows.groupBy(key).agg(*picked)


def build_knowledge_tree(entities: DataFrame, info: Sequence[str], intro_urls: DataFrame | None = None) -> DataFrame:
    """Nested tree, one row per (organization, family, page): the members as a map of structs.

    A page holds at most 1,000 members, so that no row grows with a large family.
    """
    rows = ranked(entities, ["organization", "family"], [F.col("entity")], "rank")
    page = F.floor((F.col("rank") - 1) / _PAGE).cast("int")
    member = F.struct("entity", F.struct(*info).alias("info"))
    tree = (
        rows.withColumn("page", page)
        .groupBy("organization", "family", "page")
        .agg(F.map_from_entries(F.collect_list(member)).alias("models"))
    )
    return tree.join(intro_urls, "family", "left") if intro_urls is not None else tree


def flatten_tree(tree: DataFrame) -> DataFrame:
    """``tree(organization, family, entity, ord, ...)`` with one organization per family, the first seen, and
    one row per (family, entity), the last seen."""
    others = [c for c in tree.columns if c not in ("organization", "family", "entity", "ord")]
    homes = tree.groupBy("family").agg(F.min_by("organization", "ord").alias("organization"))
    last = F.max_by(F.struct(F.col("ord"), *others), F.col("ord"))
    members = tree.groupBy("family", "entity").agg(last.alias("info"))
    return members.join(homes, "family").select("organization", "family", "entity", *[f"info.{c}" for c in others])


def org_entities(entities: DataFrame, organization: str) -> DataFrame:
    return entities.filter(F.lower("organization").contains(organization.lower())).select("entity")


def open_source_entities(entities: DataFrame) -> DataFrame:
    return entities.filter("open_source").select("entity")


def list_families(entities: DataFrame, organization: str | None = None) -> DataFrame:
    if organization:
        entities = entities.filter(F.lower("organization").contains(organization.lower()))
    return entities.groupBy("family", "organization").agg(F.count(F.lit(1)).alias("n_entities"))


def sort_by_size(names: DataFrame, column: str = "entity") -> DataFrame:
    """Sorted by the size in the name, then by name."""
    return names.withColumn("size", fields.name_size(F.col(column))).orderBy("size", column)


def preview(df: DataFrame, columns: Sequence[str], order: str = "entity", n: int = 20) -> DataFrame:
    return df.select(*columns).orderBy(order).limit(n)


#: Default layouts: columns under their own names, related ones together.
ITEM_LAYOUT = (
    Block(("item", "category", "task", "evaluation_metric", "num_samples", "difficulty")), Block(("subcategory_descriptions",)),
    Block(("paper_url", "dataset_url", "links", "summary")),
)
ENTITY_LAYOUT = (
    Block(("entity", "organization", "family", "release_date", "open_source")), Block(("parameters", "language_model", "vision_model")),
    Block(("intro_url", "paper_url", "official_url", "links")), Block(("technical_summary", "community_summary")),
)
FAMILY_LAYOUT = (
    Block(("family", "organization", "n_members", "first_members", "intro_url")), Block(("technical_summary",)),
    Block((Field("sentiment_score", digits=2), "hype_level", "web_mentions_count", "positive_aspects", "negative_aspects", "community_summary")),
)


def item_text(items: DataFrame, layout: Sequence[Block] = ITEM_LAYOUT) -> DataFrame:
    """Readable description per item by the layout; empty fields and columns that are not there are left out."""
    return items.select("item", rendered(items, layout).alias("text"))


def entity_text(entities: DataFrame, layout: Sequence[Block] = ENTITY_LAYOUT, brief: Sequence[str] = ("parameters", "language_model", "vision_model")) -> DataFrame:
    """Description per entity by the layout, and ``brief``, the named columns in one line (empty if they all are)."""
    short = F.concat_ws(", ", *[F.when(F.col(c) != "", F.col(c)) for c in brief])
    return entities.select("entity", short.alias("brief"), rendered(entities, layout).alias("text"))


def family_text(families: DataFrame, entities: DataFrame, layout: Sequence[Block] = FAMILY_LAYOUT, shown: int = 0) -> DataFrame:
    """Description per family by the layout, which may also use ``n_members``, ``hype_level`` (where there are mentions)
    and ``first_members``, the first ``shown`` names. A family without members stays, with none."""
    from scoreweave.operators.spread import first_per_key

    counts = entities.groupBy("family").agg(F.count(F.lit(1)).alias("n_members"))
    out = families.join(counts, "family", "left").withColumn("n_members", F.coalesce("n_members", F.lit(0).cast("long")))
    if shown:
        first = first_per_key(entities.select("family", "entity"), ["family"], [F.col("entity")], shown)
        out = out.join(first.groupBy("family").agg(F.sort_array(F.collect_list("entity")).alias("first_members")), "family", "left")
    if "web_mentions_count" in families.columns:
        out = out.withColumn("hype_level", F.when(F.col("web_mentions_count") > 0, fields.hype_level(F.col("web_mentions_count"))))
    return out.select("family", rendered(out, layout).alias("text"))


def entity_info(names: DataFrame, entities: DataFrame, families: DataFrame) -> DataFrame:
    """All that is known of the entities in ``names(entity)``: their own columns, and those of their family as
    ``family_<column>`` (its introduction, summary, feedback); nulls where nothing is known."""
    own = [c for c in entities.columns if c != "entity"]
    told = [c for c in families.columns if c not in ("family", "organization")]
    known = entities.groupBy("entity").agg(F.first(F.struct(*own)).alias("_own"))
    home = families.groupBy("family").agg(F.first(F.struct(*told)).alias("_home"))
    out = names.select("entity").distinct().join(known, "entity", "left").select("entity", "_own.*").join(home, "family", "left")
    return out.select("entity", *own, *[F.col(f"_home.{c}").alias(f"family_{c}") for c in told])
