"""Dimension documents: trees of organizations, families and entities; items; components; stored replies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreweave.functions.fields import digits_only, parse_parameters

_ENTITY = (
    "STRUCT<parameters: STRING, language_model: STRING, vision_model: STRING, release_date: STRING, "
    "open_source: BOOLEAN, main_url: STRING, huggingface: STRING, arxiv: STRING, technical_summary: STRING, "
    "sentiment_score: DOUBLE>"
)
_FAMILY = (
    "STRUCT<intro_url: STRING, technical_summary: STRING, sentiment_score: DOUBLE, hype_level: STRING, "
    "positive_aspects: ARRAY<STRING>, negative_aspects: ARRAY<STRING>, community_summary: STRING, "
    f"web_mentions_count: INT, models: MAP<STRING, {_ENTITY}>>"
)
TREE_SCHEMA = f"organizations MAP<STRING, STRUCT<families: MAP<STRING, {_FAMILY}>>>"
FEATURES_SCHEMA = f"model_families MAP<STRING, STRUCT<organization: STRING, models: MAP<STRING, {_ENTITY}>>>"
ITEMS_SCHEMA = (
    "benchmarks MAP<STRING, STRUCT<task: STRING, category: STRING, evaluation_metric: STRING, num_samples: STRING, "
    "difficulty: STRING, subcategories: ARRAY<STRING>, subcategory_descriptions: MAP<STRING, STRING>>>"
)
COMPONENTS_SCHEMA = (
    "components MAP<STRING, STRUCT<type: STRING, organization: STRING, parameters: STRING, architecture: STRING, "
    "key_features: ARRAY<STRING>, summary: STRING, huggingface: STRING, used_by_count: INT, "
    "used_by_examples: ARRAY<STRING>>>"
)


def _families(docs: DataFrame) -> DataFrame:
    tree = docs.select(F.from_json("doc", TREE_SCHEMA).alias("d"))
    orgs = tree.select(F.explode("d.organizations").alias("organization", "o"))
    return orgs.select("organization", F.explode("o.families").alias("family", "f"))


def read_tree_families(docs: DataFrame) -> DataFrame:
    columns = [
        "intro_url", "technical_summary", "sentiment_score", "hype_level", "positive_aspects", "negative_aspects",
        "community_summary", "web_mentions_count",
    ]
    return _families(docs).select("organization", "family", *[f"f.{c}" for c in columns]).distinct()


def read_tree_entities(docs: DataFrame) -> DataFrame:
    """Entities of the tree. A tree may be spread over many documents (pages of a family, for instance)."""
    rows = _families(docs).select("organization", "family", F.explode("f.models").alias("entity", "m"))
    return rows.select("organization", "family", "entity", "m.*")


def tree_counts(docs: DataFrame) -> DataFrame:
    return _families(docs).agg(
        F.countDistinct("organization").alias("n_organizations"),
        F.countDistinct("organization", "family").alias("n_families"),
    )


def read_entity_features(docs: DataFrame) -> DataFrame:
    """Feature rows per entity: family and its organization, size, openness as 0/1, sentiment 0.5 if missing."""
    tree = docs.select(F.from_json("doc", FEATURES_SCHEMA).alias("d"))
    families = tree.select(F.explode("d.model_families").alias("family", "f"))
    rows = families.select(
        "family", F.coalesce("f.organization", F.lit("Unknown")).alias("organization"), F.explode("f.models").alias("entity", "m")
    )
    return rows.select(
        "entity",
        "family",
        "organization",
        parse_parameters(F.col("m.parameters")).alias("parameters"),
        F.when(F.col("m.open_source"), 1.0).otherwise(0.0).alias("open_source"),
        F.coalesce("m.sentiment_score", F.lit(0.5)).alias("sentiment_score"),
    )


def read_item_features(docs: DataFrame) -> DataFrame:
    tree = docs.select(F.from_json("doc", ITEMS_SCHEMA).alias("d"))
    rows = tree.select(F.explode("d.benchmarks").alias("item", "b"))
    return rows.select(
        "item",
        "b.task",
        F.coalesce("b.category", F.lit("unknown")).alias("category"),
        "b.evaluation_metric",
        digits_only(F.col("b.num_samples")).alias("num_samples"),
        "b.difficulty",
        "b.subcategories",
        "b.subcategory_descriptions",
        F.size(F.coalesce("b.subcategories", F.array().cast("array<string>"))).alias("n_subcategories"),
    )


def read_components(docs: DataFrame, kind: str) -> DataFrame:
    tree = docs.select(F.from_json("doc", COMPONENTS_SCHEMA).alias("d"))
    rows = tree.select(F.explode("d.components").alias("component", "c"))
    return rows.select("component", F.lit(kind).alias("kind"), "c.*")


def search_hits(replies: DataFrame) -> DataFrame:
    """Rows ``(subject, position, title, snippet, url)`` of stored search replies ``(subject, doc)``."""
    parsed = replies.select(
        "subject", F.from_json("doc", "items ARRAY<STRUCT<title: STRING, snippet: STRING, link: STRING>>").alias("d")
    )
    rows = parsed.select("subject", F.posexplode("d.items").alias("position", "i"))
    empty = F.lit("")
    return rows.select(
        "subject",
        "position",
        F.coalesce("i.title", empty).alias("title"),
        F.coalesce("i.snippet", empty).alias("snippet"),
        F.coalesce("i.link", empty).alias("url"),
    )


def discussion_hits(replies: DataFrame, at_most: int | None = None, text_limit: int | None = None) -> DataFrame:
    """Discussions of stored replies ``(subject, doc)``; the first ``at_most``, and texts cut, only if asked for."""
    parsed = replies.select(
        "subject",
        F.from_json("doc", "discussions ARRAY<STRUCT<title: STRING, content: STRING, status: STRING>>").alias("d"),
    )
    rows = parsed.select("subject", F.posexplode(F.col("d.discussions") if at_most is None else F.slice("d.discussions", 1, at_most)).alias("position", "i"))
    empty = F.lit("")
    return rows.select(
        "subject",
        "position",
        F.coalesce("i.title", empty).alias("title"),
        F.coalesce(F.col("i.content") if text_limit is None else F.substring("i.content", 1, text_limit), empty).alias("text"),
        F.coalesce("i.status", empty).alias("status"),
        F.lit("huggingface").alias("source"),
    )


def paper_feed(replies: DataFrame) -> DataFrame:
    """Title and abstract of stored paper feeds ``(subject, doc)``, line ends as blanks."""

    def field(name):
        found = F.xpath_string("doc", F.lit(f"/*[local-name()='feed']/*[local-name()='entry'][1]/*[local-name()='{name}']"))
        return F.replace(F.trim(found), F.lit("\n"), F.lit(" "))

    return replies.select("subject", field("title").alias("title"), field("summary").alias("abstract"))
