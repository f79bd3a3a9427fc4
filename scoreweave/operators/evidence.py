"""Evidence per predicted cell and the corrections taken from replies.

Evidence that all cells of a family share is kept once, keyed by (family, item); a cell carries its family
and summary figures. Pairing every target with every relative would square a large family.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreweave.functions import fields, text
from scoreweave.functions.layout import Block, Field, rendered
from scoreweave.operators.matching import organization_profile
from scoreweave.operators.spread import first_per_key, ranked, running_sums

_PAGE = 1000  # lines in one page of family scores
_MIN_RANKED = 3  # items with fewer scores have no neighbours
_UNKNOWN = "Unknown"


def family_scores(entities: DataFrame, scores: DataFrame) -> DataFrame:
    """Scores of family members: ``(family, item, entity, parameters, score)``."""
    members = entities.select("entity", "family", "parameters")
    return scores.join(members, "entity").select("family", "item", "entity", "parameters", "score")


def sibling_summary(targets: DataFrame, entities: DataFrame, scores: DataFrame) -> DataFrame:
    """Per target: number, mean, lowest and highest of the scores that *other* members of its family have on
    the item. Left-one-out figures come from totals per (family, item), so no pairs are formed."""
    members = family_scores(entities, scores)
    totals = members.groupBy("family", "item").agg(F.count(F.lit(1)).alias("_n"), F.sum("score").alias("_s"))
    low = first_per_key(members, ["family", "item"], [F.col("score"), F.col("entity")], 2)
    high = first_per_key(members, ["family", "item"], [F.col("score").desc(), F.col("entity")], 2)
    low = low.groupBy("family", "item").agg(F.sort_array(F.collect_list(F.struct("score", "entity"))).alias("_low"))
    high = high.groupBy("family", "item").agg(
        F.sort_array(F.collect_list(F.struct("score", "entity")), asc=False).alias("_high")
    )
    own = scores.select("entity", "item", F.col("score").alias("_own"))
    out = targets.join(entities.select("entity", "family"), "entity", "left").join(own, ["entity", "item"], "left")
    out = out.join(totals.join(low, ["family", "item"]).join(high, ["family", "item"]), ["family", "item"], "left")
    n = F.coalesce("_n", F.lit(0)) - F.when(F.col("_own").isNotNull(), 1).otherwise(0)

    def edge(extremes):
        first, second = F.try_element_at(extremes, F.lit(1)), F.try_element_at(extremes, F.lit(2))
        return F.when(first["entity"] == F.col("entity"), second["score"]).otherwise(first["score"])

    return out.select(
        *targets.columns,
        "family",
        n.cast("long").alias("sibling_count"),
        F.when(n > 0, (F.col("_s") - F.coalesce("_own", F.lit(0.0))) / n).alias("sibling_mean"),
        edge(F.col("_low")).alias("sibling_min"),
        edge(F.col("_high")).alias("sibling_max"),
    )


def family_score_pages(entities: DataFrame, scores: DataFrame, ranges: DataFrame) -> DataFrame:
    """Text of the family's scores per (family, item), 0 to 100 with one decimal, in pages of 1,000 lines.

    A target reads the pages of its family and item. It cannot meet itself there: its own score on the item
    is held out.
    """
    rows = fields.with_range(family_scores(entities, scores), ranges)
    percent = fields.to_percent(F.col("score"), F.col("lo"), F.col("hi"))
    size = F.coalesce("parameters", F.lit("N/A"))
    line = F.concat(F.lit("  "), "entity", F.lit(" ("), size, F.lit("): "), fields.fixed(percent, 1))
    rows = ranked(rows.select("family", "item", "entity", line.alias("line")), ["family", "item"], [F.col("entity")])
    page = F.floor((F.col("rank") - 1) / _PAGE).cast("int")
    lines = F.transform(F.sort_array(F.collect_list(F.struct("rank", "line"))), lambda e: e["line"])
    return rows.groupBy("family", "item", page.alias("page")).agg(
        F.count(F.lit(1)).alias("n_lines"), F.concat_ws("\n", lines).alias("text")
    )


HEAD_LAYOUT = (Block(("entity", Field("parameters", empty="unknown"), Field("family", empty="none"), "scored_relatives")),)


def score_matrix_head(targets: DataFrame, entities: DataFrame, scores: DataFrame, layout: Sequence[Block] = HEAD_LAYOUT) -> DataFrame:
    """First lines of the family score table of each target; the pages of its family and item follow them."""
    counts = (
        family_scores(entities, scores).groupBy("family").agg(F.countDistinct("entity").alias("_members"))
    )
    out = targets.join(entities.select("entity", "family", "parameters"), "entity", "left")
    out = out.join(counts, "family", "left")
    own = scores.select("entity", F.lit(1).alias("_scored")).distinct()
    out = out.join(own, "entity", "left")
    others = F.coalesce("_members", F.lit(0)) - F.coalesce("_scored", F.lit(0))
    out = out.withColumn("scored_relatives", others)
    head = rendered(out, layout)
    return out.select(*targets.columns, "family", head.alias("head"))


def family_members(entities: DataFrame, scores: DataFrame) -> DataFrame:
    """``(family, entity, ...)``: every member with its own columns and how many scores it has; targets refer to the rows
    of their family."""
    counts = scores.groupBy("entity").agg(F.count(F.lit(1)).alias("n_scores"))
    members = entities.filter("family IS NOT NULL").join(counts, "entity", "left")
    return members.withColumn("n_scores", F.coalesce("n_scores", F.lit(0).cast("long")))


def member_scores(entities: DataFrame, scores: DataFrame, ranges: DataFrame) -> DataFrame:
    """``(family, entity, item, score, percent)``: the scores of each member on all items, kept once per family."""
    rows = fields.with_range(scores.join(entities.select("entity", "family").filter("family IS NOT NULL"), "entity"), ranges)
    percent = fields.to_percent(F.col("score"), F.col("lo"), F.col("hi"))
    return rows.select("family", "entity", "item", "score", percent.alias("percent"))


def family_evidence(
    targets: DataFrame, entities: DataFrame, scores: DataFrame, families: DataFrame | None = None
) -> DataFrame:
    """Per target: organization, family, family description, member count and the figures of its siblings. The members
    and their scores are tables of their own, keyed by family: ``family_members`` and ``member_scores``."""
    info = entities.select("entity", "organization", "family")
    members = entities.groupBy("family").agg(F.count(F.lit(1)).alias("family_size"))
    out = sibling_summary(targets, entities, scores).drop("family").join(info, "entity", "left")
    out = out.join(members, "family", "left")
    if families is not None:
        described = [c for c in families.columns if c not in ("organization", "family")]
        out = out.join(families.select("family", *described), "family", "left")
    return out


def score_ranks(scores: DataFrame) -> DataFrame:
    """Position of every score on its item, best first (ties by entity), with the best position of its value."""
    return ranked(
        scores.select("item", "entity", "score"),
        ["item"],
        [F.col("score").desc(), F.col("entity")],
        "rank",
        total="n_ranked",
        ties=("score", "best_rank", "_last"),
    ).drop("_last")


def predicted_ranks(targets: DataFrame, ranks: DataFrame) -> DataFrame:
    """Per target ``(entity, item, prediction)``: the rank on its item whose score is nearest to the
    prediction, ties to the better rank. Items with fewer than three scores give no row.

    Only the two scores on either side can be nearest, and their ranks follow from how many scores lie above.
    Equal scores of an item are one mark with a count, so a frequent value is one row.
    """
    known = ranks.filter(F.col("n_ranked") >= _MIN_RANKED)
    none = F.lit(None).cast("string").alias("target")
    marks = known.groupBy("item", F.col("score").alias("value")).agg(F.count(F.lit(1)).alias("times")).withColumn("target", none)
    asked = targets.select("item", F.col("prediction").alias("value"), F.lit(0).cast("long").alias("times"), F.col("entity").alias("target"))
    # A target precedes equal scores, so that those count as "not above".
    order = [F.col("value").desc(), F.col("target").desc_nulls_last()]
    placed = running_sums(marks.unionByName(asked), ["item"], order, {"above": F.col("times")})
    placed = placed.filter("target IS NOT NULL").select("item", F.col("target").alias("entity"), "value", "above")
    sides = placed.withColumn("rank", F.explode(F.array("above", F.col("above") + 1)))
    near = sides.join(known.select("item", "rank", "score", "best_rank", "n_ranked"), ["item", "rank"])
    choice = F.struct(F.abs(F.col("score") - F.col("value")).alias("far"), "best_rank", "n_ranked")
    best = near.groupBy("entity", "item").agg(F.min(choice).alias("b"))
    return best.select("entity", "item", F.col("b.best_rank").alias("predicted_rank"), F.col("b.n_ranked").alias("n_ranked"))


def rank_neighbours(targets: DataFrame, scores: DataFrame, k: int = 4) -> DataFrame:
    """Entities within ``k`` ranks of the rank nearest to the prediction."""
    ranks = score_ranks(scores)
    around = predicted_ranks(targets, ranks)
    low = F.greatest(F.lit(1), F.col("predicted_rank") - k)
    high = F.least(F.col("n_ranked"), F.col("predicted_rank") + k)
    wide = around.withColumn("rank", F.explode(F.sequence(low, high)))
    peers = ranks.select("item", "rank", F.col("entity").alias("peer"), F.col("score").alias("peer_score"))
    return wide.join(peers, ["item", "rank"]).select(
        "entity", "item", "predicted_rank", "n_ranked", "rank", "peer", "peer_score"
    )


def neighbour_details(
    neighbours: DataFrame,
    tree: DataFrame,
    profiles: Sequence[tuple],
    vision_organizations: DataFrame | None = None,
    language_organizations: DataFrame | None = None,
    summary_limit: int | None = None,
) -> DataFrame:
    """Neighbours with organization profile, components, size, date and summary; unknown defaults.

    ``tree(entity, organization, parameters, language_model, vision_model, release_date, technical_summary)``
    is prepared per entity first, then joined once. The two component tables map a component to its maker.
    """
    profile = organization_profile(F.coalesce("organization", F.lit(_UNKNOWN)), profiles)
    info = tree.select("*", profile.alias("_p"))
    for table, column in ((vision_organizations, "vision_model"), (language_organizations, "language_model")):
        name = f"{column}_organization"
        if table is None:
            info = info.withColumn(name, F.lit(_UNKNOWN))
        else:
            made = table.select(F.col("component").alias(column), F.col("organization").alias(name))
            info = info.join(made, column, "left")
    info = info.withColumnRenamed("entity", "peer")

    def known(c):
        return F.coalesce(c, F.lit(_UNKNOWN)).alias(c)

    summary = F.col("technical_summary")
    return neighbours.join(info, "peer", "left").select(
        *neighbours.columns,
        known("organization"),
        F.coalesce("_p.region", F.lit(_UNKNOWN)).alias("region"),
        F.coalesce("_p.size", F.lit("small")).alias("organization_size"),
        F.coalesce("_p.local_focus", F.lit(False)).alias("local_focus"),
        *[known(c) for c in ("vision_model", "vision_model_organization", "language_model")],
        *[known(c) for c in ("language_model_organization", "parameters", "release_date")],
        F.coalesce(summary if summary_limit is None else F.substring(summary, 1, summary_limit), F.lit("")).alias("technical_summary"),
    )


def _peer_figures(neighbours: DataFrame, ranges: DataFrame, *more: Column) -> DataFrame:
    """Lowest, median and highest peer score per target (0 to 100); a target has at most 2k + 1 peers."""
    percent = fields.to_percent(F.col("peer_score"), F.col("lo"), F.col("hi"))
    return (
        fields.with_range(neighbours, ranges)
        .groupBy("entity", "item")
        .agg(
            F.min(percent).alias("peer_min"),
            F.median(percent).alias("peer_median"),
            F.max(percent).alias("peer_max"),
            *more,
        )
    )


def _with_flag(figures: DataFrame, targets: DataFrame, ranges: DataFrame, margin: float) -> DataFrame:
    asked = fields.with_range(targets.select("entity", "item", "prediction"), ranges)
    asked = asked.select(
        "entity", "item", fields.to_percent(F.col("prediction"), F.col("lo"), F.col("hi")).alias("prediction_percent")
    )
    p = F.col("prediction_percent")
    flag = F.when(p > F.col("peer_max") + margin, "overestimate").when(p < F.col("peer_min") - margin, "underestimate")
    return (
        figures.join(asked, ["entity", "item"])
        .withColumn("deviation", p - F.col("peer_median"))
        .withColumn("flag", flag.otherwise("consistent"))
    )


def peer_summary(neighbours: DataFrame, targets: DataFrame, ranges: DataFrame, margin: float = 0.0) -> DataFrame:
    """Lowest, median and highest peer score per target (0 to 100), the prediction's distance from the
    median, and whether the prediction lies above, below or inside the peers' range."""
    return _with_flag(_peer_figures(neighbours, ranges), targets, ranges, margin)


def rank_evidence(
    targets: DataFrame, scores: DataFrame, ranges: DataFrame, k: int = 4, margin: float = 0.0
) -> DataFrame:
    """Per target: predicted rank, ranked entities, peers in order (at most 2k + 1) and their summary."""
    member = F.struct("rank", F.col("peer").alias("entity"), F.col("peer_score").alias("score"))
    figures = _peer_figures(
        rank_neighbours(targets, scores, k),
        ranges,
        F.first("predicted_rank").alias("predicted_rank"),
        F.first("n_ranked").alias("n_ranked"),
        F.sort_array(F.collect_list(member)).alias("peers"),
    )
    return _with_flag(figures, targets, ranges, margin)


EVOLUTION_LAYOUT = (Block(("entity", "vision_model", "language_model", "parameters", "organization", "release_date", Field("percent", "score", 1))),)
COMPONENT_LAYOUT = (Block(("component", "organization", "architecture", "parameters", "training_data", Field("key_features", between=", "), "summary")),)
SUMMARY_LAYOUT = (
    Block(("entity", "organization", "family", "parameters", "language_model", "vision_model", "release_date"), "target"),
    Block(("own_summary",)),
    Block((Field("predicted_rank"), "n_ranked", Field("peer_lines", "peers", between="\n  ")), "neighbours in rank"),
    Block(("technical_summary", "evolution"), "family"),
    Block((Field("sentiment_score", digits=2), "sentiment", "positive_aspects", "negative_aspects", "community_summary"), "feedback"),
    Block(("sibling_count", Field("sibling_min", digits=1), Field("sibling_max", digits=1), Field("sibling_mean", digits=1)), "scores of relatives"),
    Block(("item", "category", "task", "difficulty"), "item"),
)


def evolution_table(
    entities: DataFrame, scores: DataFrame, ranges: DataFrame, targets: DataFrame | None = None, layout: Sequence[Block] = EVOLUTION_LAYOUT
) -> DataFrame:
    """All members of a family, with their score on the item where they have one: ``(family, item, entity, line,
    percent)``, 0 to 100. The line has the fields of the layout in one row. A member without a score keeps its line, and
    its ``percent`` is null.

    The items of a family are those it has targets on; without ``targets``, those it has scores on. Entities without
    a family have no table.
    """
    asked = scores if targets is None else targets
    cells = asked.join(entities.select("entity", "family"), "entity").select("family", "item").distinct()
    rows = fields.with_range(scores, ranges)
    percent = fields.to_percent(F.col("score"), F.col("lo"), F.col("hi"))
    found = rows.select("entity", "item", percent.alias("percent"))
    out = cells.join(entities, "family").join(found, ["entity", "item"], "left")
    line = F.regexp_replace(rendered(out, layout), "\n+", ", ")
    return out.select("family", "item", "entity", line.alias("line"), "percent")


def component_text(
    targets: DataFrame, entities: DataFrame, components: DataFrame, column: str, layout: Sequence[Block] = COMPONENT_LAYOUT
) -> DataFrame:
    """Text on the target's component, by the layout. Targets whose component is not described keep a null text.
    ``components(component, ...)``: maker, architecture, size, training data, features, as far as known."""
    known = components.select(F.col("component").alias(column), rendered(components, layout).alias(f"{column}_text"))
    per_entity = entities.select("entity", column).join(known, column, "left").select("entity", f"{column}_text")
    return targets.join(per_entity, "entity", "left")


def _given(c: str) -> Column:
    """A summary worth showing: not empty and not marked as missing."""
    return F.when((F.col(c) != "") & ~F.col(c).contains("Not provided"), F.col(c))


def evidence_summary(
    targets: DataFrame,
    entities: DataFrame,
    scores: DataFrame,
    ranges: DataFrame,
    families: DataFrame,
    items: DataFrame,
    k: int = 4,
    evolution: DataFrame | None = None,
    layout: Sequence[Block] = SUMMARY_LAYOUT,
) -> DataFrame:
    """Report per target by the layout, in blocks; a block without data is left out, and nothing is cut.

    Columns for the layout are those of the entity, its family and the item, the figures of its siblings, its rank and
    ``peer_lines`` (at most 2k + 1, each with organization and size), ``own_summary`` (the entity's own technical
    summary, if ``entities`` has one), ``sentiment`` in words, and ``evolution``, the reply on the family's course from
    ``evolution(family, item, text)``. The family's scores on the item are here by their figures and in full in
    ``family_score_pages`` under the same (family, item).
    """
    # Makers meet the peers before these are gathered: one aggregate a target, and no peer is unpacked again.
    maker = entities.select(F.col("entity").alias("peer"), F.concat_ws(", ", "organization", "parameters").alias("_about"))
    near = rank_neighbours(targets, scores, k).join(maker, "peer", "left")
    about = F.when(F.col("_about") != "", F.concat(F.lit(" ("), "_about", F.lit(")")))
    line = F.concat(F.col("rank").cast("string"), F.lit(". "), "peer", F.coalesce(about, F.lit("")), F.lit(": "), fields.fixed(F.col("peer_score"), 1))
    peers = near.groupBy("entity", "item").agg(
        F.first("predicted_rank").alias("predicted_rank"),
        F.first("n_ranked").alias("n_ranked"),
        F.sort_array(F.collect_list(F.struct("rank", "peer", line.alias("line")))).alias("_lines"),
    )
    peers = peers.withColumn("peer_lines", F.transform("_lines", lambda x: x["line"])).drop("_lines")
    siblings = sibling_summary(targets, entities, scores).drop("family")
    own = entities.select(
        "entity", "organization", "family", "parameters", "language_model", "vision_model", "release_date",
        *([F.col("technical_summary").alias("own_summary")] if "technical_summary" in entities.columns else []),
    )
    told = families.select(
        "family", "technical_summary", "sentiment_score", "positive_aspects", "negative_aspects", "community_summary"
    )
    rows = siblings.join(own, "entity", "left").join(told, "family", "left").join(peers, ["entity", "item"], "left")
    rows = rows.join(items.select("item", "category", "task", "difficulty"), "item", "left")
    if evolution is not None:
        rows = rows.join(evolution.select("family", "item", F.col("text").alias("evolution")), ["family", "item"], "left")
    felt = F.coalesce(F.col("sentiment_score") != 0, F.lit(False))
    some = F.coalesce(F.col("sibling_count") > 0, F.lit(False))
    shown = {c: F.when(felt, F.col(c)) for c in ("sentiment_score", "positive_aspects", "negative_aspects", "community_summary")}
    shown |= {"sentiment": F.when(felt, fields.sentiment_label(F.col("sentiment_score"))), "technical_summary": _given("technical_summary")}
    # Figures are rounded on a grid first: the last bit of a mean decides no digit.
    shown |= {c: F.when(some, F.round(c, 6)) for c in ("sibling_min", "sibling_max", "sibling_mean")}
    shown["sibling_count"] = F.when(some, F.col("sibling_count"))
    shown["item"] = F.when(F.col("category") != "", F.col("item"))
    view = rows.withColumn("_item", F.col("item")).withColumns(shown)
    return view.select("entity", F.col("_item").alias("item"), "family", rendered(view, layout).alias("summary"))


def request_table(evidence: DataFrame, templates: Mapping[str, str], keys: Sequence[str] = ("entity", "item")) -> DataFrame:
    """One request text per target and step: ``{column}`` in a template is replaced by the column's text.

    The user writes the templates; the result is a table, nothing is sent.
    """
    steps = []
    names = "|".join(re.escape(c) for c in sorted(evidence.columns, key=len, reverse=True))
    for step, template in templates.items():
        # Cut once: text that comes from a column is not looked at again. Odd pieces are column names.
        pieces = re.split("{(" + names + ")}", template)
        parts = [F.coalesce(F.col(p).cast("string"), F.lit("N/A")) if k % 2 else F.lit(p) for k, p in enumerate(pieces)]
        steps.append(F.struct(F.lit(step).alias("step"), F.concat(*parts).alias("request")))
    return evidence.select(*keys, F.explode(F.array(*steps)).alias("r")).select(*keys, "r.*")


def parse_adjustments(replies: DataFrame) -> DataFrame:
    """Correction, weight, confidence and explanation from ``replies(entity, item, text)``.

    A reply without a JSON object (none, an array, a scalar) gives no row. A key that is present decides, even if it
    holds no finite number: a correction is then 0, a weight 1. Each reply is parsed once.
    """
    valid = replies.withColumn("_v", F.try_parse_json(text.json_block(F.col("text"))))
    valid = valid.filter(F.schema_of_variant("_v").startswith("OBJECT"))

    def string(name):
        return F.try_variant_get("_v", f"$.{name}", "string")

    def number(name, missing):
        value = string(name).try_cast("double")
        return F.when(F.abs(value) < float("inf"), value).otherwise(missing)  # NaN is above every number

    has_delta = F.try_variant_get("_v", "$.delta", "variant").isNotNull()
    return valid.select(
        "entity",
        "item",
        F.when(has_delta, number("delta", 0.0)).otherwise(number("adjustment", 0.0)).alias("delta"),
        fields.clip(number("credibility_weight", 1.0), 0.0, 1.0).alias("credibility_weight"),
        F.coalesce(string("confidence"), F.lit("medium")).alias("confidence"),
        F.coalesce(string("explanation"), string("analysis"), F.lit("")).alias("analysis"),
        F.try_variant_get("_v", "$.evidence_summary", "array<string>").alias("evidence_summary"),
    )


def apply_adjustments(
    predictions: DataFrame, adjustments: DataFrame, ranges: DataFrame, clip_final: bool = False
) -> DataFrame:
    """Add weight x correction on the 0 to 100 scale, back on the item's own scale where it has one.

    The start is the clipped prediction, the final score is not clipped unless asked for. Without a usable
    reply the prediction stays and direction and confidence are ``fallback``.
    """
    rows = fields.with_range(predictions, ranges)
    rows = rows.join(adjustments, ["entity", "item"], "left")
    lo, hi, p = F.col("lo"), F.col("hi"), F.col("prediction")
    change = F.col("credibility_weight") * F.col("delta")
    final = fields.to_percent(p, lo, hi) + change
    if clip_final:
        final = fields.clip(final, 0.0, 100.0)
    scaled = F.when(F.col("own_range"), fields.from_percent(final, lo, hi)).otherwise(final)
    replied = F.col("delta").isNotNull()
    moved = F.when(F.col("own_range"), scaled - p).otherwise(change)
    return rows.select(
        "entity",
        "item",
        "truth",
        F.col("prediction").alias("baseline_prediction"),
        F.when(replied, scaled).otherwise(p).alias("predicted_score"),
        F.when(replied, moved).otherwise(F.lit(0.0)).alias("adjustment"),
        F.when(replied, fields.direction(moved)).otherwise("fallback").alias("direction"),
        F.when(replied, F.col("confidence")).otherwise("fallback").alias("confidence"),
        F.when(replied, F.col("analysis")).otherwise("Semantic adjustment failed").alias("analysis"),
    )


class _Reports(Mapping):
    """Reports by name, each made when it is first asked for: a report that nobody reads runs no job."""

    def __init__(self, makers: Mapping[str, Callable[[], DataFrame]]):
        self._makers, self._made = dict(makers), {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._makers[name]()
        return self._made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)


def run_evaluation(results: DataFrame, ranges: DataFrame) -> Mapping[str, DataFrame]:
    """Reports of the corrected and of the plain predictions on the same cells, the gain, the directions."""
    from scoreweave.operators.metrics import direction_distribution, improvement, metrics_long
    from scoreweave.session import cut_lineage

    results = cut_lineage(results)

    def report(column: str) -> DataFrame:
        return metrics_long(results.select("entity", "item", "truth", F.col(column).alias("prediction")), ranges)

    reports = _Reports({
        "adjusted": lambda: report("predicted_score"),
        "baseline": lambda: report("baseline_prediction"),
        "improvement": lambda: improvement(reports["baseline"], reports["adjusted"]),
        "directions": lambda: direction_distribution(results),
    })
    return reports


def community_feedback(replies: DataFrame, mentions: DataFrame, enough: int = 30, shown: int | None = None) -> DataFrame:
    """Per subject: sentiment, positive and negative aspects and issues (the first ``shown``, if given), summary;
    mention count, confidence and hype level. ``replies(subject, text)``, ``mentions(subject, ...)``."""
    counts = mentions.groupBy("subject").agg(F.count(F.lit(1)).alias("web_mentions_count"))
    block = replies.select("subject", text.json_block(F.col("text")).alias("_j"))

    def aspects(name):
        found = F.coalesce(text.json_array(F.col("_j"), name), F.array().cast("array<string>"))
        return found if shown is None else F.slice(found, 1, shown)

    parsed = block.select(
        "subject",
        text.json_field(F.col("_j"), "sentiment").try_cast("double").alias("_sentiment"),
        aspects("positive").alias("positive_aspects"),
        aspects("negative").alias("negative_aspects"),
        aspects("issues").alias("reported_issues"),
        F.coalesce(text.json_field(F.col("_j"), "summary"), F.lit("")).alias("community_summary"),
    )
    n = F.col("web_mentions_count")
    return counts.join(parsed, "subject", "left").select(
        "subject",
        F.coalesce("_sentiment", F.lit(0.5)).alias("sentiment_score"),
        "positive_aspects",
        "negative_aspects",
        "reported_issues",
        "community_summary",
        "web_mentions_count",
        fields.mention_confidence(n, enough).alias("confidence"),
        fields.hype_level(n).alias("hype_level"),
    )


def component_knowledge(usage: DataFrame, replies: DataFrame, repositories: DataFrame, kind: str) -> DataFrame:
    """Per component in use: parsed reply, repository id, usage; summary ``N/A`` when there is no reply."""
    block = text.json_block(F.col("text"))
    parsed = replies.select("component", block.alias("_j")).filter("_j IS NOT NULL")
    parsed = parsed.select(
        "component",
        *[text.json_field(F.col("_j"), c).alias(c) for c in ("organization", "parameters", "architecture", "summary")],
        text.json_array(F.col("_j"), "key_features").alias("key_features"),
    )
    out = usage.join(parsed, "component", "left")
    out = out.join(repositories.select(F.col("name").alias("component"), F.col("repo").alias("huggingface")), "component", "left")
    return out.withColumn("type", F.lit(kind)).withColumn("summary", F.coalesce("summary", F.lit("N/A")))


def assemble_context(docs: DataFrame, at_most: int | None = None, limit: int | None = None, per_page: int = 1000) -> DataFrame:
    """Per subject and page of ``per_page`` documents: their number, and each as ``[source] title``, text, in order.

    Pages keep the text of a large subject from becoming one row; a subject within ``per_page`` has page 0 only.
    ``at_most`` takes the first documents only, ``limit`` cuts each page to so many characters, both if given.
    """
    order = [F.col("pos"), F.col("title")]
    docs = docs if at_most is None else first_per_key(docs, ["subject"], order, at_most)
    first = ranked(docs, ["subject"], order, "_place")
    first = first.withColumn("page", F.floor((F.col("_place") - 1) / F.lit(per_page)).cast("int"))
    one = F.concat(
        F.lit("\n["), F.coalesce("source", F.lit("")), F.lit("] "), F.coalesce("title", F.lit("")), F.lit("\n"),
        F.coalesce("text", F.lit("")), F.lit("\n"),
    )
    ordered = F.sort_array(F.collect_list(F.struct("_place", one.alias("piece"))))
    whole = F.array_join(F.transform(ordered, lambda e: e["piece"]), "")
    out = first.groupBy("subject", "page").agg(F.count(F.lit(1)).alias("n_docs"), whole.alias("context"))
    return out if limit is None else out.withColumn("context", F.substring("context", 1, limit))
