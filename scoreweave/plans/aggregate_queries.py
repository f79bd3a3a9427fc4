"""Aggregates, metrics and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoreweave.operators import dimensions, evidence, metrics, split, stats
from scoreweave.operators.factorize import predict_packed, running_rmse
from scoreweave.operators.spread import ranked
from scoreweave.plans.join_queries import NEIGHBOURS
from scoreweave.plans.registry import query, rounded
from scoreweave.plans.source_queries import board_docs
from scoreweave.plans.views import CUTOFF, RATIO, SEED
from scoreweave.sources.scores import leaderboard_raw


@query(
    "A1_item_stats",
    """SELECT item, count(*) AS n, round(CASE WHEN count(*) < 3 THEN (SELECT avg(score) FROM train) ELSE avg(score) END, 8) AS mu,
    round(CASE WHEN count(*) < 3 THEN (SELECT stddev_pop(score) FROM train) WHEN stddev_pop(score) = 0 THEN 1 ELSE stddev_pop(score) END, 5) AS sigma FROM train GROUP BY item""",
)
def _(t):
    out = stats.item_stats(t.training)
    return out.select("item", "n", rounded("mu", 8).alias("mu"), rounded("sigma", 5).alias("sigma"))


@query(
    "A1_sparse_item_stats",
    """SELECT event_type || cast(user_id AS VARCHAR) AS item, count(*) AS n,
    round(CASE WHEN count(*) < 3 THEN (SELECT avg(value) FROM events) ELSE avg(value) END, 8) AS mu,
    round(CASE WHEN count(*) < 3 THEN (SELECT stddev_pop(value) FROM events) WHEN stddev_pop(value) = 0 THEN 1 ELSE stddev_pop(value) END, 5) AS sigma FROM events GROUP BY 1""",
)
def _(t):
    rows = t.events.select(F.concat("event_type", F.col("user_id").cast("string")).alias("item"), F.col("value").alias("score"))
    out = stats.item_stats(rows)
    return out.select("item", "n", rounded("mu", 8).alias("mu"), rounded("sigma", 5).alias("sigma"))


@query(
    "A2_describe_items",
    "SELECT item, count(*) AS n, round(avg(score), 4) AS mean, max(score) AS max, min(score) AS min, round(stddev_samp(score), 4) AS std FROM scores GROUP BY item",
)
def _(t):
    out = stats.describe_items(t.scores)
    return out.withColumn("mean", rounded("mean", 4)).withColumn("std", rounded("std", 4))


@query(
    "A3_matrix_summary",
    """SELECT 'train' AS part, count(DISTINCT entity) AS n_entities, count(DISTINCT item) AS n_items, count(*) AS n_observations FROM train
    UNION ALL SELECT 'test', count(DISTINCT entity), count(DISTINCT item), count(*) FROM test_cells""",
)
def _(t):
    return stats.matrix_summary({"train": t.training, "test": t.held_out})


@query("A4_collect_subcategories", "SELECT DISTINCT s.item, 'part ' || e.vision_model AS sub_item FROM scores s JOIN entities e ON s.entity = e.entity UNION ALL SELECT 'Other', 'Mean'")
def _(t):
    return stats.collect_subcategories(leaderboard_raw(board_docs(t)))


@query(
    "A5_component_usage",
    """SELECT component, count(*) AS used_by_count, string_agg(entity, ',' ORDER BY entity) FILTER (WHERE rn <= 5) AS examples FROM (
      SELECT *, row_number() OVER (PARTITION BY component ORDER BY entity) AS rn FROM (SELECT entity, trim(split_part(language_model, '<br>', 1)) AS component FROM entities) y) x GROUP BY component""",
)
def _(t):
    out = stats.component_usage(t.entities, "language_model")
    return out.select("component", "used_by_count", F.array_join("used_by_examples", ",").alias("examples"))


@query(
    "A6_dimension_counts",
    """SELECT 'families_of' AS kind, organization AS name, count(DISTINCT family) AS n FROM entities GROUP BY organization
    UNION ALL SELECT 'entities_of', family, count(*) FROM entities GROUP BY family
    UNION ALL SELECT 'total', 'entities', count(*) FROM entities UNION ALL SELECT 'total', 'open_source', count(*) FROM entities WHERE open_source
    UNION ALL SELECT 'total', 'release_date', count(release_date) FROM entities
    UNION ALL SELECT 'total', 'language_models', count(DISTINCT language_model) FROM entities
    UNION ALL SELECT 'total', 'vision_models', count(DISTINCT vision_model) FROM entities""",
)
def _(t):
    return stats.dimension_counts(t.entities)


@query("A7_build_knowledge_tree", "SELECT organization, family, entity, parameters FROM entities")
def _(t):
    tree = dimensions.build_knowledge_tree(t.entities, ["parameters", "vision_model"])
    return tree.select("organization", "family", F.explode("models").alias("entity", "info")).select(
        "organization", "family", "entity", "info.parameters"
    )


@query(
    "A8_flatten_tree",
    """SELECT x.organization, e.language_model AS family, e.entity, e.parameters FROM entities e
    JOIN (SELECT language_model, arg_min(organization, ord) AS organization FROM entities GROUP BY language_model) x ON e.language_model = x.language_model""",
)
def _(t):
    tree = t.entities.select("organization", F.col("language_model").alias("family"), "entity", "ord", "parameters")
    earlier = tree.withColumn("ord", F.col("ord") - 1_000_000_000).withColumn("parameters", F.lit("old"))
    out = dimensions.flatten_tree(tree.unionByName(earlier.withColumn("organization", F.col("organization"))))
    return out


_ERRORS = """pct AS (SELECT p.*, greatest(0, least(100, (prediction - coalesce(lo, 0)) / (coalesce(hi, 100) - coalesce(lo, 0)) * 100))
    - greatest(0, least(100, (truth - coalesce(lo, 0)) / (coalesce(hi, 100) - coalesce(lo, 0)) * 100)) AS d FROM predictions p LEFT JOIN ranges r ON p.item = r.item)"""
_AVERAGE = """(rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0)"""
_SRCC = f"""sp AS (SELECT corr(rx, ry) AS srcc FROM (SELECT CAST({_AVERAGE.format("prediction")} AS DOUBLE) AS rx, CAST({_AVERAGE.format("truth")} AS DOUBLE) AS ry FROM predictions) x)"""
_KRCC = """kd AS (SELECT sum(sign(a.prediction - b.prediction) * sign(a.truth - b.truth))
      / sqrt(CAST(count(*) FILTER (WHERE a.prediction <> b.prediction) AS DOUBLE) * count(*) FILTER (WHERE a.truth <> b.truth)) AS krcc
    FROM predictions a JOIN predictions b ON (a.entity, a.item) < (b.entity, b.item))"""
_RANKS = """rk AS (SELECT entity, item, row_number() OVER (PARTITION BY item ORDER BY prediction DESC, entity) AS prediction_rank,
    row_number() OVER (PARTITION BY item ORDER BY truth DESC, entity) AS true_rank, count(*) OVER (PARTITION BY item) AS n FROM predictions)"""
_MAE3 = "m3 AS (SELECT coalesce(avg(CASE WHEN abs(prediction_rank - true_rank) <= 3 THEN 1.0 ELSE 0.0 END) FILTER (WHERE n >= 2), 0) AS mae3 FROM rk)"


@query("A9_mae_rmse", f"WITH {_ERRORS} SELECT round(avg(abs(d)), 5) AS mae, round(sqrt(avg(d * d)), 5) AS rmse FROM pct")
def _(t):
    return metrics.errors(t.predicted, t.ranges).select(rounded("mae", 5).alias("mae"), rounded("rmse", 5).alias("rmse"))


@query("A10_masked_rmse", "SELECT round(sqrt(avg((prediction - truth) * (prediction - truth))), 5) AS rmse FROM predictions")
def _(t):
    return metrics.masked_rmse(t.predicted, t.held_out).select(rounded("rmse", 5).alias("rmse"))


@query("A11_srcc", f"WITH {_SRCC} SELECT round(srcc, 6) AS srcc FROM sp")
def _(t):
    return metrics.srcc(t.predicted).select(rounded("srcc").alias("srcc"))


@query("A12_krcc", f"WITH {_KRCC} SELECT round(krcc, 6) AS krcc FROM kd")
def _(t):
    return metrics.krcc(metrics.pooled_positions(t.predicted)).select(rounded("krcc").alias("krcc"))


@query("A13_mae_at_3", f"WITH {_RANKS}, {_MAE3} SELECT round(mae3, 6) AS mae3 FROM m3")
def _(t):
    return metrics.mae_at_3(t.predicted).select(rounded("mae3").alias("mae3"))


@query(
    "A14_metrics_report",
    f"""WITH {_ERRORS}, {_SRCC}, {_KRCC}, {_RANKS}, {_MAE3}
    SELECT round(avg(abs(d)), 5) AS mae, round(sqrt(avg(d * d)), 5) AS rmse, round((SELECT srcc FROM sp), 5) AS srcc, round((SELECT krcc FROM kd), 5) AS krcc,
    round((SELECT mae3 FROM m3), 5) AS mae3, CAST(count(*) AS DOUBLE) AS n_samples, CAST(count(DISTINCT item) AS DOUBLE) AS n_items, CAST(count(DISTINCT entity) AS DOUBLE) AS n_entities FROM pct""",
)
def _(t):
    return metrics.metrics_report(t.predicted, t.ranges).select(*[rounded(m, 5).alias(m) for m in metrics.METRICS])


@query(
    "A15_improvement",
    """SELECT metric, round(base, 4) AS base, round(new, 4) AS new, round((base - new) / base * 100, 3) AS gain FROM (
      SELECT 'mae' AS metric, avg(abs(g - truth)) AS base, avg(abs(prediction - truth)) AS new FROM (SELECT *, (SELECT avg(score) FROM train) AS g FROM predictions) x
      UNION ALL SELECT 'rmse', sqrt(avg((g - truth) * (g - truth))), sqrt(avg((prediction - truth) * (prediction - truth))) FROM (SELECT *, (SELECT avg(score) FROM train) AS g FROM predictions) x) y""",
)
def _(t):
    def long(c):
        d = F.col(c) - F.col("truth")
        rows = t.predicted.withColumn("g", t.training.select(F.avg("score")).scalar())
        one = rows.select(d.alias("d")).agg(F.avg(F.abs("d")).alias("mae"), F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rmse"))
        return one.unpivot([], ["mae", "rmse"], "metric", "value")

    out = metrics.improvement(long("g"), long("prediction"))
    return out.select("metric", rounded("base", 4).alias("base"), rounded("new", 4).alias("new"), rounded("gain", 3).alias("gain"))


_DIRECTIONS = """SELECT direction, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 5) AS share FROM (
    SELECT CASE WHEN prediction - truth > 0.5 THEN 'up' WHEN prediction - truth < -0.5 THEN 'down' ELSE 'keep' END AS direction FROM predictions) x GROUP BY direction"""


@query("A16_direction_distribution", _DIRECTIONS)
def _(t):
    from scoreweave.functions.fields import direction

    rows = t.predicted.select(direction(F.col("prediction") - F.col("truth")).alias("direction"))
    return metrics.direction_distribution(rows).withColumn("share", rounded("share", 5))


@query(
    "A18_peer_summary",
    """WITH {0} SELECT x.entity, x.item, round(peer_min, 4) AS peer_min, round(peer_median, 4) AS peer_median, round(peer_max, 4) AS peer_max, round(pp - peer_median, 4) AS deviation,
    CASE WHEN pp > peer_max THEN 'overestimate' WHEN pp < peer_min THEN 'underestimate' ELSE 'consistent' END AS flag FROM (
      SELECT p.entity, p.item, min(q) AS peer_min, median(q) AS peer_median, max(q) AS peer_max FROM (
        SELECT peers.*, greatest(0, least(100, (peer_score - coalesce(lo, 0)) / (coalesce(hi, 100) - coalesce(lo, 0)) * 100)) AS q FROM peers LEFT JOIN ranges r ON peers.item = r.item) p GROUP BY 1, 2) x
    JOIN (SELECT p.entity, p.item, greatest(0, least(100, (prediction - coalesce(lo, 0)) / (coalesce(hi, 100) - coalesce(lo, 0)) * 100)) AS pp FROM predictions p LEFT JOIN ranges r ON p.item = r.item) y
      ON x.entity = y.entity AND x.item = y.item""".replace("{0}", NEIGHBOURS),
)
def _(t):
    out = evidence.peer_summary(evidence.rank_neighbours(t.predicted, t.training), t.predicted, t.ranges)
    return out.select("entity", "item", *[rounded(c, 4).alias(c) for c in ("peer_min", "peer_median", "peer_max", "deviation")], "flag")


@query("W1_rank_desc", "SELECT item, entity, row_number() OVER (PARTITION BY item ORDER BY score DESC, entity) AS rank FROM scores")
def _(t):
    return ranked(t.scores, ["item"], [F.col("score").desc(), F.col("entity")]).select("item", "entity", "rank")


@query("W2_ordinal_rank", f"WITH {_RANKS} SELECT entity, item, prediction_rank, true_rank FROM rk")
def _(t):
    return metrics.item_ranks(t.predicted).select("entity", "item", "prediction_rank", "true_rank")


@query(
    "W3_holdout_split",
    "SELECT entity, item, score, 'test' AS part FROM test_cells UNION ALL SELECT entity, item, score, 'train' FROM train",
)
def _(t):
    return split.holdout_split(t.scores, t.entities, CUTOFF, RATIO, SEED)


# Draws derived from the tables: three vectors per entity and item that move with the draw number.
_DRAWS = """SELECT 'u' AS side, d AS draw, id, array(cast(x + d AS double), cast(y AS double)) AS vec
  FROM (SELECT c_name AS id, c_acctbal / 1000 AS x, c_nationkey AS y, explode(sequence(0, 2)) AS d FROM customer) a
UNION ALL SELECT 'v', d, id, array(cast(x AS double), cast(d * 0.5 + 0.25 AS double))
  FROM (SELECT id, x, explode(sequence(0, 2)) AS d FROM (SELECT p_brand AS id, sum(p_size) / 1000 AS x FROM part GROUP BY p_brand) b) c"""
_DRAWS_SQL = """du AS (SELECT d AS draw, c_name AS id, c_acctbal / 1000 + d AS x, CAST(c_nationkey AS DOUBLE) AS y FROM customer, (SELECT unnest(range(0, 3)) AS d) x),
    dv AS (SELECT d AS draw, p_brand AS id, sum(p_size) / 1000 AS x, d * 0.5 + 0.25 AS y FROM part, (SELECT unnest(range(0, 3)) AS d) x GROUP BY d, p_brand),
    pd AS (SELECT s.entity, s.item, du.draw, du.x * dv.x + du.y * dv.y AS prediction FROM scores s JOIN du ON s.entity = du.id JOIN dv ON s.item = dv.id AND dv.draw = du.draw)"""


def given_draws(t):
    return t.sql(_DRAWS)


@query(
    "A17_posterior_summary",
    f"""WITH {_DRAWS_SQL}, st AS (SELECT item, avg(score) AS mu, stddev_pop(score) AS sigma FROM scores GROUP BY item)
    SELECT pd.entity, pd.item, round(avg(prediction) * any_value(sigma) + any_value(mu), 3) AS prediction, round(stddev_pop(prediction) * any_value(sigma), 3) AS uncertainty
    FROM pd JOIN st ON pd.item = st.item GROUP BY 1, 2""",
)
def _(t):
    from scoreweave.operators.factorize import posterior_summary

    out = posterior_summary(predict_packed(t.scores.select("entity", "item"), given_draws(t)), stats.item_stats(t.scores))
    return out.select("entity", "item", rounded("prediction", 3).alias("prediction"), rounded("uncertainty", 3).alias("uncertainty"))


@query(
    "W4_running_rmse",
    f"""WITH {_DRAWS_SQL}, run AS (SELECT pd.*, avg(prediction) OVER (PARTITION BY entity, item ORDER BY draw ROWS UNBOUNDED PRECEDING) AS m FROM pd),
    lab AS (SELECT entity, item, score, 'test' AS part FROM test_cells UNION ALL SELECT entity, item, score, 'train' FROM train)
    SELECT CAST(draw AS INT) AS draw, part, round(sqrt(avg((prediction - score) * (prediction - score))), 4) AS step_rmse, round(sqrt(avg((m - score) * (m - score))), 4) AS running_rmse
    FROM run JOIN lab ON run.entity = lab.entity AND run.item = lab.item GROUP BY 1, 2""",
)
def _(t):
    out = running_rmse(predict_packed(t.scores.select("entity", "item"), given_draws(t)), t.parts)
    return out.select("draw", "part", rounded("step_rmse", 4).alias("step_rmse"), rounded("running_rmse", 4).alias("running_rmse"))


@query(
    "W5_batch_slice",
    "SELECT entity, item, CAST(floor((row_number() OVER (ORDER BY entity, item) - 1) / ceil(count(*) OVER () / 4.0)) AS INT) AS batch FROM test_cells",
)
def _(t):
    return split.batch_slice(t.held_out, 4).select("entity", "item", "batch")
