"""Factor models, predictions, cold start, incremental results."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoreweave.operators import dimensions, evidence, factorize, similar, stats
from scoreweave.plans import gibbs_sql
from scoreweave.plans.aggregate_queries import _DRAWS_SQL, _ERRORS, _KRCC, _MAE3, _RANKS, _SRCC, given_draws
from scoreweave.plans.evidence_queries import _APPLIED
from scoreweave.plans.join_queries import SIMILAR, profile_vectors
from scoreweave.plans.registry import query, rounded
from scoreweave.session import cut_lineage, new_table_path
from scoreweave.streaming.results import incremental_results

_SETTINGS = {"dim": 4, "draws": 3, "tune": 2, "seed": 42}


def _standardized(t):
    st = cut_lineage(stats.item_stats(t.training))
    z = (F.col("score") - F.col("mu")) / F.col("sigma")
    return t.training.join(st, "item").select("entity", "item", z.alias("score")), st


def _features(t):
    entities = dimensions.entity_profiles(dimensions.profile_fields(t.entities, t.entities))
    return entities, dimensions.item_profiles(t.items)


def _summary(t, draws, st):
    cells = t.held_out.select("entity", "item")
    out = factorize.posterior_summary(factorize.predict_packed(cells, draws), st)
    return out.select("entity", "item", rounded("prediction").alias("prediction"), rounded("uncertainty").alias("uncertainty"))


def _summary_sql(tag: str) -> str:
    return f"""SELECT c.entity, c.item, round(s.prediction, 6) AS prediction, round(s.uncertainty, 6) AS uncertainty
    FROM test_cells c LEFT JOIN ({gibbs_sql.summary(tag)}) s ON s.entity = c.entity AND s.item = c.item"""


_WANTED = "wanted AS (SELECT entity, item FROM test_cells)"


@query(
    "M1_fit_pmf",
    f"""WITH {gibbs_sql.STANDARD}, {_WANTED}, p_u_ids AS (SELECT DISTINCT entity AS id FROM train), p_v_ids AS (SELECT DISTINCT item AS id FROM train),
    {gibbs_sql.sampler("p", **_SETTINGS)} {_summary_sql("p")}""",
)
def _(t):
    obs, st = _standardized(t)
    return _summary(t, factorize.fit_pmf(obs, **_SETTINGS), st)


@query(
    "M2_fit_cpmf",
    f"""WITH {gibbs_sql.STANDARD}, {gibbs_sql.FEATURES}, {_WANTED}, c_u_ids AS (SELECT entity AS id FROM entities), c_v_ids AS (SELECT DISTINCT item AS id FROM train),
    gv AS (SELECT f.* FROM fv f JOIN c_v_ids i ON i.id = f.id), {gibbs_sql.sampler("c", features=("fu", "gv"), **_SETTINGS)} {_summary_sql("c")}""",
)
def _(t):
    obs, st = _standardized(t)
    ids = t.entities.select("entity")
    return _summary(t, factorize.fit_cpmf(obs, *_features(t), entity_ids=ids, **_SETTINGS), st)


@query("M3_posterior_means", f"WITH {_DRAWS_SQL} SELECT 'u' AS side, id, round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM du GROUP BY id UNION ALL SELECT 'v', id, round(avg(x), 6), round(avg(y), 6) FROM dv GROUP BY id")
def _(t):
    out = factorize.posterior_means(given_draws(t), 2)
    return out.select("side", "id", rounded(F.col("vec")[0]).alias("x"), rounded(F.col("vec")[1]).alias("y"))


_ALL_CELLS = "SELECT e.entity, i.item FROM entities e, items i"


def _every_cell(t):
    names = [r[0] for r in t.items.select("item").collect()]  # 25 items
    return t.entities.select("entity", F.explode(F.lit(names)).alias("item"))


@query(
    "M4_global_mean",
    f"SELECT c.entity, c.item, round(coalesce(s.score, (SELECT avg(score) FROM train)), 5) AS prediction FROM ({_ALL_CELLS}) c LEFT JOIN train s ON s.entity = c.entity AND s.item = c.item",
)
def _(t):
    return factorize.global_mean(_every_cell(t), t.training).withColumn("prediction", rounded("prediction", 5))


@query(
    "M4_mean_of_means",
    f"""SELECT c.entity, c.item, round(((SELECT avg(score) FROM train) + coalesce(a.m, 0) + coalesce(b.m, 0)) / (1 + CASE WHEN a.m IS NULL THEN 0 ELSE 1 END + CASE WHEN b.m IS NULL THEN 0 ELSE 1 END), 5) AS prediction
    FROM ({_ALL_CELLS}) c LEFT JOIN (SELECT entity, avg(score) AS m FROM train GROUP BY entity) a ON a.entity = c.entity LEFT JOIN (SELECT item, avg(score) AS m FROM train GROUP BY item) b ON b.item = c.item""",
)
def _(t):
    return factorize.mean_of_means(_every_cell(t), t.training).withColumn("prediction", rounded("prediction", 5))


@query(
    "M4_uniform_random",
    f"""SELECT c.entity, c.item, round(coalesce(s.score, lo + (('0x' || substr(md5(concat_ws(':', '42', c.entity, c.item)), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496 * (hi - lo)), 5) AS prediction
    FROM ({_ALL_CELLS}) c LEFT JOIN train s ON s.entity = c.entity AND s.item = c.item, (SELECT min(score) AS lo, max(score) AS hi FROM train) b""",
)
def _(t):
    return factorize.uniform_random(_every_cell(t), t.training).withColumn("prediction", rounded("prediction", 5))


@query("M5_predict", f"WITH {_DRAWS_SQL} SELECT entity, item, round(prediction, 10) AS prediction FROM pd WHERE draw = 2")
def _(t):
    draws = given_draws(t).filter("draw = 2")
    u, v = draws.filter("side = 'u'").select("id", "vec"), draws.filter("side = 'v'").select("id", "vec")
    return factorize.predict(t.scores.select("entity", "item"), u, v).withColumn("prediction", rounded("prediction", 10))


@query(
    "M6_cold_start",
    f"""WITH {SIMILAR}, {_DRAWS_SQL.split("pd AS")[0].strip().rstrip(",")}, st AS (SELECT item, avg(score) AS mu, stddev_pop(score) AS sigma FROM scores GROUP BY item),
    p AS (SELECT b.id, t.item, b.known_id, greatest(b.similarity, 0) + 1e-8 AS w, du.x * dv.x + du.y * dv.y AS p FROM best b JOIN test_cells t ON t.entity = b.id
      JOIN du ON du.id = b.known_id AND du.draw = 0 JOIN dv ON dv.id = t.item AND dv.draw = 0 WHERE b.rank <= 5)
    SELECT p.id, p.item, round(sum(w * p) / sum(w) * any_value(sigma) + any_value(mu), 3) AS prediction, round(stddev_pop(p) * any_value(sigma), 3) AS uncertainty, string_agg(known_id, ';' ORDER BY known_id) AS similar
    FROM p JOIN st ON st.item = p.item GROUP BY 1, 2""",
)
def _(t):
    near = similar.top_k_similar(*profile_vectors(t))
    draws = given_draws(t).filter("draw = 0")
    u, v = draws.filter("side = 'u'").select("id", "vec"), draws.filter("side = 'v'").select("id", "vec")
    cells = t.held_out.select(F.col("entity").alias("id"), "item")
    out = similar.cold_start(cells, near, u, v, stats.item_stats(t.scores))
    return out.select("id", "item", rounded("prediction", 3).alias("prediction"), rounded("uncertainty", 3).alias("uncertainty"), "similar")


_COMPARED = {"dim": 4, "draws": 2, "tune": 1, "seed": 42}


def _report_sql(tag: str) -> str:
    """Long report of the metrics over the predictions of a sampler."""
    ctes = ", ".join((_ERRORS, _SRCC, _KRCC, _RANKS, _MAE3)).replace("predictions", f"{tag}_predictions")
    return f"""SELECT unnest(['mae', 'rmse', 'srcc', 'krcc', 'mae3']) AS metric, unnest([mae, rmse, srcc, krcc, mae3]) AS value FROM (
      WITH {ctes} SELECT avg(abs(d)) AS mae, sqrt(avg(d * d)) AS rmse, (SELECT srcc FROM sp) AS srcc, (SELECT krcc FROM kd) AS krcc, (SELECT mae3 FROM m3) AS mae3 FROM pct) x"""


def _predictions_sql(tag: str) -> str:
    return f"""{tag}_predictions AS MATERIALIZED (SELECT s.entity, s.item, s.prediction, c.score AS truth FROM ({gibbs_sql.summary(tag)}) s JOIN test_cells c ON c.entity = s.entity AND c.item = s.item)"""


@query(
    "M7_train_and_compare",
    f"""WITH {gibbs_sql.STANDARD}, {gibbs_sql.FEATURES}, wanted AS (SELECT c.entity, c.item FROM test_cells c WHERE c.entity IN (SELECT entity FROM train)),
    ids_u AS (SELECT DISTINCT entity AS id FROM train), ids_v AS (SELECT item AS id FROM items),
    p_u_ids AS (FROM ids_u), p_v_ids AS (FROM ids_v), c_u_ids AS (FROM ids_u), c_v_ids AS (FROM ids_v), gu AS (SELECT f.* FROM fu f JOIN ids_u i ON i.id = f.id),
    {gibbs_sql.sampler("p", **_COMPARED)}, {gibbs_sql.sampler("c", features=("gu", "fv"), **_COMPARED)}, {_predictions_sql("p")}, {_predictions_sql("c")}
    SELECT p.metric, round(p.value, 6) AS base, round(c.value, 6) AS new,
      round(CASE WHEN abs(p.value) < 1e-9 THEN 0 ELSE CASE WHEN p.metric IN ('mae', 'rmse') THEN -1 ELSE 1 END * (c.value - p.value) / abs(p.value) * 100 END, 4) AS gain
    FROM ({_report_sql("p")}) p JOIN ({_report_sql("c")}) c ON c.metric = p.metric""",
)
def _(t):
    entities, items = _features(t)
    out = factorize.train_and_compare(t.training, t.held_out, t.ranges, entities, items, **_COMPARED)
    return out.select("metric", rounded("base").alias("base"), rounded("new").alias("new"), rounded("gain", 4).alias("gain"))


@query("M8_fit_map")
def _(t):
    obs, st = _standardized(t)
    fit = factorize.fit_map(obs, dim=4, iterations=3)
    u, v = fit.filter("side = 'u'").select("id", "vec"), fit.filter("side = 'v'").select("id", "vec")
    return factorize.predict(t.held_out.select("entity", "item"), u, v).withColumn("prediction", rounded("prediction"))


@query(
    "T1_incremental_results",
    f"""WITH {_APPLIED} SELECT entity, item, round(baseline_prediction, 4) AS baseline_prediction, round(predicted_score, 4) AS predicted_score, round(adjustment, 4) AS adjustment,
    CASE WHEN delta IS NULL THEN 'fallback' WHEN adjustment > 0.5 THEN 'up' WHEN adjustment < -0.5 THEN 'down' ELSE 'keep' END AS direction FROM res""",
)
def _(t):
    source, sink = new_table_path(t.spark, "targets"), new_table_path(t.spark, "results")
    t.predicted.repartition(3).write.parquet(source)
    t.predicted.repartition(3).write.mode("append").parquet(source)  # every key arrives twice
    stream = t.spark.readStream.schema(t.predicted.schema).option("maxFilesPerTrigger", 2).parquet(source)
    replies = cut_lineage(evidence.parse_adjustments(t.replies))  # every batch reads them
    query = incremental_results(
        stream, lambda fresh: evidence.apply_adjustments(fresh, replies, t.ranges), sink, new_table_path(t.spark, "progress")
    )
    query.awaitTermination()
    rows = t.spark.read.parquet(sink)
    numbers = [rounded(c, 4).alias(c) for c in ("baseline_prediction", "predicted_score", "adjustment")]
    return rows.select("entity", "item", *numbers, "direction")
