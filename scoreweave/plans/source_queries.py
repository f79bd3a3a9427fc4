"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoreweave.operators.factorize import full_matrix
from scoreweave.operators.stats import item_stats
from scoreweave.plans.registry import query, rounded
from scoreweave.session import new_table_path
from scoreweave.sources import knowledge, scores

_ITEMS = [f"Brand#{i}" for i in range(1, 26)]

_BOARD_DOCS = """
SELECT concat('{"time":"now","results":{"', s.entity, '":{"META":{"Parameters":"', e.parameters, '","Org":"', e.organization,
  '","Method":["m","https://', e.organization, '"]},"', s.item, '":{"Overall":', cast(s.score AS string),
  ',"Overall (x)":1,"part ', e.vision_model, '":"1.5","Dir Name":"d"},"Missing":{"Overall":"N/A"},"Odd":{"Overall":"n. a."},',
  '"Empty":{"Overall":null},"Note":"no object","Other":{"Mean":3}}}}') AS doc
FROM scores s JOIN entities e ON s.entity = e.entity"""


def board_docs(t):
    """Leaderboard documents built from the scores, one per observation, so that no document grows."""
    return t.sql(_BOARD_DOCS)


@query("S1_read_leaderboard", "SELECT entity, item, score FROM scores")
def _(t):
    return scores.leaderboard_scores(board_docs(t))


@query("S1_member_lines", "SELECT entity, item, score FROM scores")
def _(t):
    """The same boards as lines of one entity each, all twice: of two values of a cell the last one counts."""
    path = new_table_path(t.spark, "lines")
    docs = board_docs(t)
    first = docs.withColumn("doc", F.regexp_replace("doc", '"Overall":([0-9.]+)', '"Overall":1$1'))
    scores.member_lines(first).write.text(f"{path}/a")
    scores.member_lines(docs).write.text(f"{path}/b")
    return scores.leaderboard_scores(scores.read_member_lines(t.spark, f"{path}/*"))


@query(
    "S1_leaderboard_entities",
    """SELECT DISTINCT e.entity, e.parameters, e.organization, '' AS release_date, concat('https://', e.organization) AS official_url
    FROM entities e JOIN scores s ON e.entity = s.entity""",
)
def _(t):
    return scores.leaderboard_entities(board_docs(t)).select(
        "entity", "parameters", "organization", "release_date", "official_url"
    )


@query("S2_read_wide_scores", "SELECT entity, item, score FROM scores")
def _(t):
    path = new_table_path(t.spark, "wide")
    scores.write_wide_scores(t.scores, path)
    return scores.read_wide_scores(t.spark, path)[0]


_WIDE = ", ".join(f"""max(CASE WHEN s.item = '{i}' THEN s.score END) AS "{i}\"""" for i in _ITEMS)


@query(
    "S3_write_wide_scores",
    f"""SELECT e.entity AS "Model", e.parameters AS "Parameters", {_WIDE}
    FROM entities e LEFT JOIN scores s ON e.entity = s.entity GROUP BY 1, 2""",
)
def _(t):
    path = new_table_path(t.spark, "wide")
    meta = t.entities.select("entity", F.col("parameters").alias("Parameters"))
    scores.write_wide_scores(t.scores, path, meta)
    wide = t.spark.read.csv(path, header=True)
    return wide.select("Model", "Parameters", *[F.col(f"`{c}`").cast("double").alias(c) for c in wide.columns[2:]])


_TREE_DOCS = """
SELECT concat('{"organizations":{"', organization, '":{"families":{"', family, '":{"intro_url":null,"sentiment_score":0.7,',
  '"positive_aspects":["a","b"],"models":{"', entity, '":{"parameters":"', parameters, '","open_source":',
  CASE WHEN open_source THEN 'true' ELSE 'false' END, ',"vision_model":"', vision_model, '"}}}}}}}') AS doc FROM entities"""


@query("S4_read_knowledge_tree", "SELECT organization, family, entity, parameters, vision_model, open_source FROM entities")
def _(t):
    return knowledge.read_tree_entities(t.sql(_TREE_DOCS)).select(
        "organization", "family", "entity", "parameters", "vision_model", "open_source"
    )


@query("S4_tree_families", "SELECT DISTINCT organization, family, CAST(0.7 AS DOUBLE) AS sentiment_score, 'a;b' AS positive FROM entities")
def _(t):
    return knowledge.read_tree_families(t.sql(_TREE_DOCS)).select(
        "organization", "family", "sentiment_score", F.concat_ws(";", "positive_aspects").alias("positive")
    )


@query("S4_tree_counts", "SELECT count(DISTINCT organization) AS n_organizations, count(DISTINCT family) AS n_families FROM entities")
def _(t):
    return knowledge.tree_counts(t.sql(_TREE_DOCS))


@query(
    "S5_read_entity_features",
    """SELECT entity, family, CASE WHEN ord % 7 = 0 THEN 'Unknown' ELSE organization END AS organization,
    coalesce(try_cast(nullif(regexp_extract(parameters, '([0-9.]+)', 1), '') AS DOUBLE), 0.0) AS parameters,
    CASE WHEN open_source THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS open_source, 0.5::DOUBLE AS sentiment_score FROM entities""",
)
def _(t):
    docs = t.sql("""
SELECT concat('{"model_families":{"', family, '":{', CASE WHEN ord % 7 = 0 THEN '' ELSE concat('"organization":"', organization, '",') END,
  '"models":{"', entity, '":{"parameters":"', parameters, '"', CASE WHEN open_source THEN ',"open_source":true' ELSE '' END, '}}}}}') AS doc
FROM entities""")
    return knowledge.read_entity_features(docs)


@query(
    "S6_read_item_features",
    "SELECT item, category, CAST(num_samples AS BIGINT) AS num_samples, CAST(least(n_subcategories, 2) AS INT) AS n_subcategories FROM items",
)
def _(t):
    docs = t.sql("""
SELECT concat('{"benchmarks":{"', item, '":{"category":"', category, '","num_samples":"', cast(num_samples AS string), ' items"',
  CASE WHEN n_subcategories >= 2 THEN ',"subcategories":["x","y"]' WHEN n_subcategories = 1 THEN ',"subcategories":["x"]' ELSE '' END,
  '}}}') AS doc FROM items""")
    return knowledge.read_item_features(docs).select("item", "category", "num_samples", "n_subcategories")


@query(
    "S7_read_components",
    """SELECT DISTINCT language_model AS component, 'language' AS kind, 'f1|f2' AS features FROM entities
    UNION ALL SELECT DISTINCT vision_model, 'vision', 'f1|f2' FROM entities""",
)
def _(t):
    docs = """
SELECT concat('{"components":{"', c, '":{"organization":"o","key_features":["f1","f2"],"used_by_count":3}}}') AS doc
FROM (SELECT DISTINCT {column} AS c FROM entities) x"""
    both = [
        knowledge.read_components(t.sql(docs.replace("{column}", column)), kind)
        for column, kind in (("language_model", "language"), ("vision_model", "vision"))
    ]
    return both[0].unionByName(both[1]).select("component", "kind", F.array_join("key_features", "|").alias("features"))


@query(
    "S8_parse_prediction_table",
    """SELECT entity, item, cast(printf('%.2f', prediction) AS DOUBLE) AS prediction, uncertainty,
    cast(printf('%.2f', truth) AS DOUBLE) AS truth FROM predictions""",
)
def _(t):
    path = new_table_path(t.spark, "table")
    scores.write_wide(scores.format_prediction_table(t.predicted), path)
    return scores.parse_prediction_cells(scores.read_wide_cells(t.spark, path)[0])


_CELLS = ", ".join(
    f"""coalesce(max(CASE WHEN item = '{i}' THEN concat('[', printf('%.2f', prediction), '±', printf('%.2f', uncertainty), ']/[', printf('%.2f', truth), ']') END), '-') AS "{i}\""""
    for i in _ITEMS
)


@query("S9_format_prediction_table", f'SELECT entity AS "Model", {_CELLS} FROM predictions GROUP BY entity')
def _(t):
    path = new_table_path(t.spark, "table")
    scores.write_wide(scores.format_prediction_table(t.predicted), path)
    return t.spark.read.csv(path, header=True)


_SIDES = """
u AS (SELECT c_name AS id, c_acctbal / 1000 AS x, 1.0 * c_nationkey AS y FROM customer),
v AS (SELECT p_brand AS id, sum(p_size) / 1000 AS x, count(*) / 10 AS y FROM part GROUP BY p_brand)"""


def _vectors(t, side):
    return t.sql(f"WITH {_SIDES} SELECT id, array(cast(x AS double), cast(y AS double)) AS vec FROM {side}")


@query("S10_write_raw_matrix", f"WITH {_SIDES} SELECT u.id AS entity, v.id AS item, round(u.x * v.x + u.y * v.y, 10) AS prediction FROM u, v")
def _(t):
    path = new_table_path(t.spark, "matrix")
    sides = [_vectors(t, side).select(F.lit(side).alias("side"), F.lit(0).alias("draw"), "id", "vec") for side in "uv"]
    scores.write_matrix(full_matrix(sides[0].unionByName(sides[1])), path)
    return t.spark.read.parquet(path).select("entity", "item", rounded("prediction", 10).alias("prediction"))


@query(
    "S10_write_uncertainty_matrix",
    f"""WITH {_SIDES}, st AS (SELECT item, avg(score) AS mu, stddev_pop(score) AS sigma FROM scores GROUP BY item),
    d AS (SELECT u.id AS entity, v.id AS item, (u.x + d) * v.x + u.y * (v.y - d) AS p FROM u, v, (SELECT unnest(range(0, 4)) AS d) k)
    SELECT entity, d.item, round(avg(p) * any_value(sigma) + any_value(mu), 3) AS prediction, round(stddev_pop(p) * any_value(sigma), 3) AS uncertainty
    FROM d JOIN st ON st.item = d.item GROUP BY 1, 2""",
)
def _(t):
    path, number = new_table_path(t.spark, "matrix"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("draw")
    u = _vectors(t, "u").select(F.lit("u").alias("side"), number, "id", "vec").withColumn("vec", F.array(F.col("vec")[0] + F.col("draw"), F.col("vec")[1]))
    v = _vectors(t, "v").select(F.lit("v").alias("side"), number, "id", "vec").withColumn("vec", F.array(F.col("vec")[0], F.col("vec")[1] - F.col("draw")))
    scores.write_matrix(full_matrix(u.unionByName(v), item_stats(t.scores)), path)
    return t.spark.read.parquet(path).select("entity", "item", rounded("prediction", 3).alias("prediction"), rounded("uncertainty", 3).alias("uncertainty"))


@query(
    "S11_write_results",
    """SELECT 'flat' AS part, entity, item, truth, prediction, uncertainty, NULL AS marks FROM predictions
    UNION ALL SELECT 'detail', entity, item, truth, prediction, uncertainty, concat(item, '|', entity) FROM predictions
    UNION ALL SELECT 'metrics', NULL, NULL, NULL, count(*)::DOUBLE, NULL, NULL FROM predictions
    UNION ALL SELECT 'metadata', '1.0', NULL, NULL, count(*)::DOUBLE, NULL, NULL FROM predictions""",
)
def _(t):
    path = new_table_path(t.spark, "results")
    nested = t.predicted.withColumn("marks", F.array("item", "entity"))
    scores.write_results(nested, t.predicted.agg(F.count(F.lit(1)).alias("n_samples")), path)
    numbers = [F.col(c).cast("double").alias(c) for c in ("truth", "prediction", "uncertainty")]
    flat = t.spark.read.csv(f"{path}/flat", header=True).select(F.lit("flat").alias("part"), "entity", "item", *numbers, F.lit(None).cast("string").alias("marks"))
    detail = t.spark.read.parquet(f"{path}/detail").select(F.lit("detail").alias("part"), "entity", "item", *numbers, F.array_join("marks", "|").alias("marks"))
    none = {c: F.lit(None).cast("string") for c in ("item", "marks")} | {c: F.lit(None).cast("double") for c in ("truth", "uncertainty")}
    metrics = t.spark.read.parquet(f"{path}/metrics").select(F.lit("metrics").alias("part"), F.lit(None).cast("string").alias("entity"), F.col("n_samples").cast("double").alias("prediction"))
    about = t.spark.read.json(f"{path}/metadata").select(F.lit("metadata").alias("part"), F.col("version").alias("entity"), F.col("total_samples").cast("double").alias("prediction"))
    return flat.unionByName(detail).unionByName(metrics.unionByName(about).withColumns(none).select(*flat.columns))


@query("S12_read_done_keys", "SELECT entity, item FROM test_cells")
def _(t):
    path = new_table_path(t.spark, "results")
    t.predicted.write.parquet(path)
    return scores.read_done_keys(t.spark, path)


@query(
    "S13_read_cold_start",
    """SELECT 'truth' AS part, s.entity, s.item, s.score AS truth, NULL AS parameters FROM scores s JOIN entities e ON s.entity = e.entity WHERE e.release_date >= '2001/07'
    UNION ALL SELECT 'entity', entity, NULL, NULL, parameters FROM entities WHERE release_date >= '2001/07'""",
)
def _(t):
    from scoreweave.functions.fields import is_recent
    from scoreweave.plans.views import CUTOFF

    path = new_table_path(t.spark, "new")
    new = t.entities.filter(is_recent(F.col("release_date"), CUTOFF)).select("entity", F.col("parameters").alias("Parameters"))
    scores.write_wide_scores(t.scores, path, new)
    entities, truth = scores.read_cold_start(t.spark, path)
    text, number = F.lit(None).cast("string"), F.lit(None).cast("double")
    truth = truth.select(F.lit("truth").alias("part"), "entity", "item", "truth", text.alias("parameters"))
    about = entities.select(F.lit("entity").alias("part"), F.col("Model").alias("entity"), text.alias("item"), number.alias("truth"), F.col("Parameters").alias("parameters"))
    return truth.unionByName(about)


@query("S14_item_names", "SELECT 'item' AS kind, item AS name FROM scores GROUP BY item UNION ALL SELECT 'entity', entity FROM scores GROUP BY entity")
def _(t):
    items = scores.item_names(t.scores).select(F.lit("item").alias("kind"), F.col("item").alias("name"))
    return items.unionByName(scores.distinct_entities(t.scores).select(F.lit("entity").alias("kind"), F.col("entity").alias("name")))
