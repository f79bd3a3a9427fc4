"""Factor models on planted data; nearest neighbours against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreweave.operators import factorize, similar
from scoreweave.session import cut_lineage


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(0)
    u, v = rng.normal(size=(60, 2)), rng.normal(size=(20, 2))
    full = u @ v.T + rng.normal(scale=0.3, size=(60, 20))
    mask = rng.random((60, 20)) < 0.5
    cells = [(f"e{i:02d}", f"i{j:02d}", float(full[i, j]), bool(mask[i, j])) for i in range(60) for j in range(20)]
    return spark.createDataFrame(cells, "entity string, item string, score double, seen boolean").cache()


def test_factors_beat_the_means(spark, planted):
    train, test = planted.filter("seen").drop("seen"), planted.filter("NOT seen").drop("seen")
    draws = factorize.fit_pmf(train, dim=2, draws=8, tune=6, seed=1)
    got = factorize.posterior_summary(factorize.predict_packed(test.select("entity", "item"), draws))
    base = factorize.mean_of_means(test.select("entity", "item"), train)

    def rmse(p):
        return p.join(test, ["entity", "item"]).agg(F.sqrt(F.avg((F.col("prediction") - F.col("score")) ** 2))).first()[0]

    assert rmse(got) < 0.75 * rmse(base)
    assert got.count() == test.count()


def test_same_seed_same_draws_whatever_the_partitions(spark, planted):
    train = planted.filter("seen").drop("seen")

    def run(df, **more):
        out = factorize.fit_pmf(df, dim=2, draws=1, tune=1, seed=7, **more).collect()
        return {(r["side"], r["id"]): np.array(r["vec"]) for r in out}

    one = run(train.coalesce(1))
    two = run(train.repartition(8), share=40)  # and with hot ids cut into shares
    assert one.keys() == two.keys()
    assert max(np.abs(one[k] - two[k]).max() for k in one) < 1e-9


def test_a_half_sweep_of_the_larger_side_shuffles_nothing(spark, planted):
    train = planted.filter("seen").select("entity", "item", "score")
    laid = factorize._Observations(train, 1000)
    try:
        few, many = ("entity", "item") if train.select("entity").distinct().count() < train.select("item").distinct().count() else ("item", "entity")
        ids = laid.lay(train.select(F.col(many).alias("id")).distinct(), "id")
        other = cut_lineage(train.select(F.col(few).alias("id")).distinct().withColumn("vec", F.expr("array(1.0D, -1.0D)")))
        drawn = factorize._half_sweep(laid, ids, other, None, many, many, few, 2, 2.0, "1:0:u", False)
        plan = drawn._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastExchange" in plan and "Exchange hashpartitioning" not in plan
        assert drawn.count() == ids.count()
    finally:
        laid.forget()


def test_both_layouts_give_the_same_draws(spark, planted, monkeypatch):
    train = planted.filter("seen").drop("seen")
    feats = train.select(F.col("entity").alias("id"), F.lit("f").alias("feature"), F.lit(1.0).alias("value")).distinct()
    items = train.select(F.col("item").alias("id"), F.lit("g").alias("feature"), F.lit(0.5).alias("value")).distinct()

    def run(few, share):
        monkeypatch.setattr(factorize, "_FEW", few)
        return {(r["side"], r["id"]): np.array(r["vec"]) for r in factorize.fit_cpmf(train, feats, items, dim=2, draws=1, tune=1, seed=7, share=share).collect()}

    one = run(1 << 24, 1000)
    for few, share in ((0, 1000), (1 << 24, 5), (0, 40)):
        other = run(few, share)
        assert one.keys() == other.keys() and max(np.abs(one[k] - other[k]).max() for k in one) < 1e-9


def test_zero_features_change_nothing(spark, planted):
    train = planted.filter("seen").drop("seen")
    plain = factorize.fit_pmf(train, dim=2, draws=1, tune=1, seed=3)
    zeros = train.select(F.col("entity").alias("id")).distinct().withColumn("feature", F.lit("f")).withColumn("value", F.lit(0.0))
    zero_items = train.select(F.col("item").alias("id")).distinct().withColumn("feature", F.lit("g")).withColumn("value", F.lit(0.0))
    same = factorize.fit_cpmf(train, zeros, zero_items, dim=2, draws=1, tune=1, seed=3)
    a = {(r["side"], r["id"]): np.array(r["vec"]) for r in plain.collect()}
    b = {(r["side"], r["id"]): np.array(r["vec"]) for r in same.collect()}
    assert a.keys() == b.keys() and max(np.abs(a[k] - b[k]).max() for k in a) < 1e-9


def test_features_reach_ids_without_observations(spark):
    rng = np.random.default_rng(2)
    groups = {f"e{i:02d}": i % 2 for i in range(40)}
    obs = [(e, f"i{j}", float((3 if g else -3) + rng.normal(scale=0.2))) for e, g in groups.items() for j in range(6) if e not in ("e00", "e01")]
    train = spark.createDataFrame(obs, "entity string, item string, score double")
    feats = spark.createDataFrame([(e, f"g={g}", 1.0) for e, g in groups.items()], "id string, feature string, value double")
    items = spark.createDataFrame([(f"i{j}", "all", 1.0) for j in range(6)], "id string, feature string, value double")
    ids = spark.createDataFrame([(e,) for e in groups], "id string")
    draws = factorize.fit_cpmf(train, feats, items, dim=2, draws=10, tune=8, seed=5, entity_ids=ids)
    cells = spark.createDataFrame([("e00", "i1"), ("e01", "i1")], "entity string, item string")
    got = {r["entity"]: r["prediction"] for r in factorize.posterior_summary(factorize.predict_packed(cells, draws)).collect()}
    assert got["e00"] < -0.5 and got["e01"] > 0.5


def test_more_observations_less_uncertainty(spark):
    rng = np.random.default_rng(4)
    obs = [(f"e{i}", f"i{j}", float(rng.normal())) for i in range(30) for j in range(12) if not (i == 0 and j > 1)]
    train = spark.createDataFrame(obs, "entity string, item string, score double")
    draws = factorize.fit_pmf(train, dim=2, draws=20, tune=5, seed=6).filter("side = 'u'")
    spread = draws.groupBy("id").agg((F.stddev(F.col("vec")[0]) + F.stddev(F.col("vec")[1])).alias("s"))
    few = spread.filter("id = 'e0'").first()["s"]
    many = spread.filter("id <> 'e0'").agg(F.avg("s")).first()[0]
    assert few > many


def _side(spark, rows, dense):
    return factorize._Side(spark.createDataFrame(rows, "id string, feature string, value double"), 3, dense)


def test_weights_by_steps_are_those_solved_in_one_place(spark):
    rng = np.random.default_rng(9)
    rows = [(f"e{i}", f"g={rng.integers(12)}", 1.0) for i in range(80)] + [(f"e{i}", "size", float(rng.normal())) for i in range(80)]
    rows += [(f"e{i}", "twice", 0.5) for i in range(9) for _ in range(2)]
    vectors = spark.createDataFrame([(f"e{i}", rng.normal(size=3).tolist()) for i in range(80)], "id string, vec array<double>")
    one, many = _side(spark, rows, 1000), _side(spark, rows, 5)
    assert one.names and many.names is None
    a = {r["feature"]: np.array(r["w"]) for r in one.draw_weights(vectors, "1:0:u").collect()}
    b = {r["feature"]: np.array(r["w"]) for r in many.draw_weights(vectors, "1:0:u").collect()}
    assert a.keys() == b.keys() and max(np.abs(a[k] - b[k]).max() for k in a) < 1e-8


def test_weights_have_the_posterior_mean_and_spread(spark):
    rows = [(f"e{i}", f"g={i % 2}", 1.0) for i in range(40)]
    vectors = spark.createDataFrame([(f"e{i}", [float(i % 2), 2.0, -1.0]) for i in range(40)], "id string, vec array<double>")
    side = _side(spark, rows, 1000)
    drawn = np.array([[r["w"] for r in sorted(side.draw_weights(vectors, f"1:{k}:u").collect())] for k in range(60)])
    want = np.array([[0.0, 40.0, -20.0], [20.0, 40.0, -20.0]]) / 21
    assert np.abs(drawn.mean(axis=0) - want).max() < 0.12 and np.abs(drawn.std(axis=0) - 21**-0.5).max() < 0.09


def test_twenty_thousand_features(spark):
    """More features than are solved for in one place: an id of its own for each entity, and its group."""
    train = spark.range(20000).selectExpr("concat('e', id) AS entity", "concat('i', id % 7) AS item", "IF(id % 2 = 0, 2.0D, -2.0D) AS score")
    features = train.selectExpr("entity AS id", "explode(array(entity, IF(score > 0, 'even', 'odd'))) AS feature", "1.0D AS value")
    items = spark.createDataFrame([(f"i{j}", "all", 1.0) for j in range(7)], "id string, feature string, value double")
    draws = factorize.fit_cpmf(train, features, items, dim=1, draws=1, tune=1, seed=2)
    got = factorize.posterior_summary(factorize.predict_packed(train.select("entity", "item"), draws)).join(train, ["entity", "item"])
    assert got.filter("prediction IS NOT NULL").count() == 20000
    assert got.select(F.corr("prediction", "score")).first()[0] > 0.5


def test_cells_without_vectors_stay(spark):
    draws = spark.createDataFrame(
        [("u", d, "a", [1.0 + d, 0.0]) for d in range(3)] + [("v", d, "x", [2.0, 1.0]) for d in range(1, 4)], "side string, draw int, id string, vec array<double>"
    )
    cells = spark.createDataFrame([("a", "x"), ("b", "x"), ("a", "y")], "entity string, item string")
    got = {(r["entity"], r["item"]): r for r in factorize.posterior_summary(factorize.predict_packed(cells, draws)).collect()}
    assert got["a", "x"]["prediction"] == 5.0 and got["a", "x"]["n_draws"] == 2 and got["a", "x"]["uncertainty"] == 1.0  # draws 1 and 2
    assert got["b", "x"]["prediction"] is None and got["a", "y"]["n_draws"] == 0
    assert {(r["draw"], r["prediction"]) for r in factorize.predict_draws(cells, draws).collect()} == {(1, 4.0), (2, 6.0)}
    u, v = (draws.filter(f"side = '{s}' AND draw = 1").select("id", "vec") for s in "uv")
    assert sorted(factorize.predict(cells, u, v).collect(), key=str)[1]["prediction"] is None


def test_raw_matrix_of_fifty_thousand_items(spark):
    u = spark.range(3).selectExpr("'u' AS side", "explode(array(0, 1)) AS draw", "concat('e', id) AS id", "array(id + draw, 1.0D) AS vec")
    v = spark.range(50000).selectExpr("'v' AS side", "explode(array(0, 1)) AS draw", "concat('i', id) AS id", "array(CAST(id % 100 AS DOUBLE), 2.0D * draw) AS vec")
    stats = spark.range(49999).selectExpr("concat('i', id) AS item", "10.0D AS mu", "2.0D AS sigma")
    draws = u.unionByName(v).selectExpr("side", "draw", "id", "transform(vec, x -> CAST(x AS DOUBLE)) AS vec")
    out = factorize.full_matrix(draws, stats).cache()
    assert out.count() == 150000 and out.select("entity", "item").distinct().count() == 150000
    got = {(r["entity"], r["item"]): (r["prediction"], r["uncertainty"]) for r in out.filter("item IN ('i7', 'i49999')").collect()}
    assert got["e2", "i7"] == ((14 + 23) / 2 * 2 + 10, 4.5 * 2)
    assert got["e0", "i49999"][0] is None  # an item without a scale
    plain = factorize.full_matrix(draws.filter("draw = 0 AND (side = 'u' OR id = 'i7')"), block=2)
    assert sorted((r["entity"], r["prediction"], r["uncertainty"]) for r in plain.collect()) == [("e0", 0.0, 0.0), ("e1", 7.0, 0.0), ("e2", 14.0, 0.0)]


def test_a_task_of_the_full_matrix_gets_few_pairs_of_blocks(spark):
    u = spark.range(40).selectExpr("'u' AS side", "0 AS draw", "concat('e', id) AS id", "array(CAST(id AS DOUBLE)) AS vec")
    v = spark.range(8).selectExpr("'v' AS side", "0 AS draw", "concat('i', id) AS id", "array(CAST(id AS DOUBLE)) AS vec")
    out = factorize.full_matrix(u.unionByName(v), block=2)  # 20 blocks times 4, of 2 times 2 cells
    per_task = out.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert out.count() == 320 and per_task <= (factorize._PAIRS + 3) * 4
    assert out.filter("prediction <> CAST(substr(entity, 2) AS INT) * CAST(substr(item, 2) AS INT)").count() == 0


def test_the_sampler_leaves_only_its_draws(spark, planted):
    import os

    folder = spark.conf.get("spark.checkpoint.dir")
    train = planted.filter("seen").drop("seen")
    before, tables = set(os.listdir(folder)), spark.catalog.listTables()
    draws = factorize.fit_pmf(train, dim=1, draws=2, tune=3, seed=1)
    new = {d for d in os.listdir(folder) if d not in before}
    kept = next(d for d in new if d.startswith("draws"))
    assert sorted(os.listdir(f"{folder}/{kept}/side=u")) == ["draw=3", "draw=4"]
    assert not any(d.startswith("observations") for d in new) and spark.catalog.listTables() == tables
    assert draws.select("draw").distinct().count() == 2


def test_the_small_side_takes_one_task(spark):
    import os

    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder))
    train = spark.range(40_000).selectExpr("concat('e', id % 4000) AS entity", "concat('i', id div 4000) AS item", "cast(id % 7 - 3 AS double) AS score")
    factorize.fit_pmf(train, dim=1, draws=1, tune=0, seed=1)
    kept = next(d for d in os.listdir(folder) if d not in before and d.startswith("draws"))
    assert len([f for f in os.listdir(f"{folder}/{kept}/side=v/draw=0") if f.startswith("part-")]) == 1


def test_ids_of_the_observations_given_or_not_and_null_ones(spark, planted):
    train = planted.filter("seen").select("entity", "item", "score")
    train = train.unionByName(spark.createDataFrame([(None, "i1", 0.5), ("e1", None, 1.5), (None, "i2", 2.5)], "entity string, item string, score double"))
    settings = {"dim": 2, "draws": 2, "tune": 1, "seed": 4}
    given = factorize.fit_pmf(train, entity_ids=train.select("entity").distinct(), item_ids=train.select("item").distinct(), **settings)
    rows = lambda df: {(r["side"], r["draw"], r["id"]): np.round(r["vec"], 9).tolist() for r in df.collect()}
    assert rows(factorize.fit_pmf(train, **settings)) == rows(given)


def _brute(new, known, k):
    out = {}
    for i, a in new.items():
        sims = []
        for j, b in known.items():
            a_, b_ = np.array(a), np.array(b)
            sims.append((-round(float(a_ @ b_ / ((np.linalg.norm(a_) + 1e-8) * (np.linalg.norm(b_) + 1e-8))), 9) + 0.0, j))
        out[i] = [j for _, j in sorted(sims)[:k]]
    return out


@pytest.mark.parametrize("cells,block", [(None, 2048), (9, 5), (1, 3)])
def test_top_k_is_exact(spark, cells, block):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(6, 3)) * 4
    known = {f"k{i:03d}": (centres[i % 6] + rng.normal(scale=0.4, size=3)).round(3).tolist() for i in range(150)}
    known |= {f"z{i}": [0.0, 0.0, 0.0] for i in range(12)} | {f"c{i:02d}": known["k000"] for i in range(40)}  # zeros, copies
    new = {f"n{i}": (centres[i % 6] + rng.normal(scale=0.5, size=3)).round(3).tolist() for i in range(20)}
    new |= {"zero": [0.0, 0.0, 0.0], "copy": known["k000"], "twin": known["k000"], "away": [-9.0, -9.0, 9.0]}
    n = spark.createDataFrame(list(new.items()), "id string, vec array<double>")
    h = spark.createDataFrame(list(known.items()), "id string, vec array<double>")
    got = {}
    for r in similar.top_k_similar(n, h, 7, cells, block).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["known_id"])
    assert got == _brute(new, known, 7)


def _shuffled(df):
    """Bytes of the rows that the exchanges of a collected result got."""
    todo, total = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        kind, below = node.getClass().getSimpleName(), node.children()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        elif kind == "ShuffleExchangeExec":
            total += node.metrics().apply("dataSize").value()
        todo += [below.apply(i) for i in range(below.size())]
    return total


@pytest.mark.parametrize("hashing,copies", [(None, 24), (similar.Hashing(bucket=32), 64)])
def test_search_without_clusters_copies_few_vectors(spark, monkeypatch, hashing, copies):
    sent = []

    def held(df):
        rows = df.collect()
        sent.append(_shuffled(df))
        return spark.createDataFrame(rows, df.schema)

    monkeypatch.setattr(similar, "cut_lineage", held)
    rng = np.random.default_rng(6)
    rows = [(f"v{i}", v) for i, v in enumerate(rng.normal(size=(1500, 64)).tolist())]  # nearly all cells can hold a neighbour
    v = spark.createDataFrame(rows, "id string, vec array<double>")
    got = similar.top_k_similar(v, v, 5, hashing=hashing)
    found = got.collect()
    assert len(found) == 7500 and all(r["id"] == r["known_id"] for r in found if r["rank"] == 1)
    assert sum(sent) + _shuffled(got) < copies * 1500 * 64 * 8  # not one for each cell (38), or bucket looked into (72)
    if hashing is None:
        want, near = _brute(dict(rows[:20]), dict(rows), 5), {}
        for r in sorted(found, key=lambda r: r["rank"]):
            near.setdefault(r["id"], []).append(r["known_id"])
        assert {i: near[i] for i in want} == want


def test_search_is_the_same_on_many_shelves_and_parts(spark, monkeypatch):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(5, 8)) * 3
    known = {f"k{i:03d}": (centres[i % 5] + rng.normal(scale=0.4, size=8)).round(3).tolist() for i in range(400)}
    known |= {f"z{i}": [0.0] * 8 for i in range(9)} | {f"c{i:02d}": known["k000"] for i in range(30)}  # zeros, copies
    known |= {f"l{i:02d}": (np.array(known["k001"]) * (i + 2)).tolist() for i in range(90)}  # one direction: a hot bucket
    new = {f"n{i}": (centres[i % 5] + rng.normal(scale=0.5, size=8)).round(3).tolist() for i in range(60)}
    new |= {"zero": [0.0] * 8, "copy": known["k000"], "twin": known["k000"], "line": known["k001"]}
    n = spark.createDataFrame(list(new.items()), "id string, vec array<double>")
    h = spark.createDataFrame(list(known.items()), "id string, vec array<double>")

    def near(**how):
        out = {}
        for r in similar.top_k_similar(n, h, 6, **how).orderBy("id", "rank").collect():
            out.setdefault(r["id"], []).append((r["known_id"], r["similarity"]))
        return out

    hashing = similar.Hashing(bucket=16)
    few = near(hashing=hashing)
    monkeypatch.setattr(similar, "_SHELF_BYTES", 20 * 8 * 8)
    monkeypatch.setattr(similar, "_PAIRS", 500)
    assert {i: [j for j, _ in found] for i, found in near(block=7).items()} == _brute(new, known, 6)
    assert near(hashing=hashing) == few


def test_vectors_without_numbers_come_last(spark):
    rng = np.random.default_rng(2)
    known = {f"k{i:02d}": rng.normal(size=3).tolist() for i in range(40)}
    odd = [("a0", [np.nan, 1.0, 0.0]), ("a1", [np.nan, 2.0, 0.0])]
    new = {f"n{i}": rng.normal(size=3).tolist() for i in range(5)}
    n = spark.createDataFrame([*new.items(), ("none", [np.nan, 0.0, 0.0])], "id string, vec array<double>")
    h = spark.createDataFrame([*known.items(), *odd], "id string, vec array<double>")
    got = {}
    for r in similar.top_k_similar(n, h, 4).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append((r["known_id"], r["similarity"] is None))
    assert [x for _, x in got.pop("none")] == [True] * 4
    assert got == {i: [(j, False) for j in found] for i, found in _brute(new, known, 4).items()}


def test_hashed_search_finds_nine_tenths(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 24))
    known = {f"k{i:04d}": (centres[i % 40] + rng.normal(scale=0.5, size=24)).tolist() for i in range(3000)}
    known |= {f"c{i:03d}": known["k0000"] for i in range(300)} | {"z": [0.0] * 24}  # a hot bucket, and no direction
    new = {f"n{i}": (centres[i % 40] + rng.normal(scale=0.5, size=24)).tolist() for i in range(60)} | {"copy": known["k0000"], "zero": [0.0] * 24}
    n = spark.createDataFrame(list(new.items()), "id string, vec array<double>")
    h = spark.createDataFrame(list(known.items()), "id string, vec array<double>")
    rows = similar.top_k_similar(n, h, 10, block=64, hashing=similar.Hashing(bucket=40)).collect()
    want, got = _brute(new, known, 10), {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        got.setdefault(r["id"], []).append(r["known_id"])
    assert all(len(v) == 10 == len(set(v)) for v in got.values()) and got.keys() == want.keys()
    assert sum(len(set(got[i]) & set(want[i])) for i in want) >= 0.9 * sum(map(len, want.values()))
    assert got["copy"] == want["copy"]


def test_hashed_search_leaves_planes_out_until_nine_tenths_are_found(spark):
    rng = np.random.default_rng(5)
    known = {f"k{i:04d}": v for i, v in enumerate(rng.normal(size=(6000, 32)).tolist())}  # no clusters: neighbours are far
    new = {f"n{i}": v for i, v in enumerate(rng.normal(size=(80, 32)).tolist())}
    n = spark.createDataFrame(list(new.items()), "id string, vec array<double>")
    h = spark.createDataFrame(list(known.items()), "id string, vec array<double>")
    rows = similar.top_k_similar(n, h, 5, hashing=similar.Hashing(bucket=8)).collect()
    got = {(r["id"], r["known_id"]) for r in rows}
    want = {(i, j) for i, near in _brute(new, known, 5).items() for j in near}
    assert len(rows) == 400 and len(got & want) >= 0.9 * len(want)


def test_hashed_search_of_few_vectors_is_exact(spark):
    n = spark.createDataFrame([("a", [1.0, 0.0])], "id string, vec array<double>")
    h = spark.createDataFrame([("x", [0.0, 1.0]), ("y", [1.0, 0.1])], "id string, vec array<double>")
    rows = similar.top_k_similar(n, h, 5, hashing=similar.Hashing(bucket=1)).orderBy("rank").collect()
    assert [r["known_id"] for r in rows] == ["y", "x"]
    assert similar.top_k_similar(n, h.limit(0), 5, hashing=similar.Hashing()).count() == 0
    assert similar.top_k_similar(n, h.limit(0), 5).count() == 0


def test_probes_cross_the_nearest_planes():
    margins = np.array([[0.1, -3.0, 0.2, 5.0], [-9.0, 0.5, 8.0, 0.4]])
    assert similar._flips(margins, 3).tolist() == [[1, 4, 5], [8, 2, 10]]


def test_fewer_known_than_k(spark):
    n = spark.createDataFrame([("a", [1.0, 0.0])], "id string, vec array<double>")
    h = spark.createDataFrame([("x", [0.0, 1.0]), ("y", [1.0, 0.1])], "id string, vec array<double>")
    got = [r["known_id"] for r in similar.top_k_similar(n, h, 5).orderBy("rank").collect()]
    assert got == ["y", "x"]


def test_cold_start_equals_the_weighted_vector(spark):
    cells = spark.createDataFrame([("n", "i")], "id string, item string")
    near = spark.createDataFrame([("n", "a", 0.9), ("n", "b", -0.2)], "id string, known_id string, similarity double")
    u = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [5.0, 0.0])], "id string, vec array<double>")
    v = spark.createDataFrame([("i", [0.5, 1.0])], "id string, vec array<double>")
    stats = spark.createDataFrame([("i", 10.0, 2.0)], "item string, mu double, sigma double")
    r = similar.cold_start(cells, near, u, v, stats).first()
    w = np.array([0.9 + 1e-8, 1e-8])
    vec = (w[:, None] * np.array([[1.0, 2.0], [5.0, 0.0]])).sum(0) / w.sum()
    assert r["prediction"] == pytest.approx(vec @ [0.5, 1.0] * 2 + 10)
    assert r["uncertainty"] == pytest.approx(0.0) and r["similar"] == "a;b"


def test_baselines(spark):
    train = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 3.0), ("b", "x", 5.0)], "entity string, item string, score double")
    cells = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "entity string, item string")
    got = {(r[0], r[1]): r[2] for r in factorize.mean_of_means(cells, train).collect()}
    assert got == {("a", "x"): pytest.approx((3 + 2 + 3) / 3), ("b", "y"): pytest.approx((3 + 5 + 3) / 3), ("c", "z"): 3.0}
    got = {(r[0], r[1]): r[2] for r in factorize.global_mean(cells, train).collect()}
    assert got == {("a", "x"): 1.0, ("b", "y"): 3.0, ("c", "z"): 3.0}
    drawn = {(r[0], r[1]): r[2] for r in factorize.uniform_random(cells, train, 1).collect()}
    assert drawn[("a", "x")] == 1.0 and all(1 <= x <= 5 for x in drawn.values())
