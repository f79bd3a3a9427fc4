"""Spread ranking against plain Python, with hot keys and many ties."""

import random

import pytest
from pyspark.sql import functions as F

from scoreweave.operators import metrics, split
from scoreweave.operators.evidence import predicted_ranks, rank_neighbours, score_ranks
from scoreweave.operators.spread import first_per_key, ranked, running_counts


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    # One key holds most rows, and a third of all values are the same.
    return [(("hot" if rng.random() < 0.7 else f"k{rng.randrange(9)}"), f"e{i:04d}", 1.0 if rng.random() < 0.33 else float(rng.randrange(40))) for i in range(900)]


def test_rank_total_and_ties(spark, rows):
    df = spark.createDataFrame(rows, "item string, entity string, score double").repartition(7)
    got = ranked(df, ["item"], [F.col("score").desc(), F.col("entity")], total="n", ties=("score", "lo", "hi")).collect()
    groups = {}
    for item, entity, score in rows:
        groups.setdefault(item, []).append((-score, entity))
    for group in groups.values():
        group.sort()
    assert len(got) == len(rows)
    for r in got:
        group = groups[r["item"]]
        assert group[r["rank"] - 1] == (-r["score"], r["entity"])
        same = [i + 1 for i, g in enumerate(group) if g[0] == -r["score"]]
        assert (r["n"], r["lo"], r["hi"]) == (len(group), same[0], same[-1])


def test_running_counts(spark, rows):
    df = spark.createDataFrame(rows, "item string, entity string, score double").repartition(5)
    got = running_counts(df, ["item"], [F.col("entity")], {"high": F.col("score") > 20, "all": F.lit(True)}).collect()
    for r in got:
        before = [x for x in rows if x[0] == r["item"] and x[1] <= r["entity"]]
        assert r["all"] == len(before)
        assert r["high"] == sum(x[2] > 20 for x in before)


def test_first_per_key(spark, rows):
    df = spark.createDataFrame(rows, "item string, entity string, score double")
    got = {(r["item"], r["entity"]) for r in first_per_key(df, ["item"], [F.col("entity")], 2).collect()}
    want = set()
    for item in {r[0] for r in rows}:
        want |= {(item, e) for e in sorted(x[1] for x in rows if x[0] == item)[:2]}
    assert got == want


def test_group_limit_reaches_the_map_side(spark, rows):
    df = spark.createDataFrame(rows, "item string, entity string, score double").repartition(4)
    plan = first_per_key(df, ["item"], [F.col("entity")], 2)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def _kendall(pairs):
    conc = disc = tx = ty = 0
    for i, (a, b) in enumerate(pairs):
        for c, d in pairs[:i]:
            s = (a > c) - (a < c)
            u = (b > d) - (b < d)
            tx += s != 0
            ty += u != 0
            conc += s * u > 0
            disc += s * u < 0
    return (conc - disc) / (tx * ty) ** 0.5


@pytest.mark.parametrize("block", [None, 7, 64])
def test_kendall_with_ties_in_blocks(spark, block):
    rng = random.Random(5)
    pairs = [(float(rng.randrange(12)), float(rng.randrange(15))) for _ in range(200)]
    df = spark.createDataFrame(
        [(f"e{i}", "x", p, q) for i, (p, q) in enumerate(pairs)], "entity string, item string, prediction double, truth double"
    )
    got = metrics.krcc(metrics.pooled_positions(df), block).first()["krcc"]
    assert got == pytest.approx(_kendall(pairs), abs=1e-12)


@pytest.mark.parametrize("hot", [0.0, 0.7])
def test_spearman_with_ties(spark, hot):
    rng = random.Random(6)
    pairs = [(1.0 if rng.random() < hot else float(rng.randrange(12)), float(rng.randrange(9))) for _ in range(300)]
    rows = [(f"e{i}", "x", p, q) for i, (p, q) in enumerate(pairs)] + [("n", "x", None, 1.0), ("m", "x", 2.0, None)]
    df = spark.createDataFrame(rows, "entity string, item string, prediction double, truth double")
    rank = lambda v, all_: sum(x < v for x in all_) + (sum(x == v for x in all_) + 1) / 2
    xs, ys = zip(*pairs, strict=True)
    a, b = [rank(x, xs) for x in xs], [rank(y, ys) for y in ys]
    ma, mb = sum(a) / len(a), sum(b) / len(b)
    cov = sum((x - ma) * (y - mb) for x, y in zip(a, b, strict=True))
    want = cov / (sum((x - ma) ** 2 for x in a) * sum((y - mb) ** 2 for y in b)) ** 0.5
    assert metrics.srcc(df).first()["srcc"] == pytest.approx(want, abs=1e-12)
    assert metrics.srcc(df.withColumn("truth", F.lit(3.0))).first()["srcc"] is None


def test_rank_metrics_of_a_monotone_map_are_one(spark):
    df = spark.range(60).select(
        F.concat(F.lit("e"), "id").alias("entity"), F.lit("x").alias("item"), F.col("id").cast("double").alias("truth"),
        (F.col("id") * F.col("id")).cast("double").alias("prediction"),
    )
    positions = metrics.pooled_positions(df)
    assert metrics.srcc(positions).first()["srcc"] == pytest.approx(1)
    assert metrics.krcc(positions).first()["krcc"] == pytest.approx(1)
    assert metrics.mae_at_3(df).first()["mae3"] == 1


def test_metrics_of_nothing(spark):
    none = spark.createDataFrame([], "entity string, item string, truth double, prediction double")
    ranges = spark.createDataFrame([], "item string, lo double, hi double")
    zero = metrics.metrics_report(none, ranges).first().asDict()
    assert all(v == 0 for v in zero.values())
    gone = metrics.metrics_report(none, ranges, empty=None).first().asDict()
    assert gone["mae"] is None and gone["n_samples"] == 0


def test_nearest_rank_against_brute_force(spark, rows):
    scores = [(i, e, s) for i, e, s in rows]
    rng = random.Random(9)
    targets = [(f"t{j}", rng.choice(["hot", "k1", "k2", "k3"]), round(rng.uniform(-3, 45) * 2) / 2) for j in range(120)]
    s = spark.createDataFrame(scores, "item string, entity string, score double")
    t = spark.createDataFrame(targets, "entity string, item string, prediction double")
    got = {(r["entity"], r["item"]): r["predicted_rank"] for r in predicted_ranks(t, score_ranks(s)).collect()}
    peers = {}
    for r in rank_neighbours(t, s, k=4).collect():
        peers.setdefault((r["entity"], r["item"]), set()).add((r["rank"], r["peer"]))
    for entity, item, p in targets:
        order = sorted([(-x[2], x[1]) for x in scores if x[0] == item])
        best = min(range(len(order)), key=lambda i: (abs(-order[i][0] - p), i)) + 1
        assert got[(entity, item)] == best
        lo, hi = max(1, best - 4), min(len(order), best + 4)
        assert peers[(entity, item)] == {(r, order[r - 1][1]) for r in range(lo, hi + 1)}


def test_items_with_two_scores_have_no_neighbours(spark):
    s = spark.createDataFrame([("x", "a", 1.0), ("x", "b", 2.0)], "item string, entity string, score double")
    t = spark.createDataFrame([("t", "x", 1.5)], "entity string, item string, prediction double")
    assert rank_neighbours(t, s).count() == 0


def test_split_is_a_partition_and_keeps_one_test_cell(spark):
    scores = spark.createDataFrame(
        [("new", f"i{j}", float(j)) for j in range(5)] + [("one", "i1", 3.0), ("old", "i1", 1.0), ("undated", "i2", 1.0)],
        "entity string, item string, score double",
    )
    entities = spark.createDataFrame(
        [("new", "2025/01/03"), ("one", "2025/2/1"), ("old", "2024/12/31"), ("undated", None), ("bad", "soon")],
        "entity string, release_date string",
    )
    parts = split.holdout_split(scores, entities, "2025/01/01").collect()
    assert sorted((r["entity"], r["item"], r["score"]) for r in parts) == sorted(tuple(r) for r in scores.collect())
    tests = [r["entity"] for r in parts if r["part"] == "test"]
    assert tests.count("new") == 2 and tests.count("one") == 1 and set(tests) == {"new", "one"}
    again = split.holdout_split(scores.repartition(9), entities, "2025/01/01").collect()
    assert sorted(map(tuple, parts)) == sorted(map(tuple, again))


def test_slices_are_contiguous_and_even(spark):
    t = spark.createDataFrame([(f"e{i:02d}", "x") for i in range(10)], "entity string, item string")
    got = {r["entity"]: r["batch"] for r in split.batch_slice(t, 4).collect()}
    assert [got[f"e{i:02d}"] for i in range(10)] == [0, 0, 0, 1, 1, 1, 2, 2, 2, 3]
    assert split.batch_slice(t, 2, max_samples=5).count() == 5
