"""Files in and out, corrections, incremental results."""

import json

import pytest
from pyspark.sql import functions as F

from scoreweave.operators import dimensions, evidence, stats
from scoreweave.sources import knowledge, scores
from scoreweave.streaming.results import incremental_results


def test_leaderboard_document(spark, tmp_path):
    doc = {
        "time": "t",
        "results": {
            "A": {"META": {"Parameters": "7B", "Method": ["m", "https://huggingface.co/x/y"], "OpenSource": "Yes"}, "i": {"Overall": "61.5", "Sub": 1, "Overall (x)": 2, "Dir Name": "d"}, "j": {"Overall": "N/A"}},
            "B": {"META": {}, "i": {"Overall": 3}, "k": {"Sub": 4}, "note": "text", "n": {"Overall": None}},
        },
    }
    (tmp_path / "board.json").write_text(json.dumps(doc))
    docs = scores.read_documents(spark, str(tmp_path))
    assert sorted(map(tuple, scores.leaderboard_scores(docs).collect())) == [("A", "i", 61.5), ("B", "i", 3.0)]
    meta = {r["entity"]: r for r in scores.leaderboard_entities(docs).collect()}
    assert meta["A"]["official_url"] == "https://huggingface.co/x/y" and meta["B"]["parameters"] == ""
    subs = stats.collect_subcategories(scores.leaderboard_raw(docs)).collect()
    assert sorted(map(tuple, subs)) == [("i", "Sub"), ("k", "Sub")]


def test_filters_do_not_parse_documents_again(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"results":{"A":{"i":{"Overall":1,"Sub":2}}}}')
    docs = scores.read_documents(spark, str(tmp_path))
    for rows in (scores.leaderboard_scores(docs), scores.leaderboard_raw(docs), scores.member_lines(docs)):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert rows.count() > 0 and not [x for x in plan.splitlines() if "Filter" in x and "json" in x]


def test_prediction_cells(spark):
    wide = spark.createDataFrame([("m", "[67.59±5.73]/[66.80]", "[-1.5]/[2]", "-"), ("n", "[1.2.3]/[4]", "junk", None)], "Model string, a string, b string, c string")
    got = sorted(map(tuple, scores.parse_prediction_table(wide).collect()))
    assert got == [("m", "a", 67.59, 5.73, 66.8), ("m", "b", -1.5, None, 2.0)]


def test_wide_round_trip_and_results(spark, tmp_path):
    s = spark.createDataFrame([("a", "x.1", 1.5), ("a", "y", 2.0), ("b", "y", -3.25)], "entity string, item string, score double")
    scores.write_wide_scores(s, str(tmp_path / "wide"))
    back, entities = scores.read_wide_scores(spark, str(tmp_path / "wide"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, s.collect())) and entities.count() == 2
    results = s.withColumn("evidence", F.struct(F.lit(1).alias("n")))
    scores.write_results(results, spark.range(1), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/metadata")).first()["total_samples"] == 3
    assert "evidence" not in spark.read.csv(str(tmp_path / "out/flat"), header=True).columns
    assert scores.read_done_keys(spark, str(tmp_path / "out/detail")).count() == 3
    assert scores.read_done_keys(spark, str(tmp_path / "nowhere")).count() == 0


def test_prediction_table_round_trip_with_dotted_items(spark, tmp_path):
    rows = [("a", "x.1", 1.25, 0.5, 2.0), ("a", "y`z", -1.0, None, 3.0), ("b", "y`z", 4.0, 1.0, None)]
    p = spark.createDataFrame(rows, "entity string, item string, prediction double, uncertainty double, truth double")
    scores.write_wide(scores.format_prediction_table(p), str(tmp_path / "table"))
    cells, _ = scores.read_wide_cells(spark, str(tmp_path / "table"))
    assert {r["entity"] for r in cells.collect()} == {"a"}
    assert sorted(map(tuple, scores.parse_prediction_cells(cells).collect())) == [("a", "x.1", 1.25, 0.5, 2.0), ("a", "y`z", -1.0, None, 3.0)]


def test_wide_table_of_twenty_thousand_items(spark, tmp_path):
    rows = spark.range(20000).selectExpr("concat('e', id % 3) AS entity", "concat('i', id) AS item", "CAST(id AS DOUBLE) / 2 AS score")
    about = spark.createDataFrame([("e0", "7B", 'says "x, y"'), ("e9", None, " a\\b")], "entity string, Parameters string, Organization string")
    scores.write_wide_scores(rows, str(tmp_path / "wide"), about)
    back, entities = scores.read_wide_scores(spark, str(tmp_path / "wide"))
    want = rows.filter("entity = 'e0'")
    assert back.exceptAll(want).count() == want.exceptAll(back).count() == 0
    assert sorted(map(tuple, entities.collect())) == [("e0", "7B", 'says "x, y"'), ("e9", None, " a\\b")]
    lines = spark.read.text(str(tmp_path / "wide")).collect()
    assert {r[0].count(",") for r in lines if not r[0].startswith("e0")} == {20002}


def test_wide_lines_of_odd_cells(spark, tmp_path):
    rows = [("a", "x", "1"), ("a", "x", "1"), ("b,c", 'q"r', 'say "no", twice'), ("b,c", "z", None), ("d", " lead", "line\nend"), ("é", "\\", "😀")]
    cells = spark.createDataFrame(rows, "entity string, item string, text string")
    path = str(tmp_path / "odd")
    scores.write_wide(scores.wide_lines(cells), path)
    got = {(r["entity"], r["item"]): r["text"] for r in scores.read_wide_cells(spark, path)[0].collect()}
    assert got == {("a", "x"): "1", ("b,c", 'q"r'): 'say "no", twice', ("d", " lead"): "line end", ("é", "\\"): "😀"}
    spark_reads = {r["Model"]: r for r in spark.read.csv(path, header=True).collect()}
    assert spark_reads["b,c"]['q"r'] == 'say "no", twice' and spark_reads["é"]["\\"] == "😀" and spark_reads["a"]["z"] is None
    scores.write_wide(scores.wide_lines(cells.limit(0)), str(tmp_path / "none"))
    assert scores.read_wide_cells(spark, str(tmp_path / "none"))[0].count() == 0


def test_the_last_value_of_a_cell_counts(spark, tmp_path):
    board = lambda **items: json.dumps({"results": {"A": {"META": {"Org": f"o{items.get('i')}"}, **{k: {"Overall": v} for k, v in items.items()}}}})
    docs = spark.createDataFrame([(board(i=5, j=1), 1), (board(i=3, j="N/A"), 2)], "doc string, ord int")
    want = [("A", "i", 3.0), ("A", "j", 1.0)]
    assert sorted(map(tuple, scores.leaderboard_scores(docs).collect())) == want
    assert [r["organization"] for r in scores.leaderboard_entities(docs).collect()] == ["o3"]
    assert sorted(map(tuple, scores.leaderboard_scores(docs.drop("ord")).collect())) == [("A", "i", 5.0), ("A", "j", 1.0)]
    for k in (1, 2):
        scores.member_lines(docs.filter(f"ord = {k}")).write.text(str(tmp_path / f"lines/{k}"))
    lines = scores.read_member_lines(spark, str(tmp_path / "lines/*"))
    assert sorted(map(tuple, scores.leaderboard_scores(lines).collect())) == want
    odd = spark.createDataFrame([('{"results": {"a\\"b": {"i": {"Overall": 2}}}}',), ("junk",), (None,)], "doc string")
    scores.member_lines(odd).write.text(str(tmp_path / "odd"))
    assert [tuple(r) for r in scores.leaderboard_scores(scores.read_member_lines(spark, str(tmp_path / "odd"))).collect()] == [('a"b', "i", 2.0)]


def test_knowledge_documents(spark):
    tree = {"organizations": {"O": {"families": {"F": {"intro_url": "u", "models": {"m1": {"parameters": "7B"}, "m2": {"open_source": True}}}, "G": {"models": {}}}}}}
    docs = spark.createDataFrame([(json.dumps(tree),)], "doc string")
    assert {r["entity"] for r in knowledge.read_tree_entities(docs).collect()} == {"m1", "m2"}
    assert {r["family"] for r in knowledge.read_tree_families(docs).collect()} == {"F", "G"}
    assert tuple(knowledge.tree_counts(docs).first()) == (1, 2)


def test_adjustments(spark):
    ranges = spark.createDataFrame([("wide", 0.0, 2800.0)], "item string, lo double, hi double")
    predictions = spark.createDataFrame(
        [("a", "wide", 1400.0, 1500.0), ("a", "wide2", 50.0, 40.0), ("b", "wide", 2900.0, 2000.0), ("c", "x", 20.0, 10.0)],
        "entity string, item string, prediction double, truth double",
    )
    replies = spark.createDataFrame(
        [
            ("a", "wide", '```json {"delta": 10, "credibility_weight": 0.5, "explanation": "e"} ```'),
            ("a", "wide2", '{"adjustment": "-3", "credibility_weight": 7, "analysis": "old"}'),
            ("b", "wide", '{"delta": "much", "credibility_weight": "?"}'),
            ("c", "x", "{broken"),
        ],
        "entity string, item string, text string",
    )
    parsed = {(r["entity"], r["item"]): r for r in evidence.parse_adjustments(replies).collect()}
    assert ("c", "x") not in parsed
    assert (parsed["a", "wide2"]["delta"], parsed["a", "wide2"]["credibility_weight"], parsed["a", "wide2"]["analysis"]) == (-3.0, 1.0, "old")
    assert (parsed["b", "wide"]["delta"], parsed["b", "wide"]["credibility_weight"]) == (0.0, 1.0)
    out = {(r["entity"], r["item"]): r for r in evidence.apply_adjustments(predictions, evidence.parse_adjustments(replies), ranges).collect()}
    assert out["a", "wide"]["predicted_score"] == pytest.approx(1540) and out["a", "wide"]["adjustment"] == pytest.approx(140)
    assert out["a", "wide2"]["predicted_score"] == 47.0 and out["a", "wide2"]["direction"] == "down"
    # Beyond its range the prediction is clipped first; the change is taken against the unclipped one.
    assert out["b", "wide"]["predicted_score"] == 2800.0 and out["b", "wide"]["adjustment"] == -100.0
    assert out["c", "x"]["direction"] == "fallback" and out["c", "x"]["predicted_score"] == 20.0


def test_weight_zero_is_the_identity(spark):
    ranges = spark.createDataFrame([("w", 0.0, 120.0)], "item string, lo double, hi double")
    p = spark.createDataFrame([("a", "w", 60.0, 1.0), ("a", "v", 33.0, 1.0)], "entity string, item string, prediction double, truth double")
    adj = p.select("entity", "item", F.lit(9.0).alias("delta"), F.lit(0.0).alias("credibility_weight"), F.lit("low").alias("confidence"), F.lit("").alias("analysis"))
    for r in evidence.apply_adjustments(p, adj, ranges).collect():
        assert r["predicted_score"] == pytest.approx(r["baseline_prediction"]) and r["direction"] == "keep"


def test_leave_one_out_in_a_hot_family(spark):
    entities = spark.createDataFrame([(f"e{i}", "F", "7B") for i in range(60)] + [("lonely", "L", "1B")], "entity string, family string, parameters string")
    s = spark.createDataFrame([(f"e{i}", "x", float(i % 7)) for i in range(60)] + [("lonely", "x", 1.0)], "entity string, item string, score double")
    got = {r["entity"]: r for r in evidence.sibling_summary(s.select("entity", "item"), entities, s).collect()}
    for i in range(60):
        others = [float(j % 7) for j in range(60) if j != i]
        r = got[f"e{i}"]
        assert (r["sibling_count"], r["sibling_min"], r["sibling_max"]) == (59, min(others), max(others))
        assert r["sibling_mean"] == pytest.approx(sum(others) / 59)
    assert got["lonely"]["sibling_count"] == 0 and got["lonely"]["sibling_mean"] is None and got["lonely"]["sibling_min"] is None


def test_pages_of_a_large_family(spark):
    n = 2500
    rows = spark.range(n).select(F.format_string("e%05d", "id").alias("entity"), F.lit("F").alias("family"), F.lit("O").alias("organization"), F.lit("7B").alias("parameters"))
    s = rows.select("entity", F.lit("x").alias("item"), F.lit(5.0).alias("score"))
    ranges = spark.createDataFrame([], "item string, lo double, hi double")
    pages = {r["page"]: r for r in evidence.family_score_pages(rows, s, ranges).collect()}
    assert {p: r["n_lines"] for p, r in pages.items()} == {0: 1000, 1: 1000, 2: 500}
    assert pages[2]["text"].split("\n")[0] == "  e02000 (7B): 5.0"
    tree = dimensions.build_knowledge_tree(rows, ["parameters"])
    assert sorted(r["n"] for r in tree.select(F.size("models").alias("n")).collect()) == [500, 1000, 1000]


def test_query_gives_the_pages_of_a_family_as_one_text(spark):
    from types import SimpleNamespace

    from scoreweave.plans import registry

    registry._load()
    names = [f"e{i:05d}" for i in range(2300)]
    tables = SimpleNamespace(
        entities=spark.createDataFrame([(e, "f", "7B") for e in names], "entity string, family string, parameters string"),
        training=spark.createDataFrame([(e, "i", 50.0) for e in names], "entity string, item string, score double"),
        ranges=spark.createDataFrame([], "item string, lo double, hi double"),
    )
    build, _ = registry._QUERIES["E4_family_score_pages"]
    (row,) = build(tables).collect()
    assert row["n_lines"] == 2300 and row["text"].split("\n") == [f"  {e} (7B): 50.0" for e in names]


def test_context_keeps_all_documents_in_pages(spark):
    docs = spark.range(40).select(F.lit("s").alias("subject"), F.col("id").alias("pos"), F.lit("t").alias("title"), F.lit("web").alias("source"), F.col("id").cast("string").alias("text"))
    r = evidence.assemble_context(docs).first()
    assert r["n_docs"] == 40 and r["context"].startswith("\n[web] t\n0\n") and r["context"].endswith("\n39\n")
    pages = {r["page"]: r for r in evidence.assemble_context(docs, per_page=16).collect()}
    assert {p: r["n_docs"] for p, r in pages.items()} == {0: 16, 1: 16, 2: 8} and pages[1]["context"].startswith("\n[web] t\n16\n")
    assert evidence.assemble_context(docs, at_most=30, limit=20).first()["context"] == "\n[web] t\n0\n\n[web] t\n"


def test_replies_must_be_objects_with_finite_numbers(spark):
    texts = ['```json [1, 2] ```', '```json 5 ```', '{"delta": "NaN"}', '{"delta": null, "adjustment": 4}', '{"adjustment": 4, "credibility_weight": "x"}', "none", '{"delta": 1e999}']
    rows = spark.createDataFrame([("e", str(k), t) for k, t in enumerate(texts)], "entity string, item string, text string")
    got = {r["item"]: (r["delta"], r["credibility_weight"]) for r in evidence.parse_adjustments(rows).collect()}
    assert got == {"2": (0.0, 1.0), "3": (0.0, 1.0), "4": (4.0, 1.0), "6": (0.0, 1.0)}


def test_request_text_is_not_substituted_again(spark):
    rows = spark.createDataFrame([("{item}", "i", None)], "entity string, item string, more string")
    got = evidence.request_table(rows, {"a": "{entity} {item} {more} {other}"}).first()
    assert got["request"] == "{item} i N/A {other}"


def test_a_frequent_score_is_one_mark(spark):
    scores = spark.range(400).select(F.lit("x").alias("item"), F.format_string("e%03d", "id").alias("entity"), F.when(F.col("id") < 360, 5.0).otherwise(F.col("id") * 1.0).alias("score"))
    targets = spark.createDataFrame([("a", "x", 5.2), ("b", "x", 380.4), ("c", "x", -1.0)], "entity string, item string, prediction double")
    got = {r["entity"]: r["predicted_rank"] for r in evidence.predicted_ranks(targets, evidence.score_ranks(scores)).collect()}
    assert got == {"a": 41, "b": 20, "c": 41}


def test_incremental_results_write_each_key_once(spark, tmp_path):
    schema = "entity string, item string, prediction double, truth double"
    source, sink, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    ranges = spark.createDataFrame([], "item string, lo double, hi double")
    none = spark.createDataFrame([], "entity string, item string, delta double, credibility_weight double, confidence string, analysis string")

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        incremental_results(stream, lambda t: evidence.apply_adjustments(t, none, ranges), sink, progress).awaitTermination()

    spark.createDataFrame([("a", "x", 1.0, 1.0), ("a", "x", 1.0, 1.0), ("b", "x", 2.0, 1.0)], schema).coalesce(1).write.parquet(source)
    run()
    spark.createDataFrame([("b", "x", 2.0, 1.0), ("c", "x", 3.0, 1.0)], schema).coalesce(1).write.mode("append").parquet(source)
    run()
    got = sorted((r["entity"], r["item"]) for r in spark.read.parquet(sink).collect())
    assert got == [("a", "x"), ("b", "x"), ("c", "x")]


def _stream(spark, tmp_path, schema, **options):
    source, sink, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        incremental_results(stream, lambda t: t, sink, progress, **options).awaitTermination()

    return run, sink


def test_later_batches_open_no_earlier_results(spark, tmp_path):
    import glob

    run, sink = _stream(spark, tmp_path, "entity string, item string, n int")
    run([("a", "x", 1), ("b", "x", 1)])
    for name in glob.glob(f"{sink}/batch=*/*.parquet"):
        with open(name, "wb") as file:
            file.write(b"not a table")
    for k in range(3):
        run([("a", "x", 2 + k), ("b", "x", 2), (f"c{k}", "x", 2), (None, "x", k)])
    last = [r for d in sorted(glob.glob(f"{sink}/batch=*"))[1:] if glob.glob(f"{d}/*.parquet") for r in spark.read.parquet(d).collect()]
    assert sorted((r["entity"] or "", r["n"]) for r in last if r["n"] is not None) == [("", 0), ("c0", 2), ("c1", 2), ("c2", 2)]


def test_keys_done_before_the_stream_and_keys_behind_the_watermark(spark, tmp_path):
    from datetime import datetime

    done = spark.createDataFrame([("a", "x")], "entity string, item string")
    day = lambda d: datetime(2024, 1, d)
    run, sink = _stream(spark, tmp_path, "entity string, item string, at timestamp", done=done, event_time="at", delay="2 days")
    run([("a", "x", day(1)), ("b", "x", day(1)), ("b", "x", day(2))])
    run([("b", "x", day(2)), ("c", "x", day(20))])
    run([("b", "x", day(21)), ("c", "x", day(21))])  # b was forgotten, c was not
    got = sorted((r["entity"], r["at"].day) for r in spark.read.parquet(sink).collect())
    assert got == [("b", 1), ("b", 21), ("c", 20)]


def test_evolution_keeps_members_without_a_score_and_components_all_features(spark):
    entities = spark.createDataFrame(
        [("a", "f", "v", "l", "7B", "2024"), ("b", "f", "v", "l", "9B", None), ("c", None, "v", "l", "1B", None)],
        "entity string, family string, vision_model string, language_model string, parameters string, release_date string",
    )
    scores = spark.createDataFrame([("a", "i", 50.0), ("c", "i", 9.0)], "entity string, item string, score double")
    ranges = spark.createDataFrame([], "item string, lo double, hi double")
    targets = spark.createDataFrame([("b", "i"), ("b", "j")], "entity string, item string")
    a = "entity: a, vision model: v, language model: l, parameters: 7B, release date: 2024"
    b = "entity: b, vision model: v, language model: l, parameters: 9B"
    lines = lambda rows: {(r["item"], r["line"]) for r in rows.collect()}
    assert lines(evidence.evolution_table(entities, scores, ranges)) == {("i", a + ", score: 50.0"), ("i", b)}
    out = evidence.evolution_table(entities, scores, ranges, targets)
    assert lines(out) == {("i", a + ", score: 50.0"), ("i", b), ("j", a), ("j", b)} and out.count() == 4
    known = spark.createDataFrame([("v", "m", "x", list("abcd"))], "component string, organization string, architecture string, key_features array<string>")
    texts = evidence.component_text(targets, entities, known, "vision_model").collect()
    assert all(r["vision_model_text"].endswith("key features: a, b, c, d") for r in texts) and len(texts) == 2


def test_layouts_show_what_is_there(spark):
    from scoreweave.functions.layout import Block, Field, rendered

    df = spark.createDataFrame([("a", None, 1.25, ["x", "y"], {"k": 1}, True), ("", "b", None, [], {}, None)], "s string, t string, n double, l array<string>, m map<string,int>, f boolean")
    blocks = [Block(("s", "t", "absent"), "names"), Block((Field("n", "number", 1, empty="none"), Field("l", between=", "), "m", "f"))]
    got = [r[0] for r in df.select(rendered(df, blocks)).collect()]
    assert got == ["names\ns: a\n\nnumber: 1.2\nl: x, y\nm: k=1\nf: yes", "names\nt: b\n\nnumber: none"]
    assert df.select(rendered(df, [Block(("absent",))])).first()[0] == ""


def test_directions_run_no_metrics(spark, monkeypatch):
    from scoreweave.operators import metrics

    asked = []
    whole = metrics.metrics_long
    monkeypatch.setattr(metrics, "metrics_long", lambda *given: asked.append(1) or whole(*given))
    rows = [(f"e{i}", "i", float(i), float(i), i + 1.0, ("up", "keep", "fallback")[i % 3]) for i in range(9)]
    results = spark.createDataFrame(rows, "entity string, item string, truth double, baseline_prediction double, predicted_score double, direction string")
    reports = evidence.run_evaluation(results, spark.createDataFrame([], "item string, lo double, hi double"))
    assert sorted((r["direction"], r["n"], r["share"]) for r in reports["directions"].collect()) == [("keep", 3, 50.0), ("up", 3, 50.0)]
    assert asked == [] and set(reports) == {"adjusted", "baseline", "improvement", "directions"}
    gain = {r["metric"]: r["new"] for r in reports["improvement"].collect()}
    assert gain["mae"] == 1.0 and len(asked) == 2


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_summary_reads_entities_once_and_gathers_peers_once(spark):
    from scoreweave.plans.registry import all_queries

    plan = _plan(all_queries()["E5_evidence_summary"](spark, "/root/testdata/sf0.001"))
    assert "orders.parquet" not in plan and "median" not in plan and "explode(peers" not in plan


def test_profiles_of_the_neighbour_search_are_written_once(spark):
    from scoreweave.plans.join_queries import profile_vectors
    from scoreweave.plans.views import Tables

    for side in profile_vectors(Tables(spark, "/root/testdata/sf0.001")):
        assert "Join" not in _plan(side) and "Aggregate" not in _plan(side)
