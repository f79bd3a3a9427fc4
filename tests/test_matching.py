"""Containment joins, resolution tiers, repositories, rules."""

import random

from pyspark.sql import functions as F

from scoreweave.operators import matching


def test_contained_pairs_against_brute_force(spark):
    rng = random.Random(1)
    needles = {"".join(rng.choice("ab") for _ in range(rng.randrange(0, 6))) for _ in range(40)}
    hay = {"".join(rng.choice("ab") for _ in range(rng.randrange(0, 9))) for _ in range(60)} | {"aaaaaaaa"}
    n = spark.createDataFrame([(x,) for x in needles] * 2, "x string")
    h = spark.createDataFrame([(x,) for x in hay] * 2, "y string")
    got = sorted(tuple(r) for r in matching.contained_pairs(n, h).collect())
    assert got == sorted((a, b) for a in needles for b in hay if a and b and a in b)


def test_no_theta_join_in_containment(spark):
    n = spark.createDataFrame([("abc",)], "x string")
    plan = matching.contained_pairs(n, n)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_tiers(spark):
    dictionary = spark.createDataFrame([("Alpha-2 Long", 1), ("alpha", 2), ("Alpha", 3), ("beta 2", 4), ("", 0)], "key string, ord int")
    names = spark.createDataFrame([("Alpha",), ("ALPHA-2",), ("the beta 2 x",), ("BETA_2",), ("gamma",), ("",)], "name string")
    fuzzy = {r["name"]: r["key"] for r in matching.resolve_item(names, dictionary).collect()}
    assert fuzzy["Alpha"] == "Alpha"  # the very same text beats an earlier containment
    assert fuzzy["ALPHA-2"] == "Alpha-2 Long"  # lowest place among "inside" and "around"
    assert fuzzy["the beta 2 x"] == "beta 2"
    assert fuzzy["BETA_2"] is None and fuzzy["gamma"] is None
    normal = {r["name"]: r["key"] for r in matching.resolve_entity(names, dictionary).collect()}
    assert normal["BETA_2"] == "beta 2"
    one_way = {r["name"]: r["key"] for r in matching.resolve_component(names, dictionary).collect()}
    assert one_way["the beta 2 x"] is None and one_way["ALPHA-2"] == "Alpha-2 Long"


def test_repository_scores(spark):
    names = spark.createDataFrame([("Net-7B",), ("Net-13B (v2)",), ("Zeta",), ("Lone",)], "name string")
    repos = spark.createDataFrame(
        [("a/net_7b", 5), ("b/net-7b", 9), ("c/net-34b", 100), ("d/zeta-chat", 3), ("e/zeta-chat-long", 50), ("f/other", 7)],
        "repo string, downloads int",
    )
    got = {r["name"]: (r["repo"], r["exact"]) for r in matching.match_repository(names, repos).collect()}
    assert got["Net-7B"] == ("b/net-7b", True)  # both normalise alike: more downloads
    assert got["Net-13B (v2)"] == ("c/net-34b", False)  # same base, 90 points, most downloads
    assert got["Zeta"] == ("d/zeta-chat", False)  # containment, the shorter difference
    assert got["Lone"] == (None, None)


def test_first_rule_wins(spark):
    e = spark.createDataFrame([("Abc-7B",), ("Abc-VL2",), ("Abc-VL",), ("zAbc",), ("plain",)], "entity string")
    rules = [("vl", r"Abc-VL(?!2).*", "o1"), ("abc", r"Abc-\d+B|Abc-VL.*", "o2"), ("never", r"Abc.*7B", "o3")]
    got = {r["entity"]: (r["family"], r["rule_organization"]) for r in matching.assign_family(e, rules).collect()}
    assert got == {"Abc-7B": ("abc", "o2"), "Abc-VL2": ("abc", "o2"), "Abc-VL": ("vl", "o1"), "zAbc": ("zAbc", None), "plain": ("plain", None)}


def test_organization_profiles(spark):
    profiles = [("Acme", "US", "large", 0.9, False, ("x",)), ("Acme Labs", "EU", "small", 0.8, False)]
    names = spark.createDataFrame([("Acme Labs",), ("acme lab",), ("Beijing Works",), ("Else",), ("",), (None,)], "name string")
    p = matching.organization_profile(F.col("name"), profiles)
    got = {r["name"]: (r["p"]["region"], r["p"]["credibility"]) for r in names.select("name", p.alias("p")).collect()}
    assert got["Acme Labs"] == ("EU", 0.8) and got["acme lab"] == ("US", 0.9)
    assert got["Beijing Works"] == ("CN", 0.7) and got["Else"] == ("Unknown", 0.6)
    assert got[""] == ("Unknown", 0.5) and got[None] == ("Unknown", 0.5)


def test_one_letter_needles_and_long_texts(spark):
    rng = random.Random(2)
    long = "".join(rng.choice("abcdé ") for _ in range(300_000)) + "needle at the end"
    hay = [long, "x" * 5000 + "y", "ab", "ü", long[100_000:104_000]]
    needles = ["e", "ü", "x" * 3000, "x" * 5000 + "z", "needle at", long[4090:4100], long[2000:9000], "ab", "q", "yx"]
    n = spark.createDataFrame([(x,) for x in needles], "x string")
    h = spark.createDataFrame([(x,) for x in hay], "y string")
    got = sorted(tuple(r) for r in matching.contained_pairs(n, h).collect())
    assert got == sorted((a, b) for a in needles for b in hay if a in b)
    none = h.limit(0)
    assert matching.contained_pairs(n, none).count() == matching.contained_pairs(none, h).count() == 0


def test_searches_are_kept_apart_by_sides(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 5))) for _ in range(30)]
    rows = lambda k: [(w, rng.choice([1, 2, 3, 4])) for w in words]
    needles, hays = rows(0), rows(1)
    make = lambda r: spark.createDataFrame(r, "text string, sides int")
    got = {(r["needle"], r["hay"]): r["sides"] for r in matching.containments(make(needles), make(hays)).collect()}
    a, b = {}, {}
    for out, given in ((a, needles), (b, hays)):
        for w, s in given:
            out[w] = out.get(w, 0) | s
    assert got == {(x, y): a[x] & b[y] for x in a for y in b if x in y and a[x] & b[y]}


def test_five_thousand_rules(spark):
    rules = [(f"f{k}", f"Model{k}[-_]?(?:7B|x).*", f"o{k}") for k in range(4990)] + [
        ("any", ".*special", "s"), ("alt", "Zed|Yed", "z"), ("opt", r"Qa?\.b+c", "q"), ("esc", r"N\.5\+.*", "n"), ("late", "Model7.*", "late"), ("none", "", "all")
    ]
    names = ["Model7-7B", "Model77x", "Model4989_x1", "Model7-8B", "Model12 special", "Yed-1", "Q.bbc", "Qa.bc", "N.5+x", "other-1", None]
    df = spark.createDataFrame([(n,) for n in names], "entity string")
    import re

    def first(name):
        hit = next(((f, o) for f, p, o in rules if name is not None and re.match(p, name)), None)
        return hit or (None if name is None else name.split("-")[0], None)

    for given in (rules, rules[:-1]):
        got = {r["entity"]: (r["family"], r["rule_organization"]) for r in matching.assign_family(df, given).collect()}
        rules = given
        assert got == {n: first(n) for n in names}


def test_literal_prefixes(spark):
    cases = {"abc.*": "abc", "ab?c": "a", "ab*": "a", "ab+c": "ab", r"a\.b": "a.b", r"a\.?b": "a", "a|b": "", "(?i)abc": "", "x{0,2}y": "", r"\d+": "", "": ""}
    rows = spark.createDataFrame([(p,) for p in cases], "p string").select("p", matching.literal_prefix(F.col("p")).alias("l")).collect()
    assert {r["p"]: r["l"] for r in rows} == cases


def test_organization_profiles_as_a_table(spark):
    profiles = [(f"Maker {k}", k, "US", "large", 0.9, False, ["x"]) for k in range(3000)] + [("Acme Labs", 4000, "EU", "small", 0.8, False, []), ("Acme", 3500, "US", "large", 0.7, True, None)]
    table = spark.createDataFrame(profiles, "name string, ord int, region string, size string, credibility double, local_focus boolean, specialties array<string>")
    names = spark.createDataFrame([(n, k) for k, n in enumerate(["Acme Labs", "acme lab", "the maker 77", "Beijing Works", "Else", "", None, "Else"])], "org string, ord int")
    rows = matching.with_organization_profile(names, "org", table).collect()
    got = {r["org"]: (r["profile"]["region"], r["profile"]["credibility"]) for r in rows}
    assert len(rows) == 8 and got["Acme Labs"] == ("EU", 0.8) and got["acme lab"] == ("US", 0.7) and got["the maker 77"] == ("US", 0.9)
    assert got["Beijing Works"] == ("CN", 0.7) and got["Else"] == ("Unknown", 0.6) and got[""] == got[None] == ("Unknown", 0.5)


def test_best_hit_takes_the_first_of_the_right_tier(spark):
    rows = [
        ("Abc", "o/xabcx", 9, 1), ("Abc", "o/abc-long", 5, 2), ("Abc", "o/long-abc", 7, 3),  # starts or ends: downloads
        ("Same", "o/same-more", 99, 1), ("Same", "p/sa_me", 1, 2), ("Same", "q/same", 50, 3),  # equal: the first
        ("Mid", "o/xmidx", 1, 1), ("Mid", "o/ymidy", 99, 2),  # contains: the first hit only
        ("No", "o/other", 1, 1), ("No", "o/xnox", 99, 2),
    ]
    got = {r["subject"]: (r["dataset"], r["tier"]) for r in matching.best_hit(spark.createDataFrame(rows, "subject string, dataset string, downloads long, position int")).collect()}
    assert got == {"Abc": ("o/long-abc", 1), "Same": ("p/sa_me", 0), "Mid": ("o/xmidx", 2), "No": (None, None)}
