"""Personal data: overlapping candidates, boosted trees over format and context, calibrated thresholds.

Strict patterns give the base spans. Broad generators propose further spans: digit groups and address-like strings
that the strict rules turn down. Candidates that coincide with a base span are positive examples. Of the others, those
that fail a checkable rule and have no cue before them are negative (``_WRONG``); the rest have no label: they are what
is looked for, so neither the trees nor the thresholds take them as errors. Gradient-boosted trees learn from the form
of the span and the characters and words before it. They learn from a part of a sample of at most ``sample`` candidates
with a label, by hash; on all others with a label each kind's threshold is set to the least score whose precision
reaches the target. Candidates above it are added. A few hundred made-up examples of right and wrong candidates of each
kind (``examples``) stand beside those of the corpus, so that a corpus without wrong ones, or with few of a kind, has a
model and a threshold like any other. Column functions, joins and Spark's own trees only; all candidates are scored.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreweave.llm.common import filled, matches, text_key
from scoreweave.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
#: The base patterns. Possessive repeats and look-behinds find the same matches in linear time.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Broad generators: kind of the span they propose, pattern.
BROAD = (
    ("contact", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]++)*+"),
    ("number", r"(?<![0-9+])\+?\(?[0-9](?:[\x20().-]{0,2}+[0-9]){6,}+"),
    ("address", r"(?<![0-9.])[0-9]{1,5}+(?:\.[0-9]{1,5}+){3,}+"),
)
CUES = r"(?i)(?:mail|phone|tel|call|fax|card|visa|account|address|contact|host|ip)[^A-Za-z0-9]*$"
#: Written-out signs of an address, and what they stand for.
SIGNS = ((r"\x20?(?:\(at\)|\[at\])\x20?", "@"), (r"\x20?(?:\(dot\)|\[dot\])\x20?", "."))
_ORDER = (*KINDS, *(k for k, _ in BROAD))
_SPAN = "array<struct<start:int,place:int,end:int,kind:string>>"


def _digits(word: Column) -> Column:
    return F.regexp_replace(word, "[^0-9]", "")


def _luhn(word: Column) -> Column:
    """Checksum of 12 to 19 digits."""
    plain = F.filter(F.split(F.reverse(_digits(word)), ""), lambda d: d != "")
    twice = lambda v: F.when(v > 9, v - 9).otherwise(v)
    values = F.transform(plain, lambda d, i: F.when(i % 2 == 1, twice(2 * d.cast("int"))).otherwise(d.cast("int")))
    total = F.aggregate(values, F.lit(0), lambda a, v: a + v)
    return F.length(_digits(word)).between(12, 19) & (total % 10 == 0)


def _small_parts(word: Column) -> Column:
    """Parts between dots of at most 255."""
    value = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
    return F.forall(F.split(word, r"\."), lambda p: (F.length(value(p)) <= 3) & (value(p).cast("int") <= 255))


_HOLDS = {
    "email": lambda w: F.lit(True), "ip": _small_parts, "card": _luhn,
    "phone": lambda w: F.length(_digits(w)).between(9, 15),
}


def _spans(t: Column, kind: str, pattern: str, holds=lambda w: F.lit(True)) -> Column:
    place = F.lit(_ORDER.index(kind))
    found = F.filter(matches(t, pattern), lambda m: holds(m["word"]))
    spans = F.transform(found, lambda m: F.struct(m["start"].alias("start"), place.alias("place"), m["end"].alias("end"), F.lit(kind).alias("kind")))
    return F.when(t.rlike(pattern), spans).otherwise(F.array().cast(_SPAN))


def base_spans(text: str | Column = "text") -> Column:
    """Spans (start, place, end, kind) of the strict patterns, by start, then kind."""
    t = filled(text)
    return F.array_sort(F.concat(*[_spans(t, k, PATTERNS[k], _HOLDS[k]) for k in KINDS]))


def _plain(word: Column) -> Column:
    """A candidate with its written-out signs as signs."""
    for pattern, sign in SIGNS:
        word = F.regexp_replace(word, pattern, sign)
    return word


#: What no span of the kind can be: no domain with a name at its end; digits of no telephone and no card; parts over 255.
_WRONG = {
    "contact": lambda w: ~w.rlike(r"@\x20?[A-Za-z0-9-]+(?:\x20?\.\x20?[A-Za-z0-9-]+)*\x20?\.\x20?[A-Za-z]{2,}$"),
    "number": lambda w: ~F.length(_digits(w)).between(9, 19) | ((F.length(_digits(w)) > 11) & ~w.rlike(r"^[+(]") & ~_luhn(w)),
    "address": lambda w: ~_small_parts(w),
}


FEATURES = ("length", "digits", "blanks", "dots", "dashes", "plus", "at", "letters", "groups", "longest", "cue", "before_word", "after_word", "before_dot")


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """(key, span, strict, label, features) of all spans that the broad generators propose, once per text.

    ``label`` is 1 for strict candidates, 0 for those that can't be right, and null for the others.
    """
    t = F.col("t")
    rows = docs.select(text_key(text).alias("key"), filled(text).alias("t"))
    rows = rows.withColumn("broad", F.concat(*[_spans(t, k, p) for k, p in BROAD])).filter(F.size("broad") > 0)
    rows = rows.withColumn("base", base_spans(t))
    near = lambda s: F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    one = F.transform("broad", lambda s: F.struct(
        s.alias("span"), near(s).alias("strict"), t.substr(s["start"] + 1, s["end"] - s["start"]).alias("word"),
        t.substr(F.greatest(F.lit(1), s["start"] - 23), F.least(F.lit(24), s["start"])).alias("before"),
        t.substr(s["end"] + 1, F.lit(2)).alias("after"),
    ))
    rows = rows.select("key", F.explode(one).alias("c")).select("key", "c.*").distinct()
    rows = rows.withColumn("word", _plain(F.col("word")))
    w, n = F.col("word"), lambda p: (F.length("word") - F.length(F.regexp_replace("word", p, ""))).cast("double")
    groups = F.filter(F.split(w, "[^0-9]+"), lambda g: g != "")
    values = {
        "length": F.length(w), "digits": n("[0-9]"), "blanks": n(r"\x20"), "dots": n(r"\."), "dashes": n("-"), "plus": n(r"[+(]"),
        "at": n("@"), "letters": n("[A-Za-z]"), "groups": F.size(groups),
        "longest": F.coalesce(F.array_max(F.transform(groups, lambda g: F.length(g))), F.lit(0)),
        "cue": F.col("before").rlike(CUES), "before_word": F.col("before").rlike(r"[A-Za-z0-9]$"),
        "after_word": F.col("after").rlike("^[A-Za-z0-9]"), "before_dot": F.col("before").rlike(r"[.:/-]$"),
    }
    wrong = F.coalesce(*[F.when(F.col("span.kind") == k, bad(w)) for k, bad in _WRONG.items()])
    label = F.when(F.col("strict"), 1.0).when(wrong & ~values["cue"], 0.0)
    return rows.select("key", "span", "strict", label.alias("label"), *[F.coalesce(values[f].cast("double"), F.lit(0.0)).alias(f) for f in FEATURES])


def examples(spark: SparkSession) -> DataFrame:
    """Labelled candidates made by rule: per kind some that are right and some that break a rule."""
    right = [
        "write to {a}.{b}@site{c}.org today", "mail: {b}{c}@{a}.example.com", "call +{c} {c}55 {b}67 {c}{b}1 now", "phone +{b}{c}-{c}20-{b}4-{c}{a}7 please",
        "host 10.{a}.{b}.{c} is up", "from 192.168.{c}.{a} to us", "card 4{c}{b} 0000 0000 0000 {a}", "address: {a}@b{c}.net",
    ]
    wrong = [
        "{a} items @{b} each and x{c}@y", "see {a}@{b} or u{c}@host", "room {c} {b} {a} 1 2 3 4 5", "sums {a} {b} {c} {c} {b} {a} 11 22 33 44 55 66",
        "version 30{a}.4{b}.5{c}.999 is out", "section {c}{b}0.{b}77.{c}88.{b}00 of it", "code 1{a}2{b}3{c}4{a}5{b}6{c}7{a}8{b}9{c}", "part 9{c}9.8{b}8.{c}77.666",
    ]
    texts = [t.format(a=1 + k % 9, b=2 + (k * 7) % 8, c=10 + (k * 13) % 89) for t in right + wrong for k in range(40)]
    return candidates(spark.createDataFrame([(t,) for t in texts], "text string"))


def scored(found: DataFrame, sample: int, trees: int, depth: int) -> DataFrame:
    """Candidates with the model's ``score`` and their kind's ``least``.

    The trees learn from the sample; the thresholds come from all candidates with a label that the trees did not learn
    from. Made-up examples are among both, and not in the result.
    """
    found = found.withColumn("made", F.lit(False)).unionByName(examples(found.sparkSession).withColumn("made", F.lit(True)))
    place = [F.col("key"), F.col("span.start"), F.col("span.end"), F.col("span.place")]
    vector = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    rows = vector.transform(found).withColumn("_order", F.xxhash64(*place))
    rows = rows.withColumn("_part", F.pmod(F.xxhash64(*place, F.lit(17)), F.lit(10)))
    last = rows.filter("label is not null and not made").select("_order").orderBy("_order").limit(sample).agg(F.max("_order")).first()[0]
    known = F.col("made") if last is None else F.col("made") | (F.col("_order") <= last)
    learnt = known & (F.col("_part") < 7) & F.col("label").isNotNull()
    fit = cut_lineage(rows.filter(learnt))
    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.2, seed=7, cacheNodeIds=False).fit(fit)
    out = model.transform(rows).withColumn("score", vector_to_array("probability")[1])
    out = cut_lineage(out.select("key", "span", "strict", "label", "score", "made", learnt.alias("learnt")))
    held = out.filter("not learnt and label is not null")
    held = held.groupBy("span.kind", F.floor(F.col("score") * 100).alias("bin")).agg(F.sum("label").alias("good"), F.count(F.lit(1)).alias("n"))
    return out.filter("not made").join(F.broadcast(_thresholds(held)), F.col("span.kind") == F.col("kind"), "left")


def _thresholds(held: DataFrame, target: float = 0.9) -> DataFrame:
    """For each of the generators' kinds the least hundredth of score at and above which ``target`` of its held-out
    candidates are good; 2 means that no score is enough.

    ``held`` has at most 101 rows for each kind.
    """
    bins: dict[str, list[tuple[int, float, int]]] = {kind: [] for kind, _ in BROAD}
    for kind, bin_, good, n in held.collect():
        bins[kind].append((bin_, good, n))

    def least(counts: list[tuple[int, float, int]]) -> float:
        best, right, total = 2.0, 0.0, 0
        for bin_, good, n in sorted(counts, reverse=True):
            right, total = right + good, total + n
            best = bin_ / 100 if right >= target * total else best
        return best

    return held.sparkSession.createDataFrame([(kind, least(own)) for kind, own in bins.items()], "kind string, least double")


def find_pii(docs: DataFrame, sample: int = 20_000, trees: int = 10, depth: int = 3, text: str = "text") -> DataFrame:
    """Add ``pii``: base and all spans (start, place, end, kind), in code points, sorted by start, then kind.

    Overlapping spans all stand; a candidate that overlaps a base span is not added again. A null text counts as empty
    and has none; repeated rows get equal results, null ids don't matter, an empty table stays empty. Other columns stay
    as they are, whatever their names; an input column named ``pii`` is replaced.
    """
    chosen = scored(cut_lineage(candidates(docs, text)), sample, trees, depth).filter("not strict and score >= least")
    added = chosen.groupBy("key").agg(F.collect_list("span").alias("more"))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(whole, base_spans(text).alias("base"), text_key(text).alias("key")).join(added, "key", "left")
    every = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(_SPAN))))
    rows = rows.select("row", F.struct("base", every.alias("spans")).alias("pii"))
    return rows.select(*[F.col("row")[c].alias(c) for c in docs.columns if c != "pii"], "pii")
