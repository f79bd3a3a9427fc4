"""Secret scans: patterns for whole credentials, and linking of parts that mean little alone.

Access identifiers, opaque strings and endpoints are weak candidates. One is reported only when a part of a
complementary role starts within its scope: an identifier or an endpoint needs a secret, an opaque string needs either.
A plain hex string counts as a secret for others only if a word like key or token stands before it (else it may be a
commit or a checksum), and an opaque string that is part of an address is none of its own.
The interval join compares cells instead of pairs: per text, role and stretch of one scope it keeps the first and last
start, and a part looks at its own stretch and the two beside it. Column functions and joins only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreweave.llm.common import filled, let, matches, span_list, text_key
from scoreweave.session import cut_lineage

#: The base patterns, in the order of their kinds, each with its least length.
ASSIGN = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?{}[A-Za-z0-9+/_.=-]+{}"""
KINDS = ("assign", "access", "hex")
ACCESS, HEX = "AKIA[A-Z0-9]{16,}+", "[0-9a-f]{24,}+"

#: Weak parts: kind, role, pattern. Look-behinds keep a long run of characters from being tried at each place.
WEAK = (
    ("identifier", "who", r"""(?i)(?:access_?key_?id|client_?id|user_?name|user|login|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}"""),
    ("opaque", "what", r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[A-Z0-9+/_=-]*[a-z])(?=[a-z0-9+/_=-]*[A-Z])[A-Za-z0-9+/_=-]{20,}+"),
    ("endpoint", "where", r"""(?:https?|ftps?|ssh|jdbc:[a-z]{2,12}|postgres(?:ql)?|mysql|mongodb|redis|amqps?|s3)://[^\x00-\x20"'<>]+"""),
)
#: What makes a plain hex string a secret: such a word at most 24 characters before it, in the same line.
CUE = r"(?i)(?:secret|token|key|passw|pwd|auth|credential|private|signature)[^\n]{0,24}$"
ROLES = {"assign": "what", "hex": "what", "access": "who"} | {kind: role for kind, role, _ in WEAK}
NEEDS = {"who": ("what",), "where": ("what",), "what": ("who", "where")}
_SPAN = "array<struct<start:int,place:int,end:int,kind:string>>"
_ORDER = (*KINDS, *(kind for kind, _, _ in WEAK))


def _spans(t: Column, kind: str, pattern: str, group: str | None = None) -> Column:
    found = matches(t, pattern, group)
    if group is not None:
        found = F.filter(found, lambda m: F.length(m["part"]) >= 6)
    place = F.lit(_ORDER.index(kind))
    spans = F.transform(found, lambda m: F.struct(m["start"].alias("start"), place.alias("place"), m["end"].alias("end"), F.lit(kind).alias("kind")))
    return F.when(t.rlike(pattern), spans).otherwise(F.array().cast(_SPAN))


def base_spans(text: str | Column = "text") -> Column:
    """Spans (start, place, end, kind) of the base patterns, by start, then kind."""
    t = filled(text)
    assign = _spans(t, "assign", ASSIGN.format("", ""), ASSIGN.format("(", ")"))
    return F.array_sort(F.concat(assign, _spans(t, "access", ACCESS), _spans(t, "hex", HEX)))


def weak_spans(text: str | Column = "text") -> Column:
    t = filled(text)
    return F.concat(*[_spans(t, kind, pattern) for kind, _, pattern in WEAK])


def linked_spans(docs: DataFrame, scope: int = 400, text: str = "text") -> DataFrame:
    """(key, linked) of the texts with weak parts that a complementary part lies near to; ``key`` names the text."""
    role = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    weak = F.col("part.place") >= len(KINDS)
    found = docs.select(text_key(text).alias("key"), F.col(text).alias("t")).withColumn("weak", weak_spans("t"))
    t, of = F.col("t"), lambda kind: F.filter("weak", lambda s: s["kind"] == kind)
    addresses = of("endpoint")
    apart = F.filter("weak", lambda s: (s["kind"] != "opaque") | ~F.exists(addresses, lambda e: (e["start"] <= s["start"]) & (s["start"] < e["end"])))
    cued = F.filter(base_spans("t"), lambda s: (s["kind"] != "hex") | t.substr(F.greatest(F.lit(1), s["start"] - 39), F.least(F.lit(40), s["start"])).rlike(CUE))
    found = found.filter(F.size("weak") > 0).withColumn("weak", apart).filter(F.size("weak") > 0)
    found = found.select("key", F.explode(F.concat("weak", cued)).alias("part"))
    # Both sides of the join below read the parts; the patterns run once.
    parts = cut_lineage(found.select("key", "part", role[F.col("part.kind")].alias("role"), weak.alias("weak")).distinct())
    stretch = F.floor(F.col("part.start") / scope)
    cells = parts.groupBy("key", "role", stretch.alias("cell")).agg(
        F.min("part.start").alias("first"), F.max("part.start").alias("last")
    )
    needs = F.create_map(*[x for r, other in NEEDS.items() for x in (F.lit(r), F.array(*map(F.lit, other)))])
    asks = parts.filter("weak").select("key", "part", F.explode(needs[F.col("role")]).alias("role"), stretch.alias("at"))
    asks = asks.withColumn("cell", F.explode(F.sequence(F.col("at") - 1, F.col("at") + 1)))
    near = (F.col("last") >= F.col("part.start") - scope) & (F.col("first") <= F.col("part.start") + scope)
    linked = asks.join(cells, ["key", "role", "cell"]).filter(near).select("key", "part").distinct()
    return linked.groupBy("key").agg(F.collect_list("part").alias("linked"))


def find_secrets(docs: DataFrame, scope: int = 400, text: str = "text") -> DataFrame:
    """Add ``secrets``: base and all spans (start, place, end, kind), in code points, sorted by start, then kind.

    Overlapping spans of different kinds all stand. A null text counts as empty and has none; repeated rows get equal
    results, null ids don't matter, and an empty table stays empty. Other columns stay as they are, whatever their
    names; an input column named ``secrets`` is replaced.
    """
    return _with_spans(docs, scope, text).select(*[F.col("row")[c].alias(c) for c in docs.columns if c != "secrets"], "secrets")


def _with_spans(docs: DataFrame, scope: int, text: str) -> DataFrame:
    """(row, secrets): every row of ``docs`` as one struct, and its spans."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(whole, base_spans(text).alias("base"), text_key(text).alias("key"))
    rows = rows.join(linked_spans(docs, scope, text), "key", "left")
    every = F.array_sort(F.concat("base", F.coalesce("linked", F.array().cast(_SPAN))))
    return rows.select("row", F.struct("base", every.alias("spans")).alias("secrets"))


def redacted(text: Column, spans: Column, mark: str) -> Column:
    """The text with each run of overlapping or touching spans (sorted by start) replaced by ``mark``."""
    run = "array<struct<start:int,end:int>>"
    one = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))

    def add(runs: Column, s: Column) -> Column:
        last = F.element_at(F.concat(F.array(F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("end"))), runs), -1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        joined = F.concat(F.slice(runs, F.lit(1), F.greatest(F.lit(0), F.size(runs) - 1)), F.array(longer))
        return F.when(s["start"] <= last["end"], joined).otherwise(F.concat(runs, F.array(one(s))))

    def cut(runs: Column) -> Column:
        begin = lambda k: F.when(k > 0, F.get(runs, k - 1)["end"]).otherwise(F.lit(0))
        pieces = F.transform(runs, lambda r, k: F.concat(text.substr(begin(k) + 1, r["start"] - begin(k)), F.lit(mark)))
        rest = F.element_at(runs, -1)["end"]
        return F.concat(F.array_join(pieces, ""), text.substr(rest + 1, F.length(text) - rest))

    return F.when(F.size(spans) > 0, let(F.aggregate(spans, F.array().cast(run), add), cut)).otherwise(text)


def without_secrets(docs: DataFrame, scope: int = 400, mark: str = "<SECRET>", text: str = "text") -> DataFrame:
    """All rows and columns of ``docs``, with every secret in the text replaced by ``mark``."""
    cleaned = redacted(F.col("row")[text], F.col("secrets.spans"), mark).alias(text)
    return _with_spans(docs, scope, text).select(*[cleaned if c == text else F.col("row")[c].alias(c) for c in docs.columns])


def digest(spans: Column) -> Column:
    """SHA-256 of the span list, as lowercase hex."""
    return F.sha2(span_list(spans).cast("binary"), 256)
