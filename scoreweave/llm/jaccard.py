"""N-gram Jaccard join: prefix filter on rare shingles first, with length, positional and suffix filters.

1. Documents become sets of shingle names (64 bits); equal sets form a class, and only classes are compared.
2. A longer prefix in hash order cuts the work: two linked sets share at least ``l`` of their prefix tokens, so a set
   with fewer repeated ones has no partner. Only these tokens, about a fifth, are shuffled, packed by cells of the
   name space; a token that is frequent in one batch leaves it once.
3. What is left is ordered by its true frequency, rarest first, ties by name. Tokens of frequency 1 lead and match
   nobody; the rest of the prefix is joined, under the length and positional filters.
4. In a list of classes with a common token, each is first compared with one leader, the most central of them. Then
   only classes still apart are paired, those of the list's largest component on one side only: no link is lost, and
   a group of copies costs its size, not the square. Every pair is verified once, after a bound from partitioned
   suffix counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreweave.llm.common import few_at_once, filled, scratch, text_key
from scoreweave.llm.components import components
from scoreweave.session import cut_lineage

#: Parts of the name space whose counts bound an overlap (the suffix filter).
PARTS = 16
#: Tokens of the sets that are counted together.
LOT = 1_000_000
#: Sets that leave a task together.
SETS = 256
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit names of the word shingles; fewer words than ``width`` make one shingle, none make none."""
    # Bytes lower-case A-Z only, and split at space and tab to carriage return only.
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b"\n".join(words), seed=len(words))], np.uint64).view(np.int64)
    name = xxhash.xxh3_64_intdigest
    w = np.array([name(x) for x in words], np.uint64)
    n = len(w) - width + 1
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            h = (h ^ (h >> np.uint64(31))) * _A + w[k : k + n] * _B
        h = (h ^ (h >> np.uint64(32))) * _A
        h ^= h >> np.uint64(29)
    return np.unique(h.view(np.int64))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int64()))


def _ceil(n: np.ndarray | int, percent: int) -> int:
    return -(-n * percent // 100)


def _alpha(n: Column, m: Column, percent: int) -> Column:
    """Least overlap of linked sets of sizes ``n`` and ``m``: 100 i >= percent (n + m - i)."""
    return F.ceil(F.lit(percent) * (n + m) / F.lit(100 + percent))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) of classes that are linked."""
    side = lambda k: sets.select(F.col("cid").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in ("names", "parts")])
    both = pairs.join(side("u"), "u").join(side("v"), "v")
    n, m = F.size("names_u"), F.size("names_v")
    bound = F.aggregate(F.zip_with("parts_u", "parts_v", lambda a, b: F.least(a, b)), F.lit(0).cast("long"), lambda a, x: a + x)
    overlap = F.when(bound >= _alpha(n, m, percent), F.size(F.array_intersect("names_u", "names_v"))).otherwise(0)
    return both.filter((100 + percent) * overlap >= percent * (n + m)).select("u", "v")


def near_duplicates(
    docs: DataFrame, width: int = 4, percent: int = 85, extra: int = 8, cell_bits: int | None = None,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row (doc_id, n_shingles, component_id) per row of ``docs``, by links of Jaccard >= ``percent`` / 100.

    ``component_id`` is the smallest doc_id reachable by links, itself included. Null, empty and blank texts have no
    shingles and link with nothing, so they keep their own id. Repeated rows and equal texts link; null ids are never
    the smallest. An empty table gives no rows; other columns are left out. ``extra`` is the part of a set, in
    percent, by which the first prefix is longer than it must be, and ``cell_bits`` sets how many cells its tokens
    are dealt to (as many as the rows need, if not given); neither changes the result. Equal 64-bit names of different sets are taken for equal sets.
    """
    members = _members(docs, width, percent, extra, cell_bits, doc_id, text)
    least = members.filter("_class is not null").groupBy("_class").agg(F.min("doc_id").alias("_least"))
    out = members.join(least, "_class", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("_least", "doc_id").alias("component_id"))


def one_of_each(
    docs: DataFrame, width: int = 5, percent: int = 80, extra: int = 8, cell_bits: int | None = None,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """The rows of ``docs``, all columns, without near duplicates: of each group of linked texts one row stays, that
    with the least id (null ids last, equal ids by the text's digest).

    Texts without a word are linked with nothing and all stay. Different texts that share an id, or have none, are
    judged each by its own text.
    """
    members = _members(docs, width, percent, extra, cell_bits, doc_id, text).filter("_class is not null")
    first = members.groupBy("_class").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("first"))
    # Ids that may be null are compared as text; equal texts are in one class, so an id and a text name one row of it.
    name = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("")).alias("name")
    chosen = first.select(name(F.col("first.doc_id")), F.col("first.key").alias("key"))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(whole, name(F.col(doc_id)), text_key(text).alias("key"), filled(text).rlike(r"[^\x20\x09-\x0D]").alias("words"))
    kept = rows.filter("words").join(chosen, ["name", "key"], "left_semi").dropDuplicates(["name", "key"])
    return kept.select("row.*").unionByName(rows.filter("not words").select("row.*"))


def _members(docs: DataFrame, width: int, percent: int, extra: int, cell_bits: int | None, doc_id: str, text: str) -> DataFrame:
    """One row (doc_id, n, key, _class) per row of ``docs``; equal classes are linked, a text without words has none."""
    kind = dict(docs.dtypes)[doc_id]
    # A cell's tokens meet in one task: twice the rows, twice the cells.
    bits = cell_bits or max(10, (docs.count() >> 13).bit_length())
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), text_key(text).alias("key"))
    fields = f"doc_id {kind}, n long, cid long, key binary, batch long, at long, hits long, cell long, names binary, owners binary"
    summary, forget = scratch(source.mapInArrow(lambda b: _summaries(b, width, percent, extra, bits, kind), fields))
    rows = cut_lineage(summary.filter("cell is null").select("doc_id", "n", "cid", "key", "batch", "at", "hits"))
    wanted = cut_lineage(_with_partners(rows, summary.filter("cell is not null"), percent, extra))
    forget()
    texts = _perhaps_in(source.select("key", "text"), wanted, "key")
    texts = texts.join(wanted, "key").select("cid", "text").dropDuplicates(["cid"])
    sets = cut_lineage(texts.mapInArrow(lambda b: _sets(b, width), "cid long, lot long, names array<long>, parts array<long>"))
    labels = components(_links(sets, percent, bits))
    members = rows.select("doc_id", "n", "cid", "key").join(labels, F.col("cid") == F.col("node"), "left")
    return members.select("doc_id", "n", "key", F.coalesce("label", "cid").alias("_class"))


def _summaries(batches: Iterator[pa.RecordBatch], width: int, percent: int, extra: int, bits: int, kind: str):
    """A row per document, and a row per cell with the prefix tokens of the batch's documents."""
    names = ["doc_id", "n", "cid", "key", "batch", "at", "hits", "cell", "names", "owners"]
    types = [None, *[pa.int64()] * 2, pa.binary(), *[pa.int64()] * 4, pa.binary(), pa.binary()]
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        cids, sizes, heads, fresh = [], [], [], []
        first: dict[int, int] = {}
        for k, value in enumerate(few_at_once(batch.column(1))):
            s = shingles(value, width)
            n = len(s)
            cids.append(xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if n else None)
            sizes.append(n)
            if n and first.setdefault(cids[k], k) == k:
                fresh.append(k)
                heads.append(s[: n - _ceil(n, percent) + max(1, _ceil(n, extra))].copy())  # a slice would keep all of the set
        tokens = np.concatenate(heads or [np.zeros(0, np.int64)])
        owners = np.repeat(np.array(fresh, np.uint32), np.array([len(h) for h in heads], np.int64))
        heads.clear()
        order = np.argsort(tokens, kind="stable")
        tokens, owners = tokens[order], owners[order]
        same = tokens[1:] == tokens[:-1]
        again = np.concatenate([[False], same]) | np.concatenate([same, [False]]) if len(tokens) else np.zeros(0, bool)
        hits = np.bincount(owners[again], minlength=len(cids))
        hits = [int(hits[first[c]]) if c is not None else 0 for c in cids]
        # A token of several documents here is known to repeat: it leaves once, without an owner.
        keep = ~again | np.concatenate([[True], ~same]) if len(tokens) else again
        owners = np.where(again, np.uint32(0xFFFFFFFF), owners)[keep]
        tokens = tokens[keep]
        at = [first[c] if c is not None else None for c in cids]
        none = [None] * len(cids)
        columns = [batch.column(0), sizes, cids, batch.column(2), [number] * len(cids), at, hits, none, none, none]
        arrays = [c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, names=names)
        cell = (tokens.view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(64 - bits)
        cuts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, int)
        ends = [*cuts[1:].tolist(), len(cell)]
        none = [None] * len(cuts)
        packed = [[x[a:b].tobytes() for a, b in zip(cuts.tolist(), ends, strict=False)] for x in (tokens, owners)]
        columns = [none, none, none, none, [number] * len(cuts), none, none, cell[cuts].astype(np.int64), *packed]
        types[0] = batch.schema.field(0).type
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)
        number += 1


def _repeated(cell: pa.Table) -> pa.Table:
    """Of one cell: how many tokens of each (batch, owner) occur in other batches too, or repeat in one."""
    names = [np.frombuffer(x, np.int64) for x in cell["names"].to_pylist()]
    batches = np.repeat(cell["batch"].to_numpy(), [len(x) for x in names])
    owners = np.concatenate([np.frombuffer(x, np.uint32) for x in cell["owners"].to_pylist()]).astype(np.int64)
    _, place, count = np.unique(np.concatenate(names), return_inverse=True, return_counts=True)
    hit = (count[place] > 1) & (owners != 0xFFFFFFFF)
    inside = np.zeros(len(count), bool)
    inside[place[owners == 0xFFFFFFFF]] = True
    hit |= inside[place] & (owners != 0xFFFFFFFF)
    pairs, count = np.unique(np.stack([batches[hit], owners[hit]]), axis=1, return_counts=True)
    return pa.table({"batch": pairs[0].astype(np.int64), "at": pairs[1].astype(np.int64), "more": count.astype(np.int64)})


def _with_partners(rows: DataFrame, cells: DataFrame, percent: int, extra: int) -> DataFrame:
    """(cid, key) of the sets that may have a partner: enough tokens of their first prefix occur elsewhere."""
    found = cells.select("cell", "batch", "names", "owners").groupBy("cell").applyInArrow(_repeated, "batch long, at long, more long")
    found = found.groupBy("batch", "at").agg(F.sum("more").alias("more"))
    need = F.greatest(F.lit(1), F.ceil(F.lit(extra) * F.ceil(F.lit(percent) * F.col("n") / 100) / 100))
    both = rows.filter("cid is not null").join(found, ["batch", "at"], "left")
    both = both.filter(F.col("hits") + F.coalesce("more", F.lit(0)) >= need)
    return both.groupBy("cid").agg(F.min("key").alias("key"))


def _perhaps_in(rows: DataFrame, wanted: DataFrame, key: str, bits: int = 24) -> DataFrame:
    """Rows whose key may be among the wanted ones: a filter of 2^bits bits, sent to all tasks as 2^bits / 2^15 rows.

    It keeps most texts that aren't wanted from being shuffled for the join that follows; its size never grows.
    """
    place = F.pmod(F.xxhash64(key), F.lit(1 << bits))
    marks = wanted.select(place.alias("_p")).groupBy(F.bitmap_bucket_number("_p").alias("_bucket"))
    marks = marks.agg(F.bitmap_construct_agg(F.bitmap_bit_position("_p")).alias("_map"))
    rows = rows.withColumn("_p", place).join(F.broadcast(marks), F.bitmap_bucket_number("_p") == F.col("_bucket"))
    at = F.bitmap_bit_position("_p")
    byte = F.conv(F.hex(F.substring("_map", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return rows.filter(F.getbit(byte, (at % 8).cast("int")) == 1).drop("_p", "_bucket", "_map")


def _arrays(column: pa.Array) -> list[np.ndarray]:
    """The arrays of a list column."""
    sizes = np.diff(column.offsets.to_numpy())
    return np.split(column.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)[:-1]) if len(column) else []


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Sets with the counts of their parts, and a lot number: a lot holds about ``LOT`` tokens, or one set."""
    lot, held = TaskContext.get().partitionId() << 32, 0
    for whole in batches:
        for start in range(0, whole.num_rows, SETS):
            batch = whole.slice(start, SETS)
            sets, lots = [shingles(value, width) for value in batch.column(1).to_pylist()], []
            for s in sets:
                if held and held + len(s) > LOT:
                    lot, held = lot + 1, 0
                held += len(s)
                lots.append(lot)
            parts = [np.bincount(s & (PARTS - 1), minlength=PARTS).astype(np.int64) for s in sets]
            columns = [batch.column(0), pa.array(lots, pa.int64()), _lists(sets), _lists(parts)]
            yield pa.RecordBatch.from_arrays(columns, names=["cid", "lot", "names", "parts"])


def _count_lots(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """(cell, lot, names, counts): how often the tokens of a cell occur in what was read of a lot."""
    for batch in batches:
        lots, sets = batch.column(0).to_numpy(), _arrays(batch.column(1))
        rows = []
        for lot in np.unique(lots).tolist():
            names, counts = np.unique(np.concatenate([s for s, k in zip(sets, lots, strict=True) if k == lot]), return_counts=True)
            cell = (names.view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(64 - bits)
            cuts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])).tolist()
            for i, j in zip(cuts, [*cuts[1:], len(cell)], strict=True):
                rows.append((int(cell[i]), lot, names[i:j].tobytes(), counts[i:j].astype(np.int64).tobytes()))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 4
        types = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["cell", "lot", "names", "counts"])


def _frequencies(cell: pa.Table) -> pa.Table:
    """Of one cell: (lot, names, counts) with the counts of all lots, for names that occur more than once."""
    names = [np.frombuffer(x, np.int64) for x in cell["names"].to_pylist()]
    counts = np.concatenate([np.frombuffer(x, np.int64) for x in cell["counts"].to_pylist()])
    _, place = np.unique(np.concatenate(names), return_inverse=True)
    total = np.bincount(place, counts).astype(np.int64)[place]
    out, at = [], 0
    for lot, own in zip(cell["lot"].to_pylist(), names, strict=True):
        t = total[at : at + len(own)]
        at += len(own)
        if (t > 1).any():
            out.append((lot, own[t > 1].tobytes(), t[t > 1].tobytes()))
    columns = list(zip(*out, strict=True)) if out else [()] * 3
    return pa.table([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.binary(), pa.binary()], strict=True)], names=["lot", "names", "counts"])


def _prefixes(sets: pa.Table, found: pa.Table, percent: int) -> pa.Table:
    """Of one lot: (h, cid, n, at) of the joinable tokens of its sets' rare-first prefixes."""
    read = lambda c: np.concatenate([np.frombuffer(x, np.int64) for x in found[c].to_pylist()] or [np.zeros(0, np.int64)])
    names, counts = read("names"), read("counts")
    order = np.argsort(names, kind="stable")
    names, counts, out = names[order], counts[order], []
    for chunk in sets.to_batches() if len(names) else []:
        for cid, own in zip(chunk.column("cid").to_pylist(), _arrays(chunk.column("names")), strict=True):
            at = np.minimum(np.searchsorted(names, own), len(names) - 1)
            often = names[at] == own
            alone = len(own) - int(often.sum())  # tokens of frequency 1 come first
            joinable = max(0, len(own) - _ceil(len(own), percent) + 1 - alone)
            own, times = own[often], counts[at[often]]
            first = own[np.lexsort((own, times))[:joinable]]
            out.append((first, np.full(len(first), cid), np.full(len(first), len(often)), alone + np.arange(len(first))))
    columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4
    return pa.table([pa.array(c, pa.int64()) for c in columns], names=["h", "cid", "n", "at"])


def _postings(sets: DataFrame, percent: int, bits: int) -> DataFrame:
    """(h, cid, n, at): tokens of the rare-first prefixes that occur in several sets, with their places.

    Counting takes two rounds of packed names: lots send each of their names once, with its count, and get the counts
    of all lots back for those that occur again.
    """
    dealt = sets.select("lot", "names").mapInArrow(lambda b: _count_lots(b, bits), "cell long, lot long, names binary, counts binary")
    found = dealt.groupBy("cell").applyInArrow(_frequencies, "lot long, names binary, counts binary")
    lots = sets.select("lot", "cid", "names").groupBy("lot").cogroup(found.groupBy("lot"))
    return lots.applyInArrow(lambda a, b: _prefixes(a, b, percent), "h long, cid long, n long, at long")


def _links(sets: DataFrame, percent: int, bits: int) -> DataFrame:
    """Links (u, v) whose components are those of all links."""
    posts = cut_lineage(_postings(sets, percent, bits))

    def passes() -> Column:
        n, m = F.col("x.n"), F.col("y.n")
        rest = F.least(n - F.col("x.at"), m - F.col("y.at"))
        return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (rest >= _alpha(n, m, percent))

    def candidates(x: DataFrame, y: DataFrame, also: Column) -> DataFrame:
        pairs = x.alias("x").join(y.alias("y"), F.col("x.h") == F.col("y.h")).filter(also & passes())
        return pairs.select(F.least("x.cid", "y.cid").alias("u"), F.greatest("x.cid", "y.cid").alias("v")).distinct()

    # The leader of a list has the token at the least place, so few rare tokens of its own: of near copies it is the one
    # that differs least from what they have in common, and links with every one that links at all by few differences.
    leaders = posts.groupBy("h").agg(F.min(F.struct("at", "n", "cid")).alias("l")).select("h", "l.n", "l.cid", "l.at")
    first = cut_lineage(candidates(posts, leaders, F.col("x.cid") != F.col("y.cid")))
    links = cut_lineage(_verified(first, sets, percent))
    labels = components(links)
    named = posts.join(labels, F.col("cid") == F.col("node"), "left").withColumn("label", F.coalesce("label", "cid")).drop("node")
    named = cut_lineage(named)
    per = named.groupBy("h", "label").agg(F.count(F.lit(1)).alias("c"))
    main = per.groupBy("h").agg(F.max(F.struct("c", "label"))["label"].alias("main"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    mixed = named.join(main.select("h", "main"), "h")
    once = (F.col("y.label") == F.col("y.main")) | (F.col("x.cid") < F.col("y.cid"))
    second = candidates(mixed.filter("label <> main"), mixed, (F.col("x.label") != F.col("y.label")) & once)
    second = second.join(first, ["u", "v"], "left_anti")
    return links.unionByName(_verified(second, sets, percent))
