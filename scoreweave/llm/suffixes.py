"""Repeated byte strings by distributed prefix doubling on sampled suffixes.

Prefix doubling ranks suffixes by their first h bytes, pairs the rank at a place with that h bytes on, and ranks the
pairs, dropping places whose rank is unique, until h reaches the threshold. Here a rank is a name: a hash that follows
from the names of the two halves, so equal strings have equal names in every task and a round needs no global order;
Spark deals the names by range (a cell holds a stretch of the sorted names) and finds the unique ones. Ranking every
byte would move many times the input, so the rounds run where they can matter:

* h = 50, at sampled places: the smallest name of each stretch of 151 places. Any 200 bytes hold such a place, chosen
  by these bytes alone, so a window whose sample is unique is itself unique and leaves.
* Windows with one sample form a run. Runs are named whole; equal runs are past the threshold at once.
* Runs left over, and one example of each settled run with their sample, are cut at fixed distances from the sample
  into blocks of 16 windows. All windows of a block hold its core of 185 bytes: where that is unique, they leave. All
  lie in 215 bytes: where these repeat, they are settled.
* h = 100 and 200, at every place of the blocks left over.

Equal texts are one text of weight 2. Hot strings leave a batch once, so a cell never receives a row for each copy.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreweave.llm.common import filled, scratch, text_key
from scoreweave.session import cut_lineage, new_table_path

#: Places of one pass over a text, and the owner that stands for a name known to repeat.
_CHUNK, _KNOWN = 1 << 20, 0xFFFFFFFF
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_CELLS = "batch long, at long, place long, cell long, a binary, b binary, owner binary, places binary"


def names(data: np.ndarray, h: int) -> np.ndarray:
    """Names of the h-byte strings at every place, by doubling."""
    with np.errstate(over="ignore"):
        out, width = (data.astype(np.uint64) + np.uint64(1)) * _A, 1
        while width < h:
            step = min(width, h - width)
            out = (out[:-step] ^ (out[:-step] >> np.uint64(32))) * _A + out[step:] * _B
            width += step
        return (out ^ (out >> np.uint64(29))) * _A


def samples(name: np.ndarray, stretch: int) -> np.ndarray:
    """For every stretch of ``stretch`` names, the place of its smallest (in the upper 44 bits; the first on ties)."""
    low = np.uint64(_CHUNK - 1)
    least, width = (name & ~low) | np.arange(len(name), dtype=np.uint64), 1
    while width < stretch:
        step = min(width, stretch - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    return (least & low).astype(np.int64)


def _passes(data: bytes, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """(base, bytes) of overlapping passes, each window of ``length`` bytes in exactly one."""
    view, step = np.frombuffer(data, np.uint8), _CHUNK - length
    for base in range(0, len(view) - length + 1, step):
        yield base, view[base : base + step + length - 1]


def _runs(data: bytes, length: int, h: int) -> Iterator[tuple[int, int, int, int]]:
    """(first window, last window, place of the sample, name of the sample) of each run of windows.

    A run that goes on in the next pass is one run: two parts would name the block between them twice.
    """
    kept = None
    for base, part in _passes(data, length):
        name = names(part, h)
        place = samples(name, length - h + 1)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        last = np.concatenate([first[1:] - 1, [len(place) - 1]])
        chosen = place[first]
        found = list(zip((first + base).tolist(), (last + base).tolist(), (chosen + base).tolist(), name[chosen].tolist(), strict=True))
        if kept:
            if kept[2] == found[0][2]:
                found[0] = (kept[0], *found[0][1:])
            else:
                yield kept
        kept = found.pop()
        yield from found
    if kept:
        yield kept


def _blocks(runs: list, size: int) -> Iterator[tuple[int, int, int, bool, bytes]]:
    """(first place, first and last window in the run, example or not, way to the sample) of the blocks of runs.

    The way to the sample is part of a block's names: blocks of two samples can hold the same bytes of one text.
    """
    for run in runs:
        place, first, last = run["place"], run["first"], run["last"]
        for start in range(place + (first - place) // size * size, last + 1, size):
            yield start, max(first, start), min(last, start + size - 1), run["heavy"], (place - start).to_bytes(8, "little", signed=True)


def _repeats(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the names (a, b), and the number of each one's group in that order."""
    order = np.lexsort((b, a))
    new = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    return order, np.cumsum(np.concatenate([[0], new])) if len(a) else np.zeros(0, int)


class _Deal:
    """Names with their owners and places, of one batch, dealt to cells."""

    def __init__(self, bits: int):
        self.bits, self.number = bits, TaskContext.get().partitionId() << 32

    def batch(self, a: np.ndarray, b: np.ndarray, owner: np.ndarray, place: np.ndarray, heavy: np.ndarray) -> pa.RecordBatch:
        """``heavy`` marks names of weight 2. Rows (batch, at, place) for those known to repeat, and one per cell."""
        order, group = _repeats(a, b)
        a, b, owner, place, heavy = a[order], b[order], owner[order], place[order], heavy[order]
        size = np.bincount(group)
        again = (size[group] > 1) | (np.bincount(group, heavy)[group] > 0) if len(a) else np.zeros(0, bool)
        start = np.concatenate([[True], group[1:] != group[:-1]]) if len(a) else again
        known = again & ~heavy
        keep = ~again | start
        sent = np.where(again, np.uint32(_KNOWN), owner.astype(np.uint32))[keep]
        a, b, far = a[keep], b[keep], place[keep]
        cell = a >> np.uint64(64 - self.bits)
        cuts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(a) else np.zeros(0, int)
        ends = np.concatenate([cuts[1:], [len(a)]]).astype(int) if len(a) else cuts
        n, m = int(known.sum()), len(cuts)
        pack = lambda x: [None] * n + [x[i:j].tobytes() for i, j in zip(cuts.tolist(), ends.tolist(), strict=True)]
        columns = [
            pa.array([self.number] * (n + m), pa.int64()), pa.array(owner[known].tolist() + [None] * m, pa.int64()),
            pa.array(place[known].tolist() + [None] * m, pa.int64()), pa.array([None] * n + cell[cuts].tolist(), pa.int64()),
            *(pa.array(pack(x), pa.binary()) for x in (a, b, sent, far.astype(np.uint32))),
        ]
        self.number += 1
        return pa.RecordBatch.from_arrays(columns, names=["batch", "at", "place", "cell", "a", "b", "owner", "places"])


def _dealt(deal: _Deal, keys: pa.Array, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """What ``deal`` makes of the columns, then a row (batch, at, key) with cell -1 for every text of the batch."""
    number, n, none = deal.number, len(keys), lambda t: pa.nulls(len(keys), t)
    out = deal.batch(*columns)
    yield out.append_column("key", pa.nulls(out.num_rows, pa.binary()))
    whole = [pa.array(x, pa.int64()) for x in ([number] * n, range(n))] + [none(pa.int64()), pa.array([-1] * n, pa.int64())]
    yield pa.RecordBatch.from_arrays([*whole, *[none(pa.binary())] * 4, keys], names=[*out.schema.names, "key"])


def _found(dealt: DataFrame, places: str) -> DataFrame:
    """(key, array of places) of the names of each text that are not unique."""
    dealt, forget = scratch(dealt)
    found = _survivors(dealt.filter("cell is null or cell >= 0")).groupBy("batch", "at").agg(F.collect_set("place").alias(places))
    found = found.join(dealt.filter("cell = -1").select("batch", "at", "key"), ["batch", "at"]).select("key", places)
    found = cut_lineage(found)
    forget()
    return found


def _meet(cell: pa.Table) -> pa.Table:
    """Of one cell: (batch, at, place) of the names that occur in more than one batch, or repeat in one."""
    read = lambda c, kind: [np.frombuffer(x, kind) for x in cell[c].to_pylist()]
    a = read("a", np.uint64)
    batch = np.repeat(cell["batch"].to_numpy(), [len(x) for x in a])
    a, b, owner, place = np.concatenate(a), *(np.concatenate(read(c, k)) for c, k in (("b", np.uint64), ("owner", np.uint32), ("places", np.uint32)))
    order, group = _repeats(a, b)
    batch, owner, place = batch[order], owner[order].astype(np.int64), place[order].astype(np.int64)
    size = np.bincount(group, 1 + (owner == _KNOWN))
    hit = (size[group] > 1) & (owner != _KNOWN)
    return pa.table({"batch": batch[hit], "at": owner[hit], "place": place[hit]})


def _survivors(dealt: DataFrame) -> DataFrame:
    """(batch, at, place) of the names that are not unique."""
    cells = dealt.filter("cell is not null").select("cell", "batch", "a", "b", "owner", "places")
    found = cells.groupBy("cell").applyInArrow(_meet, "batch long, at long, place long")
    return dealt.filter("cell is null and at is not null").select("batch", "at", "place").unionByName(found)


def _bytes(value: str | None) -> bytes:
    return (value or "").encode("utf-8", "surrogatepass")


def _texts(docs: DataFrame, text: str) -> DataFrame:
    """Distinct texts (key, text, heavy), as a table bucketed by key, so that later joins don't move the texts."""
    spark = docs.sparkSession
    rows = docs.select(text_key(text).alias("key"), filled(text).alias("text"))
    rows = rows.groupBy("key").agg(F.first("text").alias("text"), (F.count(F.lit(1)) > 1).alias("heavy"))
    name, path = f"texts_{uuid.uuid4().hex}", new_table_path(spark, "texts")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = rows.repartition(buckets, "key").write.option("path", path).option("compression", "zstd")
    writer.bucketBy(buckets, "key").saveAsTable(name)
    return spark.table(name)


def remove_repeats(
    docs: DataFrame, length: int = 200, h: int = 50, size: int = 16, cell_bits: int = 10, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row (doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) per row of ``docs``.

    ``spans`` are the maximal byte ranges (start, end exclusive, UTF-8) covered by a ``length``-byte string that also
    starts elsewhere, in the same or another row; rows of equal text repeat each other. Null texts are empty; texts
    under ``length`` bytes lose nothing unless a string overlaps itself; an empty table gives no rows; other columns
    are left out. Names have 64 bits where they only preselect, and 128 bits where they decide.
    """
    if not 2 * h <= length or length % 2 or not 0 < size <= length:
        raise ValueError("length must be even, h at most half of it, and size at most length")
    texts = _texts(docs, text)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deal = _Deal(cell_bits)
        for batch in batches:
            a, owner, place, heavy = [], [], [], []
            for k, (value, twice) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                runs = list(_runs(_bytes(value), length, h))
                found = {(r[2], r[3]) for r in runs}
                a += [n for _, n in found]
                place += [p for p, _ in found]
                owner += [k] * len(found)
                heavy += [twice] * len(found)
            columns = (np.array(c, t) for c, t in ((a, np.uint64), ([0] * len(a), np.uint64), (owner, np.int64), (place, np.int64), (heavy, bool)))
            yield from _dealt(deal, batch.column(0), *columns)

    marks = _found(texts.select("key", "text", "heavy").mapInArrow(sample, _CELLS + ", key binary"), "marks")
    heavy = texts.filter("heavy").select("key", F.lit(None).cast("array<long>").alias("marks"))
    marked = texts.join(marks.unionByName(heavy), "key").select("key", "text", "heavy", "marks")

    def name_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, value, twice, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data, known = _bytes(value), set(places or ())
                for first, last, place, name in _runs(data, length, h):
                    if twice or place in known:
                        part = hashlib.blake2b(data[first : last + length], digest_size=16).digest()
                        out.append((key, first, last, place, name - (1 << 63), part, twice))
            columns = list(zip(*out, strict=True)) if out else [()] * 7
            kinds = [pa.binary(), *[pa.int64()] * 4, pa.binary(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["key", "first", "last", "place", "name", "part", "heavy"])

    runs = cut_lineage(marked.mapInArrow(name_runs, "key binary, first long, last long, place long, name long, part binary, heavy boolean"))
    settled = runs.groupBy("part").agg(
        F.sum(F.when(F.col("heavy"), 2).otherwise(1)).alias("times"), F.min(F.struct("key", "first", "last", "place", "name")).alias("run")
    )
    settled = cut_lineage(settled)
    open_runs = settled.filter("times = 1").select("run.*", F.lit(False).alias("heavy"))
    asked = open_runs.select("name").distinct()
    examples = settled.filter("times > 1").select("run.*", F.lit(True).alias("heavy")).join(asked, "name", "left_semi")
    both = open_runs.unionByName(examples.select(*open_runs.columns))
    both = both.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("first", "last", "place", "heavy"))).alias("runs"))
    both = cut_lineage(both)
    left = texts.select("key", "text").join(both, "key").select("key", "text", "runs")

    def name_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deal = _Deal(cell_bits)
        for batch in batches:
            digests, owner, place, heavy = [], [], [], []
            for k, (value, found) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                data = _bytes(value)
                for number, (start, first, last, example, way) in enumerate(_blocks(found, size)):
                    stop = start + size - 1 + length
                    parts = [(2 * number, data[start + size - 1 : start + length], False)]
                    # A settled run repeats what lies inside it; a block at its end may reach further.
                    inside = example and last - first == size - 1
                    parts += [(2 * number + 1, data[start:stop], inside)] if start >= 0 and stop <= len(data) else []
                    for n, part, twice in parts:
                        digests.append(hashlib.blake2b(part, digest_size=16, salt=way).digest())
                        owner.append(k)
                        place.append(n)
                        heavy.append(twice)
            names_ = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
            yield from _dealt(deal, batch.column(0), names_[:, 0], names_[:, 1], np.array(owner, np.int64), np.array(place, np.int64), np.array(heavy, bool))

    blocks = _found(left.mapInArrow(name_blocks, _CELLS + ", key binary"), "blocks")
    left = left.join(blocks, "key").select("key", "text", "runs", "blocks")

    def pair_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deal, half = _Deal(cell_bits), length // 2
        for batch in batches:
            parts = []
            for k, (value, found, alive) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True)):
                view, alive = np.frombuffer(_bytes(value), np.uint8), set(alive)
                for number, (_, first, last, example, _) in enumerate(_blocks(found, size)):
                    if 2 * number in alive:  # settled ones too, as witnesses of what others share with them
                        name, n = names(view[first : last + length], half), last - first + 1
                        twice = example or 2 * number + 1 in alive
                        parts.append((name[:n], name[half : half + n], np.full(n, k), np.arange(first, last + 1), np.full(n, twice)))
            empty = (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2 + (np.zeros(0, bool),)
            yield from _dealt(deal, batch.column(0), *[np.concatenate(c) for c in zip(*(parts or [empty]), strict=True)])

    places = _found(left.mapInArrow(pair_places, _CELLS + ", key binary"), "places")
    whole = runs.filter("not heavy").join(settled.filter("times > 1").select("part"), "part", "left_semi")
    whole = whole.groupBy("key").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    whole = whole.select("key", F.col("runs").alias("whole"))
    covered = places.join(whole, "key", "full").join(both.join(blocks, "key"), "key", "full")
    covered = texts.join(covered, "key", "left").select("key", "text", "heavy", "places", "whole", "runs", "blocks")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, value, twice, places, whole, runs, alive in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data, alive = _bytes(value), set(alive or ())
                found = [(p, p + length) for p in places or ()] + [(r["first"], r["last"] + length) for r in whole or ()]
                for number, (_, first, last, example, _) in enumerate(_blocks(runs or [], size)):
                    if 2 * number + 1 in alive and not example:
                        found.append((first, last + length))
                found += [(0, len(data))] if twice and len(data) >= length else []
                spans: list[list[int]] = []
                for a, b in sorted(found):
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(b, spans[-1][1])
                    else:
                        spans.append([a, b])
                kept, at = hashlib.sha256(), 0
                for a, b in spans:
                    kept.update(data[at:a])
                    at = b
                kept.update(data[at:])
                out.append((key, len(data), sum(b - a for a, b in spans), len(spans), kept.hexdigest(), [{"start": a, "end": b} for a, b in spans]))
            kinds = [pa.binary(), *[pa.int64()] * 3, pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            columns = list(zip(*out, strict=True)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    fields = "key binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"
    cleaned = covered.mapInArrow(cut, fields)
    named = docs.select(F.col(doc_id).alias("doc_id"), text_key(text).alias("key"))
    return named.join(cleaned, "key").drop("key")
