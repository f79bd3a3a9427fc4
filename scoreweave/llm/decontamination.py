"""Benchmark decontamination by the q-gram lemma in diagonal bands, verified by banded alignment.

Items are cut into overlapping segments of three quarters of ``length`` characters, a quarter of it apart, so any
passage of ``length`` characters holds a whole one. A region of a document within ``k`` edits of a segment of n
characters shares at least n + 1 - q (k + 1) of its q-grams with it, and their diagonals (place in the document less
place in the segment) differ by at most ``k``. So q-gram hits are counted in overlapping bands of diagonals, bands under
the bound are dropped, and the others are aligned. A segment that is found counts if ``length`` characters of the item
around it are found too, as they are or within the edit budget. Documents never move: the items, in blocks of bounded
size, are sent to the tasks, one pass for each block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from scoreweave.llm.common import few_at_once

#: Fixed odd multiplier of the q-gram hash, characters of one vector pass, and bits of the first lookup.
_MIX, _CHUNK, _BITS = np.uint64(0x9E3779B97F4A7C15), 1_000_000, 22


def _hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of every q-gram, by doubling: a gram's hash follows from those of its two halves."""
    with np.errstate(over="ignore"):
        h, width = (codes.astype(np.uint64) + np.uint64(1)) * _MIX, 1
        while width < q:
            step = min(width, q - width)
            h = (h[:-step] * _MIX) ^ (h[step:] + (h[step:] >> np.uint64(29)))
            width += step
        return (h ^ (h >> np.uint64(32))) * _MIX


def edits(segment: str, region: str, limit: int) -> tuple[int, int] | None:
    """Fewest edits that turn ``segment`` into a part of ``region``, and that part's end; None above ``limit``.

    Cells outside the band that ``limit`` edits and the spare length of the region allow are not filled.
    """
    n, m = len(segment), len(region)
    spare = max(0, m - n) + limit
    above = {j: 0 for j in range(m + 1)}
    for i in range(1, n + 1):
        row, c = {}, segment[i - 1]
        for j in range(max(0, i - limit), min(m, i + spare) + 1):
            best = above.get(j, limit + 1) + 1
            if j:
                best = min(best, row.get(j - 1, limit + 1) + 1, above.get(j - 1, limit + 1) + (c != region[j - 1]))
            if best <= limit:
                row[j] = best
        if not row:
            return None
        above = row
    end = min(above, key=lambda j: (above[j], j))
    return above[end], end


class Index:
    """Segments of some items (number, folded text) and their q-grams, sorted by hash."""

    def __init__(self, items: list[tuple[int, str]], q: int, length: int, rate: float):
        self.q, self.length, self.rate, self.texts = q, length, rate, dict(items)
        self.segments: list[tuple[int, str, int]] = []  # item, text, edit budget
        self.at: list[int | None] = []  # place in the item, None if the segment is all of it
        self.short = [(i, t) for i, t in items if 0 < len(t) < 2 * q]
        part = max(2 * q, 3 * length // 4)
        for item, text in items:
            if len(text) >= 2 * q:
                last = len(text) - part
                places = [None] if len(text) < length else sorted({*range(0, last, max(1, length - part)), last})
                for at in places:
                    piece = text if at is None else text[at : at + part]
                    self.segments.append((item, piece, min(int(rate * len(piece)), (len(piece) + 1 - q - 1) // q)))
                    self.at.append(at)
        codes = [_hashes(_codes(s), q) for _, s, _ in self.segments]
        sizes = [len(c) for c in codes]
        hashes = np.concatenate(codes) if codes else np.zeros(0, np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        self.segment = np.repeat(np.arange(len(sizes)), sizes)[order]
        self.place = np.concatenate([np.arange(n) for n in sizes])[order] if sizes else np.zeros(0, int)
        self.need = np.array([len(s) + 1 - q * (k + 1) for _, s, k in self.segments], int)
        self.band = max([k for _, _, k in self.segments], default=0) + 1
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[(self.hashes >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def candidates(self, codes: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(segment, first, last diagonal) of the bands that hold enough hits."""
        if len(codes) < self.q or not len(self.hashes):
            return
        h = _hashes(codes, self.q)
        at = np.flatnonzero(self.seen[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
        low, high = np.searchsorted(self.hashes, h[at], "left"), np.searchsorted(self.hashes, h[at], "right")
        count = high - low
        at, low, count = at[count > 0], low[count > 0], count[count > 0]
        if not len(at):
            return
        entry = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        segment, diagonal = self.segment[entry], np.repeat(at, count) - self.place[entry]
        shift = self.length + self.band
        band = (diagonal + shift) // self.band
        span = int(band.max()) + 2
        # Each hit counts in two bands of twice the width, so diagonals that differ by less share one.
        key = np.concatenate([segment * span + band, segment * span + band - 1])
        key, hits = np.unique(key, return_counts=True)
        key = key[hits >= self.need[key // span]]
        for k in key.tolist():
            first = (k % span) * self.band - shift
            yield k // span, first, first + 2 * self.band - 1

    def _long_enough(self, number: int, text: str, end: int, changed: int) -> bool:
        """Whether the item goes on around a segment that was found, its last character before ``end``, for ``length``
        characters in all."""
        item, segment, _ = self.segments[number]
        at, whole = self.at[number], self.texts[item]
        if at is None or len(segment) >= self.length:
            return True
        start, spare = end - len(segment), self.length - len(segment)
        if not changed:
            left = right = 0
            while left < spare and at - left > 0 and start - left > 0 and whole[at - left - 1] == text[start - left - 1]:
                left += 1
            stop = at + len(segment)
            while right < spare and stop + right < len(whole) and end + right < len(text) and whole[stop + right] == text[end + right]:
                right += 1
            if left + right >= spare:
                return True
        budget = int(self.rate * self.length)
        region = text[max(0, start - spare - budget) : end + spare + budget]
        begins = {max(0, min(at - back, len(whole) - self.length)) for back in (0, spare // 2, spare)}
        return any(edits(whole[b : b + self.length], region, budget) for b in begins)

    def scan(self, text: str) -> dict[int, tuple[int, int, int, int]]:
        """Per item found: first start, last end (of regions looked at), verified segments, fewest edits."""
        found: dict[int, tuple[int, int, int, int]] = {}
        overlap = 4 * self.length + 2 * self.band
        done: set[tuple[int, int]] = set()

        def add(item: int, start: int, end: int, n: int) -> None:
            a, b, c, d = found.get(item, (start, end, 0, n))
            found[item] = (min(a, start), max(b, end), c + 1, min(d, n))

        for base in range(0, max(1, len(text)), _CHUNK):
            part = text[base : base + _CHUNK + overlap]
            for number, first, last in self.candidates(_codes(part)):
                item, segment, budget = self.segments[number]
                low = max(0, first - budget)
                region = part[low : last + len(segment) + budget + 1]
                exact = region.find(segment)
                hit = (0, exact + len(segment)) if exact >= 0 else edits(segment, region, budget)
                if hit and (number, base + low + hit[1]) not in done and self._long_enough(number, part, low + hit[1], hit[0]):
                    done.add((number, base + low + hit[1]))
                    add(item, base + low + hit[1] - len(segment), base + low + hit[1], hit[0])
        for item, short in self.short:
            at = text.find(short)
            if at >= 0:
                add(item, at, at + len(short), 0)
        return {i: (max(0, a), b, c, d) for i, (a, b, c, d) in found.items()}


def folded(text: str | None) -> str:
    """The text with A to Z in lower case; its length stays."""
    return (text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _blocks(items: DataFrame, item_id: str, text: str, limit: int) -> Iterator[tuple[list, list[tuple[int, str]]]]:
    """Items in blocks of at most ``limit`` characters (or one item): their ids, and their texts by number."""
    names, block, size = [], [], 0
    for item, value in items.select(item_id, text).toLocalIterator():
        if not value:
            continue
        if block and size + len(value) > limit:
            yield names, block
            names, block, size = [], [], 0
        block.append((len(names), folded(value)))
        names.append(item)
        size += len(value)
    if block:
        yield names, block


def leaks(
    docs: DataFrame, items: DataFrame, q: int = 12, length: int = 64, rate: float = 0.05, block: int = 4_000_000,
    doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """One row (doc_id, item_id, start, end, n_segments, edits) for each document and item that it holds a part of.

    A part is a passage of at least ``length`` characters (or a whole shorter item) with at most ``rate`` edits a
    character; every unchanged passage of ``length`` characters is found. Capitals A to Z don't matter. Items under 2q
    characters must occur as they are; null or empty items and texts match nothing. Ids may have any type; an item
    without an id is reported with a null one. Repeated documents and null ids give their own rows; empty tables none.
    """
    kind, item_kind = dict(docs.dtypes)[doc_id], dict(items.dtypes)[item_id]
    schema = f"doc_id {kind}, item_id {item_kind}, start long, end long, n_segments long, edits long"
    source, out, id_type = docs.select(doc_id, text), None, to_arrow_type(items.schema[item_id].dataType)
    for names, part in _blocks(items, item_id, item_text, block):

        def run(batches: Iterator[pa.RecordBatch], part=part, names=names) -> Iterator[pa.RecordBatch]:
            index, known = Index(part, q, length, rate), pa.array(names, id_type)
            for batch in batches:
                rows, hits = [], []
                for k, value in enumerate(few_at_once(batch.column(1))):
                    for item, hit in index.scan(folded(value)).items():
                        rows.append(k)
                        hits.append((item, *hit))
                columns = list(zip(*hits, strict=True)) if hits else [()] * 5
                ids = batch.column(0).take(pa.array(rows, pa.int64()))
                numbers = [pa.array(c, pa.int64()) for c in columns]
                named = ["doc_id", "item_id", "start", "end", "n_segments", "edits"]
                yield pa.RecordBatch.from_arrays([ids, known.take(numbers[0]), *numbers[1:]], names=named)

        found = source.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return docs.sparkSession.createDataFrame([], schema)
    return out


def without_leaks(docs: DataFrame, items: DataFrame, q: int = 12, length: int = 64, rate: float = 0.05, block: int = 4_000_000, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:  # noqa: E501
    """The rows of ``docs``, all columns, that hold no part of any item; the rules are those of ``leaks``."""
    place = docs.columns.index(text)
    for _, part in _blocks(items, item_id, item_text, block):

        def run(batches: Iterator[pa.RecordBatch], part=part) -> Iterator[pa.RecordBatch]:
            index = Index(part, q, length, rate)
            for batch in batches:
                clean = [not index.scan(folded(value)) for value in few_at_once(batch.column(place))]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
