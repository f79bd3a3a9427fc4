"""Vector codes: integer vectors cut into parts, each part named by its nearest entry of that part's codebook.

Components are integers, so a block of rows has few distinct values per dimension. Each block is kept as a dictionary
of values and one code per component. A round tabulates, per dimension, the squared differences of the block's values
to all entries of the codebook; the distances of all parts are then gathers from these tables and additions. All
arithmetic is exact. Only sums and counts per entry leave a task, and only codebooks reach the driver: parts x entries
rows, whatever the table's size.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreweave.llm.common import scratch

#: Components of a block of rows, all dimensions together.
BLOCK = 1 << 22
#: Integers up to here have squared differences that add up within 64 bits over 256 dimensions.
_NARROW = 1 << 26
#: Components beyond this have no code: their sums would not stay exact.
_WIDEST = 1 << 52
_LONG = (1 << 63) - 1


@dataclass(frozen=True)
class Codebooks:
    """``entries[part][entry]``: the integer components of an entry; ``scale`` is what components are multiplied by."""

    entries: list[list[list[int]]]
    scale: int
    dims: int

    def sha256(self) -> str:
        numbers = (str(x) for part in self.entries for entry in part for x in entry)
        return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def kept(vectors: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is there and holds finite numbers only."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(v.isNotNull() & F.coalesce(finite, F.lit(False)))


def _codable(v, scale: int):
    return F.forall(v, lambda x: F.abs(x.cast("double") * scale) <= float(_WIDEST))


def _matrix(column: pa.Array, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows can be coded, and their components as whole float64 numbers."""
    lengths = np.diff(column.offsets.to_numpy())
    fits = lengths == dims
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if not fits.all():
        flat = flat[np.repeat(fits, lengths)]
    whole = np.floor(flat.reshape(int(fits.sum()), dims) * scale)
    narrow = (np.abs(whole) <= _WIDEST).all(axis=1)
    fits[np.flatnonzero(fits)[~narrow]] = False
    return fits, whole[narrow]


def _dictionaries(whole: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Per dimension the distinct values and the code of each row's component; a row of codes per dimension."""
    codes, values = np.empty(whole.shape[::-1], np.uint32), []
    for d in range(whole.shape[1]):
        found, inverse = np.unique(whole[:, d], return_inverse=True)
        values.append(found)
        codes[d] = inverse.reshape(-1)
    return values, codes


def _numbers(values: np.ndarray, wide: bool) -> np.ndarray:
    """Whole float64 numbers as 64-bit integers, or as Python's where these might not do."""
    return np.array([int(x) for x in values], object) if wide else values.astype(np.int64)


def _nearest(values: list[np.ndarray], codes: np.ndarray, part: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row, the lower one of equally near ones, and the squared distance."""
    wide = any(abs(x) > _NARROW for entry in part for x in entry) or any(np.abs(v).max(initial=0) > _NARROW for v in values)
    wide, rows = wide or len(values) > 256, codes.shape[1]
    best, least = np.zeros(rows, np.uint8 if len(part) <= 256 else np.int64), np.zeros(rows, object if wide else np.int64)
    kind = object if wide else np.int64
    tables = []
    for d, found in enumerate(values):
        entries = np.array([entry[d] for entry in part], kind)
        tables.append((_numbers(found, wide)[:, None] - entries[None, :]) ** 2)
    step = 8192  # the distances of so many rows stay in the cache
    for k in range(0, rows, step):
        distance = np.zeros((min(step, rows - k), len(part)), kind)
        for d, table in enumerate(tables):
            distance += table[codes[d, k : k + step]]
        near = distance.argmin(axis=1)
        best[k : k + step] = near
        least[k : k + step] = distance[np.arange(len(near)), near]
    return best, least


def _encoded(vectors: DataFrame, vector: str, dims: int, parts: int, scale: int) -> DataFrame:
    """Rows (part, n, values, codes) for each block of rows: per dimension its dictionary, and the codes."""
    width, most = dims // parts, max(1, min(65536, BLOCK // dims))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def out() -> pa.RecordBatch:
            values, codes = _dictionaries(np.concatenate(held))
            columns = [[], [], [], []]
            for p in range(parts):
                own = range(p * width, p * width + width)
                row = (p, codes.shape[1], [values[d].tobytes() for d in own], [codes[d].astype("<u2").tobytes() for d in own])
                for column, x in zip(columns, row, strict=True):
                    column.append(x)
            kinds = [pa.int32(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["part", "n", "values", "codes"])

        for batch in batches:
            whole = _matrix(batch.column(0), dims, scale)[1]
            while len(whole):
                taken = whole[: most - rows]
                held.append(taken)
                rows += len(taken)
                whole = whole[len(taken) :]
                if rows == most:
                    yield out()
                    held, rows = [], 0
        if rows:
            yield out()

    return vectors.select(vector).mapInArrow(blocks, "part int, n long, values array<binary>, codes array<binary>")


def fit_codebooks(
    vectors: DataFrame, entries: int = 16, parts: int = 8, rounds: int = 6, scale: int = 4096,
    vec_id: str = "vec_id", vector: str = "embedding",
) -> Codebooks | None:
    """Codebooks of all rows; None if there is no row to begin with.

    Each part's codebook starts as that part of the ``entries`` rows with the least ids (null ids last, equal ids by
    components), and has fewer entries if there are fewer rows. A round names the nearest entry of each row and then
    replaces each entry by the floor of the mean of its rows; entries without rows stay. Of the rows with any component
    the one with the least id tells the number of dimensions; rows of another length, or with components beyond
    2 ** 52, have no part in it.
    """
    rows = kept(vectors, vector).select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("embedding"))
    order = [F.col("vec_id").asc_nulls_last(), F.col("embedding").asc()]
    lead = rows.filter(F.size("embedding") > 0).orderBy(*order).select(F.size("embedding").alias("dims")).first()
    if lead is None:
        return None
    dims = lead["dims"]
    if dims % parts:
        raise ValueError(f"{dims} dimensions can't be cut into {parts} equal parts")
    usable = rows.filter((F.size("embedding") == dims) & _codable(F.col("embedding"), scale))
    start = [[math.floor(x * scale) for x in r["embedding"]] for r in usable.orderBy(*order).select("embedding").limit(entries).collect()]
    if not start:
        return None
    width = dims // parts
    books = [[row[p * width : p * width + width] for row in start] for p in range(parts)]
    blocks, forget = scratch(_encoded(rows, "embedding", dims, parts, scale))
    try:
        for _ in range(rounds):
            for r in _sums(blocks, books).collect():  # parts x entries rows
                books[r["part"]][r["entry"]] = [int(s) // r["n"] for s in r["sums"]]
    finally:
        forget()
    return Codebooks(books, scale, dims)


def _sums(blocks: DataFrame, books: list) -> DataFrame:
    """Rows (part, entry, n, sums): how many rows an entry is nearest to, and their sum by component."""
    width = len(books[0][0])

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for part, n, values, codes in zip(batch["part"], batch["n"], batch["values"], batch["codes"], strict=True):
                found = [np.frombuffer(v, np.float64) for v in values]
                where = np.concatenate([np.frombuffer(c, "<u2") for c in codes]).reshape(width, n)
                best = _nearest(found, where, books[part])[0]
                size = len(books[part])
                counts, totals = np.bincount(best, minlength=size), np.empty((size, width), object)
                for d, v in enumerate(found):
                    # How often each entry meets each value: again no work per component but counting.
                    met = np.bincount(best.astype(np.int64) * len(v) + where[d], minlength=size * len(v)).reshape(size, len(v))
                    wide = np.abs(v).max(initial=0) > 2**40
                    totals[:, d] = [int(x) for x in met.astype(object if wide else np.int64) @ _numbers(v, wide)]
                for e in np.flatnonzero(counts).tolist():
                    out.append((part, e, int(counts[e]), [str(x) for x in totals[e]]))
            yield pd.DataFrame(out, columns=["part", "entry", "n", "sums"])

    partial = blocks.mapInPandas(add, "part int, entry int, n long, sums array<string>")
    total = F.array(*[F.sum(F.get("sums", F.lit(d)).cast("decimal(38,0)")) for d in range(width)])
    return partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), total.alias("sums"))


def encode(
    vectors: DataFrame, books: Codebooks | None, vec_id: str = "vec_id", vector: str = "embedding", keep: Sequence[str] = ()
) -> DataFrame:
    """vec_id, code (per part the entry's number in two hex digits, four beyond 256 entries), error (squared distance
    over all parts), and the columns of ``keep``; other columns are left out.

    Rows whose vector is null or holds null or non-finite components are left out. Rows of another length than the
    codebooks, or with components beyond 2 ** 52, have a null code and error; so has every row if there are no
    codebooks. An error beyond 64 bits is null. Repeated rows get the same code. No shuffle.
    """
    rows = kept(vectors, vector).select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("_vector"), *keep)
    fields = [f for f in rows.schema.fields if f.name != "_vector"]
    if len({f.name for f in fields} - {"code", "error"}) < 1 + len(keep):
        raise ValueError("columns to keep can't be named vec_id, code or error")
    if books is None:
        return rows.select("vec_id", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"), *keep)
    fields[1:1] = [T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]
    parts, most = len(books.entries), max(map(len, books.entries))
    width, digits = books.dims // parts, 2 if most <= 256 else 4
    names = [f"{k:0{digits}x}" for k in range(most)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shown = np.array(names)
        for batch in batches:
            fits, whole = _matrix(batch.column(1), books.dims, books.scale)
            values, codes = _dictionaries(whole)
            text, total = np.full(len(whole), ""), np.zeros(len(whole), object if books.dims > 256 else np.int64)
            for p, part in enumerate(books.entries):
                own = slice(p * width, p * width + width)
                best, least = _nearest(values[own], codes[own], part)
                text = np.char.add(text, shown[best])
                total = total + (least.astype(object) if total.dtype == object or least.dtype == object else least)
            coded, errors = np.full(batch.num_rows, None, object), np.full(batch.num_rows, None, object)
            coded[fits], errors[fits] = text, [x if x <= _LONG else None for x in total.tolist()]
            found = [pa.array(coded, pa.string()), pa.array(errors, pa.int64())]
            rest = [batch.column(k) for k in range(2, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *found, *rest], [f.name for f in fields])

    return rows.mapInArrow(run, T.StructType(fields))
