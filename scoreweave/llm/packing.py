"""Packing by multiway differencing (Karmarkar and Karp): near-equal windows of at most ``capacity`` tokens.

A document is cut into full windows and a rest; the rest is cut into pieces of at most ``grain`` tokens, so that many
small pieces meet in a window. Each task packs the pieces of ``block`` documents at a time: every piece starts as a
partition with one filled window, and the two partitions with the largest imbalance are merged, fullest window with
emptiest, until one is left. If a window exceeds the capacity, the window count rises by one and the block is packed
again. Nothing is shuffled, and memory holds one block.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreweave.llm.common import few_at_once
from scoreweave.llm.tokens import encoder, vocabulary_file

#: A sequence id is the number of the task in the upper bits, and of the sequence within the task in the lower ones.
TASK_BITS = 40


def difference(sizes: list[int], windows: int) -> list[tuple[int, list[int]]]:
    """Multiway differencing: (sum, places in ``sizes``) of each of ``windows`` near-equal windows that has any."""
    if not sizes:
        return []
    # A partition lists its filled windows, fullest first; what lacks to ``windows`` is empty.
    heap = [(-size, k, [(size, [k])]) for k, size in enumerate(sizes)]
    heapq.heapify(heap)
    order = len(sizes)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        free = windows - len(a)
        # Fullest meets emptiest: the largest of b take what a leaves empty, its smallest join the smallest of a.
        merged = a + b[:free]
        for k, (total, places) in enumerate(reversed(b[free:]), windows - len(b)):
            merged[k] = (merged[k][0] + total, merged[k][1] + places)
        merged.sort(key=lambda w: -w[0])
        least = merged[-1][0] if len(merged) == windows else 0
        heapq.heappush(heap, (least - merged[0][0], order, merged))
        order += 1
    return heap[0][2]


def windows_of(sizes: list[int], capacity: int) -> list[list[int]]:
    """Places of ``sizes`` by window, each window at most ``capacity``; no size may exceed it."""
    count = -(-sum(sizes) // capacity)
    while True:
        parts = difference(sizes, count)
        if not parts or parts[0][0] <= capacity:
            return [places for _, places in parts]
        count += 1


def pack(
    docs: DataFrame,
    capacity: int = 1024,
    end_id: int = 0,
    grain: int = 512,
    block: int = 128,
    vocabulary: str | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids if asked for).

    A document is the ids of its text, then ``end_id``; a null or empty text is ``end_id`` alone. Each id lies in
    exactly one piece. Offsets are gapless from 0 within a sequence. Repeated rows and null ids are packed like any
    other; an empty table gives no rows; other columns are left out. Sequence ids are unique, with gaps between tasks.
    """
    vocabulary = vocabulary or vocabulary_file()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, first = encoder(vocabulary), TaskContext.get().partitionId() << TASK_BITS
        end = np.array([end_id], "<u4").tobytes()
        rows, rests, documents = [], [], 0
        arrow = [pa.string(), *[pa.int64()] * 6, *([pa.list_(pa.int64())] if with_ids else [])]

        def piece(name, ids: bytes, start: int, length: int, sequence: int, offset: int) -> list:
            part = ids[4 * start : 4 * (start + length)] if len(ids) != 4 * length else ids
            row = [name, start, length, zlib.crc32(part), None, sequence, offset]
            return [*row, np.frombuffer(part, "<u4").astype("int64")] if with_ids else row

        def flush() -> pa.RecordBatch:
            nonlocal rows, rests, first, documents
            for places in windows_of([r[2] for r in rests], capacity):
                offset = 0
                for row in (rests[k] for k in places):
                    row[5], row[6] = first, offset
                    offset += row[2]
                first += 1
            columns = zip(*rows, *rests, strict=True)
            rows, rests, documents = [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow, strict=True)], names=names)

        for batch in batches:
            arrow[0] = batch.schema.field(0).type
            for name, value in zip(batch.column(0).to_pylist(), few_at_once(batch.column(1)), strict=True):
                ids = encode.encode(value or "") + end
                total, start = len(ids) // 4, 0
                while total - start >= capacity:
                    rows.append(piece(name, ids, start, capacity, first, 0))
                    rows[-1][4] = total
                    first, start = first + 1, start + capacity
                while start < total:
                    length = min(grain, total - start)
                    rests.append(piece(name, ids, start, length, -1, 0))
                    rests[-1][4] = total
                    start += length
                documents += 1
                if documents >= block:
                    yield flush()
        if rows or rests:
            yield flush()

    kind = dict(docs.dtypes)[doc_id]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])]
    types = [kind, *["long"] * 6, "array<long>"]
    schema = ", ".join(f"{n} {t}" for n, t in zip(names, types, strict=False))
    # Ids travel as strings, whatever their type.
    named = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).alias("text"))
    out = named.mapInArrow(run, schema.replace(f"doc_id {kind}", "doc_id string"))
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))
