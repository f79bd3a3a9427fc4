"""Sharding by longest processing time: groups of equal texts, largest first, to the least-loaded shard.

Groups of one size are interchangeable, so the schedule needs only how many groups have each size. That histogram
goes to the driver: with total size T it has fewer than sqrt(2 T) rows (sizes 1 + 2 + ... must fit into T), whatever
the number of rows or groups. The heap runs over it and says how many groups of each size each shard takes; Spark
numbers the groups of a size and so gives each its shard. The result equals the schedule over all single groups.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreweave.llm.common import filled, text_key
from scoreweave.operators.spread import ranked
from scoreweave.session import cut_lineage


def longest_first(classes: Iterable[tuple[int, int]], shards: int) -> list[tuple[int, list[int]]]:
    """Per size, largest first, the number of groups each shard takes; ``classes`` holds (size, groups).

    The least-loaded shard takes the next group, the lower number on ties. Many groups of one size are taken up to a
    common level at once, which gives what the heap would give one by one.
    """
    heap, out = [(0, k) for k in range(shards)], []
    for size, count in sorted(classes, reverse=True):
        taken = [0] * shards
        if count > shards:
            low, high = heap[0][0], heap[0][0] + size * count + 1
            under = lambda level: sum(max(0, -((load - level) // size)) for load, _ in heap)  # noqa: E731, B023
            while high - low > 1:
                middle = (low + high) // 2
                low, high = (middle, high) if under(middle) <= count else (low, middle)
            for load, k in heap:
                taken[k] = max(0, -((load - low) // size))
            heap = [(load + size * taken[k], k) for load, k in heap]
            heapq.heapify(heap)
        for _ in range(count - sum(taken)):
            load, k = heap[0]
            heapq.heapreplace(heap, (load + size, k))
            taken[k] += 1
        out.append((size, taken))
    return out


def shard(docs: DataFrame, shards: int = 16, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row (doc_id, size, text_crc32, shard, slot) per row of ``docs``.

    ``size`` is the UTF-8 length plus 1. Rows of equal text form a group and share a shard; a null text has no bytes
    and goes with empty ones (checksum 0). ``slot`` counts from 0 within a shard, by doc_id; null ids come first and
    ties fall in any order. An empty table gives no rows; other columns are left out.
    """
    t = filled(text)
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(t) + 1).cast("long").alias("size"),
        F.crc32(t.cast("binary")).alias("text_crc32"),
        text_key(text).alias("_key"),
    )
    groups = cut_lineage(rows.groupBy("_key").agg(F.sum("size").alias("_total")))
    sizes = groups.groupBy("_total").count()
    plan = longest_first(((r[0], r[1]) for r in sizes.collect()), shards)
    bounds = [(size, [sum(taken[: k + 1]) for k in range(shards)]) for size, taken in plan]
    bounds = groups.sparkSession.createDataFrame(bounds, "_total long, _ends array<long>")
    placed = ranked(groups, ["_total"], [F.col("_key").asc()], rank="_place").join(bounds, "_total")
    placed = placed.select("_key", F.size(F.filter("_ends", lambda e: e < F.col("_place"))).alias("shard"))
    out = ranked(rows.join(placed, "_key"), ["shard"], [F.col("doc_id").asc()], rank="_place")
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("_place") - 1).alias("slot"))
