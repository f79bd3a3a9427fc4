"""Incremental results: new targets arrive as a stream, each key is written once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from scoreweave.operators.split import resume

KEYS = ["entity", "item"]


def incremental_results(
    new_targets: DataFrame,
    adjust: Callable[[DataFrame], DataFrame],
    path: str,
    checkpoint: str,
    done: DataFrame | None = None,
    event_time: str | None = None,
    delay: str = "30 days",
) -> StreamingQuery:
    """Apply ``adjust`` to targets whose key has not come before; run until the source is read.

    Which keys have come is kept by key in the state store under ``checkpoint``, so a micro-batch reads its own targets
    and the state of their keys, and no result of earlier batches. With ``event_time``, a timestamp of the targets, a
    key is forgotten when the watermark passes it by ``delay``, which bounds the state; a repeat that comes later than
    that is a new target. ``done`` holds keys finished before the stream began.

    Each micro-batch owns the folder ``batch=<id>`` and replaces it: state and folder belong to the batch, so a batch
    that is run again after a failure writes the same rows once.
    """
    if event_time is None:
        first = new_targets.dropDuplicates(KEYS)
    else:
        first = new_targets.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(KEYS)

    def write(batch: DataFrame, batch_id: int) -> None:
        fresh = batch if done is None else resume(batch, done)
        adjust(fresh).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return first.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
