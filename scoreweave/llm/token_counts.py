"""Token counts of documents in flat token streams that have no index: a scan for end-of-document ids.

A stream is a sequence of blocks ``(file, block_no, data)`` of little-endian ids. Tasks look for the separator in
whole blocks with array comparison; blocks are scanned apart, and a document may begin blocks before it ends. A
prefix scan over one small row per block, in two levels, says where each block starts, how many documents ended
before it and where the last of them ended; with that the boundaries are stitched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scoreweave.llm.tokens import encoder, vocabulary_file

#: Blocks that one task scans in a row; the second level has one row for each so many.
SPAN = 4096


def write_stream(
    docs: DataFrame, path: str, end_id: int = 50256, block: int = 65536, vocabulary: str | None = None,
    doc_id: str = "doc_id", text: str = "text",
) -> None:
    """Write the documents as flat streams of 16-bit ids, one stream per task: Parquet rows (file, block_no, data).

    The ids of a text, then ``end_id``; a null text has no ids. ``doc_ids`` names the documents that end in a block,
    for whoever must map counts back; the scan doesn't read it.
    """
    vocabulary = vocabulary or vocabulary_file()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, file = encoder(vocabulary), TaskContext.get().partitionId()
        end, size = np.array([end_id], "<u2").tobytes(), 2 * block
        held, names, number = bytearray(), [], 0

        def row(data: bytes, ended: list) -> list:
            nonlocal number
            number += 1
            return [file, number - 1, bytes(data), ended]

        columns = ["file", "block_no", "data", "doc_ids"]
        for batch in batches:
            out = []
            for name, value in zip(batch["doc_id"].tolist(), batch["text"], strict=True):
                ids = np.frombuffer(encode.encode(value or ""), "<u4")
                if len(ids) and ids.max() > 0xFFFF:
                    raise ValueError("an id needs more than 16 bits")
                held += ids.astype("<u2").tobytes()
                while len(held) >= size:
                    out.append(row(held[:size], names))
                    names = []
                    del held[:size]
                held += end
                names.append(name)
                if len(held) >= size:
                    out.append(row(held[:size], names))
                    names = []
                    del held[:size]
            if out:
                yield pd.DataFrame(out, columns=columns)
        if held:
            yield pd.DataFrame([row(held, names)], columns=columns)

    named = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).alias("text"))
    out = named.mapInPandas(run, "file long, block_no long, data binary, doc_ids array<string>")
    out.write.option("compression", "zstd").parquet(path)


def read_flat_files(spark, path: str, block: int = 65536, width: int = 2) -> DataFrame:
    """Blocks of raw token files (any path Spark reads, each below 2 GB); ``file`` is a number made from its path."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = block * width
        for batch in batches:
            for file, content in zip(batch["file"], batch["content"], strict=True):
                for k in range(0, len(content), step):
                    yield pd.DataFrame({"file": [file], "block_no": [k // step], "data": [content[k : k + step]]})

    raw = spark.read.format("binaryFile").load(path).select(F.xxhash64("path").alias("file"), "content")
    return raw.mapInPandas(cut, "file long, block_no long, data binary")


def count_tokens(blocks: DataFrame, end_id: int = 50256, width: int = 2) -> DataFrame:
    """One row per document: file, doc_no (from 0 in its file), block_no and place of its separator, start, n_tokens.

    ``blocks`` has file, block_no (from 0) and data; other columns are left out. The separator isn't counted. A
    stream's last document may lack one: then ``place`` is null and ``ended`` false. A null or empty block holds no
    ids; two separators in a row make a document of 0 tokens; an empty table gives no rows.
    """
    kind = {2: "<u2", 4: "<u4"}[width]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = [np.frombuffer(d or b"", kind) for d in batch["data"]]
            yield pd.DataFrame({
                "file": batch["file"], "block_no": batch["block_no"], "n": [len(i) for i in ids],
                "seps": [np.flatnonzero(i == end_id).astype("int64") for i in ids],
            })

    found = blocks.select("file", "block_no", "data").mapInPandas(scan, "file long, block_no long, n long, seps array<long>")
    found = found.withColumn("_span", F.floor(F.col("block_no") / SPAN))
    first, inner = F.lit(0).cast("long"), Window.partitionBy("file", "_span").orderBy("block_no")
    before, over = inner.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("file").orderBy("_span")
    over = over.rowsBetween(Window.unboundedPreceding, -1)
    # Within a span of blocks: ids and separators before each block, and the last separator, counted from the span.
    local = found.withColumns({
        "_at": F.coalesce(F.sum("n").over(before), first), "_docs": F.coalesce(F.sum(F.size("seps")).over(before), first),
        "_last_block": F.lead("block_no").over(inner).isNull(),
    })
    local = local.withColumn("_end", F.max(F.col("_at") + F.try_element_at("seps", F.lit(-1))).over(before))
    own = F.when(F.size("seps") > 0, F.col("_at") + F.try_element_at("seps", F.lit(-1)))
    spans = local.groupBy("file", "_span").agg(
        F.sum("n").alias("_n"), F.sum(F.size("seps")).alias("_d"), F.max(own).alias("_e")
    )
    spans = spans.withColumns({"_at0": F.coalesce(F.sum("_n").over(over), first), "_docs0": F.coalesce(F.sum("_d").over(over), first)})
    spans = spans.withColumns({
        "_end0": F.coalesce(F.max(F.col("_at0") + F.col("_e")).over(over), F.lit(-1)),
        "_final": F.lead("_span").over(Window.partitionBy("file").orderBy("_span")).isNull(),
    })
    placed = local.join(spans.select("file", "_span", "_at0", "_docs0", "_end0", "_final"), ["file", "_span"])
    at = F.col("_at0") + F.col("_at")
    placed = placed.withColumn("_prev", F.coalesce(F.col("_at0") + F.col("_end"), F.col("_end0")))
    last = F.coalesce(at + F.try_element_at("seps", F.lit(-1)), F.col("_prev"))
    total = at + F.col("n")
    closing = F.when(F.col("_last_block") & F.col("_final") & (last < total - 1), F.array(total)).otherwise(F.array().cast("array<long>"))
    ends = F.concat(F.transform("seps", lambda s: at + s), closing)
    rows = placed.withColumns({"_ends": ends, "_n_seps": F.size("seps")})
    rows = rows.select("file", "block_no", "_prev", "_ends", "_n_seps", (F.col("_docs0") + F.col("_docs")).alias("_base"), F.posexplode("_ends").alias("place", "_stop"))
    start = F.coalesce(F.when(F.col("place") > 0, F.get("_ends", F.col("place") - 1)), F.col("_prev")) + 1
    ended = F.col("place") < F.col("_n_seps")
    return rows.select(
        "file", (F.col("_base") + F.col("place")).alias("doc_no"), "block_no", F.when(ended, F.col("place")).alias("place"),
        start.alias("start"), (F.col("_stop") - start).alias("n_tokens"), ended.alias("ended"),
    )
