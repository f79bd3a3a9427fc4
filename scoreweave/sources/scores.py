"""Score tables: leaderboard documents, wide CSV, prediction tables, matrices, results.

The canonical form is long, ``scores(entity, item, score)`` without null rows. Wide tables exist only at
the edges, as text lines: a line is laid out from the sorted cells of its entity, however many items there are.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreweave.functions.fields import fixed
from scoreweave.operators.spread import ranked
from scoreweave.session import cut_lineage

# Metadata columns of a wide table, and the metadata keys of a leaderboard document.
META_COLUMNS = ("Model", "Parameters", "Organization", "OpenSource", "Time")
META_KEY = "META"
META_FIELDS = {
    "parameters": "Parameters",
    "language_model": "Language Model",
    "vision_model": "Vision Model",
    "organization": "Org",
    "release_date": "Time",
    "open_source": "OpenSource",
}
_NUMBER = r"([-+]?[0-9.]+(?:[eE][-+]?[0-9]+)?)"
# The cell format of a prediction table.
CELL = rf"^\[{_NUMBER}(?:±{_NUMBER})?\]/\[{_NUMBER}\]$"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole JSON documents, one per file. A directory may hold any number of them."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "doc")


def read_member_lines(spark: SparkSession, path: str) -> DataFrame:
    """Documents of one entity per line, ``{"<entity>": {...}}``: files of any size, cut where Spark likes.

    ``ord`` is the order of the lines: by file name, then by place in the file.
    """
    lines = spark.read.text(path).select(F.col("value").alias("doc"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
    return lines.withColumn("ord", F.struct("_file", "_block", F.monotonically_increasing_id().alias("_line"))).select("doc", "ord")


def member_lines(docs: DataFrame) -> DataFrame:
    """Whole documents as lines of one entity each, for ``read_member_lines``; entities keep their texts as they are."""
    members = docs.select(F.explode_outer(F.from_json("doc", "results MAP<STRING, STRING>")["results"]).alias("entity", "fields"))
    return members.filter("entity IS NOT NULL").select(F.to_json(F.create_map("entity", F.lit("\u0001"))).alias("head"), "fields").select(
        F.concat(F.replace("head", F.lit('"\\u0001"}'), F.lit("")), "fields", F.lit("}")).alias("value")
    )


def _members(docs: DataFrame) -> DataFrame:
    """(entity, fields, at) of whole documents, or of lines of one entity each; ``at`` grows with the order of the
    documents (column ``ord``, if there is one) and within a document.

    Each document is parsed once: a plain ``explode`` would have Spark test size and null of what it explodes in a filter,
    which parses it again for each test. Only a text that can have the key ``results`` is read as a whole document.
    """
    members = "MAP<STRING, MAP<STRING, STRING>>"
    may_be_whole = F.col("doc").contains("results") | F.col("doc").contains("\\u")
    whole = F.when(may_be_whole, F.from_json("doc", f"results {members}")["results"])
    ordered = "ord" in docs.columns
    parsed = docs.select(F.coalesce(whole, F.from_json("doc", members)).alias("d"), *(["ord"] if ordered else []))
    rows = parsed.select(*(["ord"] if ordered else []), F.posexplode_outer("d").alias("no", "entity", "fields"))
    return rows.filter("no IS NOT NULL").select("entity", "fields", F.struct(*(["ord"] if ordered else []), "no").alias("at"))


def _item_fields(docs: DataFrame) -> DataFrame:
    """(entity, item, value, at): the text of each item's entry."""
    rows = _members(docs).select("entity", "at", F.posexplode_outer("fields").alias("no", "item", "value"))
    return rows.filter(F.col("item") != META_KEY).select("entity", "item", "value", F.struct("at", "no").alias("at"))


def leaderboard_raw(docs: DataFrame) -> DataFrame:
    """Every sub-score ``(entity, item, sub_item, value)`` of leaderboard documents."""
    parts = _item_fields(docs).select("entity", "item", F.from_json("value", "MAP<STRING, STRING>").alias("parts"))
    return parts.select("entity", "item", F.explode_outer("parts").alias("sub_item", "value")).filter("sub_item IS NOT NULL")


def leaderboard_scores(docs: DataFrame) -> DataFrame:
    """``Overall`` of each item that holds an object; what is no number is left out.

    ``docs(doc)`` are whole documents or lines of one entity. If a cell occurs again, the last number counts, in the
    order of the column ``ord`` (if there is one) and within the document; without an order, the larger of two.
    """
    # Scores are made before the rows are, so that the filter on them does not read the texts again.
    score = lambda value: F.get_json_object(value, "$.Overall").try_cast("double")
    scored = F.transform(F.map_entries("fields"), lambda e, no: F.struct(no.alias("no"), e["key"].alias("item"), score(e["value"]).alias("score")))
    rows = _members(docs).select("entity", "at", F.explode_outer(scored).alias("f"))
    rows = rows.select("entity", "f.item", "f.score", F.struct("at", "f.no").alias("at"))
    rows = rows.filter(F.col("item") != META_KEY).filter("score IS NOT NULL AND NOT isnan(score)")
    return rows.groupBy("entity", "item").agg(F.max(F.struct("at", "score"))["score"].alias("score"))


def leaderboard_entities(docs: DataFrame) -> DataFrame:
    """Metadata per entity; a missing field is empty text. ``official_url`` is the second entry of Method."""
    meta = _members(docs).select("entity", F.col("fields")[META_KEY].alias("m"), "at")
    columns = [
        F.coalesce(F.get_json_object("m", f"$['{key}']"), F.lit("")).alias(name) for name, key in META_FIELDS.items()
    ]
    url = F.get_json_object("m", "$.Method[1]").alias("official_url")
    last = meta.select("entity", F.struct("at", F.struct(*columns, url).alias("info")).alias("m")).groupBy("entity").agg(F.max("m").alias("m"))
    return last.select("entity", "m.info.*")


def _fields(line: str) -> list[str]:
    return next(csv.reader([line], escapechar="\\", doublequote=False))


def read_wide_cells(spark: SparkSession, path: str, key: str | None = None, meta: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Cells ``(entity, item, text)`` and entities (``key`` and ``meta`` columns that are there) of wide CSV files.

    Every file begins with the same header; fields hold no line ends. Lines become rows in tasks, so any number of
    items will do: no plan has a column for each. ``key`` is the first column if not given. Empty fields are no cells.
    """
    lines = spark.read.text(path)
    header = lines.first()
    names = _fields(header[0]) if header else []
    kept = [m for m in meta if m in names]
    place = {name: k for k, name in enumerate(names)}
    at = place[key] if key is not None and names else 0
    lines = lines.filter(F.col("value") != (header[0] if header else ""))

    def batch_of(columns: list[list], labels: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], labels)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for line in batch.column(0).to_pylist():
                fields = _fields(line)
                found = [(n, x) for k, (n, x) in enumerate(zip(names, fields, strict=False)) if x != "" and k != at and n not in kept]
                yield batch_of([[fields[at]] * len(found), [n for n, _ in found], [x for _, x in found]], ["entity", "item", "text"])

    def about(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_fields(line) for line in batch.column(0).to_pylist()]
            yield batch_of([[r[place[m]] or None for r in rows] for m in kept], kept)

    types = T.StructType([T.StructField(m, T.StringType()) for m in kept])
    entities = lines.mapInArrow(about, types) if kept else lines.select()
    return lines.mapInArrow(cells, "entity string, item string, text string"), entities


def read_wide_scores(
    spark: SparkSession, path: str, meta: Sequence[str] = META_COLUMNS
) -> tuple[DataFrame, DataFrame]:
    """Scores and entities of a wide CSV; every column that is not metadata is an item."""
    cells, entities = read_wide_cells(spark, path, meta[0], meta)
    return _numbers(cells), entities


def _column(name: str):
    """A column by its very name, which may hold dots and backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def unpivot_scores(wide: DataFrame, meta: Sequence[str] = META_COLUMNS) -> DataFrame:
    key = meta[0]
    items = [c for c in wide.columns if c not in meta]
    texts = wide.select(_column(key).alias("entity"), *[_column(c).cast("string").alias(c) for c in items])
    return _numbers(texts.unpivot(["entity"], [_column(c) for c in items], "item", "text"))


def _numbers(cells: DataFrame) -> DataFrame:
    score = F.col("text").try_cast("double")
    return cells.select("entity", "item", score.alias("score")).filter("score IS NOT NULL AND NOT isnan(score)")


def item_names(scores: DataFrame) -> DataFrame:
    return scores.select("item").distinct()


def distinct_entities(scores: DataFrame) -> DataFrame:
    return scores.select("entity").distinct()


def _quoted(c) -> Column:
    """A CSV field, as Spark's reader takes it; a line end becomes a blank."""
    plain = F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"[\r\n]+", " ")
    marked = F.regexp_replace(F.regexp_replace(plain, r"\\", r"\\\\"), '"', r'\\"')
    return F.when(plain.rlike(r'[",\\\n\r]|^\s|\s$'), F.concat(F.lit('"'), marked, F.lit('"'))).otherwise(plain)


def wide_lines(cells: DataFrame, entities: DataFrame | None = None, fill: str = "", key: str = META_COLUMNS[0]) -> DataFrame:
    """CSV lines ``(header, line)`` of ``cells(entity, item, text)``: one line per entity, one field per item in the order
    of their names, ``fill`` where there is none. ``entities`` adds its columns before the items, and entities without
    cells.

    The sorted cells of an entity are laid out with runs of fills between them, so neither a column nor a plan grows
    with the items; only the header, as long as a line, holds all their names. A repeated cell counts once.
    """
    known = cut_lineage(ranked(cells.select("item").distinct(), [], [F.col("item")], "no"))
    # One value as long as a line, evaluated once.
    listed = known.agg(F.sort_array(F.collect_list(F.struct("no", "item"))).alias("all"))
    listed = listed.select(F.struct(F.size("all").alias("n"), F.array_join(F.transform("all", lambda x: _quoted(x["item"])), ",").alias("names"))).scalar()
    once = cells.groupBy("entity", "item").agg(F.min("text").alias("text")).join(known, "item")
    rows = once.groupBy("entity").agg(F.sort_array(F.collect_list(F.struct("no", "text"))).alias("cells"))
    extra = []
    if entities is not None:
        extra = [c for c in entities.columns if c != "entity"]
        rows = entities.join(rows, "entity", "left")
    rows = rows.withColumn("_all", listed)
    rows = rows.withColumns({"n": F.col("_all.n"), "names": F.col("_all.names")})
    gap = lambda n: F.repeat(F.lit("," + fill), n.cast("int"))
    before = lambda i: F.when(i > 0, F.get("cells", i - 1)["no"]).otherwise(F.lit(0))
    laid = F.transform("cells", lambda c, i: F.concat(gap(c["no"] - before(i) - 1), F.lit(","), _quoted(c["text"])))
    tail = gap(F.col("n") - F.element_at("cells", -1)["no"])
    body = F.when(F.col("cells").isNull(), gap(F.col("n"))).otherwise(F.concat(F.array_join(laid, ""), tail))
    lead = F.concat_ws(",", _quoted(F.col("entity")), *[_quoted(_column(c)) for c in extra])
    head = F.concat_ws(",", *[_quoted(F.lit(c)) for c in (key, *extra)], F.when(F.col("n") > 0, F.col("names")))
    return rows.select(head.alias("header"), F.concat(lead, body).alias("line"))


def write_wide(lines: DataFrame, path: str) -> None:
    """Write ``wide_lines`` as CSV files, each with the header before its lines."""

    def with_header(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for batch in batches:
            if first and batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(0, 1)], ["value"])
                first = False
            yield pa.RecordBatch.from_arrays([batch.column(1)], ["value"])

    lines.mapInArrow(with_header, "value string").write.mode("overwrite").text(path)


def write_wide_scores(scores: DataFrame, path: str, entities: DataFrame | None = None) -> None:
    """Wide CSV with metadata when ``entities`` is given, else entity and items only."""
    write_wide(wide_lines(scores.select("entity", "item", F.col("score").cast("string").alias("text")), entities), path)


def parse_prediction_table(wide: DataFrame, key: str = META_COLUMNS[0]) -> DataFrame:
    """Cells ``[prediction±uncertainty]/[truth]`` as rows. The uncertainty may be missing and numbers may be
    negative; cells of any other form are dropped."""
    items = [c for c in wide.columns if c != key]
    rows = wide.select(_column(key).alias("entity"), *[_column(c) for c in items])
    return parse_prediction_cells(rows.unpivot(["entity"], [_column(c) for c in items], "item", "text"))


def parse_prediction_cells(cells: DataFrame) -> DataFrame:
    """As ``parse_prediction_table``, from ``cells(entity, item, text)``, as ``read_wide_cells`` gives them."""

    def number(group):
        return F.regexp_extract("text", CELL, group).try_cast("double")

    out = cells.filter(F.col("text").rlike(CELL)).select(
        "entity", "item", number(1).alias("prediction"), number(2).alias("uncertainty"), number(3).alias("truth")
    )
    return out.filter("prediction IS NOT NULL AND truth IS NOT NULL")


def format_cells(predictions: DataFrame) -> DataFrame:
    """``(entity, item, cell)`` with two decimals; without a truth the cell is ``-``."""

    def two(c):
        return fixed(F.col(c), 2)

    sure = F.concat(F.lit("["), two("prediction"), F.lit("]/["), two("truth"), F.lit("]"))
    both = F.concat(F.lit("["), two("prediction"), F.lit("±"), two("uncertainty"), F.lit("]/["), two("truth"), F.lit("]"))
    cell = F.when(F.col("truth").isNull(), "-").when(F.col("uncertainty").isNull(), sure).otherwise(both)
    return predictions.select("entity", "item", cell.alias("cell"))


def format_prediction_table(predictions: DataFrame) -> DataFrame:
    """Lines of the wide text table of the entities that have a target; ``-`` where there is none. See ``wide_lines``."""
    having = predictions.filter("truth IS NOT NULL").select("entity").distinct()
    cells = format_cells(predictions).join(having, "entity", "left_semi")
    return wide_lines(cells.withColumnRenamed("cell", "text"), fill="-")


def write_matrix(predictions: DataFrame, path: str, wide: bool = False) -> None:
    """Predictions or uncertainties as Parquet by item, or as wide CSV when asked for."""
    if wide:
        value = [c for c in predictions.columns if c not in ("entity", "item")][0]
        write_wide(wide_lines(predictions.select("entity", "item", F.col(value).cast("string").alias("text"))), path)
    else:
        predictions.write.mode("overwrite").parquet(path)


def write_results(results: DataFrame, metrics: DataFrame, path: str, version: str = "1.0") -> None:
    """Nested detail as Parquet, flat columns as CSV, metrics and metadata as tables of their own. ``results`` is
    evaluated once: the other tables are made from its Parquet."""
    spark = results.sparkSession
    results.write.mode("overwrite").parquet(f"{path}/detail")
    results = spark.read.schema(results.schema).parquet(f"{path}/detail")
    flat = [f.name for f in results.schema.fields if not isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))]
    results.select(*[_column(c) for c in flat]).write.mode("overwrite").csv(f"{path}/flat", header=True)
    metrics.write.mode("overwrite").parquet(f"{path}/metrics")
    about = results.agg(F.count(F.lit(1)).alias("total_samples")).select(
        F.lit(version).alias("version"), F.current_timestamp().alias("saved_at"), "total_samples"
    )
    about.write.mode("overwrite").json(f"{path}/metadata")


def read_done_keys(spark: SparkSession, path: str, before_batch: int | None = None) -> DataFrame:
    """Keys of earlier results; empty when there is no table yet. ``before_batch`` leaves out that batch and
    later ones of an incremental table."""
    try:
        done = spark.read.parquet(path)
    except AnalysisException as problem:
        if "PATH_NOT_FOUND" not in str(problem.getCondition()):
            raise
        return spark.createDataFrame([], "entity string, item string")
    if before_batch is not None:
        done = done.filter(F.col("batch") < before_batch)
    return done.select("entity", "item").distinct()


def read_cold_start(spark: SparkSession, path: str, meta: Sequence[str] = META_COLUMNS) -> tuple[DataFrame, DataFrame]:
    """New entities with metadata, and their true scores where given."""
    scores, entities = read_wide_scores(spark, path, meta)
    return entities, scores.withColumnRenamed("score", "truth")
