"""File sources and sinks.

* typed CSV scans with an explicit schema; a missing file is an empty frame
  *with* that schema, so a later join on ``date`` still resolves;
* the per-model score files as ONE scan of a directory partitioned by
  ``model_name`` (no loop over models);
* the stored nested responses as a schema-on-read JSON scan, response documents
  record by record;
* sinks: per-model partitioned output and a persist step that reports
  failure instead of raising.  Both write beside the output and switch to the
  new rows when these are complete, so a failed write leaves the old rows.
"""

from __future__ import annotations

import csv
import logging
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import unquote

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from stakeperf import schemas
from stakeperf.operators.scores import SCORE_PREFIX, document_scores
from stakeperf.session import on_workers, scratch_path
from stakeperf.sources.documents import ODD, PIECE_END, RECORDS, record_lines

log = logging.getLogger(__name__)


@contextmanager
def _setting(spark: SparkSession, key: str, value: str):
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _partition_type_inference(spark: SparkSession, enabled: bool):
    return _setting(spark, "spark.sql.sources.partitionColumnTypeInference.enabled", str(enabled).lower())


def _as_struct(spark: SparkSession, schema: StructType | str) -> StructType:
    if isinstance(schema, StructType):
        return schema
    return spark.createDataFrame([], schema).schema


def by_name(df: DataFrame, schema: StructType, keep: tuple[str, ...] = ()) -> DataFrame:
    """Project text columns onto a schema by column *name* (as R's
    ``read.csv`` does), casting with ``try_cast``; a column the file lacks
    is NULL.  ``keep`` names extra columns passed through unchanged."""
    have = set(df.columns)
    cols = [F.col(k) for k in keep if k in have]
    for f in schema.fields:
        src = F.col(f"`{f.name}`") if f.name in have else F.lit(None)
        cols.append(src.try_cast(f.dataType).alias(f.name))
    return df.select(*cols)


def read_csv_typed(spark: SparkSession, path: str, schema: StructType | str,
                   fail_if_missing: bool = False, null_value: str | None = None) -> DataFrame:
    """A CSV file (or folder) with a header, columns matched to ``schema`` by
    name.  A missing path is an empty frame with the schema (logged), or an
    error when ``fail_if_missing``."""
    struct = _as_struct(spark, schema)
    reader = spark.read.option("header", True)
    if null_value is not None:
        reader = reader.option("nullValue", null_value)
    try:
        return by_name(reader.csv(path), struct)
    except AnalysisException as exc:
        if fail_if_missing or "PATH_NOT_FOUND" not in str(exc):
            raise
        log.warning("File not found: %s", path)
        return spark.createDataFrame([], struct)


def read_investment_data(spark: SparkSession, datadir: str, investments_file: str,
                         fixedincome_file: str, investments_schema: StructType | str,
                         fixedincome_schema: StructType | str) -> tuple[DataFrame, DataFrame]:
    """Both blotter inputs; either may be missing (then empty, typed)."""
    base = datadir.rstrip("/")
    return (read_csv_typed(spark, f"{base}/{investments_file}", investments_schema),
            read_csv_typed(spark, f"{base}/{fixedincome_file}", fixedincome_schema))


def _first_line(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first line with any text of a task, which then stops reading."""
    for batch in batches:
        for i, line in enumerate(batch.column("header").to_pylist()):
            if line.strip():
                yield batch.slice(i, 1)
                return


def _headers(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """The files under a path by their header line, whatever it says.

    The executors look at the beginning of each file only: a task has one split
    (opening a file is made to cost as much as a full one) and stops after its first
    batch of lines.  The driver gets a path per file, which its file index holds anyway."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").text(path)
    probe = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.col("value").alias("header"))
    groups: dict[str, list[str]] = {}
    with _setting(spark, "spark.sql.files.openCostInBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")), \
            _setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", "64"):
        for r in probe.mapInArrow(_first_line, probe.schema).where("at = 0").collect():
            groups.setdefault(r["header"], []).append(r["file"])
    return groups


def _decoded(c: str) -> Column:
    """A file name or path of ``_metadata``, which holds it percent-encoded."""
    return F.url_decode(F.replace(F.col(c), F.lit("+"), F.lit("%2B")))


def _file_order() -> Column:
    """The order of a row in its file: the offset of its split plus its number
    in the task, which reads at most a split's bytes and so fewer rows."""
    return (F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)).cast("bigint")


def _by_own_header(spark: SparkSession, path: str, schema: StructType, null_value: str | None,
                   base: str | None, model: Column) -> DataFrame:
    """Score files, each read by its own header: files with equal headers are
    one scan, so every file is read once; a column that a file lacks is NULL there.
    A nested-column prefix is stripped from the names before the
    columns are matched; without a ``seq`` column the order in the file is ``seq``."""
    out = spark.createDataFrame([], StructType([StructField("model_name", StringType()), *schema.fields]))
    for header, files in sorted(_headers(spark, path).items()):
        raw = next(csv.reader([header]))
        names = [c.replace(SCORE_PREFIX, "", 1) if c.startswith(SCORE_PREFIX) else c for c in raw]
        reader = spark.read.option("header", True).schema(StructType([StructField(f"c{k}", StringType()) for k in range(len(names))]))
        if null_value is not None:
            reader = reader.option("nullValue", null_value)
        if base is not None:
            reader = reader.option("basePath", base)
        df = reader.csv([unquote(f) for f in sorted(files)])
        df = df.select(model.alias("model_name"), _file_order().alias("seq" if "seq" not in names else "_order"),
                       *[F.col(f"c{k}").alias(n) for k, n in enumerate(names) if n not in names[:k] and n != "model_name"])
        out = out.unionByName(by_name(df, schema, keep=("model_name",)))
    return out


def scan_models(spark: SparkSession, root: str, schema: StructType = schemas.STAKED_SCORES,
                null_value: str | None = None) -> DataFrame:
    """All per-model score files under ``root/model_name=<m>/``, each by its own
    header.  The model comes from the partition directory, so a filter on
    ``model_name`` prunes whole directories.  ``null_value="NA"`` reads files
    written by R's ``write.csv``."""
    # model names are text even when they look like numbers ("007"): the
    # partition values are typed when the file index is built, i.e. here
    with _partition_type_inference(spark, False):
        return _by_own_header(spark, root, schema, null_value, root, F.col("model_name"))


def scan_model_files(spark: SparkSession, folder: str, schema: StructType = schemas.STAKED_SCORES,
                     null_value: str | None = "NA") -> DataFrame:
    """The flat layout: one ``<model>.csv`` per model in one folder (as the
    source writes them), each by its own header; ``model_name`` comes from each
    row's file name."""
    name = F.regexp_extract(_decoded("_metadata.file_name"), r"^(.*)\.csv$", 1)
    return _by_own_header(spark, folder, schema, null_value, None, name)


def read_nested_scores(spark: SparkSession, path: str, schema: StructType = schemas.ROUND_RECORD) -> DataFrame:
    """Stored nested responses (JSON lines, one round record per line);
    ``rec_pos`` is a record's place in its file."""
    return spark.read.schema(schema).json(path).withColumn("rec_pos", _file_order())


def _documents(spark: SparkSession, paths: str | list[str], schema: StructType) -> DataFrame:
    reader = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True)
    return reader.option("pathGlobFilter", DOCUMENT_FILES).json(paths)


#: Documents are named ``<model>.json``, or lie as text, perhaps compressed, in a Spark
#: output folder named so.
DOCUMENT_FILES = "*.{json,txt,txt.gz}"


def _document_parts(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """Documents in parts: model, ``records``, and the place of the first of them
    (``rec_pos``) and the score rows before it (``first_row``) in the document.

    The documents are read once, as text, each by one task that splits no file, and their
    records written as JSON lines to the shared folder, so no task holds a document.
    Documents that are not followed there (an encoding, a syntax that only Spark's reader
    knows, or an error) come whole from Spark's reader."""
    text = on_workers(spark).read.option("recursiveFileLookup", True).option("pathGlobFilter", DOCUMENT_FILES).option("lineSep", PIECE_END).text(folder)
    path = F.col("_metadata.file_path")
    text = text.where(path.endswith(".json") | path.rlike("/document=[^/]*/[^/]*$"))
    first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0
    about = {"file": path, "model_name": _document_model(), "size": F.when(~path.endswith(".gz"), F.col("_metadata.file_size"))}
    pieces = text.select(*[F.when(first, c).alias(n) for n, c in about.items()], F.col("value").cast("binary").alias("value"))
    odd, out = Observation(), scratch_path(spark, "records")
    lines = pieces.mapInArrow(record_lines, "value string").observe(odd, F.count_if(F.col("value").startswith(ODD)).alias("n"))
    one_task_a_file = str(1 << 50)
    with _setting(spark, "spark.sql.files.maxPartitionBytes", one_task_a_file), \
            _setting(spark, "spark.sql.files.openCostInBytes", one_task_a_file):
        lines.write.option("compression", "snappy").option("maxRecordsPerFile", 100_000).text(out)

    record = schema["data"].dataType[RECORDS].dataType.elementType
    types = {"file": StringType(), "odd": StringType(), "model_name": StringType(), "rec_pos": LongType(), "first_row": LongType(), "record": record}
    read = spark.read.schema(StructType([StructField(n, t) for n, t in types.items()])).json(out)
    columns = ["model_name", "records", "rec_pos", "first_row"]
    parts = read.withColumn("records", F.array("record"))
    if not odd.get["n"]:
        return parts.select(*columns)
    files = [r["odd"] for r in read.where(F.col("odd").isNotNull()).select("odd").collect()]
    whole = _documents(spark, [unquote(f) for f in sorted(files)], schema).select(
        _document_model().alias("model_name"), F.col(f"data.{RECORDS}").alias("records"),
        F.lit(0).cast("bigint").alias("rec_pos"), F.lit(0).cast("bigint").alias("first_row"))
    return parts.where(F.col("odd").isNull() & ~F.col("file").isin(files)).select(*columns).unionByName(whole)


def read_responses(spark: SparkSession, folder: str, schema: StructType = schemas.RESPONSE) -> DataFrame:
    """Stored response documents, one JSON document per model named
    ``<model>.json``: one scan of the folder, the round records taken
    out of ``data.v2RoundModelPerformances`` and the model taken from the
    file name.  Gives the nested records ``flatten_scores`` expects."""
    return _part_records(_document_parts(spark, folder, schema))


def read_response_scores(spark: SparkSession, folder: str, schema: StructType = schemas.RESPONSE) -> DataFrame:
    """Flat score rows of response documents, with ``rec_pos`` and each row's place in
    its document (``row_index``, from 1): a part of a document knows the rows before it, so
    its scores are numbered where they lie."""
    return document_scores(_document_parts(spark, folder, schema))


def _document_model() -> Column:
    folder = F.regexp_extract(_decoded("_metadata.file_path"), r"/document=([^/]*)\.json/[^/]*$", 1)
    name = F.regexp_extract(_decoded("_metadata.file_name"), r"^(.*)\.(?:json|txt)(?:\.gz)?$", 1)
    return F.when(folder != "", folder).otherwise(name)


def response_records(docs: DataFrame) -> DataFrame:
    """Round records out of response documents read by a file source (batch
    or streaming), with their position in the document (``rec_pos``); the model
    is the document's file name without ``.json``, or that of a Spark output
    folder named ``document=<model>.json``."""
    return _part_records(docs.select(_document_model().alias("model_name"), F.col(f"data.{RECORDS}").alias("records"), F.lit(0).alias("rec_pos")))


def _part_records(parts: DataFrame) -> DataFrame:
    records = parts.select("model_name", "rec_pos", F.posexplode_outer("records").alias("_k", "_r"))
    return records.where(F.col("_r").isNotNull()).select(
        "model_name", (F.col("rec_pos") + F.col("_k")).cast("bigint").alias("rec_pos"), *[F.col("_r")[f.name].alias(f.name) for f in schemas.RESPONSE_RECORD.fields])


def _file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and its path type."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    return hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def _beside(path: str, mark: str) -> str:
    """A hidden name next to ``path``: readers of the folder above don't see it."""
    parent, _, name = path.rstrip("/").rpartition("/")
    return f"{parent}/.{name}.{mark}"


def _recover(spark: SparkSession, path: str) -> None:
    """Put back the old rows if a switch was cut off between its two renames."""
    fs, at = _file_system(spark, path)
    if not fs.exists(at(path)):
        for kept in fs.globStatus(at(_beside(path, "old-*"))) or []:
            fs.rename(kept.getPath(), at(path))
            return


def _switch(spark: SparkSession, staged: str, path: str) -> None:
    """``staged`` becomes ``path``; the old rows go only once the new ones are in place."""
    fs, at = _file_system(spark, path)
    old = _beside(path, f"old-{uuid.uuid4().hex[:12]}")
    had = fs.exists(at(path))
    if had and not fs.rename(at(path), at(old)):
        raise OSError(f"cannot move {path} aside")
    done = False
    try:
        done = fs.rename(at(staged), at(path))
    finally:
        if not done and had:
            fs.rename(at(old), at(path))
    if not done:
        raise OSError(f"cannot move {staged} to {path}")
    if had:
        fs.delete(at(old), True)


@contextmanager
def _staged(spark: SparkSession, path: str):
    """A folder beside ``path`` to write to; it takes the place of ``path`` at the end,
    or goes if the write fails."""
    path = path.rstrip("/")
    _recover(spark, path)
    fs, at = _file_system(spark, path)
    staged = _beside(path, f"new-{uuid.uuid4().hex[:12]}")
    try:
        yield staged
        _switch(spark, staged, path)
    finally:
        if fs.exists(at(staged)):
            fs.delete(at(staged), True)


def write_per_model(df: DataFrame, root: str, fmt: str = "csv", model: str = "model_name", only_models: bool = False) -> None:
    """One directory per model (created as needed), with files by size: rows are
    rebalanced by model, so adaptive execution gives a large model several tasks of
    about ``spark.sql.adaptive.advisoryPartitionSizeInBytes`` each and small models
    share one, and no task writes to every directory.

    The whole output is replaced, or with ``only_models`` the directories of the
    models in ``df`` alone.  Either way the old rows stay until the new ones are
    complete, and a retried job never leaves a mix of attempts."""
    spark = df.sparkSession

    def write(path: str) -> None:
        writer = df.hint("rebalance", model).write.partitionBy(model).option("maxRecordsPerFile", 10_000_000)
        if fmt == "csv":
            writer = writer.option("header", True)
        if only_models:
            writer = writer.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.format(fmt).save(path)

    if only_models:
        _recover(spark, root)
        write(root)
    else:
        with _staged(spark, root) as staged:
            write(staged)


def persist(df: DataFrame, path: str, description: str = "", fmt: str = "parquet") -> bool:
    """Write ``df``; log and return False on failure instead of raising, with the
    old rows still in place."""
    try:
        with _staged(df.sparkSession, path) as staged:
            df.write.format(fmt).save(staged)
        log.info("Saved %s to %s", description, path)
        return True
    except Exception as exc:  # noqa: BLE001 - the sink reports, the caller decides
        log.warning("Failed to save %s to %s: %s", description, path, exc)
        return False
