"""The score ingest as a streaming job.

In batch, responses for all models are flattened and written once.  When
responses keep arriving as files (one JSON-lines file per fetched response),
the same operators run incrementally: a file source reads only new files, the
rows are flattened and filtered exactly as in batch, and a file sink appends
them to the per-model table.  The source offsets and the sink's commit log
live under a checkpoint location in the shared checkpoint folder, so a
restarted or partly failed run neither loses nor duplicates files.

Only the row-local steps are streamable; the positional ("parity") filter
needs an order over all of a model's rows and stays a batch operator.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from stakeperf import schemas
from stakeperf.config import SCORE_METRICS
from stakeperf.operators.scores import filter_scores, flatten_scores
from stakeperf.sources.files import response_records
from stakeperf.session import scratch_path


def score_ingest_query(spark: SparkSession, source_dir: str, sink_dir: str,
                       checkpoint: str | None = None, schema: StructType = schemas.ROUND_RECORD,
                       metrics: Sequence[str] = SCORE_METRICS, available_now: bool = True,
                       max_files_per_trigger: int | None = None, documents: bool = False) -> StreamingQuery:
    """Start the ingest; returns the running query.

    ``available_now=True`` processes every file present at start (in as many
    micro-batches as ``max_files_per_trigger`` asks for) and stops, which is
    how a scheduled ingest runs; ``False`` keeps polling the folder.
    ``documents=True`` reads whole response documents (``<model>.json``)
    instead of JSON lines of round records.
    """
    reader = spark.readStream
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if documents:
        # one response document per model, <model>.json, as stored by a fetch
        docs = reader.schema(schemas.RESPONSE).option("multiLine", True).json(source_dir)
        records = response_records(docs)
    else:
        records = reader.schema(schema).json(source_dir)
    rows = filter_scores(flatten_scores(records), metrics)
    writer = (rows.writeStream.format("parquet")
              .option("path", sink_dir)
              .option("checkpointLocation", checkpoint or scratch_path(spark, "ingest-checkpoint"))
              .partitionBy("model_name")
              .outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
