"""Session construction and the shared scratch location.

Intermediate tables are written under ``spark.checkpoint.dir``, which on a
cluster names a shared file system.  We only set it ourselves when the session
has none (local tests), never override it.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # checkpointed stages are deleted once nothing references them
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # No broadcast on planner *estimates* (an aggregate's estimate is not a
    # bound).  AQE still turns a join into a broadcast when the measured size
    # of a finished shuffle is small, and falls back to sort-merge otherwise;
    # only a calendar over a given window of days carries an explicit broadcast.
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(10 * 1024 * 1024),
}


def cluster_conf(input_bytes: int, executors: int, cores_per_executor: int = 4,
                 target_partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Settings for a large cluster, sized from the input volume.

    Scan splits and shuffle partitions are sized so a task handles about
    ``target_partition_bytes``; AQE starts from that many shuffle partitions
    and coalesces small ones, splits skewed join partitions, and converts a
    join to a broadcast only after measuring the finished shuffle.  For
    100 TB of input on 1000 executors this gives ~400k scan splits and a
    shuffle-partition start of ~400k (coalesced down at run time).
    """
    slots = max(1, executors * cores_per_executor)
    partitions = max(2 * slots, input_bytes // target_partition_bytes)
    return {
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(2 * target_partition_bytes),
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 << 20),
        # lost executors: keep shuffle files reachable and retry stages
        "spark.decommission.enabled": "true",
        "spark.storage.decommission.shuffleBlocks.enabled": "true",
        "spark.stage.maxConsecutiveAttempts": "8",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "stakeperf", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_root(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    When the setting is absent and Spark runs in local mode (tests), a
    private folder is created and registered; on a cluster a missing setting
    is an error, because a machine-local folder would not survive the loss of
    an executor.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        root = tempfile.mkdtemp(prefix="stakeperf-ckpt-")
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the checkpoint root for a written table."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/stakeperf/{name}-{uuid.uuid4().hex[:12]}"


#: Spark's limit of the bytes in an Arrow batch, and ours: both sides of each Python
#: task hold a batch outside the heap, and whole texts fill Spark's 64 MB.
ARROW_BYTES, ARROW_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def on_workers(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package: the same as setting
    ``spark.executorEnv.PYTHONPATH`` when the session was built.  Packages
    shipped with ``--py-files`` need no such path.  Arrow batches get a smaller
    limit, unless the session has one of its own."""
    if ARROW_BYTES not in spark.conf.getAll:
        spark.conf.set(ARROW_BYTES, str(ARROW_LIMIT))
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, env.get("PYTHONPATH", "")]))
    return spark


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage of a stage that several branches read: the rows are
    written once as Parquet to the shared folder (``spark.checkpoint.dir``),
    and every branch reads back the columns it needs.  Survives the loss of
    executors; never a machine-local folder on a cluster."""
    path = scratch_path(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Spark removes the shuffle files of a query that has ended, not when its driver next
#: collects garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def stage(df: DataFrame):
    """The rows of ``df`` as ``materialize`` gives them, for writes inside the block, at the
    end of which they are deleted.  The shuffle files of each write go with it, so the disk
    holds those of one write at a time."""
    spark = df.sparkSession
    path, before = scratch_path(spark, "stage"), spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        spark.conf.unset(SHUFFLES_GO) if before is None else spark.conf.set(SHUFFLES_GO, before)
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
