"""What the operators share: table access, written stages, Arrow batches."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stakeperf.session import on_workers, scratch_path

#: Bytes of text a task works on at a time; one longer text is taken whole.
CHUNK_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = on_workers(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write the rows as Parquet to the shared folder of
    ``spark.checkpoint.dir`` and read them back.  Survives lost executors and
    lets later reads prune columns.  A file per task: scans have a task per split,
    and adaptive execution merges small shuffle partitions by their bytes."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(taken: list[str], name: str) -> str:
    """``name``, or ``name`` after underscores where a column has it already."""
    while name.lower() in {t.lower() for t in taken}:
        name = "_" + name
    return name


class Texts:
    """UTF-8 bytes of some rows of an Arrow string column; null counts as empty."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
        column = column.fill_null("") if column.null_count else column
        if len(column):
            offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
        else:
            offsets = np.zeros(1, np.int64)
        body = column.buffers()[2] if len(column) else None
        lo, hi = int(offsets[0]), int(offsets[-1])
        raw = np.frombuffer(body, dtype=np.uint8)[lo:hi] if body is not None and hi > lo else np.empty(0, np.uint8)
        self.offsets = offsets - lo
        self.n = len(column)
        # eight zero bytes more, so that words can be read eight bytes at a time
        self.data = np.concatenate([raw, np.zeros(8, np.uint8)])

    @property
    def size(self) -> int:
        return len(self.data) - 8

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.offsets[i]:self.offsets[i + 1]].tobytes()


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``limit`` bytes of text each, whole rows only."""
    col = batch.column(batch.schema.get_field_index(column))
    n = len(col)
    if not n:
        return
    lengths = np.asarray(pc.fill_null(pc.binary_length(col), 0), dtype=np.int64)
    part = np.cumsum(lengths) // limit
    cuts = np.flatnonzero(np.diff(part)) + 1
    edges = [0, *cuts.tolist(), n]
    for a, b in zip(edges, edges[1:]):
        yield batch.slice(a, b - a)


def sorted_groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """One table per run of rows equal in ``names``, over batches that come sorted by these."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(n).to_numpy() for n in names], axis=1)
        edges = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
        if held and any(held[-1].column(n)[held[-1].num_rows - 1].as_py() != k for n, k in zip(names, key[0].tolist())):
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(edges[:-2], edges[1:-1]):
            yield pa.Table.from_batches([*held, batch.slice(a, b - a)])
            held = []
        held.append(batch.slice(edges[-2]))
    if held:
        yield pa.Table.from_batches(held)


#: Bits of an IdFilter: 4 MB, whatever the data.
FILTER_BITS = 1 << 25


class IdFilter:
    """A bitmap of hashed ids of fixed size, to leave most other rows out before
    a join: never refuses an id that was put in, and the join settles the rest."""

    def __init__(self, ids: DataFrame, column: str):
        slot = F.pmod(F.xxhash64(column), F.lit(FILTER_BITS)) + 1
        parts = ids.where(F.col(column).isNotNull()).select(slot.alias("s")).groupBy(F.bitmap_bucket_number("s").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits"))
        self.bits = np.zeros(FILTER_BITS // 8, np.uint8)
        for r in parts.toLocalIterator():  # at most FILTER_BITS / 32768 rows of 4096 bytes
            at = (r["k"] - 1) * 4096
            self.bits[at:at + 4096] = np.frombuffer(r["bits"], np.uint8)

    def slots(self, column):
        """The column to be looked up by ``has``."""
        return F.pmod(F.xxhash64(column), F.lit(FILTER_BITS))

    def has(self, slots: np.ndarray) -> np.ndarray:
        return (self.bits[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1


def empty(schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([], f.type) for f in schema], schema=schema)


_STATE: dict = {}


def per_worker(key, build):
    """A value built once per Python worker process and kept between tasks.  A worker
    keeps one: the next operator that it serves needs the memory."""
    if key not in _STATE:
        _STATE[key] = build()
    return _STATE[key]


def _release() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def per_task(run: Callable) -> Callable:
    """A function over a task's batches, after which its worker gives freed memory
    back to the system: workers live on, idle, while other stages' workers run."""
    @functools.wraps(run)
    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = set(_STATE)
        yield from run(batches)
        if set(_STATE) - kept:
            for key in kept:
                del _STATE[key]
        _release()
    return tidy
