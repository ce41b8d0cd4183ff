"""Near-duplicate embeddings by cross-polytope hashing.

A vector is turned by a pseudo-random rotation (three rounds of random signs
and a fast Hadamard transform) and hashed to its nearest vertex of the
cross-polytope: the coordinate of largest size, with its sign.  Two such hashes
make the bucket of a table; the next-nearest vertices give further buckets that
the vector also looks into.  With 6 tables and 2 probes, vectors of 64
components at cosine 0.9 meet with probability 0.989 (simulated), at 0.95 with 0.9996.

Vectors that meet are compared by cosine in double precision:

1. Equal vectors form a class; the smallest id stands for it, with its count.
2. Each class goes to its own bucket and its probes of every table.  A bucket
   of more than ``BLOCK`` rows is cut into blocks, and each pair of blocks is a
   separate group, so that no task holds a bucket and no pair is left out.
3. A group compares its pairs as one matrix product.  A pair that meets more
   than once is counted where it meets first, which both signatures tell.
4. A group returns its members' link counts and a forest that joins what is
   linked, not the pairs; components are found over the forests.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components link with nothing, and so do rows with a null id; vectors of
different lengths don't link; a row that repeats an id is another vector; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stakeperf.llm.common import empty, per_task, written
from stakeperf.llm.components import components
from stakeperf.llm.spans import BASES, U, mix

TABLES, PROBES, FUNCTIONS, BLOCK = 6, 2, 2, 1024
SIGNED = pa.schema([("rep", pa.int64()), ("copies", pa.int64()), ("vector", pa.binary()), ("buckets", pa.list_(pa.int64()))])
FOREST = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, whose length is a power of two, scaled to keep lengths."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def signatures(x: np.ndarray, tables: int = TABLES, probes: int = PROBES) -> np.ndarray:
    """[vector, table, 1 + probes] bucket numbers: the own bucket, then the next-nearest ones."""
    n, dim = x.shape
    size = max(2, 1 << (dim - 1).bit_length())
    unit = np.zeros((n, size))
    unit[:, :dim] = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = np.empty((n, tables, 1 + probes), np.uint64)
    reach = min(size, probes + 1)
    for t in range(tables):
        key, cost = np.full((n, 1), U((t + 1) * BASES[0] % 2**64) + U(dim)), np.zeros((n, 1))
        for f in range(FUNCTIONS):
            signs = np.random.default_rng([size, t, f]).choice([-1.0, 1.0], size=(3, size))
            y = unit
            for s in signs:
                y = hadamard(y * s)
            far = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :reach]
            value = np.take_along_axis(y, far, axis=1)
            vertex = (2 * far + (value < 0)).astype(np.uint64)
            away = (np.abs(value[:, :1]) - np.abs(value)) ** 2
            key = mix((key[:, :, None] * U(BASES[1]) + vertex[:, None, :] + U(1)).reshape(n, -1))
            cost = (cost[:, :, None] + away[:, None, :]).reshape(n, -1)
            best = np.argsort(cost, axis=1, kind="stable")[:, :probes + 1]
            key, cost = np.take_along_axis(key, best, axis=1), np.take_along_axis(cost, best, axis=1)
        out[:, t, :key.shape[1]] = key
        out[:, t, key.shape[1]:] = key[:, :1]  # fewer vertices than probes
    return out


def _rows(column: pa.Array) -> list[np.ndarray]:
    flat = column.values.to_numpy(zero_copy_only=False)
    edge = column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(edge, edge[1:])]


def _signed(classes: DataFrame, tables: int, probes: int) -> DataFrame:
    @per_task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _rows(batch.column("embedding"))
            keys: list = [None] * len(vectors)
            for dim in {len(v) for v in vectors}:
                rows = [i for i, v in enumerate(vectors) if len(v) == dim]
                x = np.array([vectors[i] for i in rows], np.float64)
                x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
                for i, k in zip(rows, signatures(x, tables, probes).view(np.int64).reshape(len(rows), -1)):
                    keys[i] = k
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("copies"), pa.array([v.tobytes() for v in vectors], pa.binary()), pa.array(keys, pa.list_(pa.int64()))], schema=SIGNED)
        yield empty(SIGNED)
    return classes.select("rep", "copies", "embedding").mapInArrow(run, "rep bigint, copies bigint, vector binary, buckets array<bigint>")


def _met(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of two signatures of one table meet there."""
    return (a[:, :1] == b).any(axis=1) | (b[:, :1] == a).any(axis=1)


def compare(rep, copies, x, sig, home, part, pair, table, bucket, threshold):
    """(rep, links, root) of the members of one group that link.

    sig: [member, table, 1 + probes]; home: whether this is the member's own
    bucket; part: its block; pair: the group's two blocks."""
    left = np.flatnonzero(part == pair[0])
    right = left if pair[0] == pair[1] else np.flatnonzero(part == pair[1])
    if not home.any() or not len(left) or not len(right):
        return None
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
    norm = np.sqrt((x * x).sum(axis=1))
    cosine = (x[left] @ x[right].T) / (norm[left][:, None] * norm[right][None, :])
    near = (cosine >= threshold) & (home[left][:, None] | home[right][None, :])
    if left is right:
        near = np.triu(near, 1)
    i, j = np.nonzero(near)
    if not len(i):
        return None
    i, j = left[i], right[j]
    first = np.ones(len(i), bool)
    for t in range(table):
        first &= ~_met(sig[i, t], sig[j, t])
    # a pair where each probes the other's bucket is counted in the smaller bucket
    both = home[i] ^ home[j]
    inner, outer = np.where(home[i], i, j), np.where(home[i], j, i)
    own = sig[outer, table, 0]
    first &= ~(both & (sig[inner, table, 1:] == own[:, None]).any(axis=1) & (own < bucket))
    # a class meets itself when two of its probes fall together
    first &= rep[i] != rep[j]
    i, j = i[first], j[first]
    if not len(i):
        return None
    links = np.bincount(i, weights=copies[j], minlength=len(rep)) + np.bincount(j, weights=copies[i], minlength=len(rep))
    label = np.unique(rep, return_inverse=True)[1]
    order = np.sort(np.unique(rep))
    while True:
        low = np.minimum(label[i], label[j])
        after = label.copy()
        np.minimum.at(after, i, low)
        np.minimum.at(after, j, low)
        if (after == label).all():
            break
        label = after
    some = links > 0
    return rep[some], links[some].astype(np.int64), order[label[some]]


def _compared(rows: DataFrame, threshold: float, tables: int, width: int, dtype: str) -> DataFrame:
    """Streams groups that come sorted; the last group of a batch waits for the next batch."""
    def groups(t: pa.Table):
        key = np.stack([t.column(n).to_numpy() for n in ("bucket", "p", "q")], axis=1)
        cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        return [0, *cuts.tolist(), t.num_rows]

    def work(t: pa.Table, edges: list[int]) -> Iterator[pa.RecordBatch]:
        out = []
        t = t.combine_chunks()
        rep, copies, home, part, table, bucket, p, q = (t.column(n).to_numpy() for n in ("rep", "copies", "home", "part", "tab", "bucket", "p", "q"))
        vector, sig = t.column("vector").combine_chunks(), _flat(t.column("buckets"))
        offsets = np.frombuffer(vector.buffers()[1], np.int32)[vector.offset:vector.offset + len(vector) + 1]
        for a, b in zip(edges, edges[1:]):
            if b - a > 1:
                x = np.frombuffer(vector.buffers()[2], np.uint8)[offsets[a]:offsets[b]].view(dtype).reshape(b - a, -1).astype(np.float64)
                got = compare(rep[a:b], copies[a:b], x, sig[a:b].reshape(b - a, tables, width), home[a:b], part[a:b], (p[a], q[a]), int(table[a]), bucket[a], threshold)
                if got:
                    out.append(got)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], schema=FOREST)

    def _flat(column) -> np.ndarray:
        column = column.combine_chunks()
        return column.flatten().to_numpy().reshape(len(column), tables * width)

    @per_task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            ends = tuple(batch.column(n)[batch.num_rows - 1].as_py() for n in ("bucket", "p", "q"))
            begins = tuple(batch.column(n)[0].as_py() for n in ("bucket", "p", "q"))
            held.append(batch)
            if begins == ends and last in (None, begins):
                last = ends  # still one group
                continue
            t = pa.Table.from_batches(held)
            edges = groups(t)
            yield from work(t.slice(0, edges[-2]), edges[:-1])
            held, last = t.slice(edges[-2]).to_batches(), ends
        if held:
            t = pa.Table.from_batches(held)
            yield from work(t, groups(t))
        yield empty(FOREST)

    return rows.mapInArrow(run, "rep bigint, links bigint, root bigint")


def near_duplicates(embeddings: DataFrame, threshold: float = 0.9, tables: int = TABLES, probes: int = PROBES, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of (vec_id, embedding)."""
    element = embeddings.schema["embedding"].dataType.elementType.typeName()
    kind, dtype = ("float", "<f4") if element == "float" else ("double", "<f8")
    rows = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("embedding"))
    fine = "vec_id is not null and embedding is not null and exists(embedding, x -> x <> 0) and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    usable = rows.withColumn("embedding", F.when(F.expr(fine), F.col("embedding")))
    classes = written(usable.where("embedding is not null").groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes")
    signed = written(_signed(classes, tables, probes), "signed")

    width = 1 + probes
    spread = signed.select("*", F.posexplode("buckets").alias("place", "bucket"))
    sizes = spread.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / block).alias("parts")).where("parts > 1")
    spread = spread.join(sizes, "bucket", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("bigint")))
    spread = spread.withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts"))).withColumn("x", F.explode(F.expr("sequence(0L, parts - 1)")))
    spread = spread.select("bucket", F.least("part", "x").alias("p"), F.greatest("part", "x").alias("q"), "part", "rep", "copies", "vector", "buckets",
                           F.expr(f"place % {width} = 0").alias("home"), F.expr(f"cast(floor(place / {width}) as bigint)").alias("tab"))
    spread = spread.repartition("bucket", "p", "q").sortWithinPartitions("bucket", "p", "q")
    forest = written(_compared(spread, threshold, tables, width, dtype), "forest")

    linked = forest.groupBy("rep").agg(F.sum("links").alias("linked"))
    found = components(forest, "rep", "root").withColumnRenamed("node", "rep")
    known = usable.join(classes, "embedding", "left").join(linked, "rep", "left").join(found, "rep", "left")
    n_links = F.coalesce(F.col("copies") - 1, F.lit(0)) + F.coalesce("linked", F.lit(0))
    return known.select("vec_id", n_links.cast("bigint").alias("n_links"), F.coalesce("component", "rep", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
