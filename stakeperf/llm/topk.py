"""Exact top-k by inner product, with a three-phase uniform threshold.

Components are dealt to ``parts`` dimension parts.  For a query, each part gives
every vector a partial score; the score is the sum over the parts.

1. Gather: each block of vectors lists the k best partial scores of each part
   for a query, and returns the k best full scores among the listed vectors.
   The k-th best of all blocks' returns is t: the k-th best score of all is
   t or more.
2. Cut off: t goes out to all blocks.  A vector whose partial scores are all
   below t / parts scores below t, so each part collects the vectors with a
   partial score of t / parts or more, and no other can be in the result.
3. Resolve: the collected vectors are scored exactly; a block returns its k best
   of them, ties to the smaller id, and the k best of all blocks are the result.

Vectors travel in blocks of bounded size, queries in groups of bounded size; a
block meets each group of queries once per phase, and returns at most k rows a
query.

Scores are whole numbers and always exact.  Where a block and its queries can only
give sums below 2**53, doubles hold them.  Elsewhere doubles of scaled vectors only
choose: a vector stays if its rounded score plus what rounding can amount to reaches
the cut-off, and whole-number arithmetic scores those that stay.  A score beyond a
long is shown as the nearest long but ranks by its whole value, which travels with
it as bytes that order alike.

Defined results: vectors that are null or hold null or non-finite components
take no part, nor do those with one whose multiple by ``scale`` leaves the doubles, nor
rows with a null id; fewer candidates than k give fewer
rows; a query never meets rows of its own id; vectors of another length than
the query's are no candidates; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stakeperf.llm.common import empty, per_task, written

PARTS, BLOCK, QUERIES, TILE = 2, 2048, 4096, 512
BLOCKED = pa.schema([("dim", pa.int64()), ("ids", pa.list_(pa.int64())), ("values", pa.binary())])
SCORES = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("beyond", pa.binary())])
#: Sums of doubles are exact below, and the ends of a long.
EXACT, LEAST, MOST = 1 << 53, -(1 << 63), (1 << 63) - 1


def quantised(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, dim, whole-number components) of the rows that take part; doubles of 2**53 and more are whole."""
    fine = f"vec_id is not null and embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs({scale}D * x) < double('infinity'))"
    rows = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(fine)
    return rows.selectExpr("vec_id", "cast(size(embedding) as bigint) dim", f"transform(embedding, x -> if(abs({scale}D * x) < {EXACT}D, double(floor({scale}D * x)), {scale}D * x)) x")


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """(dim, ids, values): rows packed into blocks of one length, within each partition."""
    @per_task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, tuple[list, list]] = {}

        def pack(dim):
            ids, values = waiting.pop(dim)
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int64()), pa.array([np.concatenate(ids)], pa.list_(pa.int64())), pa.array([np.concatenate(values).tobytes()], pa.binary())], schema=BLOCKED)

        for batch in batches:
            ids, dims = batch.column("vec_id").to_numpy(), batch.column("dim").to_numpy()
            flat = batch.column("x").flatten().to_numpy(zero_copy_only=False)
            start = np.cumsum(dims) - dims
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                for k in range(0, len(at), size):
                    some = at[k:k + size]
                    a, b = waiting.setdefault(dim, ([], []))
                    a.append(ids[some])
                    b.append(flat[(start[some][:, None] + np.arange(dim)).ravel()])
                    if sum(map(len, a)) >= size:
                        yield pack(dim)
        for dim in list(waiting):
            yield pack(dim)
        yield empty(BLOCKED)
    return rows.mapInArrow(run, "dim bigint, ids array<bigint>, values binary")


def _parts(dim: int, parts: int) -> list[slice]:
    edge = np.linspace(0, dim, min(parts, max(dim, 1)) + 1).astype(int).tolist()
    return [slice(a, b) for a, b in zip(edge, edge[1:])]


def _best(row: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of each row, ties to the smaller id; scores may be Python's whole numbers."""
    if score.dtype == object:
        order = np.array(sorted(range(len(row)), key=lambda i: (row[i], -score[i], ids[i])), np.int64)
    else:
        order = np.lexsort((ids, -score, row))
    r = row[order]
    first = np.searchsorted(r, r, "left")
    return order[np.arange(len(r)) - first < k]


def _scaled(q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float, float]:
    """Queries and vectors, the powers of two they were divided by, and how far a double may be
    from their products: the vectors themselves and 0 where sums of doubles are exact."""
    high = [float(np.abs(m).max(initial=0.0)) for m in (q, x)]
    if high[0] * high[1] * x.shape[1] < EXACT:
        return q, x, 1.0, 1.0, 0.0
    eq, ex = (float(np.ldexp(1.0, int(np.frexp(h)[1]) - 1)) if h else 1.0 for h in high)
    # components are below 2 now, products below 4
    return q / eq, x / ex, eq, ex, 4.0 * x.shape[1] * (x.shape[1] + 8) * 2.0 ** -52


def _exact(q: np.ndarray, x: np.ndarray, row: np.ndarray, col: np.ndarray, slack: float) -> np.ndarray:
    """The scores of pairs of rows."""
    if not slack:
        return (q[row] * x[col]).sum(axis=1)
    whole = lambda m, some: {i: [int(v) for v in m[i]] for i in np.unique(some).tolist()}
    a, b = whole(q, row), whole(x, col)
    out = np.empty(len(row), object)
    out[:] = [sum(map(int.__mul__, a[i], b[j])) for i, j in zip(row.tolist(), col.tolist())]
    return out


def gather(qids, q, _, ids, x, k, parts):
    """Phase 1 of one block and some queries: (query, vector, full score)."""
    out = []
    other = qids[:, None] != ids[None, :]
    near_q, near_x, _, _, slack = _scaled(q, x)
    for s in _parts(x.shape[1], parts):
        score = np.where(other, near_q[:, s] @ near_x[:, s].T, -np.inf)
        m = min(k, len(ids))
        best = np.argpartition(-score, m - 1, axis=1)[:, :m]
        out.append(best)
    listed = np.sort(np.concatenate(out, axis=1), axis=1)
    new = np.ones(listed.shape, bool)
    new[:, 1:] = listed[:, 1:] != listed[:, :-1]
    row, at = np.nonzero(new & np.take_along_axis(other, listed, axis=1))
    col = listed[row, at]
    score = _exact(q, x, row, col, slack)
    top = _best(row, ids[col], score, k)
    return qids[row[top]], ids[col[top]], score[top]


def collect(qids, q, cut, ids, x, k, parts):
    """Phases 2 and 3 of one block and some queries: (query, vector, exact score)."""
    wanted = np.zeros((len(qids), len(ids)), bool)
    slices = _parts(x.shape[1], parts)
    near_q, near_x, eq, ex, slack = _scaled(q, x)
    if slack:
        cut = cut / eq / ex
        cut = np.where(np.isfinite(cut), cut - np.abs(cut) * 2.0 ** -50 - len(slices) * slack, cut)
    full = np.zeros(wanted.shape)
    for s in slices:
        score = near_q[:, s] @ near_x[:, s].T
        wanted |= len(slices) * score >= cut[:, None]
        full += score
    wanted &= qids[:, None] != ids[None, :]
    if slack:  # whole numbers are slow: only what may be among the block's k best is scored
        near = np.where(wanted, full, -np.inf)
        m = min(k, len(ids))
        kth = -np.partition(-near, m - 1, axis=1)[:, m - 1:m]
        wanted &= full >= kth - 2 * slack
    row, col = np.nonzero(wanted)
    score = _exact(q, x, row, col, slack)
    top = _best(row, ids[col], score, k)
    return qids[row[top]], ids[col[top]], score[top]


def _bytes(score: int) -> bytes | None:
    """For a score at or beyond the ends of a long: bytes that order as the scores do."""
    if LEAST < score < MOST:
        return None
    size = (abs(score).bit_length() + 7) // 8
    body = size.to_bytes(2, "big") + abs(score).to_bytes(size, "big")
    return b"\1" + body if score > 0 else b"\0" + bytes(255 - c for c in body)


def _columns(qids, ids, score) -> list[pa.Array]:
    if score.dtype != object:
        return [*(pa.array(c.astype(np.int64)) for c in (qids, ids, score)), pa.nulls(len(ids), pa.binary())]
    whole = score.tolist()
    return [pa.array(qids), pa.array(ids), pa.array([min(max(v, LEAST), MOST) for v in whole], pa.int64()), pa.array([_bytes(v) for v in whole], pa.binary())]


def _meet(blocks: DataFrame, groups: DataFrame, work, k: int, parts: int) -> DataFrame:
    """``work`` on every block and every group of queries of its length."""
    numbers = groups.groupBy("dim").agg(F.collect_list("g").alias("gs"))  # one number for QUERIES queries
    pairs = blocks.join(numbers, "dim").withColumn("g", F.explode("gs")).drop("gs").join(groups, ["dim", "g"])

    @per_task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, ids, values, qids, qvalues, cut in zip(*(batch.column(n) for n in ("dim", "ids", "values", "qids", "qvalues", "cutoffs"))):
                d = dim.as_py()
                ids, qids, cut = (np.asarray(c.values) for c in (ids, qids, cut))
                x, q = (np.frombuffer(v.as_buffer(), np.float64).reshape(n, d) for v, n in ((values, len(ids)), (qvalues, len(qids))))
                for t in range(0, len(qids), TILE):
                    some = slice(t, t + TILE)
                    out = work(qids[some], q[some], cut[some], ids, x, k, parts)
                    yield pa.RecordBatch.from_arrays(_columns(*out), schema=SCORES)
        yield empty(SCORES)
    return pairs.select("dim", "ids", "values", "qids", "qvalues", "cutoffs").mapInArrow(run, "query_id bigint, vec_id bigint, score bigint, beyond binary")


def _ranked(scores: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("beyond").desc(), "vec_id")
    return scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def search(embeddings: DataFrame, is_query: str = "vec_id % 50 = 0", k: int = 5, scale: int = 256, parts: int = PARTS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of each query row.

    Query rows that repeat an id must hold equal vectors; they count once."""
    rows = written(quantised(embeddings, scale), "quantised")
    blocks = written(_blocks(rows, BLOCK), "blocks")
    queries = rows.where(is_query).dropDuplicates(["vec_id"])
    n = max(1, -(-queries.count() // QUERIES))
    groups = written(_blocks(queries.repartition(n, "vec_id"), QUERIES), "queries")
    groups = written(groups.selectExpr("dim", "monotonically_increasing_id() g", "ids qids", "values qvalues"), "query-groups")
    zero = F.transform("qids", lambda x: F.lit(0.0)).alias("cutoffs")
    listed = _meet(blocks, groups.select("*", zero), gather, k, parts)
    cut = _ranked(listed, k).where(F.col("rank") == k).where(F.col("score") > LEAST).selectExpr("query_id", "double(score) cutoff")
    each = groups.select("g", F.posexplode("qids").alias("at", "query_id")).join(cut, "query_id", "left")
    lowest = F.coalesce("cutoff", F.lit(float("-inf")))
    cutoffs = each.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("at", lowest.alias("cutoff")))).alias("c")).selectExpr("g", "transform(c, x -> x.cutoff) cutoffs")
    found = _meet(blocks, written(groups.join(cutoffs, "g"), "cutoffs"), collect, k, parts)
    return _ranked(found, k).select("query_id", "rank", "vec_id", "score")
