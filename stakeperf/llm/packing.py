"""Best-fit packing of documents into sequences, certified by lower bounds.

1. Each whole text becomes token ids and one closing id; only a document longer
   than a sequence is cut, into pieces of the full length.
2. The pieces are dealt to partitions of bounded size, and each partition packs
   its own by best-fit decreasing.
3. Dual-feasible functions of the lengths give a lower bound on the number of
   sequences that any packing of those pieces needs.  A partition that meets
   its bound is certified: no other packing of it has fewer sequences.
4. While all sequences together are more than the bound for all pieces, the
   partitions exchange documents: one with a gap gives up every sequence that
   has room left, a certified one those with a sixteenth or more left.  These
   pieces are dealt anew and packed again; the other sequences stay.  This ends
   at the bound, when one partition holds all that is left, or after ``rounds``.

Defined results: null or empty text is the closing id alone; equal documents
are packed one by one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stakeperf.llm.common import Texts, chunks, empty, per_task, per_worker, sorted_groups, written
from stakeperf.llm.tokens import LibraryPieces, PieceTable

CAPACITY = 2048
#: Pieces a task packs at a time; 40 bytes each.
PARTITION_ROWS = 1 << 18

PIECES = pa.schema([(n, pa.int64()) for n in ("doc_id", "piece", "start", "length", "ids_crc32")])
PLACED = pa.schema([*PIECES, ("sequence_id", pa.int64()), ("offset", pa.int64()), ("free", pa.int64()), ("gap", pa.int64())])


def lower_bound(count: np.ndarray) -> int:
    """The best of the bounds that two families of dual-feasible functions give;
    ``count``: how many pieces have each length from 0 to the capacity.

    For a threshold t up to half the capacity, lengths above capacity - t count
    as a full sequence, lengths below t as nothing and others as themselves.
    For a whole number k, a length x counts as floor((k+1)x/capacity)/k, or as
    x/capacity where (k+1)x is a multiple of the capacity."""
    capacity = len(count) - 1
    size = np.arange(capacity + 1)
    ones = np.concatenate([[0], np.cumsum(count)])  # ones[x]: pieces shorter than x
    mass = np.concatenate([[0], np.cumsum(count * size)])
    t = np.arange(0, capacity // 2 + 1)
    whole = ones[-1] - ones[capacity - t + 1]
    middle = mass[capacity - t + 1] - mass[t]
    best = int(np.max(whole + -(-middle // capacity)))
    for k in range(1, 41):
        scaled = (k + 1) * size
        value = np.where(scaled % capacity == 0, k * size, scaled // capacity * capacity)  # times k * capacity
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY):
    """(sequence of each piece, offset of each piece, room left in each sequence).

    Longest first, each into the fullest sequence that still has room.  Open
    sequences are kept by the room they have; the set of rooms is one integer."""
    order = np.argsort(-lengths, kind="stable")
    place = np.empty(len(lengths), np.int64)
    offset = np.empty(len(lengths), np.int64)
    open_by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, room = 0, []
    for i, x in zip(order.tolist(), lengths[order].tolist()):
        fits = rooms >> x
        if fits:
            r = x + (fits & -fits).bit_length() - 1
            b = open_by_room[r].pop()
            if not open_by_room[r]:
                rooms &= ~(1 << r)
        else:
            r, b = capacity, len(room)
            room.append(capacity)
        place[i], offset[i] = b, capacity - r
        room[b] = r - x
        if r > x:
            open_by_room[r - x].append(b)
            rooms |= 1 << (r - x)
    return place, offset, np.array(room, np.int64)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, close: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every whole text."""
    @per_task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = per_worker(("library", path), lambda: PieceTable(LibraryPieces(path)))
        end = np.array([close], "<u4").tobytes()
        for batch in batches:
            for part in chunks(batch):
                ids, edge = table(Texts(part.column("text")))
                ids = ids.astype("<u4", copy=False)
                row, piece, start, length, crc = [], [], [], [], []
                for k, (a, b) in enumerate(zip(edge.tolist(), edge[1:].tolist())):
                    n = b - a + 1
                    body = ids[a:b].tobytes() + end
                    for p, s in enumerate(range(0, n, capacity)):
                        row.append(k)
                        piece.append(p)
                        start.append(s)
                        length.append(min(capacity, n - s))
                        crc.append(zlib.crc32(body[4 * s:4 * (s + capacity)]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (piece, start, length, crc))], schema=PIECES)
        yield empty(PIECES)
    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id bigint, piece bigint, start bigint, length bigint, ids_crc32 bigint")


def _packed(rows: DataFrame, n_partitions: int, round_no: int, capacity: int) -> DataFrame:
    """Each partition packed on its own; ``gap``: its sequences beyond its lower bound."""
    @per_task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sorted_groups(batches, ["part"]):
            # the same packing whatever order the shuffle delivers
            t = t.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")]).combine_chunks()
            first = (round_no << 56) + (t.column("part")[0].as_py() << 32)
            lengths = t.column("length").to_numpy()
            place, offset, room = best_fit_decreasing(lengths, capacity)
            gap = len(room) - lower_bound(np.bincount(lengths, minlength=capacity + 1))
            columns = [t.column(n) for n in PIECES.names]
            yield from pa.Table.from_arrays([*columns, pa.array(first + place), pa.array(offset), pa.array(room[place]), pa.array(np.full(len(lengths), gap))], schema=PLACED).to_batches()
        yield empty(PLACED)
    part = F.pmod(F.xxhash64(F.lit(round_no), "doc_id", "piece", "ids_crc32"), F.lit(n_partitions)).alias("part")
    dealt = rows.select(*PIECES.names, part).repartition(n_partitions, "part").sortWithinPartitions("part")
    return dealt.mapInArrow(run, ", ".join(f"{f.name} bigint" for f in PLACED))


def pack(rows: DataFrame, capacity: int = CAPACITY, rounds: int = 3, partition_rows: int = PARTITION_ROWS) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``; ``rows`` as from ``pieces``."""
    rows = written(rows, "pieces")
    count = np.zeros(capacity + 1, np.int64)
    for r in rows.groupBy("length").count().collect():  # a row per length at most
        count[r["length"]] = r["count"]
    bound, left, done, used = lower_bound(count), rows, [], 0
    for r in range(rounds):
        n = left.count()
        placed = written(_packed(left, max(1, -(-n // partition_rows)), r, capacity), f"packed-{r}")
        loose = ((F.col("gap") > 0) & (F.col("free") > 0)) | (F.col("free") >= capacity // 16)
        first = F.col("offset") == 0
        new, stay = placed.agg(F.count_if(first), F.count_if(first & ~loose)).first()
        # a single partition has none to exchange with
        if used + new <= bound or n <= partition_rows or r == rounds - 1 or new == stay:
            done.append(placed)
            break
        used += stay
        done.append(placed.where(~loose))
        left = placed.where(loose).select(*PIECES.names)
    return reduce(DataFrame.unionByName, done).drop("free", "gap")
