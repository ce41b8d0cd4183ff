"""Removal of passages that repeat across documents, by repeated-phrase automata.

A window is ``width`` consecutive words.  A word goes if a window that covers
it also starts in a document with a smaller id.

1. Scan: of the ``phrase``-word phrases inside a window, the one with the
   smallest hash is the window's anchor.  Equal windows have equal anchors, so
   a window can only recur where its anchor recurs; about one word in 18 starts
   an anchor.  Documents with equal word sequences form a class here: the
   smallest id stands for it, the others lose every window.
2. Confirm: anchors that occur in two or more representatives are the recurring
   phrases; the smallest such document is the phrase's source.
3. Compile: phrases are sharded by source, a bounded number to a shard, and each
   shard's phrases become one Aho-Corasick automaton over words.
4. Stream: every document with recurring phrases runs through the automata of
   its phrases' shards (others can hold no recurring window), which locate every
   occurrence.  A shard that many documents need is split by document.
5. The windows around the occurrences are compared by two 64-bit hashes, over
   two word hashes that are independent from the bytes on: a window goes from every document but the smallest that holds it.

Defined results: null text has no words; rows with a null id neither cause nor
suffer removal; rows that repeat an id don't count as smaller than each other, and
each loses what its own text repeats (a row is known by its id and a hash of its
text); shorter texts than a window stay whole; an empty table gives no rows; other
columns are carried along by ``deduplicated`` and ignored elsewhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stakeperf.llm.common import Texts, chunks, empty, fresh, per_task, written
from stakeperf.llm.spans import BASES, U, gram_hash, mix, ranges, window_hash, word_hash, words

WIDTH, PHRASE = 50, 16
#: Phrases in one automaton, and documents that run through one copy of it.
SHARD_PHRASES, SHARD_DOCUMENTS = 4000, 4000

#: Bytes of text that the scan and the removal work on at a time: their arrays hold
#: ten numbers and more a word.  Windows that a task of step 4 holds before it hands them on.
PIECE_BYTES, HELD_WINDOWS = 1 << 20, 1 << 16

#: Tells apart the texts of rows that repeat an id.
BODY = "xxhash64(text)"

SCAN = pa.schema([("doc_id", pa.int64()), ("body", pa.int64()), ("n_words", pa.int64()), ("seq_a", pa.int64()), ("seq_b", pa.int64()), ("anchors", pa.list_(pa.int64()))])
FOUND = pa.schema([("win_a", pa.int64()), ("win_b", pa.int64()), ("doc_id", pa.int64()), ("body", pa.int64()), ("start", pa.int64())])


#: Seed of the second word hash, independent of the first from the bytes on.
SECOND = 1


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[:len(x) - (width - span)], x[width - span:]) if width > span else x


def window_anchors(h: np.ndarray, width: int, phrase: int) -> np.ndarray:
    """Anchor hash of every window of the word hashes ``h``."""
    return _sliding_min(gram_hash(h, phrase), width - phrase + 1) if len(h) >= width else np.empty(0, np.uint64)


def _scan(docs: DataFrame, width: int, phrase: int) -> DataFrame:
    @per_task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, limit=PIECE_BYTES):
                t = Texts(part.column("text"))
                start, length, doc = words(t.data, t.offsets)
                h = word_hash(t.data, start, length)
                count = np.bincount(doc, minlength=t.n)
                first = np.cumsum(count) - count
                place = (np.arange(len(h)) - first[doc] + 1).astype(np.uint64)
                sums = []
                for s, x in zip(BASES, (h, word_hash(t.data, start, length, SECOND))):
                    c = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(x + place * U(s)), dtype=np.uint64)])
                    sums.append((c[first + count] - c[first]).view(np.int64))
                anchors = window_anchors(h, width, phrase)
                inside = np.flatnonzero(doc[:len(anchors)] == doc[width - 1:]) if len(anchors) else np.empty(0, np.int64)
                at, owner = anchors[inside], doc[inside]
                new = np.ones(len(at), bool)
                new[1:] = (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])
                at, owner = at[new].view(np.int64), owner[new]
                edge = np.searchsorted(owner, np.arange(t.n + 1))
                lists = [np.unique(at[a:b]) for a, b in zip(edge, edge[1:])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("body"), pa.array(count.astype(np.int64)), *map(pa.array, sums), pa.array(lists, pa.list_(pa.int64()))], schema=SCAN)
        yield empty(SCAN)
    return docs.mapInArrow(run, "doc_id bigint, body bigint, n_words bigint, seq_a bigint, seq_b bigint, anchors array<bigint>")


class Automaton:
    """The phrases of one shard, matched on whole words."""

    def __init__(self, phrase: int):
        self.phrase, self.machine, self.ready = phrase, ahocorasick.Automaton(), False

    def learn(self, text: str, hashes: np.ndarray) -> None:
        """Adds the phrases of a source document that have these hashes."""
        t = Texts(pa.array([text], pa.string()))
        start, length, _ = words(t.data, t.offsets)
        g = gram_hash(word_hash(t.data, start, length), self.phrase)
        for p in np.flatnonzero(np.isin(g, hashes)).tolist():
            spans = zip(start[p:p + self.phrase].tolist(), length[p:p + self.phrase].tolist())
            key = " " + " ".join(t.data[s:s + n].tobytes().decode() for s, n in spans) + " "
            self.machine.add_word(key, int(g[p]))

    def locate(self, line: str) -> set[int]:
        """Hashes of the phrases that occur in words joined by one space, with a space at both ends."""
        if not self.ready:
            self.machine.make_automaton()
            self.ready = True
        return {h for _, h in self.machine.iter(line)} if len(self.machine) else set()


def _one_line(t: Texts, start: np.ndarray, length: np.ndarray) -> bytes:
    """The words, each followed by one space."""
    line = t.data[ranges(start, length + 1)]
    line[np.cumsum(length + 1) - 1] = 0x20
    return line.tobytes()


def _gathered(parts: Iterator[tuple[np.ndarray, ...]], schema: pa.Schema, limit: int) -> Iterator[pa.RecordBatch]:
    """The parts, each some rows as one array a column, as batches of ``limit`` rows
    at most: what a task holds grows neither with its documents nor with their windows."""
    held, n = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held)], schema=schema)

    for part in parts:
        for at in range(0, len(part[0]), limit):
            piece = [x[at:at + limit] for x in part]
            if held and n + len(piece[0]) > limit:
                yield batch()
                held, n = [], 0
            held.append(piece)
            n += len(piece[0])
    if held:
        yield batch()


def _matches(rows: DataFrame, width: int, phrase: int) -> DataFrame:
    """Windows whose anchor the automaton of (shard, salt) has located; rows come in order, sources first."""
    def located(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        here, machine = None, None
        for batch in batches:
            for shard, salt, kind, doc, body, text, hashes in zip(*(batch.column(n) for n in ("shard", "salt", "kind", "doc_id", "body", "text", "phrases"))):
                if here != (at := (shard.as_py(), salt.as_py())):
                    here, machine = at, Automaton(phrase)
                if kind.as_py() == 0:
                    machine.learn(text.as_py(), np.array(hashes.as_py(), np.int64).view(np.uint64))
                    continue
                t = Texts(pa.array([text.as_py()], pa.string()))
                start, length, _ = words(t.data, t.offsets)
                found = machine.locate(" " + _one_line(t, start, length).decode())
                if not found:
                    continue
                h = word_hash(t.data, start, length)
                w = np.flatnonzero(np.isin(window_anchors(h, width, phrase), np.fromiter(found, np.uint64, len(found))))
                a, b = window_hash(h, width, BASES[0])[w], window_hash(word_hash(t.data, start, length, SECOND), width, BASES[1])[w]
                yield a.view(np.int64), b.view(np.int64), np.full(len(w), doc.as_py()), np.full(len(w), body.as_py()), w

    @per_task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _gathered(located(batches), FOUND, HELD_WINDOWS)
        yield empty(FOUND)
    return rows.mapInArrow(run, "win_a bigint, win_b bigint, doc_id bigint, body bigint, start bigint")


def repeats(docs: DataFrame, width: int = WIDTH, phrase: int = PHRASE, shard_phrases: int = SHARD_PHRASES, shard_documents: int = SHARD_DOCUMENTS) -> DataFrame:
    """(doc_id, body, whole, starts) of the texts that lose words: all of a copy's
    words, or the words of the windows that start at ``starts``; ``body`` as ``BODY``."""
    row = ["doc_id", "body"]
    docs = docs.selectExpr("cast(doc_id as bigint) doc_id", f"{BODY} body", "text").where("doc_id is not null")
    scan = written(_scan(docs, width, phrase).where(F.col("n_words") >= width), "scan")
    key = ["n_words", "seq_a", "seq_b"]
    classes = written(scan.groupBy(*key).agg(F.min("doc_id").alias("rep")), "classes")
    copies = scan.drop("anchors").join(classes, key).where("doc_id > rep").select(*row).distinct()
    reps = scan.join(classes.withColumnRenamed("rep", "doc_id"), [*key, "doc_id"], "left_semi")

    anchors = reps.select(*row, F.explode("anchors").alias("h")).distinct()
    shared = anchors.groupBy("h").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last")).where("source < last").drop("last")
    hits = written(anchors.join(shared, "h"), "hits")
    shards = max(1, -(-hits.where("doc_id = source").count() // shard_phrases))
    routes = hits.withColumn("shard", F.pmod(F.xxhash64("source"), F.lit(shards))).groupBy(*row, "shard").agg(F.collect_list(F.when(F.col("source") == F.col("doc_id"), F.col("h"))).alias("phrases"))
    routes = written(routes, "routes")
    split = routes.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / shard_documents).alias("salts"))
    by_doc = routes.join(split, "shard").groupBy(*row).agg(F.collect_list(F.struct("shard", "salts", "phrases")).alias("routes"))

    mine = F.pmod(F.xxhash64(*row), F.col("r.salts"))
    every = F.when(F.size("r.phrases") > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("r.salts") - 1), lambda s: F.struct(s.alias("salt"), F.lit(0).alias("kind"))))
    jobs = F.concat(F.coalesce(every, F.array().cast("array<struct<salt:bigint,kind:int>>")), F.array(F.struct(mine.alias("salt"), F.lit(1).alias("kind"))))
    rows = docs.join(by_doc, row).select(*row, "text", F.explode("routes").alias("r")).select(*row, "text", "r", F.explode(jobs).alias("job"))
    rows = rows.select(F.col("r.shard").alias("shard"), "job.salt", "job.kind", *row, "text", F.when(F.col("job.kind") == 0, F.col("r.phrases")).alias("phrases"))
    rows = rows.repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind", "doc_id")
    found = written(_matches(rows, width, phrase), "windows")

    window = ["win_a", "win_b"]
    # written, so that both sides of the join are plain shuffles: a passage that a third of the documents share is split
    owner = found.groupBy(*window).agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).where("owner < last").drop("last")
    owner = written(owner, "owners")
    gone = found.join(owner, window).where("doc_id > owner").groupBy(*row).agg(F.collect_set("start").alias("starts"))
    none = F.lit(None).cast("array<bigint>")
    both = copies.select(*row, F.lit(True).alias("whole"), none.alias("starts")).unionByName(gone.select(*row, F.lit(False).alias("whole"), "starts"))
    return both.groupBy(*row).agg(F.max("whole").alias("whole"), F.flatten(F.collect_list("starts")).alias("starts"))


def _apply(batch: pa.RecordBatch, width: int, marks: tuple[str, str]):
    """(slice of the batch, words, words removed, kept words joined by one space) of every text."""
    for part in chunks(batch, limit=PIECE_BYTES):
        t = Texts(part.column("text"))
        start, length, doc = words(t.data, t.offsets)
        count = np.bincount(doc, minlength=t.n)
        first = np.cumsum(count) - count
        cover = np.zeros(len(start) + 1, np.int64)
        whole, starts = part.column(marks[0]), part.column(marks[1])
        for i in np.flatnonzero(np.asarray(whole.is_valid())).tolist():
            if whole[i].as_py() and count[i] >= width:
                at, n = np.array([0]), count[i]
            else:
                at, n = np.asarray(starts[i].values, np.int64) if starts[i].is_valid else np.empty(0, np.int64), width
                at = at[at + width <= count[i]]
            np.add.at(cover, first[i] + at, 1)
            np.add.at(cover, first[i] + at + n, -1)
        keep = np.cumsum(cover[:-1]) == 0
        line = _one_line(t, start[keep], length[keep])
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(length[keep] + 1)])
        kept = np.bincount(doc[keep], minlength=t.n)
        edge = ends[np.concatenate([np.zeros(1, np.int64), np.cumsum(kept)])].tolist()
        yield part, count, count - kept, [line[a:b - 1] if b > a else b"" for a, b in zip(edge, edge[1:])]


def _with_repeats(docs: DataFrame, width: int, **options) -> tuple[DataFrame, tuple[str, str]]:
    """The rows with what they lose, and the names of the two columns that say so."""
    key, body, whole, starts = (fresh(docs.columns, n) for n in ("repeat_id", "repeat_body", "whole", "starts"))
    marks = repeats(docs, width, **options).toDF(key, body, whole, starts)
    return docs.join(marks, (F.col("doc_id") == F.col(key)) & (F.expr(BODY) == F.col(body)), "left").drop(key, body), (whole, starts)


def digests(docs: DataFrame, width: int = WIDTH, **options) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row."""
    docs = docs.selectExpr("cast(doc_id as bigint) doc_id", "text")
    rows, marks = _with_repeats(docs, width, **options)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    @per_task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, count, removed, kept in _apply(batch, width, marks):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(count.astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())], schema=schema)
        yield empty(schema)

    return rows.mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")


def deduplicated(docs: DataFrame, width: int = WIDTH, **options) -> DataFrame:
    """The rows with the kept words as ``text`` (texts that lose nothing stay as
    they are, null included) and, where there is such a column, ``n_chars`` renewed."""
    fields = docs.schema
    rows, marks = _with_repeats(docs, width, **options)

    @per_task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, removed, kept in _apply(batch, width, marks):
                text = part.column("text").to_pylist()
                for i in np.flatnonzero(removed).tolist():
                    text[i] = kept[i].decode()
                columns = {n: part.column(n) for n in fields.names}
                columns["text"] = pa.array(text, columns["text"].type)
                if "n_chars" in columns:
                    n_chars = columns["n_chars"].to_pylist()
                    for i in np.flatnonzero(removed).tolist():
                        n_chars[i] = len(text[i])
                    columns["n_chars"] = pa.array(n_chars, columns["n_chars"].type)
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return rows.mapInArrow(run, fields)
