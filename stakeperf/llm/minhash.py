"""Near-duplicate documents by SuperMinHash signatures.

Every distinct shingle of a document draws a random permutation of the slots
and, at step j, offers the value j + r (r random in [0, 1)) to the slot that
comes j-th in its permutation; a slot keeps its smallest offer.  The ranks of
one shingle are tied together by its permutation, which gives the estimate of
similarity a lower variance than independent hashes.  Offers of step j are at
least j, so a document stops as soon as all its slots hold less than j: long
documents after one or two steps.

Linking, for all documents:

1. Documents with equal shingle sets form a class; its smallest id stands for it.
2. Signatures are cut into bands.  Representatives that share a band are
   candidates: first each with the smallest id of its bucket, a star, so a
   bucket of n near copies costs n comparisons.
3. Candidates are confirmed on their full shingle sets, and components found.
4. Representatives joined by shared buckets form a family.  In a family that
   still has several components, every pair of different components that shares
   a band is a candidate too: the members outside the largest component meet
   each other and the largest component's members in groups of two blocks.  A
   group tries its pairs by the number of shared bands and leaves out pairs that
   it has joined meanwhile; it returns links, not pairs.  Then components again.

Shingle sets are held as 64-bit hashes of word sequences, classes as 128 bits.

Defined results: null text, empty text and text without words have no shingles
and link with nothing; a text of fewer words than a shingle is one shingle;
rows with a null id link with nothing and are kept; rows that repeat an id are
one node, which each of its texts links; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stakeperf.llm.common import IdFilter, Texts, chunks, empty, per_task, sorted_groups, written
from stakeperf.llm.components import components
from stakeperf.llm.spans import BASES, LOWER, U, gram_hash, mix, word_hash, words

WORDS, BANDS, ROWS = 5, 25, 5
SCAN = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("bands", pa.list_(pa.int64()))])
SETS = pa.schema([("doc_id", pa.int64()), ("set_a", pa.int64()), ("shingles", pa.binary())])
LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
#: Members of a block of a family.
BLOCK = 256
#: Text a task turns into signatures at a time: a slot permutation is kept for every shingle.
SIGN_BYTES = 1 << 20


def shingles(texts: Texts, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes of all texts, n + 1 offsets); sorted within a text."""
    data = LOWER[texts.data]
    start, length, doc = words(data, texts.offsets)
    h = word_hash(data, start, length)
    count = np.bincount(doc, minlength=texts.n)
    first = np.cumsum(count) - count
    g = gram_hash(h, k)
    g = g[doc[:len(g)] == doc[k - 1:]] if len(g) else g
    short = np.flatnonzero((count > 0) & (count < k))
    n = np.maximum(count - k + 1, 0)
    n[short] = 1
    out = np.empty(int(n.sum()), np.uint64)
    edge = np.concatenate([np.zeros(1, np.int64), np.cumsum(n)])
    is_short = np.zeros(len(out), bool)
    is_short[edge[short]] = True
    out[~is_short] = g
    for i in short:
        c = int(count[i])
        out[edge[i]] = mix(gram_hash(h[first[i]:first[i] + c], c) + U(c))[0]
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
        if b - a > 1:
            out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[edge[:-1][edge[:-1] < len(out)]] = True
    return out[new], np.concatenate([np.zeros(1, np.int64), np.cumsum(new)])[edge]


def superminhash(items: np.ndarray, edge: np.ndarray, slots: int) -> np.ndarray:
    """Signatures, one row per set; a value is step << 32 | random. Empty sets keep the largest value."""
    n = len(edge) - 1
    size = np.diff(edge)
    owner = np.repeat(np.arange(n), size)
    sig = np.full(n * slots, ~U(0))

    def draw(h, j):
        r = mix(h + U((j + 1) * BASES[1] % 2**64))
        return (r >> U(32)) | U(j << 32), j + (((r & U(0xFFFFFFFF)) * U(slots - j)) >> U(32)).astype(np.int64)

    value, slot = draw(items, 0)
    np.minimum.at(sig, owner * slots + slot, value)
    j = 0
    alive = None
    while True:
        open_ = (sig.reshape(n, slots).max(axis=1) >= U((j + 1) << 32)) & (size > 0)
        if j == slots - 1 or not open_.any():
            return sig.reshape(n, slots)
        if alive is None:
            keep = np.flatnonzero(open_[owner])
            alive, own = items[keep], owner[keep]
            order = np.tile(np.arange(slots, dtype=np.uint16), (len(alive), 1))
            row = np.arange(len(alive))
            order[row, slot[keep]] = 0
        else:
            going = open_[own]
            if going.sum() < 0.7 * len(own):
                alive, own, order = alive[going], own[going], order[going]
                row = np.arange(len(alive))
        j += 1
        value, at = draw(alive, j)
        slot = order[row, at]
        order[row, at] = order[row, j]
        np.minimum.at(sig, own * slots + slot.astype(np.int64), value)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = sig[:, :bands * rows].reshape(len(sig), bands, rows)
    out = np.zeros(parts.shape[:2], np.uint64)
    factor = 1
    for j in range(rows):
        factor = factor * BASES[1] % 2**64
        out += mix(parts[:, :, j]) * U(factor)
    return mix(out + np.arange(bands, dtype=np.uint64) * U(BASES[0]))


def set_hash(items: np.ndarray, edge: np.ndarray, seed: int) -> np.ndarray:
    """A hash of every set, whatever the order of its items."""
    s = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(items ^ U(seed)), dtype=np.uint64)])
    return (s[edge[1:]] - s[edge[:-1]]).view(np.int64)


def _scan(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    @per_task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, limit=SIGN_BYTES):
                items, edge = shingles(Texts(part.column("text")), k)
                keys = band_keys(superminhash(items, edge, bands * rows), bands, rows).view(np.int64)
                a, b = (set_hash(items, edge, s) for s in BASES)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(edge)), pa.array(a), pa.array(b), pa.array(list(keys), pa.list_(pa.int64()))], schema=SCAN)
        yield empty(SCAN)
    return docs.mapInArrow(run, "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, bands array<bigint>")


def _sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(doc_id, set_a, shingles) of the documents with these ids, and of a few others."""
    wanted = IdFilter(ids, "doc_id")

    @per_task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(wanted.has(batch.column("slot").to_numpy())))
            for part in chunks(batch):
                items, edge = shingles(Texts(part.column("text")), k)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(set_hash(items, edge, BASES[0])), pa.array([items[a:b].tobytes() for a, b in zip(edge, edge[1:])], pa.binary())], schema=SETS)
        yield empty(SETS)
    rows = docs.where("doc_id is not null").select("doc_id", wanted.slots("doc_id").alias("slot"), "text")
    return rows.mapInArrow(run, "doc_id bigint, set_a bigint, shingles binary")


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, of sorted distinct shingles."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar."""
    @per_task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("left"), batch.column("right")
            good = [similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in zip(left, right)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    joined = pairs.join(sets.selectExpr("doc_id a", "shingles left"), "a").join(sets.selectExpr("doc_id b", "shingles right"), "b")
    return joined.select("a", "b", "left", "right").mapInArrow(run, "a bigint, b bigint")


def join_group(ids, component, outside, part, sets, bands, kind, p, q, percent) -> list[tuple[int, int]]:
    """Links between different components among the pairs of one group of a family.

    kind 0: members outside the largest component (block p) with its members
    (block q); kind 1: members outside it, blocks p and q."""
    left = np.flatnonzero(outside & (part == p))
    right = np.flatnonzero(~outside if kind == 0 else outside & (part == q))
    if not len(left) or not len(right):
        return []
    shared = (bands[left][:, None, :] == bands[right][None, :, :]).sum(axis=2)
    size = np.array([len(s) for s in sets], np.int64)
    fits = 100 * np.minimum(size[left][:, None], size[right][None, :]) >= percent * np.maximum(size[left][:, None], size[right][None, :])
    i, j = np.nonzero((shared > 0) & fits & (component[left][:, None] != component[right][None, :]))
    if kind == 1 and p == q:
        i, j = i[left[i] < right[j]], j[left[i] < right[j]]
    order = np.argsort(-shared[i, j], kind="stable")
    root = {c: c for c in component.tolist()}

    def find(c):
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    out = []
    for a, b in zip(left[i[order]].tolist(), right[j[order]].tolist()):
        x, y = find(int(component[a])), find(int(component[b]))
        if x != y and similar(sets[a], sets[b], percent):
            root[max(x, y)] = min(x, y)
            out.append((int(ids[a]), int(ids[b])))
    return out


def _family_links(families: DataFrame, found: DataFrame, bands: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """Links between the components inside families that have several."""
    members = families.selectExpr("node doc_id", "component family").join(found.selectExpr("node doc_id", "component"), "doc_id", "left")
    members = written(members.withColumn("component", F.coalesce("component", "doc_id")), "members")
    size = members.groupBy("family", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = size.groupBy("family").agg(F.max(F.struct("n", F.col("component"))).alias("main"), F.sum("n").alias("n")).where("n > main.n")
    mixed = mixed.selectExpr("family", "main.component main", f"cast(ceil(main.n / {block}) as bigint) mains", f"cast(ceil((n - main.n) / {block}) as bigint) others")
    # written, so that the join has plain sides and the rows of a large family can be split
    rows = members.join(written(mixed, "mixed"), "family").withColumn("outside", F.expr("component <> main"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.when(F.col("outside"), F.col("others")).otherwise(F.col("mains"))))
    jobs = F.expr("""if(outside,
        concat(transform(sequence(0L, mains - 1), x -> named_struct('kind', 0L, 'p', part, 'q', x)),
               transform(sequence(0L, others - 1), x -> named_struct('kind', 1L, 'p', least(part, x), 'q', greatest(part, x)))),
        transform(sequence(0L, others - 1), x -> named_struct('kind', 0L, 'p', x, 'q', part)))""")
    rows = rows.join(bands, "doc_id").join(sets, ["doc_id", "set_a"]).select("family", F.explode(jobs).alias("job"), "doc_id", "component", "outside", "part", "bands", "shingles")
    rows = rows.select("family", "job.kind", "job.p", "job.q", "doc_id", "component", "outside", "part", "bands", "shingles")
    group = ["family", "kind", "p", "q"]

    @per_task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sorted_groups(batches, group):
            t = t.combine_chunks()
            n = t.num_rows
            column = {c: t.column(c).to_numpy() for c in ("doc_id", "component", "outside", "part")}
            keys = t.column("bands").combine_chunks().flatten().to_numpy().reshape(n, -1)
            sets_ = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("shingles")]
            kind, p, q = (t.column(c)[0].as_py() for c in ("kind", "p", "q"))
            links = join_group(column["doc_id"], column["component"], column["outside"].astype(bool), column["part"], sets_, keys, kind, p, q, percent)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links)], schema=LINKS)
        yield empty(LINKS)

    return rows.repartition(*group).sortWithinPartitions(*group, "doc_id").mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, percent: int = 85, k: int = WORDS, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row.

    With 25 bands of 5 slots a pair of similarity 0.85 shares a band with
    probability 1 - 4e-7, one of 0.8 with 1 - 5e-5."""
    docs = docs.selectExpr("cast(doc_id as bigint) doc_id", "text")
    scan = written(_scan(docs, k, bands, rows), "scan")
    key = ["n_shingles", "set_a", "set_b"]
    classes = written(scan.where("n_shingles > 0").groupBy(*key).agg(F.min("doc_id").alias("rep")), "classes")
    reps = scan.join(classes.withColumnRenamed("rep", "doc_id"), [*key, "doc_id"], "left_semi").dropDuplicates(["doc_id", *key])
    reps = written(reps.select("doc_id", "n_shingles", "set_a", "bands"), "representatives")
    member = written(scan.drop("bands").join(classes, key, "left").select("doc_id", "n_shingles", "rep"), "members")
    # an id with several texts holds their classes together
    several = member.where("rep is not null").groupBy("doc_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select("doc_id")
    same_id = member.join(several, "doc_id").where("rep <> doc_id").selectExpr("doc_id a", "rep b")
    buckets = reps.select("doc_id", F.explode("bands").alias("key"))
    lead = buckets.groupBy("key").agg(F.min("doc_id").alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    star = written(buckets.join(lead, "key").where("doc_id <> lead").select("lead", "doc_id").distinct(), "star")

    # J(x, y) <= min(|x|, |y|) / max(|x|, |y|)
    sizes = reps.selectExpr("doc_id", "n_shingles n")
    sized = star.join(sizes, "doc_id").join(sizes.selectExpr("doc_id lead", "n m"), "lead")
    pairs = sized.where(f"100 * least(n, m) >= {int(percent)} * greatest(n, m)").selectExpr("lead a", "doc_id b").distinct()
    pairs = written(pairs, "pairs")  # dealt anew by the next join, which can then split a leader's pairs
    ids = star.select("doc_id").unionAll(star.selectExpr("lead doc_id")).distinct()
    sets = written(_sets(docs, ids, k).dropDuplicates(["doc_id", "set_a"]), "sets")
    found = components(written(_confirmed(pairs, sets, percent).unionAll(same_id), "linked"))

    signs = reps.select("doc_id", "set_a", "bands")
    more = written(_family_links(components(star, "lead", "doc_id"), found, signs, sets, percent, block), "more")
    if not more.isEmpty():
        found = components(found.selectExpr("node a", "component b").unionAll(more))

    member = member.withColumn("node", F.coalesce("rep", "doc_id")).join(found, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node"))
    return member.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def kept_documents(docs: DataFrame, percent: int = 80, **options) -> DataFrame:
    """The documents that stay, whole rows: of every group the one with the smallest id.
    Rows that repeat an id stay or go together; rows with a null id stay."""
    keep = near_duplicates(docs, percent, **options).where("kept").select("doc_id").distinct()
    return docs.join(keep, "doc_id", "left_semi").unionByName(docs.where("doc_id is null"))
