"""Toxicity by a chain of linear classifiers.

The categories form a chain.  Each has a logistic model over the text's
features and the probabilities of all earlier categories.  While training, an
earlier category's probabilities come from models that did not see the row
(out of fold), so later models learn from probabilities as they will be for
new texts; a model on all training rows serves prediction.

Features are five-byte sequences inside letter words with one blank at either
end, present or absent; the letters A-Z are lower-cased.  Of those in at least
``min_documents`` training texts, each category keeps the ``n_features`` with
the highest chi-square statistic.

Training uses about ``train_rows`` labelled ids, chosen by their hashes; of the
texts of one id the least one trains.  So the models of a category, one without
each fold and one on all rows, are fitted side by side, each in a task that holds
the selected features of at most these rows.  Prediction reads every whole text.

Defined results: null or empty text, or one without words, has no features and
gets the chain's intercepts; a category with a single class in training is
constant; without labelled rows all probabilities are 0; where all rows are of one
fold, their probability for later categories is 0.5; rows of ``labels``
with a null id or label are ignored, and of repeated ids the largest label
counts; an empty table gives no rows; other columns are carried along by
``accepted`` and ignored elsewhere.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stakeperf.llm.common import Texts, chunks, empty, per_task, sorted_groups, written
from stakeperf.llm.spans import LOWER, NON_LETTERS, U, ranges, words

#: The labelled columns as categories, in the chain's order.
CATEGORIES = {"low_quality": "1 - quality", "toxic": "toxic"}
GRAM = 5
TRAIN_ROWS, FEATURES, MIN_DOCUMENTS, FOLDS = 12_000, 600, 5, 3
#: Half of it times the squared weights is added to the mean loss; the intercept is free.
PENALTY = 3e-4
#: The fold that no row has: its model learns from all rows.
NO_FOLD = -1


def grams(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(five bytes as a number, text) of every sequence inside a padded word."""
    start, length, doc = words(t.data, t.offsets, NON_LETTERS)
    if not len(start):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    line = LOWER[t.data[ranges(start, length + 1)]]
    line[np.cumsum(length + 1) - 1] = 0x20
    line = np.concatenate([[0x20], line, np.zeros(8)]).astype(np.uint8)  # a blank before each word and after the last
    n = len(line) - 8 - GRAM + 1
    blank = line == 0x20
    inner = ~(blank[1:n + 1] | blank[2:n + 2] | blank[3:n + 3])
    at = np.flatnonzero(inner)
    value = np.ndarray((n,), "<u8", line.data, strides=(1,))[at] & U((1 << 8 * GRAM) - 1)
    return value, doc[np.searchsorted(np.cumsum(length + 1), at, "right")]


def _distinct(value: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs without repeats, by document; a gram has 40 bits, so both fit one number."""
    both = np.unique(doc.astype(np.uint64) << U(8 * GRAM) | value)
    return both & U((1 << 8 * GRAM) - 1), (both >> U(8 * GRAM)).astype(np.int64)


class Lookup:
    """Finds selected grams among many: a small bit table passes few others, a search settles."""

    def __init__(self, selected: np.ndarray):
        self.keys = np.sort(selected.astype(np.uint64))
        self.table = np.zeros(1 << 18, bool)
        self.table[self._slot(self.keys)] = True

    @staticmethod
    def _slot(x: np.ndarray) -> np.ndarray:
        return ((x * U(0x9E3779B97F4A7C15)) >> U(46)).astype(np.int64)

    def __call__(self, t: Texts) -> tuple[np.ndarray, np.ndarray]:
        """(position in keys, text), without repeats, of the selected grams that occur."""
        value, doc = grams(t)
        near = self.table[self._slot(value)]
        value, doc = _distinct(value[near], doc[near])
        at = np.searchsorted(self.keys, value)
        hit = at < len(self.keys)
        hit[hit] = self.keys[at[hit]] == value[hit]
        return at[hit], doc[hit]


@dataclass
class Chain:
    """Weights over the sorted grams, then over earlier probabilities, and the intercept, by category."""

    categories: list[str]
    keys: np.ndarray
    weights: list[np.ndarray]
    earlier: list[np.ndarray]
    intercepts: list[float]

    def probabilities(self, t: Texts, lookup: Lookup) -> np.ndarray:
        at, doc = lookup(t)
        p = np.zeros((len(self.categories), t.n))
        for c in range(len(self.categories)):
            z = np.bincount(doc, weights=self.weights[c][at], minlength=t.n) + self.intercepts[c]
            z += self.earlier[c] @ p[:c]
            p[c] = logistic(z)
        return p


def sample(docs: DataFrame, labels: DataFrame, categories: dict[str, str], train_rows: int) -> DataFrame:
    """(doc_id, text, one 0/1 column per category, fold) of about ``train_rows`` labelled documents."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), *(F.expr(e).cast("double").alias(c) for c, e in categories.items()))
    known = known.na.drop().groupBy("doc_id").agg(*(F.max(c).alias(c) for c in categories))
    n = labels.count()
    draw = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    few = known.where(draw < F.lit(min(1.0, train_rows / max(1, n))))
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).alias("fold")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(few, "doc_id")
    return texts.groupBy("doc_id", *categories).agg(F.min("text").alias("text")).withColumn("fold", fold)


def _document_counts(rows: DataFrame, names: list[str]) -> DataFrame:
    """(gram, n, positives of each category): documents that hold the gram."""
    schema = pa.schema([("gram", pa.int64()), ("n", pa.int64()), *((c, pa.int64()) for c in names)])

    @per_task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                value, doc = _distinct(*grams(Texts(part.column("text"))))
                key, which = np.unique(value, return_inverse=True)
                sums = [np.bincount(which, minlength=len(key))]
                sums += [np.bincount(which, weights=part.column(c).to_numpy()[doc], minlength=len(key)).astype(np.int64) for c in names]
                yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), *(pa.array(s.astype(np.int64)) for s in sums)], schema=schema)
        yield empty(schema)

    counts = rows.select("text", *names).mapInArrow(run, ", ".join(f"{f.name} bigint" for f in schema))
    return counts.groupBy("gram").agg(*(F.sum(c).alias(c) for c in ("n", *names)))


def select_features(rows: DataFrame, names: list[str], n_features: int, min_documents: int) -> np.ndarray:
    total = rows.agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(c) for c in names)).first()
    counts = written(_document_counts(rows, names).where(F.col("n") >= min_documents), "gram-counts")
    chosen: set[int] = set()
    for c in names:
        n, pos = float(total["n"]), float(total[c] or 0)
        if 0 < pos < n:
            apart = F.col(c) * n - F.col("n") * pos
            chi2 = apart * apart / (F.col("n") * (n + 0.5 - F.col("n")) * pos * (n - pos))
            chosen |= {r["gram"] for r in counts.orderBy(chi2.desc(), "gram").limit(n_features).select("gram").collect()}
    return np.sort(np.array(sorted(chosen), np.uint64))


def _with_features(rows: DataFrame, names: list[str], keys: np.ndarray) -> DataFrame:
    """The rows with the positions in ``keys`` of the features that they have."""
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.float64()) for c in names), ("fold", pa.int64()), ("present", pa.list_(pa.int32()))])

    @per_task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(keys)
        for batch in batches:
            for part in chunks(batch):
                at, doc = lookup(Texts(part.column("text")))
                edge = np.searchsorted(doc, np.arange(part.num_rows + 1))
                present = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(at, pa.int32()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", *names, "fold")), present], schema=schema)
        yield empty(schema)

    return rows.select("doc_id", "text", *names, "fold").mapInArrow(run, "doc_id bigint, " + ", ".join(f"{c} double" for c in names) + ", fold bigint, present array<int>")


@dataclass
class Rows:
    """Features of some rows: (row, position) of those present, and dense columns."""

    row: np.ndarray
    at: np.ndarray
    dense: np.ndarray

    @classmethod
    def of(cls, t: pa.RecordBatch | pa.Table, earlier: list[str]) -> Rows:
        present = t.column("present")
        present = present.combine_chunks() if isinstance(present, pa.ChunkedArray) else present
        row = np.repeat(np.arange(t.num_rows), np.diff(present.offsets.to_numpy()))
        dense = [t.column(c).to_numpy() for c in earlier]
        return cls(row, present.flatten().to_numpy(), np.stack(dense, axis=1) if dense else np.zeros((t.num_rows, 0)))

    def logits(self, w: np.ndarray, model: np.ndarray | int = 0) -> np.ndarray:
        """By the weights ``w[model]`` of each row: features, dense columns, intercept."""
        n, k = self.dense.shape
        model = np.broadcast_to(model, n)
        sparse = np.bincount(self.row, weights=w[model[self.row], self.at], minlength=n)
        return sparse + (self.dense * w[model, w.shape[1] - 1 - k:-1]).sum(axis=1) + w[model, -1]

    def gradient(self, slope: np.ndarray, n_features: int) -> np.ndarray:
        return np.concatenate([np.bincount(self.at, weights=slope[self.row], minlength=n_features), slope @ self.dense, [slope.sum()]])


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def descend(x: Rows, y: np.ndarray, n_features: int, penalty: float = PENALTY, steps: int = 400, memory: int = 12, tolerance: float = 1e-7) -> np.ndarray:
    """The weights of least penalised mean loss, by limited-memory BFGS; constant where ``y`` is."""
    w = np.zeros(n_features + x.dense.shape[1] + 1)
    if y.min() == y.max():
        w[-1] = 700.0 if y[0] else -700.0
        return w
    w[-1] = np.log(y.mean() / (1 - y.mean()))

    def loss(w):
        z = x.logits(w[None])
        g = x.gradient((logistic(z) - y) / len(y), n_features)
        g[:-1] += penalty * w[:-1]
        return (np.logaddexp(0, z) - y * z).mean() + penalty / 2 * (w[:-1] @ w[:-1]), g

    value, g = loss(w)
    moves: deque = deque(maxlen=memory)
    for _ in range(steps):
        if np.abs(g).max() <= tolerance:
            break
        q, taken = g.copy(), []
        for s, t in reversed(moves):
            taken.append(s @ q / (s @ t))
            q -= taken[-1] * t
        if moves:
            s, t = moves[-1]
            q *= (s @ t) / (t @ t)
        for (s, t), c in zip(moves, reversed(taken)):
            q += s * (c - t @ q / (s @ t))
        size, fall = 1.0, g @ q
        after, slope = loss(w - size * q)
        while after > value - 1e-4 * size * fall and size > 1e-9:
            size /= 2
            after, slope = loss(w - size * q)
        if after >= value:
            break  # as low as doubles can tell
        if size * (q @ (g - slope)) > 0:
            moves.append((-size * q, slope - g))
        w, value, g = w - size * q, after, slope
    return w


def _fitted(data: DataFrame, category: str, earlier: list[str], folds: list[int], n_features: int) -> dict[int, np.ndarray]:
    """The weights of the models that leave out one of ``folds`` each, fitted in parallel."""
    schema = pa.schema([("without", pa.int64()), ("weights", pa.list_(pa.float64()))])

    @per_task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sorted_groups(batches, ["without"]):
            w = descend(Rows.of(t, earlier), t.column(category).to_numpy(), n_features)
            yield pa.RecordBatch.from_arrays([t.column("without").combine_chunks()[:1], pa.array([w], schema.field("weights").type)], schema=schema)
        yield empty(schema)

    dealt = data.withColumn("without", F.explode(F.array(*(F.lit(f).cast("bigint") for f in folds)))).where("without <> fold")
    dealt = dealt.select("without", "doc_id", category, *earlier, "present").repartition(4 * len(folds), "without").sortWithinPartitions("without", "doc_id")
    found = dealt.mapInArrow(run, "without bigint, weights array<double>").collect()  # a row per fold and one more
    return {r["without"]: np.array(r["weights"]) for r in found}


def _out_of_fold(data: DataFrame, earlier: list[str], models: dict[int, np.ndarray], name: str, width: int) -> DataFrame:
    """The rows with the probability that the model without their fold gives them."""
    w = np.stack([models.get(f, np.zeros(width)) for f in range(FOLDS)])

    @per_task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = logistic(Rows.of(batch, earlier).logits(w, batch.column("fold").to_numpy()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], names=[*batch.schema.names, name])

    return data.mapInArrow(run, data.withColumn(name, F.lit(0.0)).schema)


def train(rows: DataFrame, names: list[str], n_features: int = FEATURES, min_documents: int = MIN_DOCUMENTS) -> Chain:
    rows = written(rows, "labelled")
    keys = select_features(rows, names, n_features, min_documents)
    chain = Chain(names, keys, [], [], [])
    if not len(keys):
        mean = rows.agg(*(F.avg(c).alias(c) for c in names)).first()
        for k, c in enumerate(names):
            p = min(max(mean[c] or 0.0, 1e-12), 1 - 1e-12)
            chain.weights.append(np.zeros(0))
            chain.earlier.append(np.zeros(k))
            chain.intercepts.append(float(np.log(p / (1 - p))) if mean[c] else -700.0)
        return chain
    data = written(_with_features(rows, names, keys), "features")
    earlier: list[str] = []
    for c in names:
        last = c == names[-1]
        models = _fitted(data, c, earlier, [NO_FOLD] if last else [NO_FOLD, *range(FOLDS)], len(keys))
        w = models[NO_FOLD]
        chain.weights.append(w[:len(keys)])
        chain.earlier.append(w[len(keys):-1])
        chain.intercepts.append(float(w[-1]))
        if not last:
            data = written(_out_of_fold(data, earlier, models, f"p_{c}", len(w)), "features")
            earlier.append(f"p_{c}")
    return chain


def _predicted(docs: DataFrame, chain: Chain, schema: pa.Schema, spark_schema, row) -> DataFrame:
    @per_task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(chain.keys)
        for batch in batches:
            for part in chunks(batch):
                yield row(part, chain.probabilities(Texts(part.column("text")), lookup))
        if schema is not None:
            yield empty(schema)
    return docs.mapInArrow(run, spark_schema)


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, str] | None = None, train_rows: int = TRAIN_ROWS, **options) -> Chain:
    categories = categories or CATEGORIES
    return train(sample(docs, labels, categories, train_rows), list(categories), **options)


def score(docs: DataFrame, chain: Chain, threshold: float = 0.5) -> DataFrame:
    """(doc_id, p_<category> ..., rejected) of every row; the last category decides."""
    names = [f"p_{c}" for c in chain.categories]
    schema = pa.schema([("doc_id", pa.int64()), *((n, pa.float64()) for n in names), ("rejected", pa.bool_())])

    def row(part, p):
        return pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, p), pa.array(p[-1] >= threshold)], schema=schema)

    return _predicted(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), chain, schema, "doc_id bigint, " + ", ".join(f"{n} double" for n in names) + ", rejected boolean", row)


def accepted(docs: DataFrame, chain: Chain, threshold: float = 0.5) -> DataFrame:
    """The rows whose last category stays under the threshold."""
    names = docs.columns

    def row(part, p):
        return pa.RecordBatch.from_arrays([part.column(n) for n in names], names=names).filter(pa.array(p[-1] < threshold))

    return _predicted(docs, chain, None, docs.schema, row)
