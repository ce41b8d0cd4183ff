"""Language of a text by cross-parsing entropy.

For each language a suffix automaton of its reference text knows every
substring of that text.  A document is parsed greedily into the longest phrases
that occur there; few, long phrases mean that the document is like the
reference.  The phrase count times the bits to point into the reference, per
character, is the cross-parsing entropy; the language with the least wins, the
smaller name on ties.

The automata are small arrays: ``[state, character class] -> next state`` with
one bit for "a phrase ended here", so a task steps through thousands of blocks
of text at once.  A phrase ends at the end of a block of ``BLOCK`` characters.

The model is fitted on a bounded sample: ``sample_rows`` excerpts of
``excerpt_chars`` characters of different texts per language, chosen by the
texts' hashes, ``total_chars`` for all languages together.  Prediction reads
every whole text.

Defined results: ``und`` with score 0 where the text is null or has no letter,
or where nothing could be learned; equal texts get equal results; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stakeperf.llm.common import chunks, empty, per_task, per_worker

BLOCK = 1024
#: Character classes: the blank, the commonest letters one by one, the others by code point.
CLASSES, OWN = 64, 47
PREDICTED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


def reference_texts(labelled: DataFrame, sample_rows: int = 48, excerpt_chars: int = 512, total_chars: int = 131_072) -> dict[str, str]:
    """Reference text per language from rows (text, lang) with both present."""
    rows = labelled.where("lang is not null and length(text) > 0").select("lang", "text", F.xxhash64("text").alias("h"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()}
    if not counts:
        return {}
    # keep about eight times the wanted rows by hash, then the first different texts in hash order
    share = {lang: min(1.0, 8.0 * sample_rows / n) for lang, n in counts.items()}
    rate = F.create_map(*[x for lang, s in sorted(share.items()) for x in (F.lit(lang), F.lit(s))])
    draw = F.pmod("h", F.lit(1 << 30)) / F.lit(float(1 << 30))
    cut = F.expr(f"substring(text, cast(1 + pmod(h, greatest(1, length(text) - {excerpt_chars})) as int), {excerpt_chars})")
    few = rows.where(draw < rate[F.col("lang")]).select("lang", "h", cut.alias("part")).dropDuplicates(["lang", "h"])
    few = few.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("k") <= sample_rows)
    parts: dict[str, list] = {}
    for r in few.orderBy("lang", "k").collect():  # at most sample_rows * excerpt_chars a language
        parts.setdefault(r["lang"], []).append(r["part"])
    limit = total_chars // len(parts) if parts else 0
    return {lang: " ".join(p)[:limit] for lang, p in sorted(parts.items())}


class Alphabet:
    """Classes of characters; class 0 is every character that is no letter."""

    def __init__(self, texts: list[str]):
        points = np.arange(0x110000)
        letter = np.fromiter((chr(c).isalpha() for c in points), bool, len(points))
        self.table = np.where(letter, 1 + OWN + points % (CLASSES - OWN - 1), 0).astype(np.uint8)
        common = Counter(c for t in texts for c in t.lower() if c.isalpha())
        for k, (c, _) in enumerate(sorted(common.items(), key=lambda x: (-x[1], x[0]))[:OWN]):
            self.table[ord(c)] = 1 + k

    def __call__(self, text: str) -> np.ndarray:
        """Classes of the lower-cased text; a run of other characters counts as one blank."""
        code = self.table[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
        keep = np.ones(len(code), bool)
        keep[1:] = (code[1:] > 0) | (code[:-1] > 0)
        return code[keep]


def suffix_automaton(code: np.ndarray) -> list[dict[int, int]]:
    """Transitions of the states of the smallest automaton of all substrings; state 0 is the start."""
    step: list[dict[int, int]] = [{}]
    link, longest, last = [-1], [0], 0
    for c in code.tolist():
        new = len(step)
        step.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if longest[q] == longest[p] + 1:
                link[new] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                longest.append(longest[p] + 1)
                link.append(link[q])
                link[q] = link[new] = twin
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
        last = new
    return step


class CrossParser:
    """Phrase counts of texts against the reference text of each language."""

    def __init__(self, references: dict[str, str]):
        self.languages = list(references)
        self.alphabet = Alphabet(list(references.values()))
        tables, starts, bits, base = [], [], [], 0
        for text in references.values():
            code = self.alphabet(text)
            step = suffix_automaton(code)
            dead = base + len(step)  # a state where no phrase is open
            fresh = np.full(CLASSES, dead * CLASSES * 2 + 1, np.int32)
            for c, s in step[0].items():
                fresh[c] = (base + s) * CLASSES * 2 + 1
            t = np.tile(fresh, (len(step) + 1, 1))
            for s, out in enumerate(step):
                for c, n in out.items():
                    t[s, c] = (base + n) * CLASSES * 2
            tables.append(t)
            starts.append(dead * CLASSES)
            bits.append(np.log2(len(code) + 2))
            base += len(step) + 1
        self.table = np.concatenate(tables).ravel()
        self.starts, self.bits = np.array(starts, np.int32), np.array(bits)

    def phrases(self, codes: list[np.ndarray]) -> np.ndarray:
        """[language, text] phrase counts."""
        owner = np.concatenate([np.full(-(-len(c) // BLOCK), i) for i, c in enumerate(codes)]).astype(np.int64)
        blocks = [c[k:k + BLOCK] for c in codes for k in range(0, len(c), BLOCK)]
        length = np.array([len(b) for b in blocks], np.int64)
        order = np.argsort(-length, kind="stable")
        length, owner = length[order], owner[order]
        lanes = np.zeros((len(blocks), int(length[0])), np.uint8)
        for row, i in enumerate(order.tolist()):
            lanes[row, :len(blocks[i])] = blocks[i]
        lanes = np.ascontiguousarray(lanes.T).astype(np.int32)
        active = np.searchsorted(-length, -np.arange(lanes.shape[0]), "left")
        state = np.repeat(self.starts[:, None], len(blocks), axis=1)
        count = np.zeros(state.shape, np.int32)
        for t, w in enumerate(active.tolist()):
            v = self.table.take(state[:, :w] + lanes[t, :w])
            count[:, :w] += v & 1
            state[:, :w] = v >> 1
        total = np.zeros((len(self.languages), len(codes)))
        for k in range(len(self.languages)):
            total[k] = np.bincount(owner, weights=count[k], minlength=len(codes))
        return total

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        codes = [self.alphabet(t) if t else np.empty(0, np.uint8) for t in texts]
        known = [i for i, c in enumerate(codes) if c.any()]
        names, score = ["und"] * len(texts), np.zeros(len(texts))
        if known and self.languages:
            size = np.array([len(codes[i]) for i in known])
            entropy = self.phrases([codes[i] for i in known]) * self.bits[:, None] / size
            best = entropy.argmin(axis=0)
            share = 1 / entropy
            score[known] = share.max(axis=0) / share.sum(axis=0)
            for i, b in zip(known, best.tolist()):
                names[i] = self.languages[b]
        return names, score


def held_out(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(3)) == 1


def predict(docs: DataFrame, references: dict[str, str]) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of (doc_id, text)."""
    version = hashlib.sha256(repr(references).encode()).hexdigest()

    @per_task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = per_worker(("parser", version), lambda: CrossParser(references) if references else None)
        for batch in batches:
            for part in chunks(batch, limit=2 << 20):
                texts = part.column("text").to_pylist()
                names, score = parser.predict(texts) if parser else (["und"] * len(texts), np.zeros(len(texts)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(names, pa.string()), pa.array(score)], schema=PREDICTED)
        yield empty(PREDICTED)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, **sample) -> DataFrame:
    """Learns from the rows of (doc_id, text, lang) that aren't held out and predicts all."""
    return predict(docs.select("doc_id", "text"), reference_texts(docs.where(~held_out()).select("text", "lang"), **sample))
