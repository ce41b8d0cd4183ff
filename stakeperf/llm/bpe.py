"""BPE encoding and decoding with forced-boundary splitting.

A pair of neighbouring bytes that occurs inside no vocabulary token can never
end up inside one token, whatever the merges do: merging only ever builds
vocabulary tokens.  Every such pair is a certain cut.  A pre-token is cut there,
its fragments are encoded independently of each other (so a fragment seen in
many words is encoded once), and their ids are concatenated.  Only a pre-token's
last fragment carries the end-of-word suffix.

Defined results: null text counts as empty; empty text has no ids and decodes
to the empty string; special tokens written out in a text become their ids, as
the library does; equal texts give equal rows; columns of the input other than
``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import models

from stakeperf.llm.common import Texts, chunks, empty, per_task, per_worker
from stakeperf.llm.tokens import PieceTable, Splitter, load

SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
CODES = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64())), ("decoded", pa.string())])


class ForcedBoundaries:
    """Encodes pieces by fragments; ``merges`` and vocabulary come from the file at ``path``."""

    def __init__(self, path: str, limit: int = 200_000):
        self.tokenizer = load(path)
        self.split = Splitter(self.tokenizer)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.last = models.BPE(vocab=model["vocab"], merges=merges, end_of_word_suffix=model["end_of_word_suffix"])
        self.inner = models.BPE(vocab=model["vocab"], merges=merges)
        inside = {t[i:i + 2] for t in map(self._bare, model["vocab"]) for i in range(len(t) - 1)}
        after: dict[str, list[str]] = {}
        for a, b in inside:
            after.setdefault(a, []).append(b)
        # a fragment: characters each followed by one that may share a token with it
        chars = sorted({c for t in model["vocab"] for c in self._bare(t)})
        step = "|".join(f"{re.escape(a)}(?=[{''.join(map(re.escape, sorted(after[a])))}])" for a in chars if a in after)
        self.fragment = re.compile(f"(?:{step})*.", re.DOTALL)
        self.seen: tuple[dict, dict] = ({}, {})
        self.limit = limit

    def _bare(self, token: str) -> str:
        return token.removesuffix(self.suffix) if self.suffix else token

    def fragments(self, piece: str) -> list[str]:
        return self.fragment.findall(piece)

    def piece(self, piece: str) -> list[int]:
        parts = self.fragments(piece)
        out: list[int] = []
        for k, part in enumerate(parts):
            end = k == len(parts) - 1
            seen = self.seen[end]
            got = seen.get(part)
            if got is None:
                got = [t.id for t in (self.last if end else self.inner).tokenize(part)]
                if len(seen) > self.limit:
                    seen.clear()
                if len(part) <= 64:
                    seen[part] = got
            out += got
        return out

    def __call__(self, batch: list[bytes], odd: list[bool]) -> list[list[int]]:
        return [[i for p in self.split(piece, is_odd) for i in ([p] if isinstance(p, int) else self.piece(p))]
                for piece, is_odd in zip(batch, odd)]


class Decoder:
    """Token strings by id.  The vocabulary file names no decoder, so tokens join by one space."""

    def __init__(self, path: str):
        t = load(path)
        self.strings = [(t.id_to_token(i) or "").encode() for i in range(t.get_vocab_size(with_added_tokens=True))]

    def __call__(self, ids: np.ndarray) -> bytes:
        return b" ".join(map(self.strings.__getitem__, ids.tolist()))


def _coded(batches, path):
    table = per_worker(("forced", path), lambda: PieceTable(ForcedBoundaries(path)))
    decode = per_worker(("decoder", path), lambda: Decoder(path))
    for batch in batches:
        for part in chunks(batch):
            texts = Texts(part.column("text"))
            ids, edge = table(texts)
            yield part.column("doc_id"), [ids[a:b] for a, b in zip(edge, edge[1:])], decode


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded) of every whole text."""
    @per_task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, ids, decode in _coded(batches, path):
            yield pa.RecordBatch.from_arrays([doc, pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64())), pa.array([decode(x).decode() for x in ids], pa.string())], schema=CODES)
        yield empty(CODES)
    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id bigint, ids array<bigint>, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Count and digests of the ids and of the decoded text of every whole text."""
    @per_task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, ids, decode in _coded(batches, path):
            yield pa.RecordBatch.from_arrays([
                doc, pa.array([len(x) for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(decode(x)).hexdigest() for x in ids], pa.string())], schema=SCHEMA)
        yield empty(SCHEMA)
    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
