"""Token ids of whole texts, piece by piece, for vocabularies that drop white space.

The vocabulary file (a ``tokenizers`` JSON) is a parameter.  Its normaliser and
pre-tokeniser never look across white space, so a text's ids are the ids of its
blank-separated words one after the other.  Words of plain characters are cut
into pre-tokens as arrays; a word with any other character (or an apostrophe
or ``<``) stays whole and takes the library's own path.  Each distinct piece is
encoded once per cache; a batch of texts then becomes array look-ups.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from tokenizers import Tokenizer

from stakeperf.llm.common import Texts
from stakeperf.llm.spans import BLANKS, LOWER, ranges, same_bytes, word_hash, words

#: Words cut as arrays: ASCII but for apostrophe and ``<``, and the letters of U+00C0 to U+00FF.
_LETTER, _DIGIT, _MARK, _ODD = 1, 2, 3, 4
_KIND = np.full(256, _ODD, np.uint8)
_KIND[33:127] = _MARK
_KIND[BLANKS] = 0
_KIND[48:58] = _DIGIT
_KIND[97:123] = _LETTER
_KIND[[ord("'"), ord("<")]] = _ODD


#: What makes a word odd, in its bytes.
ODD = re.compile(rb"['<]|[\x00-\x08\x0e-\x1f\x7f]|[\x80-\xc2\xc4-\xff](?<!\xc3[\x80-\xbf])|\xc3[\x97\xb7]")


def pieces(texts: Texts):
    """(lower-cased bytes, start, length, document) of every piece.

    A piece is a run of letters, one digit or a run of other marks; a word with
    odd characters is one piece in its original bytes."""
    raw, n = texts.data, texts.size
    data = LOWER[raw]
    lead = np.flatnonzero(raw[:n] == 0xC3)
    tail = raw[lead + 1]
    data[lead + 1] += (((tail >= 0x80) & (tail <= 0x9E) & (tail != 0x97)) * 0x20).astype(np.uint8)
    kind = _KIND[data[:n]]
    good = lead[(tail != 0x97) & (tail != 0xB7)]
    kind[good] = _LETTER
    kind[good + 1] = _LETTER
    start, length, _ = words(raw, texts.offsets)
    odd = np.zeros(n + 1, np.int8)
    if len(start):
        bad = np.logical_or.reduceat(kind == _ODD, start)  # blanks after a word aren't odd
        odd[start[bad]] = 1
        odd[start[bad] + length[bad]] -= 1
    whole = np.cumsum(odd[:n], dtype=np.int8).astype(bool)
    data[:n][whole] = raw[:n][whole]
    kind[whole & (kind > 0)] = _ODD
    edge = np.zeros(n + 1, bool)
    edge[texts.offsets[:-1]] = True
    edge[1:n] |= (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    edge[n] = True
    at = np.flatnonzero(edge)
    keep = kind[at[:-1]] > 0
    begin = at[:-1][keep]
    return data, begin, np.diff(at)[keep], np.searchsorted(texts.offsets, begin, "right") - 1


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in shown}
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + len(table) - len(shown))
    return table


#: For bytes read as Latin-1.
AS_TEXT = str.maketrans({chr(b): c for b, c in byte_alphabet().items()})


def load(path: str) -> Tokenizer:
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


class Splitter:
    """The pre-tokens of a piece, each in the byte alphabet, or the id of a special token."""

    def __init__(self, tokenizer: Tokenizer):
        self.tokenizer = tokenizer
        self.special = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def __call__(self, piece: bytes, odd: bool) -> list[str | int]:
        if not odd:
            return [piece.decode("latin-1").translate(AS_TEXT)]
        text = piece.decode()
        parts = self.cut.split(text) if self.cut is not None else [text]
        return [x for p in parts if p for x in ([self.special[p]] if p in self.special else self.library(p))]

    def library(self, text: str) -> list[str]:
        normal = self.tokenizer.normalizer.normalize_str(text)
        return [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]


class LibraryPieces:
    """Ids of pieces by the library's own merges."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.split = Splitter(self.tokenizer)

    def __call__(self, batch: list[bytes], odd: list[bool]) -> list[list[int]]:
        merge, out = self.tokenizer.model.tokenize, []
        for piece, is_odd in zip(batch, odd):
            ids: list[int] = []
            for p in self.split(piece, is_odd):
                ids += [p] if isinstance(p, int) else [t.id for t in merge(p)]
            out.append(ids)
        return out


class PieceTable:
    """Ids of all pieces of a batch, with a bounded cache.  Pieces are found by hash
    and compared by their bytes; where two pieces share a hash, the table starts
    anew with another seed."""

    def __init__(self, encode: Callable[[list[bytes], list[bool]], list[list[int]]], limit: int = 1 << 18):
        self.encode, self.limit, self.seed = encode, limit, 0
        self._clear()

    def _clear(self) -> None:
        self.keys = np.empty(0, np.uint64)
        self.at = np.empty(0, np.int64)
        self.count = np.empty(0, np.int64)
        self.pool = np.empty(0, np.uint32)
        self.begin = np.empty(0, np.int64)  # of a key's piece in ``bytes``
        self.length = np.empty(0, np.int64)
        self.bytes = np.zeros(8, np.uint8)

    def __call__(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, n + 1 offsets of each text's ids)."""
        data, start, length, doc = pieces(texts)
        if not len(start):
            return np.empty(0, np.uint32), np.zeros(texts.n + 1, np.int64)
        while True:
            distinct, first, which = np.unique(word_hash(data, start, length, self.seed), return_index=True, return_inverse=True)
            row = self._rows(distinct, first, data, start, length)[which]
            if (self.length[row] == length).all() and same_bytes(data, start, self.bytes, self.begin[row], length).all():
                break
            self.seed += 1
            self._clear()
        count = self.count[row]
        ids = self.pool[ranges(self.at[row], count)]
        before = np.concatenate([np.zeros(1, np.int64), np.cumsum(count)])
        edges = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.bincount(doc, minlength=texts.n))])
        return ids, before[edges]

    def _rows(self, distinct, first, data, start, length) -> np.ndarray:
        if len(self.keys) + len(distinct) > self.limit or len(self.pool) > 8 * self.limit or len(self.bytes) > 32 * self.limit:
            self._clear()
        at = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == distinct[inside]
        new = np.flatnonzero(~known)
        if len(new):
            spans = first[new]
            batch = [data[s:s + n].tobytes() for s, n in zip(start[spans].tolist(), length[spans].tolist())]
            ids = self.encode(batch, [ODD.search(p) is not None for p in batch])
            count = np.array([len(x) for x in ids], np.int64)
            flat = np.array([i for x in ids for i in x], np.uint32)
            keys = np.concatenate([self.keys, distinct[new]])
            order = np.argsort(keys, kind="stable")
            self.at = np.concatenate([self.at, len(self.pool) + np.cumsum(count) - count])[order]
            self.count = np.concatenate([self.count, count])[order]
            size = length[spans]
            self.begin = np.concatenate([self.begin, len(self.bytes) - 8 + np.cumsum(size) - size])[order]
            self.length = np.concatenate([self.length, size])[order]
            self.bytes = np.concatenate([self.bytes[:-8], np.frombuffer(b"".join(batch), np.uint8), np.zeros(8, np.uint8)])
            self.pool = np.concatenate([self.pool, flat])
            self.keys = keys[order]
            at = np.searchsorted(self.keys, distinct)
        return at
