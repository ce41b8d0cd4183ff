"""Runs of repeated words: every run by brute force, digests, edges."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from stakeperf.llm import periodic
from stakeperf.llm.queries import QUERIES, looped_places
from tests.llm.conftest import rows_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def all_runs(w):
    """(start, length, period) of every run, by scanning every period."""
    found = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i > s and i + q - s >= max(6, 4 * q) and not any(a <= s and i + q <= a + n for a, n, _ in found):
                found.append((s, i + q - s, q))
            i += i == s
    return sorted(found, key=lambda r: (r[0], r[2]))


def looped(i, w):
    """The words after the loop that the contract describes, word by word."""
    h = zlib.crc32(str(i).encode())
    g, n = h // 10, len(w)
    if i is None or h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]


def digest(i, w):
    r = all_runs(w)
    drop = {k for s, n, q in r for k in range(s + q, s + n)}
    best = min(r, key=lambda x: (-x[1], x[0], x[2]), default=None)
    top = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in r)
    kept = " ".join(x for k, x in enumerate(w) if k not in drop)
    return (i, len(r), *top, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def repetitive(rnd):
    w = []
    for _ in range(rnd.randrange(1, 6)):
        u = [rnd.choice("aé日bc"[:rnd.randrange(1, 6)]) * rnd.choice([1, 1, 9]) for _ in range(rnd.randrange(1, 9))]
        w += (u * rnd.randrange(1, 9))[:rnd.randrange(1, 60)] + [rnd.choice("abc") for _ in range(rnd.randrange(4))]
    return w


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_runs_match_brute_force(seed, monkeypatch):
    rnd = random.Random(seed)
    monkeypatch.setattr(periodic, "CANDIDATES", rnd.choice([3, 1 << 21]))
    for _ in range(150):
        docs = [repetitive(rnd) for _ in range(rnd.randrange(1, 5))]
        names = {x: k for k, x in enumerate(sorted({x for w in docs for x in w}))}
        word = np.array([names[x] for w in docs for x in w])
        doc = np.repeat(np.arange(len(docs)), [len(w) for w in docs])
        want, at = [], 0
        for w in docs:
            want += [[s + at, s + at + n, q] for s, n, q in all_runs(w)]
            at += len(w)
        assert periodic.runs(word, doc).tolist() == want


def test_a_lying_hash_is_put_right(monkeypatch):
    rnd = random.Random(7)
    real = periodic.Sequence.hash
    monkeypatch.setattr(periodic.Sequence, "hash", lambda self, start, length: real(self, start, length) & np.uint64(3))
    for _ in range(60):
        w = repetitive(rnd)
        names = {x: k for k, x in enumerate(sorted(set(w)))}
        got = periodic.runs(np.array([names[x] for x in w]), np.zeros(len(w), np.int64)).tolist()
        for s, e, q in got:
            assert w[s:e - q] == w[s + q:e] and e - s >= max(6, 4 * q)


def test_digests_match_brute_force(documents):
    rnd = random.Random(5)
    rows = [(k, " ".join(repetitive(rnd))) for k in range(60)] + [(k, " ".join(f"v{rnd.randrange(10**9)}" for _ in range(rnd.randrange(90)))) for k in range(60, 120)]
    rows += [(200, None), (201, ""), (202, " \n\t"), (203, "a"), (204, "a " * 20000), (205, "a b " * 9000 + "c"), (None, "x y x y x y x y"), (3, "b b b b b b"), (3, "c c")]
    got = rows_of(periodic.digests(documents(rows), looped_places))
    want = []
    for i, t in rows:
        w = WORD.findall(t or "")
        if len(w) > 5000:  # one run, whatever the loop does to it
            q = len(set(w[:2]))
            n = len(w) - (w[-1] == "c" and looped(i, w)[-1] == "c")
            kept = w[:q] + looped(i, w)[n:]
            want.append((i, 1, 0, n, q, 1000 * n // q, hashlib.sha256(f"0,{n},{q}\n".encode()).hexdigest(), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
        else:
            want.append(digest(i, looped(i, w)))
    assert got == sorted(want, key=repr)
    assert sum(looped(i, WORD.findall(t or "")) != WORD.findall(t or "") for i, t in rows if i is not None) > 3


def test_runs_and_collapsed_texts(documents):
    docs = documents([(1, "go go go go go go now"), (2, None), (3, "p q  p q p\tq p q end"), (4, "once only")])
    assert rows_of(periodic.find(docs)) == [(1, [(0, 6, 1)]), (2, []), (3, [(0, 8, 2)]), (4, [])]
    assert rows_of(periodic.collapsed(docs)) == [(1, "go now"), (2, ""), (3, "p q end"), (4, "once only")]
    for empty in (periodic.find, periodic.collapsed, periodic.digests):
        assert rows_of(empty(documents([]))) == []


def test_query_matches_brute_force(sp, sf_small):
    docs = sp.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((digest(r.doc_id, looped(r.doc_id, WORD.findall(r.text or ""))) for r in docs if len(r.text or "") < 12000), key=repr)
    ids = {r[0] for r in want}
    assert [r for r in rows_of(QUERIES["op12_grammar_runs"](sp, sf_small)) if r[0] in ids] == want
    assert len(want) > 150
