"""Substring removal, near-duplicates, tokens, packing: brute force on small tables."""

import hashlib
import random
import re
import struct
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from stakeperf.llm import bpe, minhash, packing, phrases
from stakeperf.llm.queries import WORD_BPE
from tests.llm.conftest import rows_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(text):
    return WORD.findall(text or "")


# ---- substring removal ------------------------------------------------------

def removal(rows, width):
    first = {}
    for i, t in rows:
        w = words_of(t)
        for p in range(len(w) - width + 1):
            k = tuple(w[p:p + width])
            if i is not None:
                first[k] = min(first.get(k, i), i)
    out = []
    for i, t in rows:
        w = words_of(t)
        gone = [False] * len(w)
        for p in range(len(w) - width + 1):
            if i is not None and first[tuple(w[p:p + width])] < i:
                gone[p:p + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), kept))
    return out


def noisy_texts(seed, n=60, vocabulary=12):
    rnd = random.Random(seed)
    vocab = [rnd.choice(["a", "é", "Bb", "x" * 70, "日本", "w"]) + str(k) for k in range(vocabulary)]
    passages = [[rnd.choice(vocab) for _ in range(rnd.randrange(6, 20))] for _ in range(4)]
    rows = []
    for i in range(n):
        w = [rnd.choice(vocab) for _ in range(rnd.randrange(0, 25))]
        for _ in range(rnd.randrange(3)):
            p = rnd.randrange(len(w) + 1)
            w[p:p] = rnd.choice(passages)
        rows.append((i * 3, rnd.choice([" ", "\n", "\t ", " "]).join(w)))
    rows += [(1000 + k, rows[5][1]) for k in range(8)]  # a group of copies
    return rows + [(2000, None), (2001, ""), (2002, " \n"), (None, rows[5][1]), (15, rows[5][1])]


@pytest.mark.parametrize("seed", [1, 2])
def test_removal_matches_brute_force(documents, seed):
    rows = noisy_texts(seed)
    got = rows_of(phrases.digests(documents(rows), width=6, phrase=3, shard_phrases=5, shard_documents=4))
    want = sorted(((i, n, g, hashlib.sha256(k.encode()).hexdigest()) for i, n, g, k in removal(rows, 6)), key=repr)
    assert got == want


def test_removal_with_production_parameters(documents):
    rnd = random.Random(5)
    passage = [f"w{rnd.randrange(10**6)}" for _ in range(70)]
    fresh = lambda n: [f"v{rnd.randrange(10**9)}" for _ in range(n)]
    rows = [(k, " ".join(fresh(30) + passage + fresh(20))) for k in range(12)]
    rows += [(50, " ".join(passage[:49])), (51, " ".join(passage[10:60])), (52, " ".join(fresh(20000)))]
    got = rows_of(phrases.digests(documents(rows)))
    want = sorted(((i, n, g, hashlib.sha256(k.encode()).hexdigest()) for i, n, g, k in removal(rows, 50)), key=repr)
    assert got == want
    assert [r[2] for r in want if r[0] in (0, 1, 50, 51)] == [0, 70, 0, 50]


def test_deduplicated_carries_columns(documents):
    rows = noisy_texts(3)
    docs = documents(rows)
    got = phrases.deduplicated(docs, width=6, phrase=3)
    assert got.schema == docs.schema
    want = sorted(((i, k if g else t) for (i, _, g, k), (_, t) in zip(removal(rows, 6), rows)), key=repr)
    assert rows_of(got.select("doc_id", "text")) == want


def test_removal_of_nothing(documents):
    assert rows_of(phrases.digests(documents([]))) == []
    assert rows_of(phrases.deduplicated(documents([]))) == []


# ---- near-duplicates --------------------------------------------------------

def shingle_set(text, k=5):
    w = words_of(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[p:p + k]) for p in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def near_groups(rows, percent):
    sets = defaultdict(list)
    for i, t in rows:
        if i is not None and (s := shingle_set(t)):
            sets[i].append(s)
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and any(100 * len(a & b) >= percent * len(a | b) for a in sets[x] for b in sets[y]):
                u, v = find(x), find(y)
                root[max(u, v)] = min(u, v)
    return sorted(((i, len(shingle_set(t)), None if i is None else find(i), i is None or find(i) == i) for i, t in rows), key=repr)


@pytest.mark.parametrize("percent,block", [(85, 2), (80, 256)])
def test_near_duplicates_match_brute_force(documents, percent, block):
    rnd = random.Random(percent)
    rows = []
    for g in range(8):
        base = [f"w{rnd.randrange(400)}" for _ in range(rnd.randrange(3, 150))]
        for _ in range(rnd.randrange(1, 9)):
            w = list(base)
            for _ in range(rnd.randrange(0, 1 + len(w) // 25)):
                w[rnd.randrange(len(w))] = f"n{rnd.randrange(10**6)}"
            rows.append((len(rows), " ".join(w).upper() if rnd.random() < 0.2 else "\n".join(w)))
    rows += [(100 + k, rows[3][1]) for k in range(5)] + [(200, None), (201, ""), (202, "one"), (203, "ONE"), (None, "one"), (3, rows[3][1])]
    assert rows_of(minhash.near_duplicates(documents(rows), percent, block=block)) == near_groups(rows, percent)


def test_chain_of_similar_texts_joins_without_star_links(documents):
    """Neighbours are similar, the ends are not: the group holds together through the middle."""
    w = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(w[k * 6:k * 6 + 200])) for k in range(20)]
    got = {r[0]: r[2] for r in rows_of(minhash.near_duplicates(documents(rows), 85, block=3))}
    assert got == {r[0]: r[2] for r in near_groups(rows, 85)}
    assert set(got.values()) == {0}


def test_superminhash_estimates_similarity():
    rnd = np.random.default_rng(3)
    for n, shared in ((400, 300), (40, 30), (4, 3)):
        x = rnd.integers(0, 2**63, n + (n - shared), dtype=np.int64).astype(np.uint64)
        est = []
        for r in range(20):
            items = np.concatenate([x[:n], x[n - shared:]]) ^ np.uint64(r)
            sig = minhash.superminhash(items, np.array([0, n, len(items)]), 125)
            est.append((sig[0] == sig[1]).mean())
        assert abs(np.mean(est) - shared / (2 * n - shared)) < 0.05
    empty = minhash.superminhash(np.empty(0, np.uint64), np.array([0, 0]), 8)
    assert (empty == np.iinfo(np.uint64).max).all()


def test_near_duplicates_of_nothing(documents):
    assert rows_of(minhash.near_duplicates(documents([]))) == []


def test_kept_documents(documents):
    rows = [(1, "a b c d e f g h"), (2, "a b c d e f g h"), (3, None), (4, ""), (None, "a b c d e f g h")]
    docs = documents(rows)
    got = minhash.kept_documents(docs)
    assert got.schema == docs.schema
    assert rows_of(got.select("doc_id")) == sorted([(1,), (3,), (4,), (None,)], key=repr)


# ---- tokens and packing -----------------------------------------------------

TEXTS = ["", None, " \n\t ", "Hello <|endoftext|>x's a<|startoftext|> it's we'LL", "ŒUVRE ﬁ é̂ İ ß ẞ ½ ² ١٢ 中文 😀👍🏽",
         "z" * 5000, "q1w2e3!!?? ''s 'tis _x_ a\u0085b a b a\x1cb", "à É×÷ÿ Ö-ö <b> & 123.456", "Σίσυφος ΟΔΟΣ ​﻿"]


def random_texts(n=150):
    rnd = random.Random(9)
    return ["".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(0xA0, 0x250), rnd.randrange(1, 0x3000), rnd.randrange(0x1F300, 0x1F700), 32])) for _ in range(rnd.randrange(40))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORD_BPE)


def test_ids_and_decoding_equal_the_library(documents, library):
    rows = list(enumerate(TEXTS + random_texts())) + [(3, TEXTS[3])]
    ids = [(i, library.encode(t or "", add_special_tokens=False).ids) for i, t in rows]
    want = sorted(((i, x, library.decode(x, skip_special_tokens=False)) for i, x in ids), key=repr)
    assert rows_of(bpe.encode(documents(rows), WORD_BPE)) == want
    digest = sorted(((i, len(x), hashlib.sha256(struct.pack(f"<{len(x)}I", *x)).hexdigest(), hashlib.sha256(d.encode()).hexdigest()) for i, x, d in want), key=repr)
    assert rows_of(bpe.digests(documents(rows), WORD_BPE)) == digest
    assert rows_of(bpe.digests(documents([]), WORD_BPE)) == []


def test_forced_boundaries_cut_and_keep_ids(library):
    forced = bpe.ForcedBoundaries(WORD_BPE)
    for word in ("zqxjkvbq", "1ÿz", "éàüñß", "xjzqÃ", "aaaa"):
        piece = word.encode().decode("latin-1").translate(__import__("stakeperf.llm.tokens", fromlist=["AS_TEXT"]).AS_TEXT)
        parts = forced.fragments(piece)
        assert "".join(parts) == piece
        assert forced.piece(piece) == [t.id for t in library.model.tokenize(piece)]
    assert len(forced.fragments("zqxjqzxq")) > 1


def test_packing_places_every_token_once(documents, library):
    rows = list(enumerate(TEXTS + random_texts(60) + ["word " * 5000, "a " * 2047, "a " * 2048])) + [(0, "")]
    docs = documents(rows)
    got = packing.pack(packing.pieces(docs, WORD_BPE), partition_rows=40).toPandas()
    by_doc = defaultdict(int)
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        by_doc[i] += len(ids)
        for r in got[got.doc_id == i].itertuples():
            part = ids[r.start:r.start + r.length]
            if i:
                assert r.start == 2048 * r.piece and zlib.crc32(struct.pack(f"<{len(part)}I", *part)) == r.ids_crc32
    assert got.groupby("doc_id").length.sum().to_dict() == dict(by_doc)
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g.offset == g.length.cumsum() - g.length).all() and g.length.sum() <= 2048
    assert got.sequence_id.nunique() <= 1 + packing.lower_bound(np.bincount(got.length, minlength=2049))
    assert rows_of(packing.pack(packing.pieces(documents([]), WORD_BPE))) == []


def fewest(lengths, capacity):
    """The smallest number of bins, by trying everything."""
    best = len(lengths)

    def go(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(lengths):
            best = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + lengths[k] <= capacity:
                go(k + 1, [*bins[:b], bins[b] + lengths[k], *bins[b + 1:]])
        go(k + 1, [*bins, lengths[k]])

    go(0, [])
    return best


def test_lower_bound_never_exceeds_the_optimum():
    rnd = random.Random(4)
    for _ in range(150):
        capacity = rnd.choice([7, 10, 24])
        lengths = np.array(sorted((rnd.randrange(1, capacity + 1) for _ in range(rnd.randrange(1, 9))), reverse=True))
        place, offset, room = packing.best_fit_decreasing(lengths, capacity)
        assert packing.lower_bound(np.bincount(lengths, minlength=capacity + 1)) <= fewest(lengths.tolist(), capacity) <= len(room)
    assert packing.lower_bound(np.bincount([6, 6, 6], minlength=11)) == 3  # not 18 / 10
    assert packing.lower_bound(np.zeros(11, np.int64)) == 0


# ---- one id on different texts ----------------------------------------------

def test_removal_judges_each_text_of_an_id(documents):
    rnd = random.Random(8)
    fresh = lambda n: [f"v{rnd.randrange(10**9)}" for _ in range(n)]
    p, x, y = fresh(60), fresh(40), fresh(200)
    for rows in ([(1, p), (3, x + p), (3, y)], [(1, p), (3, p), (3, y)], [(3, p), (3, x + p), (4, p + x)]):
        rows = [(i, " ".join(w)) for i, w in rows]
        want = sorted(((i, n, g, hashlib.sha256(k.encode()).hexdigest()) for i, n, g, k in removal(rows, 50)), key=repr)
        assert rows_of(phrases.digests(documents(rows))) == want
    assert rows_of(phrases.deduplicated(documents([(1, " ".join(p)), (3, " ".join(p)), (3, " ".join(y))])).select("doc_id", "text")) == sorted([(1, " ".join(p)), (3, ""), (3, " ".join(y))], key=repr)


def test_near_duplicates_link_each_text_of_an_id(documents):
    rnd = random.Random(8)
    base = {k: [f"{k}{rnd.randrange(10**9)}" for _ in range(100)] for k in "ABC"}
    text = lambda k, changed=0: " ".join(base[k][:100 - changed] + [f"z{rnd.randrange(10**9)}" for _ in range(changed)])
    for rows in ([(3, text("A")), (3, text("B")), (4, text("A", 2)), (5, text("B", 2))],
                 [(3, text("A")), (7, text("A")), (7, text("C")), (9, text("C", 1)), (9, None), (11, text("B"))]):
        assert rows_of(minhash.near_duplicates(documents(rows))) == near_groups(rows, 85)


def test_near_duplicates_of_very_long_texts(documents):
    rnd = random.Random(1)
    w = [f"w{rnd.randrange(10**9)}" for _ in range(60000)]
    rows = [(1, " ".join(w)), (2, " ".join(w[:-900])), (3, "short text only"), (4, " ".join(w[30000:]))]
    assert rows_of(minhash.near_duplicates(documents(rows))) == near_groups(rows, 85)


# ---- words whose bytes and length once cancelled out ------------------------

#: Pairs of words that an earlier, linear hash mixed up.
CLASHES = [("aéByé", "LG_ÿIrb"), ("<éByé", "'G_ÿIrb"), ("<ݰ[y۠", "'afܿaib")]


def test_word_hashes_differ():
    from stakeperf.llm.spans import word_hash, word_ids

    flat = [w.encode() for pair in CLASHES for w in pair] + [b"a", b"a\0", b"a" * 9, b"a" * 70, b"a" * 71]
    data = np.frombuffer(b" ".join(flat) + bytes(8), np.uint8)
    length = np.array([len(w) for w in flat])
    start = np.cumsum(length + 1) - length - 1
    for seed in (0, 1):
        assert len(set(word_hash(data, start, length, seed).tolist())) == len(flat)
    number, first = word_ids(data, np.concatenate([start, start]), np.concatenate([length, length]))
    assert (number[:len(flat)] == number[len(flat):]).all() and len(first) == len(flat)


def test_results_keep_such_words_apart(documents, library):
    rnd = random.Random(2)
    words_ = [f"w{rnd.randrange(10**6)}" for _ in range(59)]
    rows = []
    for k, (x, y) in enumerate(CLASHES):
        at = 20 + k
        rows += [(10 * k, " ".join([*words_[:at], x, *words_[at:]])), (10 * k + 1, " ".join([*words_[:at], y, *words_[at:]]))]
    got = rows_of(phrases.digests(documents(rows[:2])))
    assert [r[2] for r in got] == [r[2] for r in removal(rows[:2], 50)] == [0, 0]
    assert rows_of(minhash.near_duplicates(documents([(1, CLASHES[2][0]), (2, CLASHES[2][1])]))) == near_groups([(1, CLASHES[2][0]), (2, CLASHES[2][1])], 85)
    ids = {i: x for i, x, _ in bpe.encode(documents(list(enumerate(w for pair in CLASHES for w in pair)), 1), WORD_BPE).collect()}
    for i, w in enumerate(w for pair in CLASHES for w in pair):
        assert ids[i] == library.encode(w, add_special_tokens=False).ids


def test_piece_table_survives_a_collision(library, monkeypatch):
    import pyarrow as pa

    from stakeperf.llm import tokens
    from stakeperf.llm.common import Texts

    real = tokens.word_hash
    monkeypatch.setattr(tokens, "word_hash", lambda data, start, length, seed=0: real(data, start, length, seed) % np.uint64(7) if seed < 2 else real(data, start, length, seed))
    table = tokens.PieceTable(tokens.LibraryPieces(WORD_BPE))
    for _ in range(2):
        ids, edge = table(Texts(pa.array(["some plain words here", "other words", None])))
        assert ids.tolist() == library.encode("some plain words here other words", add_special_tokens=False).ids
    assert table.seed == 2


def test_arrow_batches_of_texts_are_small(sp):
    """A task's batch of whole texts is held twice outside the heap, so it has few bytes."""
    rows = sp.range(0, 12_000, 1, 1).selectExpr("id", "repeat('x', 2000) text")
    sizes = rows.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["b"]) for b in batches), "b bigint").collect()
    assert sum(r.b for r in sizes) > 24_000_000
    assert max(r.b for r in sizes) < 9_000_000


def test_removal_works_on_few_texts_at_a_time():
    """Arrays of a word's numbers are many times the text: they are made of a part of a batch."""
    text = " ".join(f"w{i}" for i in range(2000))
    n = (16 << 20) // len(text)
    batch = pa.record_batch({"text": pa.array([text] * n), "whole": pa.array([False] * n), "starts": pa.array([[5]] * n, pa.list_(pa.int64()))})
    tracemalloc.start()
    try:
        removed = sum(int(r.sum()) for _, _, r, _ in phrases._apply(batch, 50, ("whole", "starts")))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert removed == 50 * n
    assert peak < 40_000_000


def test_windows_are_handed_on_in_small_batches():
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    sizes = [0, 3, 25, 1, 10, 9]
    edges = np.cumsum([0, *sizes])
    parts = [(np.arange(a, b), -np.arange(a, b)) for a, b in zip(edges, edges[1:])]
    batches = list(phrases._gathered(iter(parts), schema, 10))
    assert max(b.num_rows for b in batches) <= 10
    whole = pa.Table.from_batches(batches).to_pydict()
    assert whole == {"a": list(range(sum(sizes))), "b": [-i for i in range(sum(sizes))]}
    assert not list(phrases._gathered(iter([]), schema, 10))
