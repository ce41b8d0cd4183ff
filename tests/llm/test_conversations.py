"""Conversation repair: every edit sequence on small cases, a table of best prefixes on long ones."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from stakeperf.llm import conversations as C
from stakeperf.llm.queries import QUERIES
from tests.llm.conftest import rows_of

GOOD = re.compile("(s?(ua)+)?")
SOLID = re.compile(r"[^\x20\x09-\x0D]")
NEXT = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        solid = SOLID.findall(text)
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def best(rows):
    """(cost, audit) from the cheapest prefix that ends in each role, row by row."""
    def with_inserts(table):
        for _ in range(2):
            for last, (c, w) in list(table.items()):
                for to in {"": "u", "s": "u", "u": "a", "a": "u"}[last]:
                    table[to] = min(table.get(to, (c + 3, w + "I")), (c + 3, w + "I"))
        return table

    table = with_inserts({"": (0, "")})
    for (role, _), fault in zip(rows, faults(rows)):
        new = {}

        def put(to, way):
            new[to] = min(new.get(to, way), way)

        for last, (c, w) in table.items():
            put(last, (c + 4, w + "D"))
            if fault in ("", "truncated"):
                extra = 3 * (fault == "truncated")
                for to in NEXT[last]:
                    if role[:1] == to:
                        put(to, (c + extra, w + "K"))
                    if to != "s":
                        put(to, (c + 3 + extra, w + "R"))
        table = with_inserts(new)
    return min(table[e] for e in ("", "a") if e in table)


def everything(rows):
    """(cost, audit) by trying all edits, at most two insertions in a row."""
    options = []
    for (role, _), fault in zip(rows, faults(rows)):
        o = [("D", 4, "")]
        if fault in ("", "truncated"):
            extra = 3 * (fault == "truncated")
            o += [("K", extra, role[:1] or "?")] + [("R", 3 + extra, x) for x in "ua"]
        options.append(o)
    inserts = [("", 0, ""), *(("I" * len(x), 3 * len(x), x) for x in ("u", "a", "ua", "au"))]
    found = None
    for way in itertools.product(inserts, *(x for o in options for x in (o, inserts))):
        if GOOD.fullmatch("".join(x[2] for x in way)):
            got = (sum(x[1] for x in way), "".join(x[0] for x in way))
            found = got if found is None else min(found, got)
    return found


def damage(conv, rows):
    """Rows (turn, role, text) after the contract's damage, in order."""
    out = []
    for turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))


def report(conv, rows):
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    pairs = [(r, x) for _, r, x in rows]
    f = faults(pairs)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(pairs, pairs[1:]))
    cost, audit = best(pairs)
    lines, rest, last = [], iter(pairs), ""
    for letter in audit:
        role, text = next(rest) if letter != "I" else (None, "")
        if letter != "D":
            if letter != "K":
                role = "assistant" if last == "u" else "user"
            lines.append(f"{role}:{text}")
            last = role[:1]
    return (conv, gaps, f.count("blank"), f.count("duplicate"), f.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


ROLES = ["user", "assistant", "system", "user", "assistant", "tool", "User", ""]


def random_rows(rnd, n, texts=("Hi.", "No", "", "Yes!", " \t", "Why? ", "é…")):
    return [(rnd.choice(ROLES), rnd.choice(texts) + (str(rnd.randrange(9)) + "." if rnd.random() < 0.6 else "")) for _ in range(n)]


def cases(rows):
    return [(r[:1], C.FORCED if f in ("blank", "duplicate") else C.CUT if f else C.FINE) for (r, _), f in zip(rows, faults(rows))]


def test_search_tries_as_good_as_everything():
    rnd = random.Random(1)
    for _ in range(120):
        rows = random_rows(rnd, rnd.randrange(0, 4))
        assert C.search(cases(rows), 0, C.ENDS) == everything(rows) == best(rows)


@pytest.mark.parametrize("roles", [ROLES, ["system"], ["assistant", "system"], ["user"], ["user", "system", "system"]])
def test_search_on_long_conversations(roles):
    rnd = random.Random(len(roles))
    for n in (30, 400):
        rows = [(rnd.choice(roles), f"text {rnd.randrange(10 * n)}{rnd.choice(['.', '.', ''])}") for _ in range(n)]
        assert C.search(cases(rows), 0, C.ENDS) == best(rows)


def test_stretches_chain_from_every_state():
    rnd = random.Random(3)
    for _ in range(40):
        rows = cases(random_rows(rnd, 12))
        table = {0: (0, "")}
        for part in (rows[:5], rows[5:6], rows[6:]):
            new = {}
            for s, (c, w) in table.items():
                for e in range(4):
                    if (x := C.search(part, s, (e,))) is not None:
                        new[e] = min(new.get(e, (1 << 60, "")), (c + x[0], w + x[1]))
            table = new
        assert min(table[e] for e in (0, 3) if e in table) == C.search(rows, 0, C.ENDS)


SCHEMA = "conv_id long, turn long, role string, text string, kind string, n int, audit string, digest string"


@pytest.fixture(scope="module")
def frame(sp):
    return lambda rows: sp.createDataFrame([(*r, None, None, "x", None) for r in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize("block", [3, 1024])
def test_digests_match_brute_force(frame, block):
    rnd = random.Random(block)
    table = []
    for conv in range(70):
        table += [(conv, t, *r) for t, r in enumerate(random_rows(rnd, rnd.randrange(1, 9)))]
    table += [(500, t, *r) for t, r in enumerate(random_rows(rnd, 150))]
    table += [(501, rnd.choice([None, 3, 4]), *r) for r in random_rows(rnd, 12)]
    table += [(502, 7, "user", "same.")] * 9 + [(503, None, None, None), (None, 0, "user", "Hi."), (None, 1, "assistant", "Yo."), (504, 2, "user", "x" * 100000)]
    dropped = next(c for c in range(10**6, 10**7) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    table.append((dropped, 0, "user", "gone."))
    by = {}
    for c, t, r, x in table:
        by.setdefault(c, []).append((t, r, x))
    want = sorted((report(c, damage(c, rows)) for c, rows in by.items()), key=repr)
    got = rows_of(C.digests(C.damaged(frame(table)), block))
    assert got == want
    assert next(r for r in got if r[0] == dropped)[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_repaired_conversations_are_well_formed(frame):
    rnd = random.Random(9)
    table = [(c, t, *r) for c in range(30) for t, r in enumerate(random_rows(rnd, rnd.randrange(1, 9)))]
    got = {}
    for r in C.repaired(frame(table)).orderBy("conv_id", "turn").collect():
        got.setdefault(r.conv_id, []).append(r.role[0])
    assert all(GOOD.fullmatch("".join(x)) for x in got.values()) and len(got) > 20
    assert rows_of(C.repaired(frame([]))) == [] == rows_of(C.digests(C.damaged(frame([]))))


def test_query_matches_brute_force(sp, sf_small):
    by = {}
    for r in sp.read.parquet(f"{sf_small}/conversations.parquet").collect():
        by.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    want = sorted((report(c, damage(c, rows)) for c, rows in by.items()), key=repr)
    assert rows_of(QUERIES["op11_branch_and_bound_repair"](sp, sf_small)) == want
