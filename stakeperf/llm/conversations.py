"""Repair of conversation structure by depth-first branch and bound.

A conversation is well formed if the initials of its roles are ``(s?(ua)+)?``.
Rows in order of turn (nulls first; rows of equal turn by role and text) are kept
(cost 0), given another role, user or assistant (3), or deleted (4, which blank and
repeated rows need); empty-text rows may be inserted anywhere (3); a row without an
end of sentence costs 3 more unless it is deleted.  The cheapest edits win; of
equally cheap ones the string of initials D, I, K, R that comes first.

The search walks the rows with an explicit stack.  A node is (row, state): what the
grammar allows next.  Each child's cost plus a lower bound of what the remaining
rows cost from that state is held against the incumbent (cost, audit), and a table
per node drops every prefix that is no better than one seen there.  The bounds come
from one sweep over the rows from the end; weaker ones (system rows anywhere) let
the search of 400 rows full of system rows take minutes.  The search ends when the stack is empty: the
incumbent is then proved optimal.

Scale: rows are dealt by ranges of (conversation, turn), so a long conversation
lies in several tasks, each of which sees stretches of at most ``BLOCK`` rows in
order.  A stretch that does not hold a whole conversation is solved from every
state to every state, and stretches are chained afterwards: costs add up, and of
equally cheap audits none is a prefix of another (equal letters cost the same), so
the first one chains to the first one.  Repeated rows of equal turn are counted
beforehand, texts travel as SHA-256 until the repaired text is written.  The hash
of a repaired conversation is taken over its rows one after the other.

Defined results: a null role, text, turn or conversation id reads as one space
where its text is asked for; a null conversation id is a conversation of its own;
a conversation without rows gives zeros, an empty audit and the hash of nothing;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stakeperf.llm.common import empty, per_task, written

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
FINE, CUT, FORCED = 0, 1, 2  # a row's fault: none, no end of sentence, must go
#: Rows of a stretch.
BLOCK = 1024
#: States: nothing yet; after a system row; after a user row; after an assistant row.
STATES, ENDS = 4, (0, 3)

PART = pa.schema([("conv_id", pa.int64()), ("first_turn", pa.int64()), ("place", pa.int64()), ("last_turn", pa.int64()), ("turns", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()),
                  ("truncated", pa.int64()), ("illegal", pa.int64()), ("rows", pa.int64()), ("first_role", pa.string()), ("last_role", pa.string()), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))])
PLAN = pa.schema([("conv_id", pa.int64()), *((n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string())])
RESULT = pa.schema([*PLAN, ("repaired_sha256", pa.string())])


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "bigint", pa.string(): "string", pa.list_(pa.int64()): "array<bigint>", pa.list_(pa.string()): "array<string>"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)




#: More than any cost, and the state after a row of this initial in a state that allows it.
_FAR = 1 << 60
_NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}


def _suffix_bounds(rows: list[tuple[str, int]], ends: tuple[int, ...]) -> list[list[int]]:
    """For every row and state what it and all later rows cost at least, by one sweep from the end."""
    def with_inserts(v: list[int]) -> list[int]:
        for _ in range(2):
            v = [min(x, INSERT + v[_NEXT[s, "a" if s == 2 else "u"]]) for s, x in enumerate(v)]
        return v

    out = [with_inserts([0 if s in ends else _FAR for s in range(STATES)])]
    for role, fault in reversed(rows):
        extra, to = TRUNCATED if fault == CUT else 0, out[-1]
        v = [DELETE + x for x in to]
        if fault != FORCED:
            for s in range(STATES):
                v[s] = min(v[s], REROLE + extra + to[_NEXT[s, "a" if s == 2 else "u"]])
                if (s, role) in _NEXT:
                    v[s] = min(v[s], KEEP + extra + to[_NEXT[s, role]])
        out.append(with_inserts(v))
    return out[::-1]


def search(rows: list[tuple[str, int]], start: int, ends: tuple[int, ...]) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest edits of rows (role initial, fault) that lead from state
    ``start`` to one of ``ends``; None if none do."""
    bounds = _suffix_bounds(rows, ends)
    n = len(rows)
    best: tuple[int, str] | None = None
    seen: list[dict[int, tuple[int, str]]] = [{} for _ in range(n + 1)]
    stack = [(0, start, 0, "")]
    while stack:
        i, state, cost, audit = stack.pop()
        if cost + bounds[i][state] >= _FAR:
            continue
        if best is not None:
            low = cost + bounds[i][state]
            if low > best[0] or low == best[0] and audit > best[1][:len(audit)]:
                continue
        # on leaving the stack: later prefixes that are no better are dropped, and so is this one if a better one came
        if seen[i].get(state, (cost, audit)) < (cost, audit):
            continue
        if i == n and state in ends and (best is None or (cost, audit) < best):
            best = (cost, audit)
        children = []
        want = "a" if state == 2 else "u"
        if i < n:
            role, fault = rows[i]
            extra = TRUNCATED if fault == CUT else 0
            children.append((i + 1, state, cost + DELETE, audit + "D"))
            if fault != FORCED:
                to = _NEXT.get((state, role))
                if to is not None:
                    children.append((i + 1, to, cost + KEEP + extra, audit + "K"))
                children.append((i + 1, _NEXT[state, want], cost + REROLE + extra, audit + "R"))
        children.append((i, _NEXT[state, want], cost + INSERT, audit + "I"))
        good = []
        for c in children:
            have = seen[c[0]].get(c[1])
            if have is None or (c[2], c[3]) < have:
                seen[c[0]][c[1]] = (c[2], c[3])
                good.append((c[2] + bounds[c[0]][c[1]], c[3][-1], c))
        # the most promising child is on top; of equals, the first letter
        stack += [c for _, _, c in sorted(good, key=lambda x: x[:2], reverse=True)]
    return best


def _turn_text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damaged(rows: DataFrame) -> DataFrame:
    """The contract's damage: (conv_id, turn, role, text, n), n copies of each row, 0 where it is dropped."""
    k = F.crc32(F.concat(_turn_text("conv_id"), F.lit(":"), _turn_text("turn"))) % 20
    role, text = _turn_text("role"), _turn_text("text")
    text = F.when(k == 1, "").when(k == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    return rows.select("conv_id", "turn", F.when(k == 4, "user").otherwise(role).alias("role"), text.alias("text"), F.when(k == 0, 0).when(k == 3, 2).otherwise(1).alias("n"))


def _light(rows: DataFrame) -> DataFrame:
    """Distinct rows with their number of copies and faults, texts as SHA-256."""
    last = F.substring(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    fault = F.when(last == "", FORCED).when(~last.isin(".", "!", "?"), CUT).otherwise(FINE)
    light = rows.select("conv_id", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), (last == "").alias("blank"), fault.alias("fault"), "n")
    light = light.groupBy("conv_id", "turn", "role", "digest", "blank", "fault").agg(F.sum("n").alias("n"))
    # where (role, text) comes at several turns, all but the first are repeats
    same = ["conv_id", "role", "digest"]
    early = F.coalesce("turn", F.lit(-(1 << 63)))
    light = written(light.withColumn("early", early), "turns")
    again = light.where("n > 0").groupBy(*same).agg(F.min("early").alias("first"), F.max("early").alias("last")).where("first < last").drop("last")
    again = written(again, "again").withColumnsRenamed({c: f"_{c}" for c in same})
    meets = F.col("conv_id").eqNullSafe(F.col("_conv_id")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest"))
    return light.join(again, meets, "left").withColumn("again", F.coalesce(F.col("early") > F.col("first"), F.lit(False))).select("conv_id", "turn", "role", "digest", "blank", "fault", "n", "again")


def _initial(role: str) -> str:
    return role[:1]


def _stretch(conv: int | None, rows: list[dict], whole: bool, place: int) -> tuple:
    """One row of PART for consecutive rows of a conversation."""
    faults, blank, duplicate, truncated, illegal = [], 0, 0, 0, 0
    before = None
    for r in rows:
        n, role = r["n"], _initial(r["role"])
        again = bool(r["again"])
        copies = n if again else n - 1
        if r["blank"]:
            blank += n
            faults += [(role, FORCED)] * n
        else:
            duplicate += copies
            truncated += not again and r["fault"] == CUT
            faults += [(role, FORCED if again else r["fault"])] + [(role, FORCED)] * (n - 1)
        pairs = ([before + role] if before is not None else []) + [role * 2] * (n - 1)
        illegal += sum(p not in ("su", "ua", "au") for p in pairs)
        before = role
    turns = [r["turn"] for r in rows if r["turn"] is not None]
    costs, audits = [], []
    for start in (0,) if whole else range(STATES):
        for end in (ENDS,) if whole else ((e,) for e in range(STATES)):
            found = search(faults, start, end)
            costs.append(None if found is None else found[0])
            audits.append(None if found is None else found[1])
    first, last = (_initial(rows[0]["role"]), before) if rows else (None, None)
    return (conv, turns[0] if turns else None, place, turns[-1] if turns else None, len(set(turns)), blank, duplicate, truncated, illegal, len(faults), first, last, costs, audits)


def _stretches(block: int):
    """Cuts a task's rows, which come in order, into stretches of one conversation."""
    def rows_of(batches):
        for batch in batches:
            for r in batch.to_pylist():
                while r["n"] > block:  # copies beyond the first are repeats
                    yield {**r, "n": block}
                    r = {**r, "n": r["n"] - block, "again": True}
                yield r

    @per_task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, place, size, previous, head = [], 0, 0, None, True

        def close(last: bool):
            # the first and the last conversation of a task may go on in others
            nonlocal place, size
            conv, rows, cut = previous
            out.append(_stretch(conv, rows, not (cut or last), place))
            place, size = place + 1, 0

        for r in rows_of(batches):
            if previous is not None and previous[0] == r["conv_id"]:
                if size + r["n"] > block and previous[1]:
                    previous = (previous[0], previous[1], True)
                    close(True)
                    previous = (previous[0], [], True)
            else:
                if previous is not None:
                    close(False)
                    head = False
                previous = (r["conv_id"], [], head)
            if r["n"]:
                previous[1].append(r)
                size += r["n"]
            if len(out) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), PART)], schema=PART)
                out = []
        if previous is not None:
            close(True)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), PART)], schema=PART)
        yield empty(PART)
    return run


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chains the stretches of each conversation, which come in order."""
    rows = (r for b in batches for r in b.to_pylist())
    out = []
    for conv, parts in groupby(rows, key=lambda r: r["conv_id"]):
        best: list[tuple[int, str] | None] = [(0, ""), None, None, None]
        total = [0, 0, 0, 0]
        low = high = None
        turns, role, done = 0, None, None
        for p in parts:
            for k, c in enumerate(("blank", "duplicate", "truncated", "illegal")):
                total[k] += p[c]
            if p["rows"]:
                total[3] += role is not None and role + p["first_role"] not in ("su", "ua", "au")
                role = p["last_role"]
            if p["first_turn"] is not None:
                turns += p["turns"] - (high == p["first_turn"])
                low, high = p["first_turn"] if low is None else low, p["last_turn"]
            if len(p["costs"]) == 1:
                done = (p["costs"][0], p["audits"][0])
                continue
            nxt: list[tuple[int, str] | None] = [None] * STATES
            for s in range(STATES):
                for e in range(STATES):
                    c = p["costs"][s * STATES + e]
                    if best[s] is not None and c is not None:
                        way = (best[s][0] + c, best[s][1] + p["audits"][s * STATES + e])
                        nxt[e] = way if nxt[e] is None else min(nxt[e], way)
            best = nxt
        cost, audit = done or min(best[e] for e in ENDS if best[e] is not None)
        gaps = 0 if low is None else high - low + 1 - turns
        out.append((conv, gaps, *total, cost, audit))
        if len(out) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), PLAN)], schema=PLAN)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), PLAN)], schema=PLAN)
    yield empty(PLAN)


def plans(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation of
    rows (conv_id, turn, role, text, n); n counts copies, and 0 leaves a row out but not its conversation."""
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "digest")]
    dealt = _light(rows).repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    parts = dealt.select("conv_id", "turn", "role", "blank", "fault", "n", "again").mapInArrow(_stretches(block), _ddl(PART))
    parts = written(parts, "stretches")
    return parts.repartition("conv_id").sortWithinPartitions(*(F.col(c).asc_nulls_first() for c in ("conv_id", "first_turn", "place"))).mapInArrow(_chained, _ddl(PLAN))


def repaired_rows(texts: Iterator[tuple[str, str]], audit: str) -> Iterator[tuple[str, str]]:
    """(role, text) of a conversation after the edits."""
    state = 0
    for letter in audit:
        want = "assistant" if state == 2 else "user"
        role, text = next(texts) if letter != "I" else (want, "")
        if letter == "D":
            continue
        if letter == "R":
            role = want
        state = _NEXT[state, role[:1]]
        yield role, text


def _applied(batches: Iterator[pa.RecordBatch], emit, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of each conversation after its plan, in order; ``emit(plan, rows)`` gives result rows."""
    rows = (r for b in batches for r in b.to_pylist())
    out = []
    for _, group in groupby(rows, key=lambda r: r["conv_id"]):
        plan = next(group)
        for r in emit(plan, repaired_rows(((r["role"], r["text"]) for r in group for _ in range(r["n"])), plan["audit"])):
            out.append(r)
            if len(out) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
    yield empty(schema)


def _with_plans(rows: DataFrame, block: int) -> DataFrame:
    """The rows in order, each conversation's plan in front."""
    plan = written(plans(rows, block), "plans")
    mine = [f.name for f in PLAN]
    lines = rows.where("n > 0").withColumn("digest", F.unhex(F.sha2("text", 256)))
    both = plan.withColumn("kind", F.lit(0)).unionByName(lines.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    both = both.repartition("conv_id").sortWithinPartitions(*(F.col(c).asc_nulls_first() for c in ("conv_id", "kind", "turn", "role", "digest")))
    return both.select(*mine, "role", "text", "n")


def digests(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """``plans`` with the hash of the repaired ``role:text`` lines."""
    def emit(plan, lines):
        h, first = hashlib.sha256(), True
        for role, text in lines:
            h.update(f"{'' if first else chr(10)}{role}:{text}".encode())
            first = False
        yield (*(plan[f.name] for f in PLAN), h.hexdigest())

    return _with_plans(rows, block).mapInArrow(lambda b: _applied(b, emit, RESULT), _ddl(RESULT))


def repaired(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, turn, role, text) of all conversations after repair, turns numbered from 0."""
    schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    rows = conversations.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), _turn_text("role").alias("role"), _turn_text("text").alias("text"), F.lit(1).alias("n"))

    def emit(plan, lines):
        for k, (role, text) in enumerate(lines):
            yield plan["conv_id"], k, role, text

    return _with_plans(rows, block).mapInArrow(lambda b: _applied(b, emit, schema), _ddl(schema))
