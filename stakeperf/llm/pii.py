"""Personal data: base patterns, and a semi-Markov conditional random field that adds to them.

Base spans come from four patterns with their checks (part range, Luhn, digit
count).  The field reads the words around every digit, ``@`` or ``(at)``: a
segment is a run of up to ``MAX_WORDS`` words, and each candidate is scored as
a whole (its shape, separators, digit groups, checks, neighbours, cue word) for
each kind, against the same words being ordinary text.  Dynamic programming over
segments picks boundaries and kinds jointly.  A segment without a digit, ``@``
or ``(at)`` is never an entity, so words away from those need no search.

The field is trained on a bounded sample (``TRAIN_ZONES`` excerpts) in which the
base spans are the labels, and on the same excerpts with the spans rewritten in
ways the patterns miss (no ``+``, other separators, ``(at)``, ``[.]``).

Defined results: null counts as empty text, which has no spans; base spans stay
whatever the field says, and an added span never overlaps one; equal texts give
equal rows; an empty table gives no rows; other columns are carried along by
``redacted`` and ignored elsewhere.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stakeperf.llm.common import chunks, empty, per_task

KINDS = ("email", "ip", "card", "phone")
MAX_WORDS = 6
TRAIN_ZONES, TRAIN_DOCUMENTS, EPOCHS = 240, 4000, 6

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a digit run is tried from its first digit only: a match from a later one would also be one from there
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]|\(at\)|\[at\]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """Leftmost matches of each kind that pass its check, by kind, then start."""
    out: list[Span] = []
    low, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
        low = m.end() if m else at + 1
        at = text.find("@", low)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start() < 40 and 16 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_digits(m.group())) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


# ---- candidate segments -----------------------------------------------------

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_CUES = {"tel": "phone", "phone": "phone", "call": "phone", "fax": "phone", "mobile": "phone", "email": "email", "mail": "email", "e-mail": "email", "contact": "email", "ip": "ip", "host": "ip", "server": "ip", "card": "card", "visa": "card", "credit": "card"}


def _core(text: str, a: int, b: int) -> tuple[int, int]:
    """A span without the marks around it, but for a leading ``+`` and brackets that close inside it."""
    def part_of_it(c: str, pair: str, s: str) -> bool:
        return c.isalnum() or (pair != "" and pair in s)

    while a < b and text[a] != "+" and not part_of_it(text[a], {"(": ")", "[": "]"}.get(text[a], ""), text[a:b]):
        a += 1
    while b > a and not part_of_it(text[b - 1], {")": "(", "]": "["}.get(text[b - 1], ""), text[a:b]):
        b -= 1
    return a, b


def possible(s: str) -> tuple[bool, ...]:
    """Which kinds a span may be at all: an email has one ``@`` or its like and a dot after it; an
    address has four numbers; a card 13 to 19 digits and a phone 7 to 15, without letters."""
    count = sum("0" <= c <= "9" for c in s)
    at = s.count("@") + s.count("(at)") + s.count("[at]")
    letters = any(c.isalpha() for c in s)
    return at == 1 and "." in re.split(r"@|\(at\)|\[at\]", s)[1], not at and not letters and len(re.findall("[0-9]+", s)) == 4, not at and not letters and 13 <= count <= 19, not at and not letters and 7 <= count <= 15


def zones(text: str, around: int = 2) -> Iterator[list[tuple[int, int]]]:
    """Runs of words (start, end) near a trigger, with some words of context."""
    if not _TRIGGER.search(text):
        return
    words = [m.span() for m in _WORD.finditer(text)]
    current: list[tuple[int, int]] = []
    last = -1  # last word taken
    until = -1
    for k, (a, b) in enumerate(words):
        if _TRIGGER.search(text, a, b):
            first = max(last + 1, k - around)
            if current and first > until + 1:
                yield current
                current = []
            current += words[max(first, last + 1):k + 1]
            last, until = k, k + around
        elif current and k <= until:
            current.append((a, b))
            last = k
    if current:
        yield current


def _kind_of(c: str) -> str:
    return "9" if c.isdigit() else "a" if c.isalpha() else c


def features(text: str, a: int, b: int, n: int, cue: str) -> tuple[str, ...]:
    """Names of the features of text[a:b] as one segment of n words."""
    s = text[a:b]
    groups = re.findall(r"[0-9]+", s)
    count = sum(map(len, groups))
    marks = "".join(sorted({c for c in s if not c.isalnum()}))[:6]
    letters = any(c.isalpha() for c in s)
    shape = re.sub(r"9+", "9", re.sub(r"a+", "a", "".join(map(_kind_of, s[:48]))))
    octets = len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups)
    at = s.count("@") + s.count("(at)") + s.count("[at]")
    dotted = at == 1 and "." in re.split(r"@|\(at\)|\[at\]", s)[1]
    around = (_kind_of(text[a - 1]) if a else " ") + (_kind_of(text[b]) if b < len(text) else " ")
    out = ["bias", f"n{n}", f"marks{marks}|{letters}", f"shape{shape[:24]}", f"groups{min(len(groups), 6)}|{min(count, 20) if count > 6 else 0}", f"first{_kind_of(s[0])}", f"last{_kind_of(s[-1])}", f"around{around}", f"at{min(at, 2)}|{dotted}|{letters}"]
    if not letters and not at:
        out.append(f"octets{octets}|{marks}")
        if 13 <= count <= 19:
            out.append(f"luhn{luhn(''.join(groups))}|{marks}")
        out.append(f"lengths{'-'.join(str(len(g)) for g in groups[:6])}")
    if cue:
        out.append(f"cue{cue}")
    return tuple(out)


def candidates(text: str, words: list[tuple[int, int]]) -> list[tuple[int, int, int, int, tuple[str, ...]]]:
    """(first word, word after, start, end, features and possible kinds) of every segment that may be an entity."""
    out = []
    for i in range(len(words)):
        cue = _CUES.get(text[words[i - 1][0]:words[i - 1][1]].strip(":.,").lower(), "") if i and words[i - 1][1] - words[i - 1][0] < 12 else ""
        for j in range(i + 1, min(i + MAX_WORDS, len(words)) + 1):
            a, b = _core(text, words[i][0], words[j - 1][1])
            # the first and the last word belong to it, and it is no longer than any entity
            if b - a > 320 or a >= words[i][1] or b <= words[j - 1][0] or a >= b:
                if b - a > 320:
                    break
                continue
            if _TRIGGER.search(text, a, b) and any(kinds := possible(text[a:b])):
                out.append((i, j, a, b, features(text, a, b, j - i, cue) + kinds))
    return out


def _plain(text: str, word: tuple[int, int]) -> str:
    """The feature of one word as ordinary text."""
    a, b = word
    return "O" + ("@" if "@" in text[a:b] else "") + str(min(sum(c.isdigit() for c in text[a:min(b, a + 64)]), 9))


# ---- the field --------------------------------------------------------------

class Field:
    """Weights per feature, one for each kind; ordinary words have one weight."""

    def __init__(self):
        self.weights: dict[str, np.ndarray] = {}
        self.plain: dict[str, float] = {}
        self.cache: dict = {}

    def scores(self, names: tuple) -> np.ndarray:
        got = self.cache.get(names)
        if got is None:
            got = sum((self.weights[f] for f in names[:-len(KINDS)] if f in self.weights), np.zeros(len(KINDS)))
            got = np.where(names[-len(KINDS):], got, -np.inf)
            if len(self.cache) > 100_000:
                self.cache.clear()
            self.cache[names] = got
        return got

    def decode(self, text: str, words: list[tuple[int, int]]) -> list[Span]:
        """The best segmentation's entities."""
        n = len(words)
        ends: list[list] = [[] for _ in range(n + 1)]
        for i, j, a, b, names in candidates(text, words):
            s = self.scores(names)
            k = int(s.argmax())
            ends[j].append((i, float(s[k]), (KINDS[k], a, b)))
        best, back = [0.0] * (n + 1), [None] * (n + 1)
        for j in range(1, n + 1):
            best[j] = best[j - 1] + self.plain.get(_plain(text, words[j - 1]), 0.0)
            for i, s, span in ends[j]:
                if best[i] + s > best[j]:
                    best[j], back[j] = best[i] + s, (i, span)
        out, j = [], n
        while j:
            if back[j]:
                j, span = back[j]
                out.append(span)
            else:
                j -= 1
        return out[::-1]


def train(examples: list[tuple[str, list[Span]]], epochs: int = EPOCHS, rate: float = 0.4, decay: float = 1e-4) -> Field:
    """Maximum likelihood by AdaGrad over whole excerpts, with forward and backward sums over segments."""
    ready = []
    for text, gold in examples:
        words = [m.span() for m in _WORD.finditer(text)]
        cands = candidates(text, words)
        at = {(a, b): k for k, (_, _, a, b, _) in enumerate(cands)}
        if all((a, b) in at for _, a, b in gold):
            truth = [(at[a, b], KINDS.index(kind)) for kind, a, b in gold]
            ready.append((len(words), cands, truth, [_plain(text, w) for w in words]))
    index: dict[str, int] = {}
    compiled = []
    for n, cands, truth, plain in ready:
        ids = [np.array([index.setdefault(f, len(index)) for f in names[:-len(KINDS)]]) for *_, names in cands]
        barred = [np.where(names[-len(KINDS):], 0.0, -np.inf) for *_, names in cands]
        own = [index.setdefault(p, len(index)) for p in plain]
        ends: list[list[int]] = [[] for _ in range(n + 1)]
        starts: list[list[int]] = [[] for _ in range(n + 1)]
        for c, (i, j, *_) in enumerate(cands):
            ends[j].append(c)
            starts[i].append(c)
        inside = {w for c, _ in truth for w in range(cands[c][0], cands[c][1])}
        compiled.append((n, [(c[0], c[1]) for c in cands], ids, barred, own, ends, starts, truth, inside))
    w = np.zeros((len(index), len(KINDS)))
    seen = np.full_like(w, 1e-3)
    logsum = np.logaddexp.reduce
    for _ in range(epochs):
        for n, spans, ids, barred, own, ends, starts, truth, inside in compiled:
            score = np.array([w[f].sum(axis=0) + bar for f, bar in zip(ids, barred)]) if ids else np.zeros((0, len(KINDS)))
            any_kind = logsum(score, axis=1) if len(score) else np.zeros(0)
            plain = w[own, 0]
            fore, aft = np.zeros(n + 1), np.zeros(n + 1)
            for j in range(1, n + 1):
                fore[j] = logsum([fore[j - 1] + plain[j - 1], *(fore[spans[c][0]] + any_kind[c] for c in ends[j])])
            for i in range(n - 1, -1, -1):
                aft[i] = logsum([aft[i + 1] + plain[i], *(aft[spans[c][1]] + any_kind[c] for c in starts[i])])
            grad: dict[int, np.ndarray] = {}
            chosen = dict(truth)
            for c, (i, j) in enumerate(spans):
                p = np.exp(score[c] + (fore[i] + aft[j] - fore[n]))
                if c in chosen:
                    p[chosen[c]] -= 1
                elif p.max() < 1e-4:
                    continue
                for f in ids[c]:
                    grad[f] = grad.get(f, 0) + p
            for k in range(n):
                p = math.exp(min(0.0, fore[k] + plain[k] + aft[k + 1] - fore[n])) - (k not in inside)
                grad[own[k]] = grad.get(own[k], 0) + np.array([p, *[0.0] * (len(KINDS) - 1)])
            at = np.fromiter(grad, np.int64, len(grad))
            g = np.array([grad[f] for f in at]) + decay * w[at]
            seen[at] += g * g
            w[at] -= rate * g / np.sqrt(seen[at])
    field = Field()
    for name, k in index.items():
        if name[0] == "O":
            field.plain[name] = float(w[k, 0])
        else:
            field.weights[name] = w[k]
    return field


def rewritten(text: str, gold: list[Span]) -> list[tuple[str, list[Span]]]:
    """The excerpt with its spans in forms that the base patterns miss."""
    def forms(kind: str, s: str) -> tuple[str, str]:
        d = _digits(s)
        if kind == "email":
            return s.replace("@", " (at) "), s.replace("@", "[at]")
        if kind == "ip":
            return s.replace(".", "[.]"), s.replace(".", " . ")
        if kind == "card":
            return ".".join(d[k:k + 4] for k in range(0, len(d), 4)), "/".join(d[k:k + 4] for k in range(0, len(d), 4))
        return f"({d[-10:-7]}) {d[-7:-4]}-{d[-4:]}", f"{d[-10:-7]}-{d[-7:-4]}-{d[-4:]}"

    out = []
    for v in range(2):
        parts, spans, end, n = [], [], 0, 0
        for kind, a, b in sorted(gold, key=lambda x: x[1]):
            new = forms(kind, text[a:b])[v]
            parts += [text[end:a], new]
            n += a - end
            spans.append((kind, n, n + len(new)))
            n += len(new)
            end = b
        out.append(("".join(parts) + text[end:], spans))
    return out


def learn(docs: DataFrame, n_zones: int = TRAIN_ZONES, n_documents: int = TRAIN_DOCUMENTS) -> Field:
    """A field fitted on at most ``n_zones`` excerpts of at most 400 characters,
    from about ``n_documents`` texts chosen by their hashes."""
    schema = pa.schema([("h", pa.int64()), ("zone", pa.string())])

    @per_task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                for z in zones(text):
                    if (s := text[z[0][0]:z[-1][1]]) and len(s) <= 400:
                        out.append((int.from_bytes(hashlib.blake2b(s.encode(), digest_size=7).digest(), "big"), s))
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in out], pa.int64()), pa.array([s for _, s in out], pa.string())], schema=schema)

    n = docs.count()
    few = docs.select("text").where("text rlike '[0-9@]'").where(F.pmod(F.xxhash64("text"), F.lit(max(1, n // n_documents))) == 0)
    found = few.mapInArrow(run, "h bigint, zone string").distinct().orderBy("h", "zone").limit(n_zones).collect()
    examples = []
    for row in found:
        gold = base_spans(row["zone"])
        if any(x[1] < y[2] and y[1] < x[2] for x in gold for y in gold if x is not y):
            continue
        examples.append((row["zone"], gold))
        examples += rewritten(row["zone"], gold) if gold else []
    return train(examples)


def find(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), by kind, then start."""
    if not _TRIGGER.search(text):
        return [], []
    base = base_spans(text)
    covered = np.zeros(len(text) + 1, np.int8)
    for _, a, b in base:
        covered[a:b] = 1
    added = [(k, a, b) for z in zones(text) for k, a, b in field.decode(text, z) if not covered[a:b].any()]
    every = sorted(base + added, key=lambda x: (KINDS.index(x[0]), x[1]))
    return base, every


def _listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def detect(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row; the counts are of base spans."""
    docs = docs.selectExpr("cast(doc_id as bigint) doc_id", "text")
    field = learn(docs, **options)
    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string())])

    @per_task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                found = [find(t or "", field) for t in part.column("text").to_pylist()]
                counts = [pa.array([sum(x[0] == k for x in base) for base, _ in found], pa.int64()) for k in KINDS]
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), *counts,
                    pa.array([hashlib.sha256(_listed(base).encode()).hexdigest() for base, _ in found], pa.string()),
                    pa.array([_listed(every) for _, every in found], pa.string())], schema=schema)
        yield empty(schema)

    return docs.mapInArrow(run, "doc_id bigint, " + ", ".join(f"n_{k} bigint" for k in KINDS) + ", base_sha256 string, spans string")


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its first kind's name."""
    out, end = [], 0
    for kind, a, b in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]))):
        if a >= end:
            out += [text[end:a], f"[{kind.upper()}]"]
        end = max(end, b)
    return "".join(out) + text[end:]


def redacted(docs: DataFrame, **options) -> DataFrame:
    """The rows with every span masked; ``n_chars``, where there is such a column, renewed for changed texts."""
    field = learn(docs, **options)
    fields = docs.schema

    @per_task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text").to_pylist()
            changed = []
            for i, t in enumerate(text):
                if t and (spans := find(t, field)[1]):
                    text[i] = masked(t, spans)
                    changed.append(i)
            columns = {n: batch.column(n) for n in fields.names}
            columns["text"] = pa.array(text, columns["text"].type)
            if "n_chars" in columns:
                n_chars = columns["n_chars"].to_pylist()
                for i in changed:
                    n_chars[i] = len(text[i])
                columns["n_chars"] = pa.array(n_chars, columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return docs.mapInArrow(run, fields)
