"""Response documents of any length, taken apart into their round records.

A document is one JSON value, often on one line, which Spark's JSON reader holds as one
row.  Here a task reads the text of one document in pieces and passes its records on one
by one, so that its memory follows a record instead of a document.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa

from stakeperf.operators.scores import SCORES

RECORDS = "v2RoundModelPerformances"
#: What pieces of a document end with: records and scores do, and no number or word crosses it.
PIECE_END = "}"
#: Begins the line of a document that is not followed here.
ODD = '{"odd":'
LINES_BYTES = 1 << 20

_decode = json.JSONDecoder().raw_decode
_space = re.compile(r"[ \t\n\r]*")


class _Text:
    """The text of a document, of which no more is held than the value that is read."""

    def __init__(self, chunks: Iterator[str]):
        self.chunks, self.text, self.at = chunks, "", 0

    def _more(self, least: int = 1) -> bool:
        parts, n = [self.text[self.at:]], 0
        while n < least and (chunk := next(self.chunks, None)) is not None:
            parts.append(chunk)
            n += len(chunk)
        self.text, self.at = "".join(parts), 0
        return n > 0

    def peek(self) -> str:
        while True:
            self.at = _space.match(self.text, self.at).end()
            if self.at < len(self.text):
                return self.text[self.at]
            if not self._more():
                raise ValueError("the document ends early")

    def take(self, mark: str) -> None:
        if self.peek() != mark:
            raise ValueError(f"no {mark}")
        self.at += 1

    def value(self) -> tuple[object, str]:
        """The next value and its text.  One that is cut off is read again when at least
        as much text again has come."""
        self.peek()
        while True:
            try:
                value, end = _decode(self.text, self.at)
                break
            except json.JSONDecodeError as exc:
                cut = exc.pos >= len(self.text) or exc.msg.startswith("Unterminated string")
                if not cut or not self._more(len(self.text) - self.at):
                    raise
        text, self.at = self.text[self.at:end], end
        return value, text

    def _items(self, first: str, last: str) -> Iterator[None]:
        self.take(first)
        if self.peek() != last:
            yield
            while self.peek() == ",":
                self.at += 1
                yield
        self.take(last)

    def elements(self) -> Iterator[None]:
        """Stops before each element of an array, which the caller reads."""
        return self._items("[", "]")

    def members(self) -> Iterator[str]:
        """The keys of an object; the caller reads each value."""
        seen = set()
        for _ in self._items("{", "}"):
            key, _ = self.value()
            if not isinstance(key, str) or key in seen:
                raise ValueError("a key that is no text or comes twice")
            seen.add(key)
            self.take(":")
            yield key


def _n_rows(record: dict) -> int:
    """The score rows of a record: one at least, also where its list is missing or no list of scores."""
    scores = record.get(SCORES)
    if isinstance(scores, list) and all(s is None or isinstance(s, dict) for s in scores):
        return max(1, len(scores))
    return 1


def _records(text: _Text) -> Iterator[tuple[int, int, str]]:
    """(place, score rows before it, text) of each round record of a document."""
    for key in text.members():
        if key != "data" or text.peek() != "{":
            text.value()
            continue
        for inner in text.members():
            if inner != RECORDS or text.peek() != "[":
                text.value()
                continue
            n_rows = 0
            for place, _ in enumerate(text.elements()):
                record, own = text.value()
                if isinstance(record, dict):
                    yield place, n_rows, own
                    n_rows += _n_rows(record)
                elif record is not None:
                    raise ValueError("a record that is no object")


#: Stands for the last piece's end where it is not known to be there; no JSON has it.
UNSURE = "\0"


def _chunks(batches: Iterator[pa.RecordBatch], size: int | None) -> Iterator[str]:
    """The text of a document of ``size`` bytes, which may lack the last piece's end.  Without
    a size (a compressed document) only an empty last piece is known to have one."""
    end, n, last = PIECE_END.encode(), 0, None
    for batch in batches:
        pieces = batch.column("value").to_pylist()
        if not pieces:
            continue
        n += sum(map(len, pieces)) + len(pieces)
        yield ((b"" if last is None else end) + end.join(pieces)).decode()
        last = pieces[-1]
    if last is not None:
        yield (PIECE_END if not last else UNSURE) if size is None else (PIECE_END if n <= size else "")


def record_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One JSON line per round record of a task's document, which comes in pieces
    (``value``); ``file``, ``model_name`` and ``size`` (null if it is compressed) come with the first.  A document that
    is not plain JSON of the known form gives a line saying so, perhaps after some of its records."""
    first = next((b for b in batches if b.num_rows), None)
    if first is None:
        return
    file, model, size = (first.column(c)[0].as_py() for c in ("file", "model_name", "size"))

    def whole():
        yield first
        yield from batches

    def lines():
        head = f'{{"file":{json.dumps(file)},"model_name":{json.dumps(model)},"rec_pos":'
        try:
            for place, n_rows, own in _records(_Text(_chunks(whole(), size))):
                yield f'{head}{place},"first_row":{n_rows},"record":{own.replace("\n", " ").replace("\r", " ")}}}'
        except (ValueError, RecursionError):
            yield f"{ODD}{json.dumps(file)}}}"

    out, n = [], 0
    for line in lines():
        out.append(line)
        n += len(line)
        if n > LINES_BYTES:
            yield pa.RecordBatch.from_pydict({"value": out})
            out, n = [], 0
    if out:
        yield pa.RecordBatch.from_pydict({"value": out})
