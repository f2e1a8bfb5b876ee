"""Records of a split whose first state is not known.

A line of a delimited file may begin inside a quoted cell. Each line comes with the state that it
leaves (a quoted cell open or not) after either state before it. A split of a file is read line by
line; what it yields has four kinds:

- ``RECORD``: a complete record whose first line certainly begins outside of quotes.
- ``UNKNOWN``: a line before the first of these. ``parity`` tells whether the state before it is
  the split's first state (0), the other one (1), or open whatever that is (2). ``last_if_closed``
  and ``last_if_open`` are the places of the last line up to here that opens a record, if the split
  begins closed or open.
- ``TAIL``: the lines of a record that is still open where the split ends.
- ``SPLIT``: the state after the split, from either state before it, and where its last record opens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

RECORD, UNKNOWN, TAIL, SPLIT = range(4)
PIECES = (
    "path string, block bigint, at bigint, record bigint, line string, head boolean, parity int, from_closed boolean,"
    " from_open boolean, last_if_closed bigint, last_if_open bigint, kind int"
)
_TYPES = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_(), "int": pa.int32()}
_SCHEMA = pa.schema([(name, _TYPES[kind]) for name, kind in (column.split() for column in PIECES.split(", "))])


def _states(first: bool, closed: np.ndarray, opened: np.ndarray) -> np.ndarray:
    """Whether a cell is open before each line, and after the last one."""
    settles = closed == opened
    turns = np.concatenate(([0], np.cumsum(closed & ~opened)))
    at = np.maximum.accumulate(np.where(settles, np.arange(len(closed)), -1)) if len(closed) else np.zeros(0, np.int64)
    last = np.concatenate(([-1], at))  # the last settling line before each place
    base = np.where(last >= 0, closed[last], first) if len(closed) else np.array([first])
    since = turns - turns[last + 1]
    return base ^ (since % 2 == 1)


class _Split:
    """What is known of a split while its lines come in batches."""

    def __init__(self, path: str, block: int):
        self.path, self.block = path, block
        self.known = block == 0  # a file begins outside of quotes
        self.state = False  # of the known part
        self.parity, self.settled = 0, None
        self.last = [None, None]  # places of the last lines with parity 0 and 1
        self.opened = None  # place of the last record of the known part
        self.lines: list[str] = []  # of a record that is not complete yet
        self.header = block == 0  # still to come
        self.head = False

    def rows(self, kind: int, **columns) -> pa.RecordBatch:
        n = len(columns["at"])
        fixed = {"path": [self.path] * n, "block": [self.block] * n, "kind": [kind] * n}
        arrays = []
        for field in _SCHEMA:
            values = fixed.get(field.name, columns.get(field.name))
            if values is None:
                values = [False] * n if field.name == "head" else [None] * n
            arrays.append(values.cast(field.type) if isinstance(values, pa.Array) else pa.array(values, field.type))
        return pa.RecordBatch.from_arrays(arrays, schema=_SCHEMA)

    def add(self, at: np.ndarray, lines: pa.Array, closed: np.ndarray, opened: np.ndarray) -> Iterator[pa.RecordBatch]:
        first = 0
        if not self.known:
            first = self._unknown_until(closed, opened)
            if first:
                yield self._unknown(at[:first], lines[:first], closed[:first], opened[:first])
        if first < len(at):
            yield from self._records(at[first:], lines[first:], closed[first:], opened[first:])

    def _unknown_until(self, closed: np.ndarray, opened: np.ndarray) -> int:
        """The number of lines before the first that certainly opens a record."""
        first = 0
        if self.settled is None:
            settles = np.flatnonzero(closed == opened)
            if not len(settles):
                return len(closed)
            first = int(settles[0]) + 1
            if not closed[first - 1]:
                return first
        after = np.flatnonzero(~opened[first:])  # the open cell ends
        return first + int(after[0]) + 1 if len(after) else len(closed)

    def _unknown(self, at, lines, closed, opened) -> pa.RecordBatch:
        n = len(at)
        parity = np.full(n, 2)
        if self.settled is None:
            settles = np.flatnonzero(closed == opened)
            end = int(settles[0]) + 1 if len(settles) else n
            turns = np.concatenate(([0], np.cumsum(closed[:end] & ~opened[:end])))
            parity[:end] = (self.parity + turns[:end]) % 2
            if len(settles):
                self.settled = True
                self.state = bool(closed[end - 1])
            else:
                self.parity = int((self.parity + turns[end]) % 2)
        if self.settled and n and parity[-1] == 2:
            self.state = bool(opened[-1])
        self.known = bool(self.settled) and not self.state
        lasts = []
        for k in (0, 1):
            here = np.where(parity == k, at, -1)
            places = np.maximum.accumulate(np.concatenate(([-1 if self.last[k] is None else self.last[k]], here)))[1:]
            self.last[k] = int(places[-1]) if places[-1] >= 0 else None
            lasts.append(pa.array(places, mask=places < 0))
        return self.rows(
            UNKNOWN, at=pa.array(at), line=lines, parity=pa.array(parity), from_closed=pa.array(closed),
            from_open=pa.array(opened), last_if_closed=lasts[0], last_if_open=lasts[1],
        )

    def _records(self, at, lines, closed, opened) -> Iterator[pa.RecordBatch]:
        states = _states(self.state, closed, opened)
        begin = np.flatnonzero(~states[:-1])
        self.state = bool(states[-1])
        if not len(begin):
            self.lines += lines.to_pylist()
            return
        places, texts = [], []
        if self.lines:  # the record that was open before these lines
            places.append(self.opened)
            texts.append("\n".join(self.lines + lines[: begin[0]].to_pylist()))
            self.lines = []
        ends = np.append(begin[1:], len(at))
        if self.state:
            self.lines = lines[begin[-1] :].to_pylist()
            begin, ends = begin[:-1], ends[:-1]
            self.opened = int(at[len(at) - len(self.lines)])
        elif len(begin):
            self.opened = int(at[begin[-1]])
        single = ends - begin == 1
        for b, e in zip(begin[~single], ends[~single]):
            places.append(int(at[b]))
            texts.append("\n".join(lines[b:e].to_pylist()))
        alone = lines.take(pa.array(begin[single]))
        place = np.concatenate([np.array(places, np.int64), at[begin[single]]])
        text = pa.concat_arrays([pa.array(texts, pa.string()), alone.cast(pa.string())])
        head = np.zeros(len(place), bool)
        if self.header:
            # the first record with a line that is not blank; the order is that of the places
            for i in np.argsort(place):
                if text[i].as_py().replace("\n", "").strip(" \r"):
                    head[i], self.header = True, False
                    break
            if self.header and any(x.strip(" \r") for x in self.lines):
                self.head, self.header = True, False
        if len(place):
            yield self.rows(RECORD, at=pa.array(place), line=text, head=pa.array(head))

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.lines:
            if self.header and any(x.strip(" \r") for x in self.lines):
                self.head = True
            yield self.rows(TAIL, at=[self.opened], record=[self.opened], line=["\n".join(self.lines)], head=[self.head])
        if self.known or self.settled:
            after = [self.state, self.state]
        else:
            after = [self.parity == 1, self.parity == 0]
        lasts = [x if self.opened is None else self.opened for x in self.last]
        yield self.rows(
            SPLIT, at=[self.block], from_closed=after[:1], from_open=after[1:], last_if_closed=lasts[:1], last_if_open=lasts[1:],
        )


def split_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of the splits of a task, from lines (path, block, at, line, from_closed, from_open) in order."""
    split = None
    for batch in batches:
        blocks = batch.column("block").to_numpy()
        paths = batch.column("path").dictionary_encode()
        codes = paths.indices.to_numpy()
        change = np.flatnonzero((blocks[1:] != blocks[:-1]) | (codes[1:] != codes[:-1])) + 1
        for first, last in zip([0, *change], [*change, batch.num_rows]):
            if first == last:
                continue
            path, block = batch.column("path")[first].as_py(), int(blocks[first])
            if split is None or (split.path, split.block) != (path, block):
                if split is not None:
                    yield from split.end()
                split = _Split(path, block)
            part = batch.slice(first, last - first)
            flags = [part.column(x).to_numpy(zero_copy_only=False).astype(bool) for x in ("from_closed", "from_open")]
            yield from split.add(part.column("at").to_numpy(), part.column("line"), *flags)
    if split is not None:
        yield from split.end()
