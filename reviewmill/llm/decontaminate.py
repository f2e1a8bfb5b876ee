"""Benchmark decontamination by Wu-Manber search, with words as the alphabet.

A pattern is a window of benchmark words; an item of fewer words is one pattern. Patterns of one
length are searched together: the last two words under the window choose a shift. A pair that is in
no pattern lets the search skip a whole window. A pair that ends patterns (shift 0) names a bucket
of them, the first word picks within it, and a direct comparison decides.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewmill.llm import common as c

WINDOW = 13
#: Bytes of benchmark text that are shipped and searched at once; more are searched in blocks.
BLOCK_BYTES = 16 << 20

_FOLD = bytes(
    b if chr(b).isdigit() or chr(b).islower() or b > 127 else b + 32 if chr(b).isupper() else 32
    for b in range(128)
) + bytes(range(128, 256))


def words_of(text: str | None) -> list[bytes]:
    """Words of ASCII letters, digits and all other characters beyond ASCII; A-Z in lower case."""
    return (text or "").encode().translate(_FOLD).split()


class Matcher:
    """Finds patterns of one length; a pattern is a distinct window with the numbers of its items."""

    def __init__(self, length: int, items: list[list[bytes]], ends: list[tuple[int, int]]):
        self.length = length
        self.block = min(2, length)
        self.shift: dict = {}
        self.buckets: dict = defaultdict(lambda: defaultdict(list))
        held: dict[tuple[bytes, ...], list[int]] = {}
        for item, end in ends:
            words, begin = items[item], end - length + 1
            pattern = tuple(words[begin : end + 1])
            of = held.get(pattern)
            if of is not None:
                if of[-1] != item:  # the ends of an item come one after the other
                    of.append(item)
                continue
            held[pattern] = [item]
            for last in range(begin + self.block - 1, end):
                key = tuple(words[last - self.block + 1 : last + 1])
                self.shift[key] = min(end - last, self.shift.get(key, length))
            key = tuple(words[end - self.block + 1 : end + 1])
            self.shift[key] = 0
            self.buckets[key][words[begin]].append((pattern, held[pattern]))

    def search(self, words: list[bytes]) -> Iterator[tuple[int, list[int]]]:
        """(position of the last word, items of the window) of each occurrence."""
        length, block, shift, skip = self.length, self.block, self.shift, self.length - self.block + 1
        at, n = length - 1, len(words)
        while at < n:
            key = (words[at - 1], words[at]) if block == 2 else (words[at],)
            step = shift.get(key, skip)
            if step:
                at += step
                continue
            begin = at - length + 1
            here = tuple(words[begin : at + 1])
            for pattern, items in self.buckets[key].get(words[begin], ()):
                if here == pattern:
                    yield at, items
                    break
            at += 1


class Searcher:
    """All matchers of a block of benchmark items."""

    def __init__(self, items: list[tuple[int | None, str | None]], window: int):
        self.ids = [item for item, _ in items]
        words = [words_of(text) for _, text in items]
        ends = defaultdict(list)
        for number, found in enumerate(words):
            length = min(window, len(found))
            for end in range(length - 1, len(found)) if length else ():
                ends[length].append((number, end))
        self.matchers = [Matcher(n, words, ends[n]) for n in sorted(ends)]

    def mark(self, words: list[bytes], hit: bytearray, items: set) -> None:
        for matcher in self.matchers:
            listed = set()  # a window is the same list each time
            for at, found in matcher.search(words):
                hit[at - matcher.length + 1 : at + 1] = b"\1" * matcher.length
                if id(found) not in listed:
                    listed.add(id(found))
                    items.update(self.ids[item] for item in found)


_LAST: dict[str, Searcher] = {}


def _searcher(name: str, window: int) -> Searcher:
    """The searcher of a shipped block; a worker keeps the last one."""
    if name not in _LAST:
        _LAST.clear()
        with open(c.shipped(name), "rb") as f:
            _LAST[name] = Searcher(pickle.load(f), window)
    return _LAST[name]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, limit: int) -> list[str]:
    """Ship the benchmark in files of about ``limit`` bytes; returns their names."""
    items = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).distinct()
    total = items.agg(F.sum(F.octet_length("text") + F.lit(16))).first()[0] or 0
    count = -(-total // limit)
    names = []
    for b in range(count):
        part = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(count)) == b)
        rows = sorted(((r["id"], r["text"]) for r in part.collect()), key=str)
        names.append(c.ship(items.sparkSession, "benchmark", pickle.dumps(rows)))
    return names


def find_passages(
    df: DataFrame, benchmark: DataFrame, text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES, prefix: str = "",
) -> DataFrame:
    """Mark the words of each text that lie in a benchmark window.

    Adds ``n_words``, ``n_hit``, ``spans`` (first and last word of each hit stretch) and ``items``
    (ids of the items found, sorted) to the rows; other columns stay, columns of these names are
    replaced (``prefix`` goes before them). Null and empty texts have no words; null and empty items no windows. An item without
    an id marks words but is not listed. Repeated items count once. An empty benchmark hits nothing.
    The benchmark is the query side: it is shipped in blocks of bounded size, each block searched
    while a batch of texts is in hand, so documents are read once and never shuffled.
    """
    names = _blocks(benchmark, item_col, item_text_col, block_bytes)
    text_items = dict(benchmark.dtypes)[item_col] == "string"
    span = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
    item_list = pa.list_(pa.string() if text_items else pa.int64())

    def search(column: pa.Array) -> list[pa.Array]:
        texts = [words_of(t.as_py()) for t in column]
        marks: dict[int, tuple[bytearray, set]] = {}
        for name in names:
            searcher = _searcher(name, window)
            for i, words in enumerate(texts):
                hit, items = marks.get(i) or (bytearray(len(words)), set())
                searcher.mark(words, hit, items)
                if items:
                    marks[i] = hit, items
        hits, spans, found = [0] * len(texts), [[]] * len(texts), [[]] * len(texts)
        for i, (hit, items) in marks.items():
            hits[i] = sum(hit)
            spans[i] = list(_stretches(hit))
            found[i] = sorted(x for x in items if x is not None)
        return [
            pa.array([len(w) for w in texts], pa.int64()), pa.array(hits, pa.int64()),
            pa.array(spans, span), pa.array(found, item_list),
        ]

    items = "string" if text_items else "bigint"
    return c.add_columns(
        df, text_col,
        f"{prefix}n_words bigint, {prefix}n_hit bigint, {prefix}spans array<struct<first:int,last:int>>, "
        f"{prefix}items array<{items}>",
        search,
        # a block of the benchmark is loaded for each part, so with several the parts are larger
        size=(1 << 20) if len(names) < 2 else (16 << 20),
    )


def _stretches(hit: bytearray) -> Iterator[dict[str, int]]:
    at = hit.find(1)
    while at >= 0:
        end = hit.find(0, at)
        end = len(hit) if end < 0 else end
        yield {"first": at, "last": end - 1}
        at = hit.find(1, end)


def contaminated(prefix: str = "") -> Column:
    """Something is hit, and it is at least a twentieth of the words."""
    hit, words = F.col(f"{prefix}n_hit"), F.col(f"{prefix}n_words")
    return (hit > 0) & (20 * hit >= words)
