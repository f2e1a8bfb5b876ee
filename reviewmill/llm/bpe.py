"""Byte-level BPE with a lexicon in a minimal acyclic transducer.

Frequent words (the vocabulary's own and those that are frequent in the corpus) are compiled, with
their ids, into an automaton that shares prefixes and suffixes. Each arc carries a number; the sum
along a word is the word's place in the table of id sequences. The arrays are one file that
executors fetch and map into memory, so that their workers share the pages. A batch's different
words walk the automaton side by side, a byte a step; unseen words are merged exactly.
"""

from __future__ import annotations

import io
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewmill.llm import common as c
from reviewmill.llm import merges
from reviewmill.llm.merges import Lookup, Merges, ragged

#: Words that make up this share of the corpus go into the lexicon, so at most 50,000 do. This
#: bounds the lexicon, not the result.
FREQUENT_SHARE = 1 / 50_000
#: The tokenizer's own word pattern (a fixed value): contractions; letters, numerals or other
#: characters with at most one space before; white space.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


# --- the automaton -----------------------------------------------------------


class Transducer:
    """A minimal automaton of words that numbers them in sorted order."""

    NAMES = ("arc_keys", "arc_targets", "arc_adds", "finals", "offsets", "ids")

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.arrays = arrays
        self.finals, self.offsets, self.ids = arrays["finals"], arrays["offsets"], arrays["ids"]
        self.arcs = Lookup(arrays["arc_keys"], np.arange(len(arrays["arc_keys"])))

    @classmethod
    def compile(cls, words: list[bytes], ids: np.ndarray, lengths: np.ndarray) -> Transducer:
        """From sorted distinct words; ``ids`` holds their id sequences one after the other."""
        register: dict[tuple, int] = {}
        arcs: list[list[tuple[int, int]]] = []
        ending: list[bool] = []
        count: list[int] = []
        path: list[tuple[list, bool]] = [([], False)]  # the open states along the last word

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                out, final = path.pop()
                key = (final, tuple(out))
                state = register.get(key)
                if state is None:
                    state = register[key] = len(arcs)
                    arcs.append(out)
                    ending.append(final)
                    count.append(final + sum(count[t] for _, t in out))
                path[-1][0].append((last[len(path) - 1], state))

        last = b""
        for word in words:
            common = 0
            while common < min(len(word), len(last)) and word[common] == last[common]:
                common += 1
            close(common)
            path.extend(([], False) for _ in word[common:])
            path[-1] = (path[-1][0], True)
            last = word
        close(0)
        arcs.append(path[0][0])
        ending.append(path[0][1])
        root = len(arcs) - 1
        keys, targets, adds = [], [], []
        for state, out in enumerate(arcs):
            before = int(ending[state])
            for byte, target in out:
                number = (0 if state == root else state + 1) << 8 | byte
                keys.append(number)
                targets.append(target + 1)
                adds.append(before)
                before += count[target]
        finals = np.array([ending[root], *ending[:-1]], bool)
        return cls({
            "arc_keys": np.array(keys, np.uint64), "arc_targets": np.array(targets, np.int64),
            "arc_adds": np.array(adds, np.int64), "finals": finals,
            "offsets": np.concatenate(([0], np.cumsum(lengths))).astype(np.int64), "ids": ids.astype(np.int32),
        })

    def find(self, words: list[bytes]) -> np.ndarray:
        """Each word's number, -1 for unseen words. All words take a step at a time."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(sizes) - sizes
        out = np.full(len(words), -1, np.int64)
        at = np.arange(len(words))
        state, number = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        step = 0
        while len(at):
            over = sizes[at] == step
            here = over & self.finals[state]
            out[at[here]] = number[here]
            at, state, number = at[~over], state[~over], number[~over]
            arc = self.arcs.get((state << 8 | raw[begin[at] + step]).astype(np.uint64))
            on = arc >= 0
            at, arc = at[on], arc[on]
            state, number = self.arrays["arc_targets"][arc], number[on] + self.arrays["arc_adds"][arc]
            step += 1
        return out

    def dump(self) -> bytes:
        """All arrays in one file that can be mapped."""
        head, body = [], io.BytesIO()
        for name in self.NAMES:
            body.write(b"\0" * (-body.tell() % 64))
            head.append(f"{name} {self.arrays[name].dtype.str} {body.tell()} {len(self.arrays[name])}")
            body.write(self.arrays[name].tobytes())
        text = ";".join(head).encode().ljust(1024)
        return text + body.getvalue()

    @classmethod
    def map(cls, path: str) -> Transducer:
        """Open a dumped file without reading it."""
        mapped = np.memmap(path, np.uint8, "r")
        arrays = {}
        for field in bytes(mapped[:1024]).decode().strip().split(";"):
            name, kind, start, size = field.split(" ")
            width = np.dtype(kind).itemsize
            arrays[name] = mapped[1024 + int(start) : 1024 + int(start) + int(size) * width].view(kind)
        return cls(arrays)


# --- the lexicon -------------------------------------------------------------


def corpus_words(df: DataFrame, text_col: str, share: float) -> list[str]:
    """The blank-separated words that make up at least ``share`` of the words of all texts.

    A partition reports the words that have this share of its own words, and how many words it has.
    Any word with the share in the corpus has it in some partition; partitions where it is rarer
    are not counted, so a word just at the limit may be missed, which costs time only.
    """

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        total = 0

        def report(counts, total):
            found = [(w, n) for w, n in counts.items() if n >= max(2, share * total)]
            return pa.RecordBatch.from_arrays(
                [pa.array([None, *(w for w, _ in found)], pa.string()),
                 pa.array([total, *(n for _, n in found)], pa.int64())],
                names=["word", "n"])

        for batch in batches:
            for text in batch.column(0):
                words = (text.as_py() or "").split()
                counts.update(words)
                total += len(words)
                if len(counts) > 200_000:  # what is held counts as a partition
                    yield report(counts, total)
                    counts, total = Counter(), 0
        yield report(counts, total)

    found = df.select(text_col).mapInArrow(tally, "word string, n bigint")
    counts = c.stored(found.groupBy("word").agg(F.sum("n").alias("n")), "words")
    total = counts.where("word IS NULL").agg(F.sum("n")).first()[0] or 0
    # at most 1 / share rows
    return [r["word"] for r in counts.where(F.col("word").isNotNull() & (F.col("n") >= share * total)).collect()]


def build_lexicon(tokenizer: Merges, words: list[str]) -> Transducer:
    """Compile the vocabulary's whole words and the pre-tokens of these words with their ids."""
    own = []
    for raw in tokenizer.bytes_of.values():
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            continue
        if PATTERN.findall(text) == [text]:
            own.append(raw)
    cut = {p for w in words for p in PATTERN.findall(" " + w) + PATTERN.findall(w)}
    every = sorted({*own, *(p.encode() for p in cut)})
    ids, lengths = tokenizer.merge(every)
    return Transducer.compile(every, ids, lengths)


# --- encoding ----------------------------------------------------------------


class Encoder:
    def __init__(self, tokenizer: Merges, lexicon: Transducer):
        self.tokenizer, self.lexicon = tokenizer, lexicon
        self.special = merges.special_pattern(tuple(tokenizer.special))

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens; special tokens are pieces of their own."""
        if self.special is None or not self.special.search(text):
            return PATTERN.findall(text)
        parts = self.special.split(text)
        return [w for i, part in enumerate(parts) for w in ((part, ) if i % 2 else PATTERN.findall(part))]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids per text)."""
        cut = [self.pieces(t) for t in texts]
        number: dict[str, int] = {}
        codes = np.array([number.setdefault(w, len(number)) for words in cut for w in words], np.int64)
        words = [w.encode() for w in number]
        place = self.lexicon.find(words) if words else np.zeros(0, np.int64)
        for text, code in self.tokenizer.special.items():
            if text in number:
                place[number[text]] = -2 - code
        unseen = np.flatnonzero(place == -1)
        merged, sizes = self.tokenizer.merge([words[i] for i in unseen])
        special = np.flatnonzero(place < -1)
        lexicon, offsets = self.lexicon.ids, self.lexicon.offsets
        pool = np.concatenate([lexicon, merged.astype(np.int32), (-2 - place[special]).astype(np.int32)])
        start, length = np.zeros(len(words), np.int64), np.ones(len(words), np.int64)
        seen = np.flatnonzero(place >= 0)
        start[seen] = offsets[place[seen]]
        length[seen] = offsets[place[seen] + 1] - start[seen]
        start[unseen] = len(lexicon) + np.cumsum(sizes) - sizes
        length[unseen] = sizes
        start[special] = len(lexicon) + len(merged) + np.arange(len(special))
        ids = pool[ragged(start[codes], length[codes])]
        doc = np.repeat(np.arange(len(texts)), [len(words) for words in cut])
        return ids, np.bincount(doc, weights=length[codes], minlength=len(texts)).astype(np.int64)


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def _encoder(path: str, lexicon: str) -> Encoder:
    if (path, lexicon) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path, lexicon] = Encoder(merges.load(path), Transducer.map(c.shipped(lexicon)))
    return _ENCODERS[path, lexicon]


def encode(
    df: DataFrame, tokenizer: str, text_col: str = "text", ids_col: str = "ids",
    share: float = FREQUENT_SHARE,
) -> DataFrame:
    """Add the token ids of each whole text, as an array column.

    ``tokenizer`` is the path of a byte-level tokenizer file that all machines have. A null text is
    empty and has no ids. Special tokens are not added; their strings in a text are their ids.
    All rows and other columns stay; a column named ``ids_col`` is replaced.
    """
    words = corpus_words(df, text_col, share)
    lexicon = c.ship(df.sparkSession, "lexicon", build_lexicon(merges.load(tokenizer), words).dump())

    def run(column: pa.Array) -> list[pa.Array]:
        ids, sizes = _encoder(tokenizer, lexicon).encode([t.as_py() or "" for t in column])
        ends = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
        return [pa.ListArray.from_arrays(ends, pa.array(ids, pa.int32()))]

    return c.add_columns(df, text_col, f"{ids_col} array<int>", run)


@lru_cache(maxsize=4)
def _cells(path: str) -> list[bytes]:
    """The bytes of every id; the last entry is for unknown ids."""
    table = merges.load(path).bytes_of
    return [table.get(i, b"") for i in range(max(table) + 2)]


def decode(df: DataFrame, tokenizer: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """Add the text of each id array; null ids give an empty text, unknown ids nothing.

    Bytes that are not UTF-8 become replacement characters. A column named ``text_col`` is replaced.
    """

    def run(column: pa.Array) -> list[pa.Array]:
        cells = _cells(tokenizer)
        ids = column.flatten().to_numpy()
        ids = np.where((ids >= 0) & (ids < len(cells)), ids, len(cells) - 1).tolist()
        sizes = column.value_lengths().fill_null(0).to_numpy()
        texts = [
            b"".join(map(cells.__getitem__, ids[end - n : end])).decode("utf-8", "replace")
            for n, end in zip(sizes, np.cumsum(sizes))
        ]
        return [pa.array(texts, pa.string())]

    return c.add_columns(df, ids_col, f"{text_col} string", run)
