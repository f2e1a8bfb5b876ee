"""Token counts by rank-synchronous merging of ragged arrays.

Texts are cut into pre-tokens. The different pre-tokens of some megabytes of text that a worker
has not met lately are merged together (``merges.Merges.merge``); only the number of symbols that
survive is used. Counts of met pre-tokens are kept in a dictionary of bounded size.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from reviewmill.llm import common as c
from reviewmill.llm import merges

#: Pre-tokens whose counts a worker keeps.
KEPT_WORDS = 300_000
#: Words of the tokenizer's own pattern (a fixed value of its file): contractions, letter runs,
#: single numerals, runs of anything else that is not white space.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Upper case letters whose lower case Python's tables lack or see differently (fixed values).
_LOWER = [("\u03a3", "\u03c3"), ("\ua7cb", "\u0264"), ("\ua7dc", "\u019b")]


def normalized(text: str) -> str:
    """Composed form, then lower case of each character by itself."""
    composed = text if text.isascii() else unicodedata.normalize("NFC", text)
    for upper, lower in () if text.isascii() else _LOWER:
        composed = composed.replace(upper, lower)
    return composed.lower()


class Counter:
    """Counts tokens of texts; keeps what it has counted."""

    def __init__(self, path: str, kept: int = KEPT_WORDS):
        self.merges = merges.load(path)
        self.special = merges.special_pattern(tuple(self.merges.special))
        self.kept, self.size = {}, kept

    def pieces(self, text: str) -> tuple[list[str], int]:
        """(pre-tokens, number of special tokens)."""
        if self.special is None or not self.special.search(text):
            return PATTERN.findall(normalized(text)), 0
        parts = self.special.split(text)
        words = [w for part in parts[::2] for w in PATTERN.findall(normalized(part))]
        return words, len(parts) // 2

    def count(self, texts: list[str]) -> list[int]:
        cut = [self.pieces(t) for t in texts]
        if len(self.kept) > self.size:
            self.kept.clear()
        known = self.kept
        new = list({w for words, _ in cut for w in words if w not in known})
        _, sizes = self.merges.merge([w.encode() for w in new])
        known.update(zip(new, sizes.tolist()))
        return [sum(map(known.__getitem__, words)) + extra for words, extra in cut]


_COUNTERS: dict[str, Counter] = {}


def count_tokens(df: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """Count the tokens of each whole text with the tokenizer file at this path.

    Adds ``n_bytes`` (UTF-8) and ``n_tokens``; other columns stay, columns of these names are
    replaced. Special tokens are not added; where their strings stand in a text they count as one.
    Null and empty texts have none. The path must exist on all machines.
    """

    def run(column: pa.Array) -> list[pa.Array]:
        counter = _COUNTERS.get(tokenizer) or _COUNTERS.setdefault(tokenizer, Counter(tokenizer))
        texts = [t.as_py() or "" for t in column]
        sizes = [len(t.encode()) for t in texts]
        return [pa.array(sizes, pa.int64()), pa.array(counter.count(texts), pa.int64())]

    return c.add_columns(df, text_col, "n_bytes bigint, n_tokens bigint", run)
