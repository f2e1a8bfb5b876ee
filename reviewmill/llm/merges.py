"""Byte-pair merges of many words at once, as ragged numpy arrays.

All words' symbols stand in one array. A round looks up the rank of every neighbouring pair, takes
each word's lowest, joins all its occurrences (from the left where they overlap) and goes on until
no pair of any word has a rank. A word is therefore merged exactly as one pair at a time would.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import regex

_NONE = np.int64(1) << 62
_MULTIPLIERS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93]


class Lookup:
    """Values by 64-bit keys in open hash tables: what collides in one goes to a smaller next one."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.levels = []
        keys, values = keys.astype(np.uint64), values.astype(np.int64)
        while len(keys) or not self.levels:
            bits = max(4, int(len(keys) * 8).bit_length())
            factor = np.uint64(_MULTIPLIERS[len(self.levels) % 4] + 2 * (len(self.levels) // 4))
            shift = np.uint64(64 - bits)
            slot = (keys * factor >> shift).astype(np.int64)
            _, first = np.unique(slot, return_index=True)
            held = np.full(1 << bits, np.iinfo(np.uint64).max, np.uint64)
            found = np.full(1 << bits, -1, np.int64)
            held[slot[first]], found[slot[first]] = keys[first], values[first]
            rest = np.ones(len(keys), bool)
            rest[first] = False
            full = np.zeros(1 << bits, bool)
            full[slot[rest]] = True
            self.levels.append((factor, shift, held, found, full))
            keys, values = keys[rest], values[rest]

    def get(self, keys: np.ndarray, level: int = 0) -> np.ndarray:
        """The values, -1 for unknown keys."""
        factor, shift, held, found, full = self.levels[level]
        slot = (keys * factor >> shift).astype(np.int64)
        out = np.where(held[slot] == keys, found[slot], -1)
        if level + 1 < len(self.levels):
            more = np.flatnonzero((out < 0) & full[slot])
            if len(more):
                out[more] = self.get(keys[more], level + 1)
        return out


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the slices (start, length), one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary files.

    Printable Latin-1 characters stand for themselves, the others for the letters from 256 on.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


class Merges:
    """The vocabulary and merge table of a byte-pair tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        letters = byte_letters()
        self.inner = np.array([vocab[x] for x in letters], np.int64)
        self.last = np.array([vocab[x + suffix] for x in letters], np.int64)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.joined = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.ranks = Lookup(self._key(left, right), np.arange(len(pairs)))
        # a merge after which a pair of lower rank may turn up: its occurrences go one by one
        least = np.full(max(vocab.values()) + 1, len(pairs))
        np.minimum.at(least, np.concatenate([left, right]), np.tile(np.arange(len(pairs)), 2))
        self.single = least[self.joined] < np.arange(len(pairs))
        back = {x: b for b, x in enumerate(letters)}
        self.bytes_of = {
            i: bytes(back[x] for x in (t[: -len(suffix)] if suffix and t.endswith(suffix) else t))
            for t, i in vocab.items()
        } | {i: t.encode() for t, i in self.special.items()}

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left << 32 | right).astype(np.uint64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        found = self.ranks.get(self._key(left, right))
        return np.where(found < 0, _NONE, found)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, number of symbols per word); no word is empty."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.inner[raw]
        ends = np.cumsum(sizes) - 1
        symbols[ends] = self.last[raw[ends]]
        word = np.repeat(np.arange(len(words)), sizes)
        rank = np.full(len(symbols), _NONE)
        inside = np.flatnonzero(word[:-1] == word[1:])
        rank[inside] = self._rank(symbols[inside], symbols[inside + 1])
        done_symbols, done_words = [], []
        while len(symbols):
            begin = np.flatnonzero(np.diff(word, prepend=-1))
            best = np.minimum.reduceat(rank, begin)
            lengths = np.diff(np.append(begin, len(symbols)))
            active = np.repeat(best < _NONE, lengths)
            if not active.all():  # words without a pair are done
                done_symbols.append(symbols[~active])
                done_words.append(word[~active])
                symbols, word, rank = symbols[active], word[active], rank[active]
                lengths, best = lengths[best < _NONE], best[best < _NONE]
                if not len(symbols):
                    break
            chosen = rank == np.repeat(best, lengths)
            at = np.flatnonzero(chosen)
            run = np.diff(at, prepend=-2) != 1  # overlapping occurrences: every second, from the left
            since = at - at[np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))]
            at = at[since % 2 == 0]
            one = self.single[rank[at]]
            if one.any():
                at = at[~one | (np.diff(word[at], prepend=-1) != 0)]
            symbols[at] = self.joined[rank[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            moved = np.zeros(len(symbols), bool)
            moved[at] = True
            symbols, word, rank, moved = symbols[keep], word[keep], rank[keep], moved[keep]
            moved[:-1] |= moved[1:]  # the pair before a joined symbol is new as well
            look = np.flatnonzero(moved)
            rank[look] = _NONE
            look = look[look < len(symbols) - 1]
            look = look[word[look] == word[look + 1]]
            rank[look] = self._rank(symbols[look], symbols[look + 1])
        word, symbols = np.concatenate(done_words), np.concatenate(done_symbols)
        order = np.argsort(word, kind="stable")
        return symbols[order], np.bincount(word, minlength=len(words))


@lru_cache(maxsize=4)
def load(path: str) -> Merges:
    return Merges(path)


@lru_cache(maxsize=8)
def special_pattern(specials: tuple[str, ...]):
    """Splits a text at its special tokens and keeps them; None if there are none."""
    found = "|".join(regex.escape(s) for s in sorted(specials, key=len, reverse=True))
    return regex.compile(f"({found})") if specials else None
