"""Language-model scores by a weighted backoff automaton.

The model has n-grams up to an order, with Dirichlet smoothing over add-one unigrams. h' is the
context h without its first token; a text starts in the context of a start mark:

    P(v)     = (c(v) + 1) / (N + V + 1)
    P(v | h) = (c(h v) + strength * P(v | h')) / (c(h) + strength)

As an automaton: the states are the seen contexts of up to order - 1 tokens. A state has an arc for
each token seen after it, which costs log10 P(v | h) and leads to the longest seen context that ends
with the token, and a failure arc to the state of h' that costs log10(strength / (c(h) + strength)).
The root, the empty context, has an arc for every token. A text is read once from left to right: the
state is carried, failure arcs are followed until there is an arc for the token, costs are added up.

Counts are over all training documents. They never meet in one place: chunks of documents send
their distinct n-grams with counts through a packed exchange and get back the corpus counts of
just these, which is the part of the automaton that their texts can reach.

Tokens and n-grams are known by hashes of 55 bits and not compared as text: among n different ones,
about n / 2**55 share their count with another (1e-7 of them on 30 GB of text).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewmill.llm import common as c

STRENGTH = 100.0
# Tokens of the longest n-gram.
ORDER = 3
# Long texts are read as lanes of this many tokens, side by side.
LANE = 512
_ODD = np.uint64(0x9FB21C651E98DF25)
# The low bits that a key leaves out, and the bit that tells an n-gram from a word.
_CUT = np.uint64(8)
_TAG = np.uint64(1 << 8)
_HASH = ~np.uint64((1 << 9) - 1)


class Tokens:
    """Tokens of a chunk, lower-cased words and one end per text, and the n-grams that end at each.

    ``grams[m]`` has the number of the n-gram of m tokens that ends at a token, -1 where there is
    none; the start mark counts as a token before the first one. ``keys`` are their hashes.
    """

    def __init__(self, texts: pa.Array, order: int):
        found = c.Texts(texts, lower=True)
        n = len(texts)
        self.order = order
        self.lengths = found.counts + 1
        hashes = np.full(len(found.words) + n, c.END_WORD, np.uint64)
        hashes[np.arange(len(found.words)) + found.doc] = found.words
        self.doc = np.repeat(np.arange(n), self.lengths)
        self.begin = np.cumsum(self.lengths) - self.lengths
        place = np.arange(len(hashes)) - self.begin[self.doc]
        sizes, at = [hashes & _HASH], [np.arange(len(hashes))]
        ending = hashes
        for size in range(2, order + 1):
            before = np.roll(ending, 1)
            if size == 2:
                before[self.begin] = ~c.END_WORD  # the start of a text
            ending = c.mix(before * _ODD + hashes)
            at.append(np.flatnonzero(place >= size - 2))
            sizes.append(ending[at[-1]] & _HASH | _TAG)
        self.keys, which = np.unique(np.concatenate(sizes), return_inverse=True)
        self.grams = np.full((order + 1, len(hashes)), -1, np.int32)
        for size, (where, part) in enumerate(zip(at, np.split(which, np.cumsum([len(x) for x in at[:-1]]))), 1):
            self.grams[size, where] = part

    def counts(self, train: pa.Array) -> np.ndarray:
        """How often each key occurs in the chunk's training texts."""
        trained = self.grams[1:, np.asarray(train).astype(bool)[self.doc]]
        return np.bincount(trained[trained >= 0], minlength=len(self.keys))

    def contexts(self, size: int) -> np.ndarray:
        """The n-gram of ``size`` tokens before each token."""
        before = np.roll(self.grams[size], 1)
        if size == 1:  # a text starts as often as one ends
            before[self.begin] = self.grams[1, self.begin + self.lengths - 1]
        return before

    def lanes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Where to start to read, the first token that counts, the end, whether it starts a text.

        The state depends on the order - 1 tokens before, so a lane reads these first, from the root.
        """
        number = -(-self.lengths // LANE)
        text = np.repeat(np.arange(len(number)), number)
        first = self.begin[text] + LANE * (np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number))
        stop = np.minimum(first + LANE, self.begin[text] + self.lengths[text])
        start = np.maximum(first - (self.order - 1), self.begin[text])
        longest = np.argsort(start - stop, kind="stable")
        return start[longest], first[longest], stop[longest], (start == self.begin[text])[longest]


class Automaton:
    """The states and arcs that a chunk can reach. Weights are log10 probabilities."""

    def __init__(self, counts: np.ndarray, t: Tokens, tokens: int, types: int, strength: float):
        self.seen = counts > 0
        self.failure = np.log10(strength / (counts + strength))
        chance = (counts + 1.0) / (tokens + types + 1.0)
        self.root = np.log10(chance)
        self.context = [None]
        for size in range(2, t.order + 1):
            self.context.append(t.contexts(size - 1))
            at = np.flatnonzero(t.grams[size] >= 0)
            gram, shorter, held = t.grams[size, at], t.grams[size - 1, at], self.context[-1][at]
            chance[gram] = (counts[gram] + strength * chance[shorter]) / (counts[held] + strength)
        self.arc = np.log10(chance)

    def traverse(self, t: Tokens) -> np.ndarray:
        """The weight of each token; the state of a lane is the length of its context."""
        weight = np.zeros(t.grams.shape[1])
        start, first, stop, fresh = t.lanes()
        lengths = stop - start
        state = np.where(fresh, min(1, t.order - 1), 0)
        for step in range(int(lengths.max(initial=0))):
            reading = int(np.searchsorted(-lengths, -step))  # the longest lanes come first
            at, held = start[:reading] + step, state[:reading]
            cost = np.zeros(reading)
            for size in range(t.order - 1, 0, -1):
                there = np.flatnonzero(held == size)
                fails = there[~self.seen[t.grams[size + 1, at[there]]]]
                cost[fails] += self.failure[self.context[size][at[fails]]]
                held[fails] = size - 1
            gram = t.grams[held + 1, at]
            cost += self.arc[gram]
            state[:reading] = np.where(self.seen[gram], np.minimum(held + 1, t.order - 1), 0)
            counts = at >= first[:reading]
            weight[at[counts]] = cost[counts]
        return weight


def _packed(keys: np.ndarray) -> bytes:
    """Sorted keys as the first and the gaps, in as many bytes each as the largest gap needs."""
    gaps = np.diff(keys) >> _CUT
    width = (int(gaps.max()).bit_length() + 7) // 8 if len(gaps) else 0
    low = gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + keys[:1].astype("<u8").tobytes() + low.tobytes()


def _unpacked(raw) -> np.ndarray:
    raw = bytes(raw)
    width = raw[0]
    low = np.frombuffer(raw, np.uint8, offset=9).reshape(-1, width) if width else np.zeros((0, 0), np.uint8)
    gaps = np.zeros((len(low), 8), np.uint8)
    gaps[:, :width] = low
    first = np.frombuffer(raw, "<u8", 1, 1)
    return np.cumsum(np.concatenate([first, gaps.reshape(-1).view("<u8") << _CUT]), dtype=np.uint64)


def _small(values: np.ndarray) -> bytes:
    """Counts in four bits each, zstd on top. 15 stands for those that follow, as wide as the largest."""
    low = np.minimum(values, 15).astype(np.uint8)
    low = np.append(low, np.zeros(len(low) % 2, np.uint8))
    high = values[values >= 15]
    kind = np.min_scalar_type(int(high.max()) if len(high) else 0)
    body = bytes([kind.itemsize]) + (low[::2] | low[1::2] << 4).tobytes() + high.astype(kind).tobytes()
    return len(body).to_bytes(8, "little") + pa.compress(body, codec="zstd", asbytes=True)


def _wide(raw, n: int) -> np.ndarray:
    """The ``n`` counts of ``_small``."""
    raw = bytes(raw)
    body = pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True)
    pairs = np.frombuffer(body, np.uint8, (n + 1) // 2, 1)
    counts = np.stack([pairs & 15, pairs >> 4], axis=1).reshape(-1)[:n].astype(np.int64)
    counts[counts == 15] = np.frombuffer(body, f"u{body[0]}", offset=1 + len(pairs))
    return counts


def score_texts(
    df: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text",
    strength: float = STRENGTH, order: int = ORDER,
) -> DataFrame:
    """Score every text by a model of the rows where ``train`` is true, with n-grams up to ``order``.

    Tokens are the lower-cased (A-Z) words between ASCII white space, then one end. Returns id,
    ``trained``, ``n_tokens``, ``n_known`` (tokens seen in training), ``train_tokens``,
    ``base_score`` (add-one unigrams) and ``score``, one row per input row. A null or empty text is
    one end. A null ``train`` counts as false. Without training rows every token is unknown.
    Repeated rows count as often as they occur. Other columns are not read.
    """
    docs = df.select(
        F.col(id_col).alias("id"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text_col).alias("text")
    )
    chunks = c.chunk_table(docs, "lm", ["id", "train", "text"])
    buckets = c.bucket_count(chunks)

    def count(row: pa.RecordBatch):
        t = Tokens(c.listed(row, "text"), order)
        n = t.counts(c.listed(row, "train"))
        bounds = c.split(t.keys, buckets)
        return [
            (b, _packed(t.keys[s:e]), _small(n[s:e]))
            for b, (s, e) in enumerate(zip(bounds[:-1], bounds[1:])) if e > s
        ]

    def total(table: pa.Table) -> pa.Table:
        keys = [_unpacked(x.as_buffer()) for x in table["keys"]]
        every, where = np.unique(np.concatenate(keys), return_inverse=True)
        counts = np.concatenate([_wide(x.as_buffer(), len(k)) for x, k in zip(table["extra"], keys)])
        sums = np.zeros(len(every), np.int64)
        np.add.at(sums, where, counts)
        words = sums[every & _TAG == 0]
        stats = np.zeros((2, table.num_rows), np.int64)
        stats[:, 0] = words.sum(), (words > 0).sum()
        ends = np.cumsum([len(k) for k in keys])
        # A chunk knows its own counts: what the others add is zero for most n-grams.
        back = [_small(x) for x in np.split(sums[where] - counts, ends[:-1])]
        return pa.Table.from_arrays(
            [table["chunk"], table["bucket"], c.binaries(back), pa.array(stats[0]), pa.array(stats[1])],
            names=["chunk", "bucket", "back", "tokens", "types"])

    replies = c.stored(
        c.send(chunks, count).groupBy("bucket").applyInArrow(
            total, "chunk bigint, bucket int, back binary, tokens bigint, types bigint"
        ),
        "lm-counts",
    )
    tokens, types = (int(x or 0) for x in replies.agg(F.sum("tokens"), F.sum("types")).first())

    def read(row: pa.RecordBatch, back):
        t = Tokens(c.listed(row, "text"), order)
        n = len(t.lengths)
        counts = t.counts(c.listed(row, "train"))
        bounds = c.split(t.keys, buckets)
        for b, raw in back.items():
            counts[bounds[b] : bounds[b + 1]] += _wide(raw, bounds[b + 1] - bounds[b])
        model = Automaton(counts, t, tokens, types, strength)
        score = np.add.reduceat(model.traverse(t), t.begin)
        base = np.add.reduceat(model.root[t.grams[1]], t.begin)
        known = np.add.reduceat(model.seen[t.grams[1]].astype(np.int64), t.begin)
        return pa.RecordBatch.from_arrays(
            [c.listed(row, "id"), c.listed(row, "train"), pa.array(t.lengths, pa.int64()), pa.array(known),
             pa.array(np.full(n, tokens)), pa.array(base), pa.array(score)],
            names=["id", "trained", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = dict(docs.dtypes)["id"]
    out = c.resume(
        chunks, replies.select("chunk", "bucket", "back"), read,
        f"id {kind}, trained boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
        "base_score double, score double",
    )
    return out.withColumnRenamed("id", id_col)
