"""Removal of repeated passages, found by fixed-block anchors.

A window is ``window`` neighbouring words of one document. Two equal windows share a whole block of
``window // 2`` words that starts at a multiple of that length in the earlier document. So:

1. Every document is cut into non-overlapping blocks (the index) and every rolling window of block
   length probes it. A packed exchange carries, per chunk of documents, the distinct hashes and
   whether a hash is a block; the answer is one bit per hash: a block that also occurs elsewhere.
   Short hashes do here, as a false anchor only costs a later look.
2. Around the anchors, full windows go into a second exchange (64-bit hash and its bucket). Chunks
   are in document order, so the answer is the windows that an earlier chunk has.
3. Hits next to each other join into maximal repeats, whose words go.

Nothing is kept per pair of places: a passage in a third of all documents is one entry per chunk.
Windows are told apart by 64-bit hashes of 64-bit word hashes, sent to buckets by the same hash.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewmill.llm import common as c

WINDOW = 20


def _anchors(texts: c.Texts, block: int, buckets: int):
    """(word positions, index into keys, sorted short hashes) of all rolling block-length windows."""
    at, h = texts.windows(block)
    bits = buckets.bit_length() - 1
    keys, which = np.unique(h >> np.uint64(32 - bits), return_inverse=True)
    return at, which, keys


def _rows(chunk_keys: np.ndarray, bounds: np.ndarray, extra: np.ndarray | None, kind: type):
    """The non-empty buckets of one chunk's sorted keys."""
    return [
        (b, chunk_keys[s:e].astype(kind).tobytes(), b"" if extra is None else extra[s:e].tobytes())
        for b, (s, e) in enumerate(zip(bounds[:-1], bounds[1:])) if e > s
    ]


def _bounds(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket bounds of short hashes: the bits above the lowest 32 are the bucket."""
    return np.searchsorted(keys, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(32))


def remove_repeats(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW
) -> DataFrame:
    """Drop every word covered by a window that also starts earlier (smaller id, or same text).

    Returns id, ``n_words``, ``n_removed``, ``spans`` (first and last word number of each removed
    stretch) and ``kept`` (remaining words, single spaces), one row per input row. A null or empty
    text, and one shorter than a window, loses nothing. Null ids come before all others. Rows that
    repeat an id are ordered by a hash of their text, and the later one counts as later. Other
    columns of the input are not read.
    """
    block = window // 2
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    order = ["id", "hash", "row"]  # the last two split the rows of one id; equal texts are alike
    keyed = docs.withColumn("hash", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    ordered = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    chunks = c.chunk_table(ordered, "substring", ["id", "text"])
    buckets = c.bucket_count(chunks)

    def probe(row: pa.RecordBatch):
        texts = c.Texts(c.listed(row, "text"))
        at, which, keys = _anchors(texts, block, buckets)
        flags = (np.bincount(which, minlength=len(keys)) > 1).astype(np.uint8) * 2
        flags[which[(at - texts.first[texts.doc[at]]) % block == 0]] |= 1
        return _rows(keys, _bounds(keys, buckets), flags, np.uint32)

    def meet(keys, flags, chunks_of):
        every, where = np.unique(np.concatenate(keys), return_inverse=True)
        flag = np.concatenate(flags)
        often = np.bincount(where, minlength=len(every)) > 1
        often[where[flag >= 2]] = True
        block_there = np.zeros(len(every), bool)
        block_there[where[flag & 1 == 1]] = True
        hot = (often & block_there)[where]
        ends = np.cumsum([len(k) for k in keys])
        return [np.packbits(part).tobytes() for part in np.split(hot, ends[:-1])]

    def widen(row: pa.RecordBatch, back):
        texts = c.Texts(c.listed(row, "text"))
        at, which, keys = _anchors(texts, block, buckets)
        hot = np.zeros(len(keys), bool)
        bounds = _bounds(keys, buckets)
        for b, bits in back.items():
            s, e = bounds[b], bounds[b + 1]
            hot[s:e] = np.unpackbits(np.frombuffer(bits, np.uint8), count=e - s)
        hits = np.zeros(len(texts.words) + window + 1, np.int64)
        hits[at + 1] = hot[which]
        before = np.cumsum(hits)
        where, h = texts.windows(window)
        near = before[where + window - block + 1] > before[where]
        found = np.unique(h[near])
        rows = _rows(found, c.split(found, buckets), None, np.uint64)
        chunk = row.column("chunk")[0].as_py()
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([chunk] * len(rows), pa.int64()),
             c.binaries([r[1] for r in rows]), c.binaries([r[2] for r in rows])],
            names=["bucket", "chunk", "keys", "extra"])

    def earlier(keys, _, chunks_of):
        together = np.concatenate(keys)
        _, first = np.unique(together, return_index=True)
        seen = np.ones(len(together), bool)
        seen[first] = False
        ends = np.cumsum([len(k) for k in keys])
        return [k[s].tobytes() for k, s in zip(keys, np.split(seen, ends[:-1]))]

    def cut(row: pa.RecordBatch, back):
        column = c.listed(row, "text")
        texts = c.Texts(column)
        where, h = texts.windows(window)
        _, first, which = np.unique(h, return_index=True, return_inverse=True)
        again = first[which] != np.arange(len(h))
        if back:
            again |= np.isin(h, np.concatenate([np.frombuffer(x, np.uint64) for x in back.values()]))
        edge = np.zeros(len(texts.words) + window + 1, np.int64)
        edge[where[again]] += 1
        edge[where[again] + window] -= 1
        gone = np.cumsum(edge)[: len(texts.words)] > 0
        kept, spans = [], []
        for i, text in enumerate(column):
            words = (text.as_py() or "").encode().split()
            mask = gone[texts.first[i] : texts.first[i + 1]]
            if mask.any():
                words = compress(words, ~mask)
                turn = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
                spans.append([{"first": int(a), "last": int(b) - 1} for a, b in turn.reshape(-1, 2)])
            else:
                spans.append([])
            kept.append(b" ".join(words).decode())
        removed = np.bincount(texts.doc[gone], minlength=len(column))
        return pa.RecordBatch.from_arrays(
            [c.listed(row, "id"), pa.array(texts.counts, pa.int64()), pa.array(removed, pa.int64()),
             pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))),
             pa.array(kept, pa.string())],
            names=["id", "n_words", "n_removed", "spans", "kept"])

    anchors = c.answer(c.send(chunks, probe), meet, np.uint8, np.uint32)
    windows = c.resume(chunks, anchors, widen, "bucket int, chunk bigint, keys binary, extra binary")
    seen = c.answer(windows, earlier, np.uint8)
    kind = dict(docs.dtypes)["id"]
    out = c.resume(
        chunks, seen, cut,
        f"id {kind}, n_words bigint, n_removed bigint, spans array<struct<first:int,last:int>>, kept string",
    )
    return out.withColumnRenamed("id", id_col)
