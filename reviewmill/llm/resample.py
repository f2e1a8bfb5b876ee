"""Importance resampling towards a target distribution, over hashed word n-grams.

*Length-bucketed CRC matrices.* The distinct words and word pairs of a part of the texts are grouped
by their length in bytes. A group is one uint8 matrix, a row per feature, and the CRCs of all its
rows are updated together, column by column. The results are scattered back to the features, and by
them to the words of the texts. One long word alone in its group would take a step per byte for a
single row, so features above ``LONG`` bytes go through zlib, one call each.

A bucket's gain is the log ratio of its share in the target to its share in the documents. The
documents' bucket numbers are made once and stored, two bytes a feature; counts, gains and weights
come from these. Gumbel noise by document id turns the best scores into a draw without replacement.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewmill.llm import common as c

BUCKETS = 10_000
LEAST_WORDS = 20
#: Bytes of a feature from which it is not worth a matrix of its own.
LONG = 512
#: Rows of a matrix that are updated at once, to stay in the cache.
_ROWS = 1 << 14

#: ASCII that is neither a digit nor a letter (letters are folded first).
SEPARATORS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def _crc_table() -> np.ndarray:
    """The reflected CRC-32 of each byte."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> np.uint32(1)) ^ (np.uint32(0xEDB88320) * (table & np.uint32(1)))
    return table


_TABLE = _crc_table()


def crc_rows(rows: np.ndarray) -> np.ndarray:
    """Unsigned crc32 of each row of a uint8 matrix."""
    out = np.empty(len(rows), np.uint32)
    for first in range(0, len(rows), _ROWS):
        columns = np.ascontiguousarray(rows[first : first + _ROWS].T)
        crc = np.full(columns.shape[1], 0xFFFFFFFF, np.uint32)
        for column in columns:
            crc = _TABLE[(crc ^ column) & np.uint32(255)] ^ (crc >> np.uint32(8))
        out[first : first + _ROWS] = ~crc
    return out


def _crcs(buf: np.ndarray, at: list[np.ndarray], size: list[np.ndarray]) -> np.ndarray:
    """crc32 per feature, a feature being the pieces of ``buf`` at ``at`` joined by one space."""
    total = sum(size) + len(size) - 1
    out = np.empty(len(total), np.uint32)
    order = np.argsort(total, kind="stable")
    lengths, first = np.unique(total[order], return_index=True)
    for length, members in zip(lengths.tolist(), np.split(order, first[1:])):
        if length > LONG:
            for i in members:
                out[i] = zlib.crc32(b" ".join(buf[a[i] : a[i] + s[i]].tobytes() for a, s in zip(at, size)))
            continue
        for begin in range(0, len(members), _ROWS):
            part = members[begin : begin + _ROWS]
            if len(at) == 1:
                rows = buf[at[0][part][:, None] + np.arange(length)]
            else:
                # a column lies in the first piece, is the space, or lies in the second
                place = np.arange(length)[None, :] - size[0][part][:, None]
                inside = np.where(place < 0, at[0][part][:, None] + size[0][part][:, None] + place,
                                  at[1][part][:, None] + place - 1)
                rows = np.where(place == 0, np.uint8(32), buf[np.where(place == 0, 0, inside)])
            out[part] = crc_rows(rows)
    return out


def feature_crcs(texts: pa.Array) -> tuple[c.Texts, np.ndarray, np.ndarray, np.ndarray]:
    """Words, the crc32 of each word, and (first word, crc32) of each pair of neighbours in a text."""
    found = c.Texts(texts, lower=True, seps=SEPARATORS)
    n = len(found.words)
    none = np.zeros(0, np.uint32)
    if not n:
        return found, none, np.zeros(0, np.int64), none
    buf = found.buf.copy()
    upper = (buf >= 65) & (buf <= 90)
    buf[upper] += 32
    stop = np.flatnonzero(SEPARATORS[buf])  # the buffer ends with a separator
    ends = stop[np.searchsorted(stop, found.starts)]
    _, sample, word = np.unique(found.words, return_index=True, return_inverse=True)
    at, size = found.starts[sample], (ends - found.starts)[sample]
    one = _crcs(buf, [at], [size])[word]
    left = np.flatnonzero(found.doc[1:] == found.doc[:-1])
    pairs, which = np.unique(word[left].astype(np.int64) * len(at) + word[left + 1], return_inverse=True)
    a, b = pairs // len(at), pairs % len(at)
    two = _crcs(buf, [at[a], at[b]], [size[a], size[b]])[which] if len(pairs) else none
    return found, one, left, two


def _hashed(df: DataFrame, text_col: str, buckets: int) -> DataFrame:
    """Rows with ``words`` and ``hashes``: two bytes per feature, its bucket."""
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32

    def run(column: pa.Array) -> list[pa.Array]:
        found, one, left, two = feature_crcs(column)
        bounds = np.searchsorted(left, found.first)
        ones, twos = (one % np.uint32(buckets)).astype(kind), (two % np.uint32(buckets)).astype(kind)
        cells = [
            ones[found.first[i] : found.first[i + 1]].tobytes() + twos[bounds[i] : bounds[i + 1]].tobytes()
            for i in range(len(column))
        ]
        return [pa.array(found.counts, pa.int64()), c.binaries(cells)]

    return c.add_columns(df, text_col, "words bigint, hashes binary", run)


def _width(buckets: int) -> int:
    return 2 if buckets <= 1 << 16 else 4


def _counts(hashed: DataFrame, buckets: int) -> DataFrame:
    """(bucket, count) over all features; a task sends its own sums."""
    kind = np.dtype(f"u{_width(buckets)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for cell in batch.column(0):
                sums += np.bincount(np.frombuffer(cell.as_buffer(), kind), minlength=buckets)
        held = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(sums[held])], names=["bucket", "count"])

    parts = hashed.select("hashes").mapInArrow(run, "bucket int, count bigint")
    return parts.groupBy("bucket").agg(F.sum("count").alias("count"))


def _gains(documents: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """Floored thousandths of the log ratio of the smoothed shares, by bucket; one row a bucket is collected."""
    s, t = ({r["bucket"]: r["count"] for r in counts.collect()} for counts in (documents, target))
    all_s, all_t = sum(s.values()), sum(t.values())
    return np.array([
        math.floor(1000 * math.log((t.get(b, 0) + 1) * (all_s + buckets) / ((s.get(b, 0) + 1) * (all_t + buckets))))
        for b in range(buckets)
    ], np.int64)


def noise(key: Column, seed: int) -> Column:
    """Floored thousandths of Gumbel noise, made from a hash of the seed and the key."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def draw(
    df: DataFrame, target: DataFrame, percent: int = 25, id_col: str = "doc_id", text_col: str = "text",
    target_text_col: str = "text", buckets: int = BUCKETS, least_words: int = LEAST_WORDS, seed: int = 7,
) -> DataFrame:
    """Score documents by their likeness to the target and draw the best ``percent``.

    Returns id, ``n_words``, ``n_features``, ``weight`` (floored mean gain of the features, 0 without
    any), ``score`` (weight and noise) and ``rank``, one row per input row. Of the N rows with at
    least ``least_words`` words, floor(percent * N / 100) get a rank, from 1 on: highest score first,
    ties to the smaller id (null ids last, rows of one id in any order); all others have null. Null,
    empty and wordless texts have no features; the noise of a null id is that of the empty text. An
    empty target has the same gain rule with all counts 0, an empty table no rows. Other columns are
    not read.
    """
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    hashed = c.stored(_hashed(docs, "text", buckets).select("id", "words", "hashes"), "features")
    aim = _hashed(target.select(F.col(target_text_col).alias("text")), "text", buckets)
    gains = _gains(_counts(hashed, buckets), _counts(aim, buckets), buckets)
    name = c.ship(df.sparkSession, "gains", gains.tobytes())
    kind = np.dtype(f"u{_width(buckets)}")

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(c.shipped(name), "rb") as f:
            gain = np.frombuffer(f.read(), np.int64)
        for batch in batches:
            cells = [np.frombuffer(x.as_buffer(), kind) for x in batch.column(2)]
            sizes = [len(x) for x in cells]
            weights = [int(gain[x].sum()) // len(x) if len(x) else 0 for x in cells]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(weights, pa.int64())],
                names=["id", "n_words", "n_features", "weight"])

    id_kind = dict(docs.dtypes)["id"]
    weighed = hashed.mapInArrow(weigh, f"id {id_kind}, n_words bigint, n_features bigint, weight bigint")
    scored = c.stored(weighed.withColumn("score", F.col("weight") + noise(F.col("id"), seed)), "scores")
    ranked = _ranked(scored.where(F.col("n_words") >= least_words), percent)
    others = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(others).withColumnRenamed("id", id_col)


def _ranked(rows: DataFrame, percent: int) -> DataFrame:
    """Rows with their place by score and id among the best ``percent``.

    Rows are dealt by ranges of (score, id, row), so one id may hold any part of them, and stored
    with their place in their range; the ranges before it, one count each, make that a rank.
    """
    order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("row")]
    sorted_ = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = c.stored(sorted_.drop("row").withColumn("at", F.monotonically_increasing_id()), "ranked")
    ranges = sorted(  # one row per partition
        (r["part"], r["count"]) for r in placed.groupBy(F.shiftright("at", 33).alias("part")).count().collect()
    )
    total = sum(n for _, n in ranges)
    before, starts = 0, []
    for part, n in ranges:
        starts.append((part, before))
        before += n
    offsets = rows.sparkSession.createDataFrame(starts, "part bigint, before bigint")
    met = placed.withColumn("part", F.shiftright("at", 33)).join(F.broadcast(offsets), "part")
    rank = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    drawn = percent * total // 100
    return met.withColumn("rank", F.when(rank <= drawn, rank)).drop("part", "before", "at")
