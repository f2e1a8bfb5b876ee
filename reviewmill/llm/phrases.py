"""Phrase collocations by dynamic itemset counting.

Texts are stored as chunks and dealt to a few *shards*, which are scanned in a cycle, one shard a
step. A step counts phrases of all lengths together: words from the first step on, a longer phrase
from the step after both its subphrases (without its last, without its first word) have reached the
threshold in what was scanned so far. Every phrase is counted for one full cycle from its own start,
so its count is exact; counting ends when nothing has reached the threshold for a whole cycle.

*What a step knows.* The steps at which phrases reached the threshold are kept in a table of
``SLOTS`` bytes, addressed by the phrases' hash, and shipped to the tasks: its size is fixed. Two
phrases in one slot only cause a phrase to be counted that need not be; the start of a phrase is a
function of its slots, the same in every task, so that it is still counted once per shard. With
many more frequent phrases than slots more is counted, and the result stays the same.

*What moves.* A chunk sends, for each phrase that starts in the last cycle, one entry with its count
and a place where it stands, packed by ranges of the hash: each phrase once per chunk in the whole
run, so a phrase that occurs everywhere makes no hot group. Buckets add the counts up, hand over the
frequent phrases that are through, and forget the others. The words of a frequent phrase are read
at its place at the end.

Phrases are told apart by 64-bit hashes of 64-bit word hashes and of the language.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewmill.llm import common as c
from reviewmill.session import scratch_dir

THRESHOLD = 100
LONGEST = 5
SHARDS = 3
SLOT_BITS = 24
#: Words of text per bucket.
BUCKET_WORDS = 1 << 20
NEVER = 255

_PIECE_ENDS = np.zeros(256, bool)
_PIECE_ENDS[[*b".,;:!?", 10, 11, 12, 13]] = True
_SEPARATORS = _PIECE_ENDS.copy()
_SEPARATORS[[32, 9]] = True
_ODD = np.uint64(0xD1342543DE82EF95)

_SENT = np.dtype([("n", "u4"), ("at", "u4"), ("length", "u1"), ("start", "u1")])
_HELD = np.dtype([("key", "u8"), ("n", "i8"), ("chunk", "i8"), ("at", "u4"), ("length", "u1"), ("start", "u1"), ("reached", "u1")])


class _Words:
    """Words of a chunk, as hashes that differ by language, and which follow each other in a piece."""

    def __init__(self, row: pa.RecordBatch):
        self.langs = ["und" if x is None else x for x in c.listed(row, "lang").to_pylist()]
        self.texts = c.Texts(c.listed(row, "text"), lower=True, seps=_SEPARATORS)
        salts = {x: int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest()) for x in set(self.langs)}
        salt = np.array([salts[x] for x in self.langs], np.uint64)
        self.keys = c.mix(self.texts.words + salt[self.texts.doc])
        piece = np.cumsum(_PIECE_ENDS[self.texts.buf], dtype=np.int32)[self.texts.starts]
        doc = self.texts.doc
        self.joined = (piece[1:] == piece[:-1]) & (doc[1:] == doc[:-1])

    def spelled(self) -> list[str]:
        """All words, A-Z in lower case."""
        buf = self.texts.buf.copy()
        buf[(buf >= 65) & (buf <= 90)] += 32
        stop = np.flatnonzero(_SEPARATORS[buf])
        ends = stop[np.searchsorted(stop, self.texts.starts)] if len(stop) else stop
        held = buf.tobytes()
        return [held[a:b].decode() for a, b in zip(self.texts.starts.tolist(), ends.tolist())]


def _counted(words: _Words, reached: np.ndarray, step: int, cycle: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and entries of the phrases that start in (step - cycle, step]."""
    none = np.int16(10_000)
    shift = np.uint64(64 - int(len(reached)).bit_length() + 1)
    at = np.arange(len(words.keys))
    start = np.zeros(len(at), np.int16)
    raw = words.keys
    power = 1
    keys, entries = [], []
    for length in range(1, longest + 1):
        if length > 1:
            # both subphrases are ready, and the last word follows in the same piece
            ready = np.full(len(words.keys) + 1, none)
            step_of = reached[(key >> shift).astype(np.int64)].astype(np.int16)
            ready[at] = np.where(step_of == NEVER, none, np.maximum(start, step_of + 1))
            follows = at + length - 1 < len(words.keys)
            at, raw = at[follows], raw[follows]
            start = np.maximum(ready[at], ready[at + 1])
            keep = (start < none) & words.joined[at + length - 2]
            at, raw, start = at[keep], raw[keep], start[keep]
            power = power * int(_ODD) & (1 << 64) - 1
            raw = raw + words.keys[at + length - 1] * np.uint64(power)
        key = c.mix(raw)
        new = np.flatnonzero(start > step - cycle)
        found, first, n = np.unique(key[new], return_index=True, return_counts=True)
        entry = np.empty(len(found), _SENT)
        entry["n"], entry["at"], entry["length"], entry["start"] = n, at[new][first], length, start[new][first]
        keys.append(found)
        entries.append(entry)
        if not len(at):
            break
    keys, entries = np.concatenate(keys), np.concatenate(entries)
    order = np.argsort(keys, kind="stable")
    return keys[order], entries[order]


_TABLES: dict[str, np.ndarray] = {}


def _table(name: str) -> np.ndarray:
    """The shipped steps by slot; a worker keeps the last ones."""
    if name not in _TABLES:
        _TABLES.clear()
        with open(c.shipped(name), "rb") as f:
            _TABLES[name] = np.frombuffer(zlib.decompress(f.read()), np.uint8)
    return _TABLES[name]


def _merge(held: np.ndarray, sent: pa.Table, step: int, cycle: int, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Entries of a bucket after a step; those that reached the threshold now."""
    parts = [held]
    for chunk, keys, extra in zip(sent["chunk"].to_pylist(), sent["keys"], sent["extra"]):
        entry = np.frombuffer(extra.as_buffer(), _SENT)
        part = np.empty(len(entry), _HELD)
        part["key"], part["chunk"], part["reached"] = np.frombuffer(keys.as_buffer(), np.uint64), chunk, NEVER
        for name in _SENT.names:
            part[name] = entry[name]
        parts.append(part)
    every = np.concatenate(parts)
    every = every[np.lexsort((every["chunk"], every["key"]))]
    begin = np.flatnonzero(np.append(True, every["key"][1:] != every["key"][:-1])) if len(every) else np.zeros(0, np.int64)
    out = every[begin]
    if len(out):
        out["n"] = np.add.reduceat(every["n"], begin)
        out["reached"] = np.minimum.reduceat(every["reached"], begin)
    now = (out["n"] >= threshold) & (out["reached"] == NEVER)
    out["reached"][now] = step
    return out, out[now]


def _frequent(chunks: DataFrame, threshold: int, longest: int, slot_bits: int) -> DataFrame:
    """(chunk, places): the frequent phrases, packed by the chunk where one of their places is."""
    spark = chunks.sparkSession
    shards = sorted(r["shard"] for r in chunks.select("shard").distinct().collect())  # at most the number of shards
    cycle = len(shards)
    buckets = min(c.bucket_count(chunks, BUCKET_WORDS), 1 << slot_bits)
    shift = np.uint64(64 - slot_bits)
    state = c.stored(spark.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(b"").alias("live")), "phrases")
    reached = np.full(1 << slot_bits, NEVER, np.uint8)
    done, quiet, step = [], 0, 0

    def pack(name: str, step: int):
        def run(row: pa.RecordBatch):
            keys, entries = _counted(_Words(row), _table(name), step, cycle, longest)
            bounds = c.split(keys, buckets)
            return [
                (b, keys[s:e].tobytes(), entries[s:e].tobytes())
                for b, (s, e) in enumerate(zip(bounds[:-1], bounds[1:])) if e > s
            ]
        return run

    def add(step: int):
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            held = np.frombuffer(b"".join(left["live"].to_pylist()), _HELD)
            every, now = _merge(held, right, step, cycle, threshold)
            through = every["start"].astype(np.int64) + cycle - 1 <= step
            found = every[through & (every["n"] >= threshold)]
            slots = np.unique((now["key"][now["length"] < longest] >> shift).astype(np.uint32))
            return pa.table({
                "bucket": left["bucket"], "live": c.binaries([every[~through].tobytes()]),
                "found": c.binaries([found.tobytes()]), "slots": c.binaries([slots.tobytes()]),
            })
        return run

    while cycle and quiet < cycle and step < NEVER:
        name = c.ship(spark, "reached", zlib.compress(reached.tobytes(), 1))
        shard = chunks.where(F.col("shard") == shards[step % cycle])
        sent = c.send(shard, pack(name, step))
        grown = state.select("bucket", "live").groupBy("bucket").cogroup(sent.groupBy("bucket")).applyInArrow(
            add(step), "bucket int, live binary, found binary, slots binary"
        )
        state = c.stored(grown, "phrases")
        done.append(state.select("found"))
        # distinct slots of one step: at most four bytes for each of the table
        new = [np.frombuffer(r["slots"], np.uint32) for r in state.where("octet_length(slots) > 0").select("slots").collect()]
        slots = np.concatenate([np.zeros(0, np.uint32), *new])
        reached[slots[reached[slots] == NEVER]] = step
        # words are counted in the whole first cycle
        quiet = 0 if len(slots) or step + 1 < cycle else quiet + 1
        step += 1

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in batch.column(0):
                found = np.frombuffer(cell.as_buffer(), _HELD)
                found = found[np.argsort(found["chunk"], kind="stable")]
                chunk, first = np.unique(found["chunk"], return_index=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(chunk), c.binaries([x.tobytes() for x in np.split(found, first[1:])] if len(chunk) else [])],
                    names=["chunk", "places"])

    if not done:
        return spark.createDataFrame([], "chunk bigint, places binary")
    every = done[0]
    for more in done[1:]:
        every = every.union(more)
    return every.where("octet_length(found) > 0").mapInArrow(spread, "chunk bigint, places binary")


def count_phrases(
    df: DataFrame, lang_col: str = "lang", text_col: str = "text", threshold: int = THRESHOLD,
    longest: int = LONGEST, shards: int = SHARDS, slot_bits: int = SLOT_BITS,
) -> tuple[DataFrame, DataFrame]:
    """Phrases of 1 to ``longest`` words that occur ``threshold`` times or more, and all words, by language.

    Returns (lang, words, f) and (lang, n). Texts are cut into pieces at ``. , ; : ! ?`` and line
    ends, pieces into words at blanks and tabs; A-Z count as lower case. Overlapping occurrences all
    count. A null language is ``und``; null and empty texts have no words. Repeated rows count as
    often as they stand there; an empty table has no phrases. Other columns are not read.
    """
    spark = df.sparkSession
    docs = df.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    rows = c.chunk_rows(docs, ["lang", "text"])
    name = f"llm_phrases_{uuid.uuid4().hex[:12]}"
    low = F.col("chunk").bitwiseAND((1 << 32) - 1)
    (
        rows.withColumn("shard", F.pmod(F.shiftright("chunk", 32) + low, F.lit(shards)).cast("int"))
        .write.format("parquet").partitionBy("shard").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "chunk")
        .option("path", scratch_dir(spark, "phrase-texts")).saveAsTable(name)
    )
    chunks = spark.table(name)
    places = c.stored(_frequent(chunks, threshold, longest, slot_bits), "places")

    def read(left: pa.Table, right: pa.Table) -> pa.Table:
        langs, phrases, counts = [], [], []
        for batch in left.to_batches():
            for i in range(batch.num_rows):
                words = _Words(batch.slice(i, 1))
                doc = words.texts.doc
                for lang, n in zip(words.langs, words.texts.counts.tolist()):
                    langs.append(lang)
                    phrases.append([])
                    counts.append(n)
                spelled = words.spelled() if right.num_rows else []
                for cell in right["places"]:
                    for place in np.frombuffer(cell.as_buffer(), _HELD):
                        at = int(place["at"])
                        langs.append(words.langs[doc[at]])
                        phrases.append(spelled[at : at + int(place["length"])])
                        counts.append(int(place["n"]))
        return pa.table({
            "lang": pa.array(langs, pa.string()), "words": pa.array(phrases, pa.list_(pa.string())), "f": pa.array(counts, pa.int64())
        })

    found = chunks.select("chunk", "lang", "text").groupBy("chunk").cogroup(places.groupBy("chunk")).applyInArrow(
        read, "lang string, words array<string>, f bigint"
    )
    found = c.stored(found, "frequent")
    totals = found.where("size(words) = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    return found.where("size(words) > 0"), totals


def collocations(
    df: DataFrame, top: int = 2000, covered: int = 100, lang_col: str = "lang", text_col: str = "text",
    threshold: int = THRESHOLD, longest: int = LONGEST, shards: int = SHARDS, slot_bits: int = SLOT_BITS,
) -> DataFrame:
    """The ``top`` phrases of two or more words of each language, by how much they cohere.

    A phrase that occurs a times among n words, cut into parts that occur l and r times, scores
    floor(1000 a n / (l r)) at its worst cut; of equal cuts the first counts. A phrase that stands
    in a longer one with at least ``covered`` percent of its count is left out. Returns lang, ``rank``
    (from 1: score and a descending, then the phrase), ``phrase``, a, l, r, n and score. What counts
    as a word and an occurrence stands at ``count_phrases``. Other columns are not read.
    """
    phrases, totals = count_phrases(df, lang_col, text_col, threshold, longest, shards, slot_bits)
    named = c.stored(phrases.select("lang", F.array_join("words", " ").alias("phrase"), "words", F.col("f").alias("a")), "named")
    parts = named.select("lang", "phrase", "a")
    candidates = named.where("size(words) > 1")

    cuts = candidates.select("lang", "phrase", "words", "a", F.explode(F.expr("sequence(1, size(words) - 1)")).alias("k")).select(
        "lang", "phrase", "a", "k",
        F.expr("array_join(slice(words, 1, k), ' ')").alias("left"),
        F.expr("array_join(slice(words, k + 1, size(words) - k), ' ')").alias("right"),
    )
    both = cuts.join(parts.toDF("lang", "left", "l"), ["lang", "left"]).join(parts.toDF("lang", "right", "r"), ["lang", "right"])
    wide = "cast({} as decimal(19, 0))"
    score = f"({wide.format('a')} * {wide.format('n')} * 1000BD) div ({wide.format('l')} * {wide.format('r')})"
    scored = both.join(totals, "lang").withColumn("score", F.expr(score))
    worst = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    inner = candidates.where("size(words) > 2").select(
        "lang", F.col("a").alias("whole"), F.explode(F.expr(
            "flatten(transform(sequence(2, size(words) - 1), m -> transform(sequence(1, size(words) - m + 1),"
            " i -> array_join(slice(words, i, m), ' '))))"
        )).alias("phrase"),
    ).groupBy("lang", "phrase").agg(F.max("whole").alias("whole"))
    apart = worst.join(inner, ["lang", "phrase"], "left").where(
        f"whole is null or 100BD * {wide.format('whole')} < {covered}BD * {wide.format('a')}"
    )
    order = "row_number() over (partition by lang order by cut.score desc, a desc, phrase)"
    return apart.withColumn("rank", F.expr(order).cast("long")).where(F.col("rank") <= top).select(
        "lang", "rank", "phrase", "a", "cut.l", "cut.r", "n", "cut.score"
    )
