"""What several operators share: scratch tables, shipped files, word hashes, packed exchanges.

A *packed exchange* is a shuffle whose rows are arrays. Texts are first written as chunks of some
megabytes (``chunk_table``). A task turns a chunk into its distinct 64-bit keys, cuts the sorted
keys into buckets and sends one row per bucket. Whoever gets a bucket answers each chunk. A key
that occurs everywhere is sent once per chunk, so no bucket grows with one key's frequency.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewmill.session import scratch_dir

#: Characters of text per chunk; one longer text is a chunk of its own.
CHUNK_CHARS = 4 << 20
#: Words that one bucket of an exchange should hold at most.
BUCKET_WORDS = 2 << 20
#: Bytes of an Arrow batch that goes to Python: several exist at once on either side.
BATCH_BYTES = 8 << 20


# --- scratch tables and shipped files ----------------------------------------


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table below the shared scratch folder and read it back: lineage ends here."""
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession, label: str, blob: bytes) -> str:
    """Send a file of bounded size to every executor, later ones included; returns its name."""
    name = f"{label}-{uuid.uuid4().hex[:12]}.bin"
    folder = os.path.join(SparkFiles.getRootDirectory(), f"out-{uuid.uuid4().hex[:12]}")
    os.makedirs(folder)
    path = os.path.join(folder, name)
    with open(path, "wb") as out:
        out.write(blob)
    spark.sparkContext.addFile(path)
    return name


def shipped(name: str) -> str:
    """The local path of a shipped file, inside a task or on the driver."""
    return SparkFiles.get(name)


def small_batches(spark: SparkSession) -> None:
    """Let this session send at most ``BATCH_BYTES`` (or one row) at a time to Python."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(setting))
    if held <= 0 or held > BATCH_BYTES:
        spark.conf.set(setting, str(BATCH_BYTES))


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids count as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def add_columns(
    df: DataFrame, column: str, added: str, make: Callable[[pa.Array], list[pa.Array]],
    size: int = 1 << 20,
) -> DataFrame:
    """Add columns (DDL ``added``) that ``make`` gets from an Arrow array of one column.

    All rows and other columns stay; columns of the input that bear a new name are replaced.
    ``make`` sees texts of about ``size`` bytes at a time (or 256 rows of another type).
    """
    small_batches(df.sparkSession)
    new = T.StructType.fromDDL(added)
    taken = {x.lower() for x in new.names}
    rest = df.select(*[x for x in df.columns if x == column or x.lower() not in taken])
    kept = [x for x in rest.columns if x.lower() not in taken]
    where = rest.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = 0
            for part in text_parts(batch.column(where), size):
                arrays = [batch.column(i).slice(first, len(part)) for i in places]
                yield pa.RecordBatch.from_arrays([*arrays, *make(part)], names=[*kept, *new.names])
                first += len(part)
        pa.default_memory_pool().release_unused()  # the worker stays for other tasks

    places = [rest.columns.index(x) for x in kept]
    return rest.mapInArrow(run, T.StructType([f for f in rest.schema if f.name in kept] + list(new)))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    taken = {x.lower() for x in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


# --- hashing words -----------------------------------------------------------

_U = np.uint64
_R, _R2 = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95  # odd multipliers of the two polynomials
_MASK = (1 << 64) - 1
_BLOCK = 1 << 20
END_WORD = _U(0x2545F4914F6CDD1D)

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit value over all bits."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & _MASK, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(_R2))
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64, at least n of each."""
    kept = _POWERS.get(base)
    if kept is None or len(kept[0]) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        kept = _POWERS[base] = (_powers(base, size), _powers(pow(base, -1, 1 << 64), size))
    return kept


def word_hashes(
    buf: np.ndarray, lower: bool = False, seps: np.ndarray = SPACE
) -> tuple[np.ndarray, np.ndarray]:
    """(start offset, 64-bit hash) of each word of a byte buffer; ``lower`` folds A-Z."""
    table = _BYTE_LOWER if lower else _BYTE
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    is_sep = seps[buf]
    edges = np.flatnonzero(is_sep[1:] != is_sep[:-1]) + 1
    starts = edges[is_sep[edges - 1]] if len(edges) else edges
    ends = edges[~is_sep[edges - 1]] if len(edges) else edges
    if not is_sep[0]:
        starts = np.concatenate(([0], starts))
    if not is_sep[-1]:
        ends = np.concatenate((ends, [n]))
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):  # block by block, to stay in the cache
        base = starts[first]
        last = max(first + 1, int(np.searchsorted(ends, base + _BLOCK, "right")))
        powers, inverse = _tables(_R, int(ends[last - 1] - base))
        part = table[buf[base : ends[last - 1]]]
        sums = np.empty(len(part) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(part * powers[: len(part)], out=sums[1:])
        s, e = starts[first:last] - base, ends[first:last] - base
        out[first:last] = (sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64) * _U(_R2)
        first = last
    return starts, mix(out)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` neighbouring word hashes (of the whole array)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    power = 1
    for k in range(size):
        out += words[k : k + n] * _U(power)
        power = power * _R2 & _MASK
    return mix(out)


class Texts:
    """The words of many texts: hashes in one array and where each text's words begin."""

    def __init__(self, texts: pa.Array, lower: bool = False, seps: np.ndarray = SPACE):
        values = [v or b"" for v in texts.cast(pa.large_binary()).to_pylist()]
        sizes = np.fromiter(map(len, values), np.int64, len(values))
        # one separator after each text keeps its last word from the next one's first
        self.buf = np.frombuffer(b" ".join(values) + b" " * bool(values), np.uint8)
        self.starts_byte = np.cumsum(sizes + 1) - sizes - 1
        self.starts, self.words = word_hashes(self.buf, lower, seps)
        self.first = np.searchsorted(self.starts, np.append(self.starts_byte, len(self.buf)))
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(values)), self.counts)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(position of the first word, hash) of each window that lies inside one text."""
        h = window_hashes(self.words, size)
        inside = self.doc[: len(h)] == self.doc[size - 1 :] if len(h) else np.zeros(0, bool)
        at = np.flatnonzero(inside)
        return at, h[at]


def text_parts(texts: pa.Array, size: int = 1 << 20) -> Iterator[pa.Array]:
    """Slices of neighbouring texts of about so many bytes; a longer text is one by itself.

    Arrays of another type are cut by rows.
    """
    if not pa.types.is_string(texts.type) and not pa.types.is_large_string(texts.type):
        yield from (texts.slice(i, 256) for i in range(0, len(texts), 256))
        return
    ends = _offsets(texts)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(ends, int(ends[first]) + size, "right")) - 1)
        yield texts.slice(first, last - first)
        first = last


# --- chunks and packed exchanges ---------------------------------------------


def chunk_table(df: DataFrame, label: str, columns: list[str], chars: int | None = None) -> DataFrame:
    """Store rows as chunks: (chunk, one list column per column), bucketed by chunk.

    Later joins on the chunk read their bucket without a shuffle.
    """
    return bucketed(chunk_rows(df, columns, chars), label, "chunk")


def bucketed(df: DataFrame, label: str, column: str) -> DataFrame:
    """Store a table in buckets of a column: joins and groups on it read their bucket without a shuffle."""
    spark = df.sparkSession
    name = f"llm_{label}_{uuid.uuid4().hex[:12]}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").bucketBy(buckets, column).option("path", scratch_dir(spark, label)).saveAsTable(name)
    return spark.table(name)


def chunk_rows(df: DataFrame, columns: list[str], chars: int | None = None) -> DataFrame:
    """Rows as chunks, to be stored: the table fixes which rows make a chunk, so that a task that
    runs again sees the same ones.

    ``columns`` ends with the text column, or one of bytes; the others have any type. Chunk numbers
    follow the order of the partitions and of the rows in them.
    """
    small_batches(df.sparkSession)
    chars = chars or CHUNK_CHARS
    picked = df.select(*columns)
    types = {"bigint": pa.int64(), "string": pa.large_string(), "boolean": pa.bool_(), "int": pa.int32()}
    fields = [(c, types.get(t)) for c, t in picked.dtypes]
    schema = "chunk bigint, words bigint, " + ", ".join(f"{c} array<{t}>" for c, t in picked.dtypes)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, serial = TaskContext.get().partitionId(), 0
        held, size = [], 0

        def out():
            nonlocal serial
            table = pa.Table.from_batches(held).combine_chunks()
            lists = [
                pa.LargeListArray.from_arrays(
                    pa.array([0, table.num_rows], pa.int64()), column(table[c], t or table[c].type)
                ).cast(pa.list_((t or table[c].type) if t != pa.large_string() else pa.string()))
                for c, t in fields
            ]
            serial += 1
            words = pa.array([size // 4 + table.num_rows], pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) + serial - 1], pa.int64()), words, *lists],
                names=["chunk", "words", *(c for c, _ in fields)],
            )

        def column(values, t):
            return pa.concat_arrays(values.cast(t).chunks) if values.num_chunks else pa.array([], t)

        for batch in batches:
            lengths = np.diff(_offsets(batch.column(batch.num_columns - 1)))
            first = 0
            while first < batch.num_rows:
                total = np.cumsum(lengths[first:]) + size
                take = int(np.searchsorted(total, chars, "right"))
                if take or not size:
                    take = max(take, 1)
                    held.append(batch.slice(first, take))
                    size = int(total[take - 1])
                    first += take
                if first < batch.num_rows or size >= chars:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return picked.mapInArrow(pack, schema)


def _offsets(texts: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    return np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1]


def bucket_count(chunks: DataFrame, words: int = BUCKET_WORDS) -> int:
    """Buckets of an exchange, in proportion to the text, a power of two."""
    total = chunks.agg(F.sum("words")).first()[0] or 0
    least = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return 1 << max(0, (max(least, -(-total // words)) - 1).bit_length())


def split(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bounds of the buckets in sorted keys: a bucket is a range of the key space."""
    if buckets == 1:
        return np.array([0, len(keys)])
    step = _U((1 << 64) // buckets)
    return np.append(np.searchsorted(keys, np.arange(buckets, dtype=np.uint64) * step), len(keys))


def binaries(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def send(
    chunks: DataFrame, pack: Callable[[pa.RecordBatch, int], list[tuple[int, bytes, bytes]]]
) -> DataFrame:
    """One row (bucket, chunk, keys, extra) per bucket of every chunk; ``pack`` makes them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                rows = pack(row)
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([r[0] for r in rows], pa.int32()),
                            pa.array([row.column("chunk")[0].as_py()] * len(rows), pa.int64()),
                            binaries([r[1] for r in rows]),
                            binaries([r[2] for r in rows]),
                        ],
                        names=["bucket", "chunk", "keys", "extra"],
                    )

    return chunks.mapInArrow(run, "bucket int, chunk bigint, keys binary, extra binary")


def answer(
    sent: DataFrame, reply: Callable[[list[np.ndarray], list[np.ndarray], np.ndarray], list[bytes]],
    extra: np.dtype | str, keys: np.dtype | str = np.uint64,
) -> DataFrame:
    """Answer each chunk of each bucket: ``reply(keys, extras, chunks)``, one list entry a chunk."""

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table["chunk"].to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        k = [np.frombuffer(x.as_buffer(), keys) for x in table["keys"]]
        e = [np.frombuffer(x.as_buffer(), extra) for x in table["extra"]]
        back = reply(k, e, table["chunk"].to_numpy())
        return pa.Table.from_arrays(
            [table["chunk"], table["bucket"], binaries(back)], names=["chunk", "bucket", "back"]
        )

    return sent.groupBy("bucket").applyInArrow(run, "chunk bigint, bucket int, back binary")


def resume(
    chunks: DataFrame, replies: DataFrame, finish: Callable[[pa.RecordBatch, dict[int, bytes]], pa.RecordBatch],
    schema: str,
) -> DataFrame:
    """Bring the answers back to their chunk: ``finish(chunk row, {bucket: answer})``."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        back = dict(zip(right["bucket"].to_pylist(), (x.as_buffer() for x in right["back"])))
        outs = [finish(b.slice(i, 1), back) for b in left.to_batches() for i in range(b.num_rows)]
        return pa.Table.from_batches(outs) if outs else empty

    empty = pa.table({})
    grouped = replies.groupBy("chunk")
    return chunks.groupBy("chunk").cogroup(grouped).applyInArrow(run, schema)


def listed(row: pa.RecordBatch, column: str) -> pa.Array:
    """The values of one list cell."""
    return row.column(column).flatten()
