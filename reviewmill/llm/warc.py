"""WARC archives as a Spark data source, written and read in Python tasks.

*Writing.* A task writes its rows as records of one archive after another: each record is a gzip
member of its own whose extra field ``sl`` gives the member's length, so a reader can step over it.
Archives become visible by a manifest that the commit writes; it also holds, every ``splitBytes``,
where a record begins. Files of failed or repeated tasks are in no manifest and are not read.

*Reading.* The driver plans partitions from the manifests (or, in folders without one, a file each)
and packs small ones together. A task inflates the headers of a record only. Conditions on its type
and headers that Spark pushes down are tested there; a record that fails, or whose payload is not
asked for (``payload=false``), is stepped over without inflating the rest. Members without a length
are inflated and thrown away, uncompressed records are skipped by their Content-Length.

Paths go through Arrow's file systems, so a folder may be local, shared, or a URI of a store.
"""

from __future__ import annotations

import io
import json
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewmill.llm import common as c
from reviewmill.session import scratch_dir

SPLIT_BYTES = 32 << 20
ROLL_BYTES = 1 << 30
_BATCH_ROWS, _BATCH_BYTES = 1024, 4 << 20
_HEAD_BYTES = 2048
_MANIFEST = "_manifest-"

#: Columns that stand in headers of their own.
_HEADERS = {
    "record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date",
    "content_type": "content-type", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to",
}
SCHEMA = (
    "record_type string, record_id string, target_uri string, date string, content_type string, payload_digest string,"
    " refers_to string, content_length bigint, headers map<string,string>, payload binary, file string, position bigint"
)
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_ARROW = pa.schema([
    *[(name, pa.string()) for name in _HEADERS], ("content_length", pa.int64()),
    ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()), ("file", pa.string()), ("position", pa.int64()),
])


def _file_system(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


# --- writing -----------------------------------------------------------------


def member(record: bytes, level: int = 6) -> bytes:
    """One gzip member with its own length and that of its content in the extra field."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(record) + packer.flush()
    size = 24 + len(body) + 8
    lengths = (size, len(record)) if max(size, len(record)) < 1 << 32 else (0, 0)
    extra = b"sl" + struct.pack("<HII", 8, *lengths)
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra
    return head + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def record_bytes(kind: str, headers: dict[str, str | None], payload: bytes | None) -> bytes:
    """A WARC record. Web responses and revisits hold an HTTP header before the payload."""
    web = kind in ("response", "revisit")
    block = (_HTTP if web else b"") + (payload or b"")
    fields = {"WARC-Type": kind, **headers}
    fields.setdefault("Content-Type", "application/http;msgtype=response" if web else "application/octet-stream")
    fields["Content-Length"] = str(len(block))
    lines = "".join(f"{k}: {_line(v)}\r\n" for k, v in fields.items() if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def _line(value: str) -> str:
    """A header value on one line; control characters are percent-encoded."""
    return "".join(f"%{ord(x):02X}" if ord(x) < 32 or ord(x) == 127 else x for x in value).strip(" ")


@dataclass
class _Written(ds.WriterCommitMessage):
    files: list[dict] = field(default_factory=list)


class _Writer(ds.DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], names: list[str]):
        self.path, self.names = options["path"].rstrip("/"), names
        self.split = int(options.get("splitbytes", SPLIT_BYTES))
        self.roll = int(options.get("rollbytes", ROLL_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        system, folder = _file_system(self.path)
        system.create_dir(folder, recursive=True)
        part = TaskContext.get().partitionId()
        done, out, info = _Written(), None, {}
        for batch in iterator:
            place = {name: i for i, name in enumerate(self.names)}
            for i in range(batch.num_rows):
                if out is None:
                    info = {"name": f"records-{part:06d}-{uuid.uuid4().hex[:12]}.warc.gz", "size": 0, "records": 0, "splits": []}
                    out = system.open_output_stream(f"{folder}/{info['name']}", compression=None)
                if info["size"] >= (info["splits"][-1] if info["splits"] else 0) + self.split:
                    info["splits"].append(info["size"])
                value = lambda name: batch.column(place[name])[i].as_py()
                data = member(record_bytes(value("record_type"), dict(value("headers") or []), value("payload")))
                out.write(data)
                info["size"] += len(data)
                info["records"] += 1
                if info["size"] >= self.roll:
                    out.close()
                    done.files.append(info)
                    out = None
        if out is not None:
            out.close()
            done.files.append(info)
        return done

    def commit(self, messages: list[_Written | None]) -> None:
        """One manifest per write: a line per archive."""
        system, folder = _file_system(self.path)
        system.create_dir(folder, recursive=True)
        files = [f for m in messages if m for f in m.files]
        with system.open_output_stream(f"{folder}/{_MANIFEST}{uuid.uuid4().hex[:12]}.json") as out:
            out.write("".join(json.dumps(f) + "\n" for f in files).encode())

    def abort(self, messages: list[_Written | None]) -> None:
        system, folder = _file_system(self.path)
        for m in messages:
            for f in m.files if m else ():
                system.delete_file(f"{folder}/{f['name']}")


# --- reading -----------------------------------------------------------------


@dataclass
class _Ranges(ds.InputPartition):
    """(file, first byte, end) of stretches that begin and end with a record."""

    ranges: list[tuple[str, int, int]]


def plan_ranges(path: str, split: int) -> list[list[tuple[str, int, int]]]:
    """Stretches of the archives below a path, in parts of about ``split`` bytes."""
    system, folder = _file_system(path)
    found = system.get_file_info(folder)
    if found.type == pafs.FileType.File:
        return [[(found.path, 0, found.size)]] if found.size else []
    listed = system.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
    manifests = [f.path for f in listed if f.base_name.startswith(_MANIFEST)]
    stretches = []
    if manifests:
        for manifest in sorted(manifests):
            for line in system.open_input_stream(manifest).read().decode().splitlines():
                info = json.loads(line)
                bounds = [0, *info["splits"], info["size"]]
                stretches += [(f"{folder}/{info['name']}", a, b) for a, b in zip(bounds, bounds[1:])]
    else:
        stretches = [(f.path, 0, f.size) for f in sorted(listed, key=lambda f: f.path)
                     if f.size and f.base_name.endswith((".warc", ".warc.gz"))]
    parts, held = [], split
    for s in stretches:
        if held + s[2] - s[1] > split:
            parts.append([])
            held = 0
        parts[-1].append(s)
        held += s[2] - s[1]
    return parts


def _headers(block: bytes) -> dict[str, str]:
    """Header lines by lower-case name; a line that begins with a blank goes on."""
    out: dict[str, str] = {}
    name = ""
    for line in block.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


class _Plain:
    """An uncompressed record: read as far as needed."""

    def __init__(self, source: io.BufferedReader, at: int):
        self.source, self.at = source, at
        self.size = 0

    def head(self) -> bytes:
        self.source.seek(self.at)
        held = b""
        while b"\r\n\r\n" not in held:
            more = self.source.read(_HEAD_BYTES)
            if not more:
                return b""
            held += more
        head = held[: held.index(b"\r\n\r\n") + 4]
        self.begin = self.at + len(head)
        return head

    def block(self, length: int) -> bytes:
        self.source.seek(self.begin)
        return self.source.read(length)

    def next(self, length: int) -> int:
        return self.begin + length + 4


class _Gzip:
    """A record that is a gzip member: inflated as far as needed."""

    def __init__(self, source: io.BufferedReader, at: int):
        self.source, self.at = source, at

    def head(self) -> bytes:
        self.source.seek(self.at)
        first = self.source.read(24)
        self.size = 0
        if len(first) == 24 and first[3] & 4 and first[12:14] == b"sl":
            self.size = struct.unpack("<I", first[16:20])[0]
        self.unpacker = zlib.decompressobj(31)
        self.held = self.unpacker.decompress(first, 0) if first else b""
        while b"\r\n\r\n" not in self.held:
            if not self._more(_HEAD_BYTES):
                return b""
        cut = self.held.index(b"\r\n\r\n") + 4
        head, self.held = self.held[:cut], self.held[cut:]
        return head

    def _more(self, size: int) -> bool:
        """Inflate some more; False at the end of the member."""
        if self.unpacker.eof:
            return False
        data = self.unpacker.unconsumed_tail or self.source.read(size)
        if not data:
            raise EOFError(f"the record at byte {self.at} is cut off")
        self.held += self.unpacker.decompress(data, 0 if size > _HEAD_BYTES else 4 * _HEAD_BYTES)
        return True

    def block(self, length: int) -> bytes:
        parts, total = [self.held], len(self.held)
        self.held = b""
        while total < length and self._more(1 << 16):
            parts.append(self.held)
            total += len(self.held)
            self.held = b""
        return b"".join(parts)[:length]

    def next(self, length: int) -> int:
        if self.size:
            return self.at + self.size
        while not self.unpacker.eof:
            self.held = b""
            self._more(1 << 16)
        return self.source.tell() - len(self.unpacker.unused_data)


def records(
    source: io.BufferedReader, first: int, end: int, wanted: Callable[[dict[str, str]], bool], payload: bool = True
) -> Iterator[tuple[int, dict[str, str], bytes | None]]:
    """(position, headers, payload) of the records that begin in a stretch and are wanted."""
    at = first
    while at < end:
        source.seek(at)
        record = (_Gzip if source.read(2) == b"\x1f\x8b" else _Plain)(source, at)
        head = record.head()
        if not head.lstrip().startswith(b"WARC/"):
            if head:
                raise ValueError(f"no WARC record at byte {at}")
            return
        headers = _headers(head)
        length = int(headers.get("content-length", 0))
        if wanted(headers):
            body = None
            if payload:
                body = record.block(length)
                if headers.get("content-type", "").startswith("application/http"):
                    body = body.partition(b"\r\n\r\n")[2]
            yield at, headers, body
        at = record.next(length)


def _test(condition: ds.Filter) -> Callable[[dict[str, str]], bool] | None:
    """A pushed condition as a test of headers, or None if it is not one of these."""
    if isinstance(condition, ds.Not):
        inner, column = _test(condition.child), _column(condition.child)
        if inner is None or column is None:
            return None
        if isinstance(condition.child, (ds.IsNull, ds.IsNotNull, ds.EqualNullSafe)):
            return lambda h: not inner(h)
        return lambda h: column(h) is not None and not inner(h)  # not (null = x) is null: no row
    column = _column(condition)
    if column is None:
        return None
    if isinstance(condition, ds.IsNull):
        return lambda h: column(h) is None
    if isinstance(condition, ds.IsNotNull):
        return lambda h: column(h) is not None
    if isinstance(condition, ds.EqualNullSafe):
        return lambda h: column(h) == condition.value
    if isinstance(condition, ds.In):
        return lambda h: column(h) is not None and column(h) in condition.value
    tests = {
        ds.EqualTo: lambda a, b: a == b, ds.GreaterThan: lambda a, b: a > b, ds.GreaterThanOrEqual: lambda a, b: a >= b,
        ds.LessThan: lambda a, b: a < b, ds.LessThanOrEqual: lambda a, b: a <= b,
        ds.StringStartsWith: lambda a, b: a.startswith(b), ds.StringEndsWith: lambda a, b: a.endswith(b),
        ds.StringContains: lambda a, b: b in a,
    }
    test = tests.get(type(condition))
    if test is None:
        return None
    raw = lambda x: x.encode() if isinstance(x, str) else x  # noqa: E731  strings compare by their bytes
    return lambda h: column(h) is not None and test(raw(column(h)), raw(condition.value))


def _column(condition: ds.Filter) -> Callable[[dict[str, str]], str | int | None] | None:
    """How the column of a condition is read from headers."""
    path = getattr(condition, "attribute", ())
    if len(path) != 1:
        return None
    if path[0] == "content_length":
        return lambda h: int(h.get("content-length", 0))
    name = _HEADERS.get(path[0])
    return name and (lambda h: h.get(name))


class _Reader(ds.DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"].rstrip("/")
        self.split = int(options.get("splitbytes", SPLIT_BYTES))
        self.payload = options.get("payload", "true").lower() == "true"
        self.conditions: list[ds.Filter] = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        for f in filters:
            if _test(f):
                self.conditions.append(f)
            else:
                yield f

    def partitions(self) -> list[_Ranges]:
        return [_Ranges(part) for part in plan_ranges(self.path, self.split) or [[]]]

    def read(self, partition: _Ranges) -> Iterator[pa.RecordBatch]:
        tests = [_test(f) for f in self.conditions]
        system, _ = _file_system(self.path)
        rows: list[tuple] = []
        size = 0
        for path, first, end in partition.ranges:
            with system.open_input_file(path) as raw:
                source = io.BufferedReader(raw, 1 << 18)
                for at, headers, body in records(source, first, end, lambda h: all(t(h) for t in tests), self.payload):
                    rows.append((*(headers.get(x) for x in _HEADERS.values()), int(headers.get("content-length", 0)),
                                 list(headers.items()), body, path, at))
                    size += len(body or b"")
                    if len(rows) >= _BATCH_ROWS or size >= _BATCH_BYTES:
                        yield _batch(rows)
                        rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


class WarcSource(ds.DataSource):
    """``spark.read.format("warc")`` and ``df.write.format("warc").mode("append")``.

    Written are the columns ``record_type``, ``headers`` and ``payload``, read those of ``SCHEMA``.
    Options: ``path``, ``splitBytes``, ``payload`` (read), ``rollBytes`` (write).
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> _Reader:
        return _Reader(dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> _Writer:
        return _Writer(dict(self.options), schema.names)


# --- archives of pages -------------------------------------------------------


def base32_sha1(data: Column) -> Column:
    """SHA-1 in upper-case base32: eight digits for each ten of its hexadecimal ones."""
    digest = F.sha1(data.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(digest, at, 10), 16, 32), 8, "0") for at in (1, 11, 21, 31)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _urn(row: Column) -> Column:
    h = F.md5(F.concat(F.lit("record "), row.cast("string")).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def write_archives(
    df: DataFrame, path: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html",
    least_bytes: int = 0, salts: int = 32,
) -> None:
    """Write one record per row below ``path``.

    Of rows with equal payloads of at least ``least_bytes`` bytes, the one with the smallest id (null
    ids last, equal ids in any order) is a response, the others are revisits without payload that
    name it. A null payload is the empty one. A null URI has no header, line breaks in one are
    percent-encoded. An empty table makes an empty manifest. Other columns are not read.

    Rows are stored with a number first, which names their record. Which rows are alike is decided
    on digests, per salted digest, so a payload that a third of the rows hold is no hot group.
    """
    spark = df.sparkSession
    _register(spark)
    c.small_batches(spark)
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = df.select(F.col(id_col).alias("id"), F.col(uri_col).cast("string").alias("uri"), payload.alias("payload"))
    stored = c.stored(
        rows.withColumn("digest", base32_sha1(F.col("payload"))).withColumn("bytes", F.octet_length("payload").cast("long"))
        .withColumn("row", F.monotonically_increasing_id()), "pages",
    )
    staged = stored.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)))
    key = ["digest", "bytes"]
    own = F.struct(F.isnull("id").alias("no_id"), "id", "row")
    salted = c.stored(
        staged.where(F.col("bytes") >= least_bytes).groupBy(*key, "salt").agg(F.min(own).alias("first"), F.count("*").alias("n")),
        "digests",
    )
    several = salted.groupBy(*key).agg(F.min("first").alias("first"), F.sum("n").alias("n")).where("n > 1").drop("n")
    repeated = c.stored(salted.select(*key, "salt").join(several, key), "repeated")
    named = staged.join(repeated, [*key, "salt"], "left")
    again = F.col("first").isNotNull() & (F.col("first.row") != F.col("row"))
    entries = F.map_from_arrays(
        F.array(*[F.lit(x) for x in (
            "WARC-Record-ID", "WARC-Date", "WARC-Target-URI", "WARC-Payload-Digest", "WARC-Profile", "WARC-Refers-To",
            "Page-Id", "Payload-Bytes", "Refers-To-Page")]),
        F.array(
            _urn(F.col("row")), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.col("uri"),
            F.concat(F.lit("sha1:"), F.col("digest")),
            F.when(again, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            F.when(again, _urn(F.col("first.row"))), F.col("id").cast("string"), F.col("bytes").cast("string"),
            F.when(again, F.col("first.id").cast("string")),
        ),
    )
    out = named.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"), entries.alias("headers"),
        F.when(~again, F.col("payload")).alias("payload"),
    )
    out.write.format("warc").mode("append").save(path)


def _register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_archives(spark: SparkSession, path: str, payload: bool = True, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The records below a path. Conditions on the header columns go to the tasks that read."""
    _register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).option("splitBytes", split_bytes).load(path)


def archived_pages(
    df: DataFrame, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", least_bytes: int = 0
) -> DataFrame:
    """Write pages as archives in the shared folder and read them back.

    Returns id, ``payload_bytes``, ``payload_digest``, ``record_type`` and ``refers_to`` (the
    response's id), one row per input row. What a response holds is measured and digested anew,
    a revisit tells that of its response.
    """
    path = scratch_dir(df.sparkSession, "archives")
    write_archives(df, path, id_col, uri_col, payload_col, least_bytes)
    kind = dict(df.dtypes)[id_col]
    found = read_archives(df.sparkSession, path)
    whole = F.col("record_type") == "response"
    header = lambda name: F.col("headers")[name]
    return found.select(
        header("page-id").cast(kind).alias(id_col),
        F.when(whole, F.octet_length("payload")).otherwise(header("payload-bytes")).cast("long").alias("payload_bytes"),
        F.when(whole, base32_sha1(F.col("payload"))).otherwise(F.substring_index("payload_digest", ":", -1)).alias("payload_digest"),
        "record_type", header("refers-to-page").cast(kind).alias("refers_to"),
    )
