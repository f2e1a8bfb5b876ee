"""Scans of delimited review files.

A row's place in its input is kept as one long, ``ord``: a byte-scale position (block start plus
row count inside the task) in the files laid end to end in the order of the listing. A row takes at
least one byte, so positions rise and never repeat; between files lies room for the rows that a task
may have counted in other files before. One long keeps "first row" rules inside hash aggregation.
"""

from __future__ import annotations

import hashlib
import io
import os
import re
from collections.abc import Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce
from itertools import accumulate
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from reviewmill.fixed import HEADER_SYNONYMS, STANDARD_COLUMNS
from reviewmill.functions.numbers import coerce_numeric
from reviewmill.functions.text import null_literals
from reviewmill.session import file_store, scratch_dir
from reviewmill.sizes import broadcast_if_small
from reviewmill.sources.headers import (
    choose_delimiter,
    map_columns,
    normalize_header,
    simple_header,
    sniff_delimiter,
    split_header,
)
from reviewmill.sources.records import PIECES, RECORD, SPLIT, TAIL, UNKNOWN, split_records

SUFFIXES = (".csv", ".txt")
# Files whose first lines one task reads.
HEADS_PER_TASK = 256
HEADS = "place bigint, size bigint, digest binary, line string"
# Targets whose cells come from the file; the others are derived later.
TEXT_TARGETS = [n for n, _ in STANDARD_COLUMNS if n in HEADER_SYNONYMS]


@dataclass
class ReviewSource:
    """One source after header resolution: a file, or a folder of files with one header line."""

    path: str
    parts: list[str] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    status: str = "ok"
    delimiter: str = ","
    raw_headers: list[str] = field(default_factory=list)
    mapping: dict[str, str] = field(default_factory=dict)
    error: str = ""

    @property
    def name(self) -> str:
        """Last part of the path; ``key=`` of a partition folder is left out."""
        return os.path.basename(self.path).split("=", 1)[-1]

    @property
    def layout(self) -> tuple:
        """Sources that share this can be read by one scan."""
        return (self.delimiter, tuple(self.raw_headers))

    @property
    def headers(self) -> list[str]:
        return [normalize_header(h) for h in self.raw_headers]


def list_files(spark: SparkSession, folder: str) -> list[str]:
    """Paths of all files below a folder, sorted, from the listing alone; no file is opened."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return sorted(unquote(path) for path in reader.load(folder).inputFiles())


def discover_files(spark: SparkSession, folder: str) -> DataFrame:
    """Review files in path order; other suffixes are left out, none at all is an error."""
    return spark.createDataFrame([(p,) for p in _review_paths(spark, folder)], "path string")


def file_statuses(spark: SparkSession, folder: str) -> DataFrame:
    """Every file below a folder and whether it is taken: those of other types are refused, with the reason."""
    paths = spark.createDataFrame([(p,) for p in list_files(spark, folder)], "path string")
    taken = F.lit(False)
    for suffix in SUFFIXES:
        taken = taken | F.lower("path").endswith(suffix)
    reason = F.concat(F.lit("unsupported file type: "), F.element_at(F.split("path", "/"), -1))
    return paths.select("path", F.when(taken, "taken").otherwise("refused").alias("status"), F.when(~taken, reason).alias("error"))


def _review_paths(spark: SparkSession, folder: str) -> list[str]:
    found = [p for p in list_files(spark, folder) if p.endswith(SUFFIXES)]
    if not found:
        raise FileNotFoundError(f"no {' or '.join(SUFFIXES)} files in {folder}")
    return found


def check_suffix(path: str) -> None:
    if not path.lower().endswith(SUFFIXES):
        raise ValueError(f"unsupported file type: {path}")


def header_line(spark: SparkSession, *paths: str) -> str:
    """First line that is not blank, in the first file that has one; bad bytes are replaced."""
    for path in paths:
        lines = spark.read.text(path).filter(F.trim("value") != "").head(1)
        if lines:
            return lines[0]["value"].lstrip("\ufeff")
    raise ValueError("file is empty")


def list_sources(spark: SparkSession, folder: str, by: str = "file") -> list[ReviewSource]:
    """Sources below a folder in path order. ``by='folder'`` takes each folder as one source.

    Only the listing reaches the driver.
    """
    sources: dict[str, ReviewSource] = {}
    for path in _review_paths(spark, folder):
        unit = os.path.dirname(path) if by == "folder" else path
        sources.setdefault(unit, ReviewSource(unit)).parts.append(path)
    return list(sources.values())


def sources_of(paths: Sequence[str]) -> list[ReviewSource]:
    """Sources from an explicit list of files, in that order."""
    return [ReviewSource(p, [p]) for p in paths]


def resolve_sources(
    spark: SparkSession, sources: Sequence[ReviewSource], synonyms: Mapping[str, list[str]] = HEADER_SYNONYMS
) -> list[ReviewSource]:
    """Sizes and header lines of all sources, in one job whatever the number of files.

    A source has the header of its first part that is not blank. One that cannot be read gets status
    'unreadable'; storage faults stop the job. Per file two numbers and a digest come to the driver,
    and a header line once per task that met it.
    """
    for source in sources:
        check_suffix(source.name)
    paths = [p for s in sources for p in s.parts]
    if not paths:
        return list(sources)
    listed = pa.table({"place": pa.array(range(len(paths)), pa.int64()), "path": pa.array(paths, pa.string())})
    tasks = max(spark.sparkContext.defaultParallelism, -(-len(paths) // HEADS_PER_TASK))
    heads = spark.createDataFrame(listed).repartition(min(tasks, len(paths))).mapInArrow(_read_heads, HEADS).toArrow()
    heads = heads.sort_by("place")
    lines = {d: line for d, line in zip(heads["digest"].to_pylist(), heads["line"].to_pylist()) if line is not None}
    sizes, digests = heads["size"].to_pylist(), heads["digest"].to_pylist()
    known: dict[tuple, dict] = {}
    first = 0
    for source in sources:
        own = range(first, first + len(source.parts))
        first = own.stop
        source.sizes = [max(sizes[i], 0) for i in own]
        missing = [paths[i] for i in own if sizes[i] < 0]
        digest = next((digests[i] for i in own if digests[i] is not None), None)
        key = (digest, source.name.lower().endswith(".txt"))
        if missing:
            source.status, source.error = "unreadable", f"no such file: {missing[0]}"
            continue
        if key not in known:
            known[key] = _header_facts(lines.get(digest), key[1], synonyms)
        for name, value in known[key].items():
            setattr(source, name, value)
    return list(sources)


def _header_facts(line: str | None, sniff: bool, synonyms: Mapping[str, list[str]]) -> dict:
    """What a header line says about its source; sources with one line share the result."""
    try:
        if line is None:
            raise ValueError("file is empty")
        delimiter = sniff_delimiter(line) if sniff else ","
        raw = split_header(line, delimiter)
        mapping = map_columns([normalize_header(h) for h in raw], synonyms)
    except ValueError as problem:
        return {"status": "unreadable", "error": str(problem)}
    return {"delimiter": delimiter, "raw_headers": raw, "mapping": mapping}


def _read_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size and first line of each file; a size below 0 stands for a missing file."""
    told = set()
    for batch in batches:
        rows = []
        for place, path in zip(batch["place"].to_pylist(), batch["path"].to_pylist()):
            size, line = _head(path)
            digest = None if line is None else hashlib.md5(line.encode()).digest()
            rows.append((place, size, digest, None if digest in told else line))
            told.add(digest)
        types = (pa.int64(), pa.int64(), pa.binary(), pa.string())
        columns = [pa.array(values, kind) for values, kind in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types]
        yield pa.RecordBatch.from_arrays(columns, names=["place", "size", "digest", "line"])


def _head(path: str) -> tuple[int, str | None]:
    local = "://" not in path or path.startswith("file:")
    store, inner = file_store(path if local else quote(path, safe=":/@"))
    found = store.get_file_info(inner)
    if found.type != pafs.FileType.File:
        return -1, None
    with store.open_input_stream(inner, compression=None) as raw:
        for line in io.TextIOWrapper(raw, "utf-8", "replace"):
            if line.strip(" \n"):
                return found.size, line.removesuffix("\n").lstrip("\ufeff")
    return found.size, None


def file_report(spark: SparkSession, sources: Sequence[ReviewSource]) -> DataFrame:
    rows = [(s.name, s.status, s.delimiter, s.error) for s in sources]
    return spark.createDataFrame(
        rows, "source_file string, status string, delimiter string, error string"
    )


def schema_audit(spark: SparkSession, sources: Sequence[ReviewSource]) -> DataFrame:
    """Which header fed which target column, sorted."""
    rows = [
        (s.name, target, raw)
        for s in sources
        if s.status == "ok"
        for target, raw in s.mapping.items()
    ]
    audit = spark.createDataFrame(rows, "source_file string, unified_col string, raw_col string")
    return audit.orderBy("source_file", "unified_col")


def leaves_open(line: Column, delimiter: str, inside: bool) -> Column:
    """Whether a quoted cell is open after the line, which starts a record or ``inside`` such a cell.

    A quote opens a cell only as its first character; two quotes in a quoted cell are one character;
    what follows the closing quote up to the delimiter belongs to the cell.
    """
    sep = re.escape(delimiter)
    quoted = r'[^"]*+(?:""[^"]*+)*+'
    rest = f"[^{sep}]*+{sep}"
    cells = f'(?:"{quoted}"{rest}|[^"{sep}]{rest}|{sep})*+"{quoted}' + r"\z"
    return line.rlike(f'^{quoted}(?:\\z|"{rest}{cells})' if inside else f"^{cells}")


def read_delimited(
    spark: SparkSession,
    paths: Sequence[str],
    headers: Sequence[str],
    delimiter: str = ",",
    multi_line: bool | str = "auto",
) -> DataFrame:
    """All cells as text, plus ``_path`` and ``_position``.

    ``multi_line``: True reads each file in one task; False splits files and ends a record at
    every line break; 'stitch' and 'auto' split files and keep quoted line breaks (see
    ``read_stitched``).
    """
    if multi_line in ("auto", "stitch"):
        return read_stitched(spark, paths, headers, delimiter)
    schema = StructType([StructField(h, StringType()) for h in headers])
    rows = (
        spark.read.schema(schema)
        .options(header=True, sep=delimiter, quote='"', escape='"', encoding="UTF-8")
        .option("multiLine", bool(multi_line))
        .csv(list(paths))
    )
    return rows.select(
        "*",
        F.col("_metadata.file_path").alias("_path"),
        _position().alias("_position"),
    )


def read_stitched(
    spark: SparkSession, paths: Sequence[str], headers: Sequence[str], delimiter: str = ","
) -> DataFrame:
    """Splittable scan, in one pass, of files whose quoted cells may hold line breaks.

    A line opens a record if no quoted cell is open before it. A task reads its split from both
    possible states until a line leaves the same state after either; from there on records are
    known and complete (see ``reviewmill.sources.records``). They are stored as they are met; one
    row per split then decides the state of the lines before, which are records of one line as a
    rule, and only the lines of a record that crosses that point or the end of a split are grouped.
    """
    value = F.col("value")
    plain = ~F.contains(value, F.lit('"'))  # keeps whatever state it meets
    lines = spark.read.option("lineSep", "\n").text(list(paths)).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        _position().alias("at"),
        value.alias("line"),
        F.when(plain, False).otherwise(leaves_open(value, delimiter, False)).alias("from_closed"),
        F.when(plain, True).otherwise(leaves_open(value, delimiter, True)).alias("from_open"),
    )
    kept = scratch_dir(spark, "records")
    lines.mapInArrow(split_records, PIECES).write.partitionBy("kind").parquet(kept)
    pieces = spark.read.schema(PIECES).parquet(kept)
    records = pieces.where(F.col("kind") == RECORD).select("path", F.col("at").alias("record"), "line", "head")
    kinds = {r["kind"] for r in pieces.select("kind").distinct().collect()}
    if kinds & {UNKNOWN, TAIL}:
        records = records.unionByName(_crossing(pieces))
    schema = ", ".join(f"c{i} string" for i in range(len(headers)))
    options = {"sep": delimiter, "quote": '"', "escape": '"', "multiLine": "true"}
    record = F.rtrim(F.col("line"), F.lit("\r"))
    cells = records.filter(~F.col("head") & (F.trim(record) != "")).select(
        F.from_csv(record, F.lit(schema), options).alias("_cells"), "path", "record"
    )
    return cells.select("_cells.*", "path", "record").toDF(*headers, "_path", "_position")


def _crossing(pieces: DataFrame) -> DataFrame:
    """Records that begin or end where the state of a split was not known: (path, record, line, head)."""
    in_file = Window.partitionBy("path").orderBy("block")
    splits = pieces.where(F.col("kind") == SPLIT).select(
        "path", "block", F.col("from_closed").alias("_from_closed"), F.col("from_open").alias("_from_open"),
        F.col("last_if_closed"), F.col("last_if_open"),
    )
    last = F.when(F.col("_open"), F.col("last_if_open")).otherwise(F.col("last_if_closed"))
    states = _with_states(splits, in_file).withColumn("_last", last).select(
        "path", "block", F.col("_open").cast("int").alias("state"),
        F.max("_last").over(in_file.rowsBetween(Window.unboundedPreceding, -1)).alias("carried"),
    )
    # one row per split that has lines of an unknown state
    unknown = pieces.where(F.col("kind") == UNKNOWN)
    met = unknown.join(broadcast_if_small(states), ["path", "block"])
    opening = F.when(F.col("state") == 0, F.col("last_if_closed")).otherwise(F.col("last_if_open"))
    placed = met.select(
        "path", F.coalesce(opening, "carried").alias("record"), "at", "line", "head",
        ((F.col("parity") == F.col("state")) & ~F.col("from_closed")).alias("whole"),
    )
    tails = pieces.where(F.col("kind") == TAIL).select("path", F.col("record"), "at", "line", "head")
    parts = F.array_sort(F.collect_list(F.struct("at", "line")))
    crossing = placed.where("not whole").drop("whole").unionByName(tails).groupBy("path", "record").agg(
        F.array_join(F.transform(parts, lambda part: part["line"]), "\n").alias("line"), F.max("head").alias("head"),
    )
    return placed.where("whole").select("path", "record", "line", "head").unionByName(crossing)


def _with_states(rows: DataFrame, order: WindowSpec) -> DataFrame:
    """Adds the state before each row: ``_open`` if none is open at the start, ``_open_else`` if one is.

    A row whose outcome does not depend on the state before it settles it; of the others only the
    number of those that turn it round counts.
    """
    up_to = order.rowsBetween(Window.unboundedPreceding, 0)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    settles = F.col("_from_closed") == F.col("_from_open")
    turns = (F.col("_from_closed") & ~F.col("_from_open")).cast("int")
    counted = rows.withColumn("_turns", F.sum(turns).over(up_to))
    settled = F.when(settles, F.struct(F.col("_from_closed").cast("int").alias("state"), "_turns"))
    counted = counted.withColumns({
        "_settled": F.last(settled, ignorenulls=True).over(before),
        "_past": F.coalesce(F.last("_turns").over(before), F.lit(0)),
    })
    since = F.col("_past") - F.coalesce(F.col("_settled._turns"), F.lit(0))
    opened = (F.coalesce(F.col("_settled.state"), F.lit(0)) + since) % 2 == 1
    return counted.withColumns({
        "_open": opened, "_open_else": F.when(F.col("_settled").isNull(), ~opened).otherwise(opened),
    }).drop("_settled", "_turns", "_past")


def _position() -> Column:
    """Place of a row in its file: the block's first byte plus the row count of the task."""
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return F.col("_metadata.file_block_start") + row


def by_layout(sources: Sequence[ReviewSource]) -> list[list[ReviewSource]]:
    """Readable sources in groups of one header layout each."""
    layouts: dict[tuple, list[ReviewSource]] = {}
    for source in sources:
        if source.status == "ok":
            layouts.setdefault(source.layout, []).append(source)
    if not layouts:
        raise FileNotFoundError("no readable review files")
    return list(layouts.values())


def scan_reviews(
    spark: SparkSession,
    sources: Sequence[ReviewSource],
    multi_line: bool | str = "auto",
    drop_empty: bool = True,
) -> DataFrame:
    """Mapped text columns of all readable files, with ``source_file``, ``ord``, ``has_rating``.

    Files with one header layout are read by one scan, so the plan grows with the number of
    layouts, not of files. Rows empty in every mapped column are dropped here (or flagged in
    ``has_content``).
    """
    # Always 0. A row counter in the projection keeps the filter on ``has_content`` above it;
    # pushed down, that predicate would parse every column a second time.
    hold = F.monotonically_increasing_id().bitwiseAND(F.lit(0))
    parts = []
    for group, rows in _scan_layouts(spark, sources, multi_line):
        mapping = group[0].mapping
        cells = {t: null_literals(F.col(f"`{h}`")) for t, h in mapping.items()}
        present = F.lit(False)
        for cell in cells.values():
            present = present | cell.isNotNull()
        placed = rows.select(
            *[cells.get(t, F.lit(None).cast("string")).alias(t) for t in TEXT_TARGETS],
            "source_file",
            (F.col("ord") + hold).alias("ord"),
            F.lit("rating_raw" in mapping).alias("has_rating"),
            present.alias("has_content"),
        )
        parts.append(placed.filter("has_content").drop("has_content") if drop_empty else placed)
    return reduce(DataFrame.unionByName, parts)


def scan_raw(
    spark: SparkSession, sources: Sequence[ReviewSource], multi_line: bool | str = "auto"
) -> list[DataFrame]:
    """One frame per header layout, under the headers as written, with ``source_file``."""
    frames = []
    for group, rows in _scan_layouts(spark, sources, multi_line):
        named = [
            null_literals(F.col(f"`{h}`")).alias(raw)
            for h, raw in zip(group[0].headers, group[0].raw_headers)
        ]
        frames.append(rows.select(*named, "source_file", "ord"))
    return frames


def _scan_layouts(
    spark: SparkSession, sources: Sequence[ReviewSource], multi_line: bool | str
) -> list[tuple[list[ReviewSource], DataFrame]]:
    """The sources and rows of each layout; stitched ones are read side by side."""
    groups, starts = by_layout(sources), _starts(spark, sources)
    with ThreadPoolExecutor(8) as pool:
        return list(zip(groups, pool.map(lambda group: _scan_layout(spark, group, starts, multi_line), groups)))


def _starts(spark: SparkSession, sources: Sequence[ReviewSource]) -> dict[str, int]:
    """The first ordinal of each file."""
    paths = [p for s in sources for p in s.parts]
    # rows that a task has counted in other files take no more bytes than its partition has
    room = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    starts = list(accumulate((n + room for s in sources for n in s.sizes), initial=0))
    if starts[-1] >= 1 << 63:
        raise ValueError("the files take more than 2^63 bytes")
    return dict(zip(paths, starts))


def _scan_layout(
    spark: SparkSession, group: list[ReviewSource], starts: Mapping[str, int], multi_line: bool | str
) -> DataFrame:
    """Cells under normalized headers, with the source name and the ordinal."""
    paths = [p for s in group for p in s.parts]
    headers, written = group[0].headers, group[0].raw_headers
    rows = read_delimited(spark, paths, written, group[0].delimiter, multi_line)
    rows = rows.toDF(*headers, "_path", "_position")
    if len(paths) == 1:
        ranked = rows.withColumns(
            {
                "source_file": F.lit(group[0].name),
                "_start": F.lit(starts[paths[0]]).cast("long"),
            }
        )
    else:
        # The scan reports paths percent-encoded.
        encoded = {_bare(unquote(p)): _bare(p) for p in spark.read.text(paths).inputFiles()}
        listed = [
            (encoded.get(_bare(p), _bare(p)), starts[p], s.name)
            for s in group
            for p in s.parts
        ]
        if len({path for path, _, _ in listed}) < len(listed):
            raise ValueError("two input files have the same path on different stores")
        columns = [pa.array(values) for values in zip(*listed)]
        places = spark.createDataFrame(pa.table(columns, names=["_file", "_start", "source_file"]))
        bare = F.regexp_replace("_path", SCHEME, "/")
        # one row per listed file
        ranked = rows.join(broadcast_if_small(places), bare == F.col("_file"))
    return ranked.select(
        *[F.col(f"`{h}`") for h in headers],
        "source_file",
        (F.col("_start") + F.col("_position")).alias("ord"),
    )


# Scheme and authority of a path, which a listing and a scan may spell differently.
SCHEME = "^[a-zA-Z0-9]+:(//[^/]*)?/+"


def _bare(path: str) -> str:
    return re.sub(SCHEME, "/", path)


def scan_csv(spark: SparkSession, path: str, multi_line: bool | str = "auto") -> DataFrame:
    """One delimited file with its own headers, cells as text."""
    check_suffix(path)
    line = header_line(spark, path)
    delimiter = sniff_delimiter(line) if path.lower().endswith(".txt") else ","
    headers = split_header(line, delimiter)
    rows = read_delimited(spark, [path], headers, delimiter, multi_line)
    return rows.select(*[null_literals(F.col(f"`{h}`")).alias(h) for h in headers])


def scan_by_header(spark: SparkSession, path: str, multi_line: bool | str = "auto") -> DataFrame:
    """Delimiter from header counts, lossy UTF-8; cells kept as they are, blank cells as ''."""
    try:
        line = header_line(spark, path)
    except ValueError:
        return spark.createDataFrame([], "review_id string, review_text string")
    headers = split_header(line, choose_delimiter(line))
    rows = read_delimited(spark, [path], headers, choose_delimiter(line), multi_line)
    return rows.select(*[F.coalesce(F.col(f"`{h}`"), F.lit("")).alias(h) for h in headers])


def scan_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Restaurant metadata: simple header rule, numbers for stars and totals."""
    rows = scan_csv(spark, path)
    renamed = rows.toDF(*[simple_header(c) for c in rows.columns])
    numeric = {
        c: coerce_numeric(F.col(c)) for c in ("avg_stars", "total_reviews") if c in renamed.columns
    }
    return renamed.withColumns(numeric) if numeric else renamed


def scan_processed(spark: SparkSession, path: str) -> DataFrame:
    """Processed reviews; the reader prunes to the columns in use."""
    return spark.read.parquet(path)


RECORD_SCHEMA = "review_id string, location string, rating float, text string"


def scan_records(requests: DataFrame, request: str = "request") -> DataFrame:
    """Records given inline in JSON requests, ``{"records": [...]}``; no text filter on this path."""
    parsed = F.from_json(F.col(request), f"records array<struct<{_struct(RECORD_SCHEMA)}>>")
    return requests.select(parsed["records"].alias("records")).select(F.inline("records"))


def _struct(schema: str) -> str:
    return ", ".join(field.replace(" ", ": ", 1) for field in schema.split(", "))
