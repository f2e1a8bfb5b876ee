"""New review files, standardized as they arrive.

Every sink writes one folder per micro-batch and overwrites it on replay, so a batch that runs
again after a failure leaves the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from reviewmill.fixed import HEADER_SYNONYMS
from reviewmill.functions.numbers import coerce_numeric, rating_1_5, scale_from_max
from reviewmill.functions.text import null_literals
from reviewmill.operators.dedup import TEXT_KEY, digest
from reviewmill.operators.embed import Embedder
from reviewmill.operators.vector_table import VectorTable
from reviewmill.plans.index import embed_projection
from reviewmill.plans.standardize import apply_scales, coerce_types, derive, final_projection
from reviewmill.sizes import broadcast_if_small
from reviewmill.sources.headers import map_columns

# Where a streamed row came from; used for its order inside a micro-batch.
PLACE = ["_path", "_block"]
# Low bits of an order, for the place in a file; the file's rank in its batch lies above.
POSITION_BITS = 43
# Texts that a task remembers, to leave out repeats before the shuffle.
MET_TEXTS = 1_000_000
# State that does not have to fit into the executors' memory.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_reviews(
    spark: SparkSession, folder: str, headers: Sequence[str], delimiter: str = ",",
    multi_line: bool = True, files_per_batch: int | None = None, source: str | None = None,
) -> DataFrame:
    """Stream of mapped text columns; all files of a folder share one header line.

    ``source`` names the whole folder as one source; without it each file is its own.
    """
    schema = ", ".join(f"`{h}` string" for h in headers)
    reader = spark.readStream.schema(schema).options(
        header=True, sep=delimiter, quote='"', escape='"', multiLine=multi_line
    )
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    mapping = map_columns(headers)
    cells = [
        (null_literals(F.col(f"`{mapping[t]}`")) if t in mapping else F.lit(None).cast("string"))
        .alias(t)
        for t in HEADER_SYNONYMS
    ]
    return reader.csv(folder).select(
        *cells,
        (F.lit(source) if source else _decoded(F.col("_metadata.file_name"))).alias("source_file"),
        F.col("_metadata.file_modification_time").alias("arrived"),
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.lit("rating_raw" in mapping).alias("has_rating"),
    )


def _decoded(name: Column) -> Column:
    """A percent-encoded file name as written; a plus sign is itself."""
    return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))


def with_batch_order(batch: DataFrame) -> DataFrame:
    """``ord`` inside a micro-batch: file by path, then position."""
    # One row per file of the batch, which the source limits.
    paths = [r["_path"] for r in batch.select("_path").distinct().orderBy("_path").collect()]
    ranks = batch.sparkSession.createDataFrame(
        [(p, i) for i, p in enumerate(paths)], "_path string, _rank long"
    )
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = batch.withColumn("_position", F.col("_block") + row)
    ranked = placed.join(F.broadcast(ranks), "_path")
    order = F.shiftleft("_rank", POSITION_BITS).bitwiseOR(F.col("_position")).alias("ord")
    return ranked.select(*[c for c in batch.columns if c not in PLACE], order)


def _run(stream: DataFrame, checkpoint: str, each) -> list[dict]:
    query = (
        stream.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query.recentProgress


def _overwrite(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id:010d}")


def stream_intake(stream: DataFrame, out: str, checkpoint: str, **coercion) -> None:
    """Typed rows appended as files arrive. Ratings are scaled when read (``read_scaled``)."""
    typed = coerce_types(stream.drop(*PLACE), **coercion)
    query = (
        typed.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def stream_dedup(stream: DataFrame, out: str, checkpoint: str) -> list[dict]:
    """Keep-first by text across micro-batches; returns what the batches report of their progress.

    Which texts have been seen is kept in the query's state store, an entry per source and digest,
    so a batch looks up its own texts and reads nothing that earlier ones wrote. A task leaves out
    the texts that it has met already, so a text that many rows share is one row per task in the
    shuffle. Of the rows of a batch the first counts: file by path, then position. It is picked
    before the state is asked, which then meets a text once per batch.
    """
    typed = coerce_types(stream).withColumn("text_key", digest(F.col(TEXT_KEY[0])))
    placed = StructType([*typed.schema.fields, StructField("_position", LongType())])
    kept = StructType([f for f in typed.schema.fields if f.name not in PLACE])
    key = ["source_file", "text_key"]
    firsts = typed.mapInArrow(_first_of_task, placed).repartition(*key).mapInArrow(_first_of_batch(kept.names), kept)
    firsts = firsts.dropDuplicates(key)
    spark = stream.sparkSession
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, ROCKS)
    try:
        return _run(firsts.drop("text_key"), checkpoint, lambda batch, batch_id: _overwrite(batch, out, batch_id))
    finally:
        spark.conf.set(provider, before) if before else spark.conf.unset(provider)


def _first_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their position in the file, without texts that the task has met in the same file.

    A task may take files in any order, so that only the order inside a file decides here.
    """
    met: set[tuple] = set()
    at, file = 0, None
    for batch in batches:
        columns = [batch.column(name).to_pylist() for name in ("source_file", "text_key", "_path", "_block")]
        keep, positions = [], []
        for i, (source, key, path, block) in enumerate(zip(*columns)):
            if (path, block) != file:
                file, at = (path, block), -1
                met.clear()
            at += 1
            if (source, key) not in met:
                if len(met) < MET_TEXTS:  # beyond, rows go on to the shuffle, which decides anyway
                    met.add((source, key))
                keep.append(i)
                positions.append(block + at)
        yield pa.RecordBatch.from_arrays(
            [*(column.take(pa.array(keep, pa.int64())) for column in batch.columns), pa.array(positions, pa.int64())],
            [*batch.schema.names, "_position"],
        )


def _first_of_batch(columns: list[str]):
    """The first row of each text by file and position, where all rows of a text are in one partition."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple, tuple] = {}
        held = []
        for batch in batches:
            names = ("source_file", "text_key", "_path", "_position")
            for i, (source, key, *place) in enumerate(zip(*(batch.column(n).to_pylist() for n in names))):
                row = (place, len(held), i)
                best[source, key] = min(best.get((source, key), row), row)
            held.append(batch.select(columns))
        rows: list[list[int]] = [[] for _ in held]
        for _, number, i in best.values():
            rows[number].append(i)
        for batch, taken in zip(held, rows):
            yield batch.take(pa.array(taken, pa.int64()))

    return first


def stream_scale(stream: DataFrame, out: str, maxima_out: str, checkpoint: str) -> None:
    """Typed rows, and the largest rating per source and batch."""

    def each(batch: DataFrame, batch_id: int) -> None:
        typed = coerce_types(with_batch_order(batch))
        _overwrite(typed, out, batch_id)
        tops = typed.groupBy("source_file").agg(
            F.max("rating_raw").alias("top"), F.max("has_rating").alias("has_rating")
        )
        _overwrite(tops, maxima_out, batch_id)

    _run(stream, checkpoint, each)


def read_scaled(spark: SparkSession, rows: str, maxima: str) -> DataFrame:
    """Rows with ratings on the scale known now.

    The scale joins at reading, so a source whose maximum grows needs no rewrite.
    """
    tops = spark.read.parquet(maxima).groupBy("source_file").agg(
        F.when(F.max("has_rating"), scale_from_max(F.max("top"))).alias("rating_scale")
    )
    typed = spark.read.parquet(rows)
    return final_projection(derive(apply_scales(typed, tops)), keep=["ord"])


def stream_upsert(
    stream: DataFrame, table: VectorTable, embedder: Embedder, checkpoint: str,
    scales: DataFrame | None = None,
) -> None:
    """Arriving reviews into the vector table; the last row with a text per id wins.

    A micro-batch is a version of the table, so a replay overwrites itself.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        rows = with_batch_order(batch)
        rated = rows.withColumn("rating_1_5", coerce_numeric(F.col("rating_raw")))
        if scales is not None:
            known = rated.join(broadcast_if_small(scales), "source_file", "left")
            rated = known.withColumn(
                "rating_1_5", rating_1_5(F.col("rating_1_5"), F.col("rating_scale"))
            )
        docs = embed_projection(rated, keep=["ord"])
        table.upsert(docs, batch_id, seq="ord", embedder=embedder)

    _run(stream, checkpoint, each)


def stream_counts(stream: DataFrame, out: str, counts_out: str, checkpoint: str) -> DataFrame:
    """Writes the stream and returns its counters: rows seen, with text, and with a rating that parses.

    A batch counts its rows while it writes them and stores the counters under its number, so that
    neither another stream nor a batch that runs again changes the totals.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        seen = Observation()
        counted = batch.observe(
            seen,
            F.count(F.lit(1)).alias("rows"),
            F.count("review_text").alias("with_text"),
            F.count(coerce_numeric(F.col("rating_raw"))).alias("rated"),
        )
        _overwrite(counted.drop(*PLACE), out, batch_id)
        row = batch.sparkSession.createDataFrame([seen.get], COUNTERS)
        _overwrite(row, counts_out, batch_id)

    _run(stream, checkpoint, each)
    stored = stream.sparkSession.read.schema(COUNTERS).parquet(counts_out)
    return stored.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("rows", "with_text", "rated")])


COUNTERS = "rows bigint, with_text bigint, rated bigint"
