"""The keyed vector table: last write wins per key."""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from reviewmill.fixed import VECTOR_DIM
from reviewmill.operators.embed import Embedder, embed_batches
from reviewmill.sizes import finer_partitions

ROW_SCHEMA = (
    "review_id string, location string, restaurant_name string, rating float, text string, "
    "vector array<float>"
)
CHUNK_SCHEMA = (
    "review_id string, chunk_no int, chunk_text string, location string, restaurant_name string, "
    "menu_item string, sentiment string, rating float, ts timestamp_ntz, vector array<float>"
)


def latest_per_key(batch: DataFrame, key: str = "review_id", seq: str = "seq") -> DataFrame:
    """The row with the largest ``seq`` per key, ties by the other columns.

    One row per key leaves each map task, so a hot key is cheap. Rows without a key are one key;
    a row without ``seq`` is an error.
    """
    order = F.coalesce(F.col(seq), F.raise_error(F.lit(f"a row has no {seq}")).cast(batch.schema[seq].dataType))
    rest = [c for c in batch.columns if c not in (key, seq)]
    best = batch.groupBy(key).agg(F.max(F.struct(order.alias(seq), *rest)).alias("_last"))
    return best.select(*[F.col(c) if c == key else F.col(f"_last.{c}").alias(c) for c in batch.columns])


def _same(left: DataFrame, right: DataFrame, key: str) -> Column:
    return left[key].eqNullSafe(right[f"_{key}"])


def merge_latest(
    existing: DataFrame, batch: DataFrame, key: str = "review_id", seq: str = "seq"
) -> DataFrame:
    """Existing rows whose key is not in the batch, and the batch's last row per key."""
    fresh = latest_per_key(batch, key, seq)
    keys = fresh.select(F.col(key).alias(f"_{key}"))
    kept = existing.join(keys, _same(existing, keys, key), "left_anti")
    return kept.unionByName(fresh.drop(seq), allowMissingColumns=True)


class VectorTable:
    """Keyed rows, one folder per version; the largest version of a key counts.

    An upsert adds the batch's rows under its version and touches nothing else. Applied again, it
    replaces that folder, so a replay leaves the same rows. ``read`` picks the newest version per
    key; ``compact`` writes the outcome as a table of its own.
    """

    def __init__(
        self, spark: SparkSession, path: str, schema: str = ROW_SCHEMA, key: str = "review_id",
        dim: int = VECTOR_DIM,
    ):
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, key
        self.dim = dim

    def versions(self) -> DataFrame:
        """All rows of all versions."""
        schema = f"{self.schema}, version bigint"
        try:
            return self.spark.read.schema(schema).parquet(self.path)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        """Current rows. Keys are unique inside a version, so the rows of a single one are all current."""
        rows = self.versions()
        if len({os.path.dirname(f) for f in rows.inputFiles()}) <= 1:
            return rows.filter(F.col("version").isNotNull()).drop("version")
        newest = rows.groupBy(F.col(self.key).alias(f"_{self.key}")).agg(F.max("version").alias("_version"))
        current = _same(rows, newest, self.key) & (rows["version"] == newest["_version"])
        return rows.join(newest, current, "left_semi").drop("version")

    def _write(self, rows: DataFrame, version: int) -> None:
        fields = [f.split()[0] for f in self.schema.split(", ")]
        rows.select(*fields).write.mode("overwrite").parquet(f"{self.path}/version={version:010d}")

    def upsert(
        self, batch: DataFrame, version: int, seq: str = "seq",
        embedder: Embedder | None = None, text: str = "text",
    ) -> dict[str, int]:
        """Per key the batch's last row counts from this version on.

        With an embedder, vectors are made here, for the last rows only and once. A row without
        a vector of the right size is counted as failed and not stored; ``replaced`` rows gave way
        to a later one of the batch. The three add up to the rows of the batch.
        """
        came, seen = Observation(), Observation()
        rows = latest_per_key(batch.observe(came, F.count(F.lit(1)).alias("rows")), self.key, seq).drop(seq)
        if embedder is not None:
            rows = embed_batches(rows, embedder, text)
        fits = F.coalesce(F.size("vector") == self.dim, F.lit(False)) & F.col("vector").isNotNull()
        counted = rows.observe(
            seen, F.count_if(fits).alias("indexed"), F.count_if(~fits).alias("failed")
        )
        with finer_partitions(batch.sparkSession):
            self._write(counted.filter(fits), version)
        found = {name: int(seen.get[name]) for name in ("indexed", "failed")}
        return {**found, "replaced": int(came.get["rows"]) - sum(found.values())}

    def compact(self, path: str) -> VectorTable:
        """The current rows as the only version of another table."""
        small = VectorTable(self.spark, path, self.schema, self.key, self.dim)
        small._write(self.read(), 0)
        return small


def append_chunks(docs: DataFrame, path: str) -> dict[str, int]:
    """Append chunk documents that have a vector; returns indexed and failed counts.

    A rerun adds them again; read them through ``distinct_chunks``.
    """
    seen = Observation()
    missing = F.col("vector").isNull()
    counted = docs.observe(
        seen, F.count_if(~missing).alias("indexed"), F.count_if(missing).alias("failed")
    )
    with finer_partitions(docs.sparkSession):
        counted.filter(~missing).write.mode("append").parquet(path)
    return {name: int(seen.get[name]) for name in ("indexed", "failed")}


def distinct_chunks(docs: DataFrame) -> DataFrame:
    """One row per (review, chunk), which makes repeated appends harmless."""
    return docs.dropDuplicates(["review_id", "chunk_no"])
