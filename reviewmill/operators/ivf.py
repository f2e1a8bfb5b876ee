"""Approximate search: vectors in lists around k-means centres.

A query looks only into its nearest lists. Stored by list, the files of other lists are not
read; a hot list is just more batches to score, since documents are never grouped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from reviewmill.operators.search import (
    _matrix,
    _no_hits,
    _unit,
    score_stored,
    store_queries,
    topk_per_query,
)


def _space(rows: np.ndarray, metric: str) -> np.ndarray:
    """Vectors as centres see them: of unit length for cosine and dot, as they are for l2."""
    return rows if metric == "l2" else _unit(rows)


def train_centres(
    docs: DataFrame, lists: int, vector: str = "embedding", seed: int = 42, iterations: int = 10,
    metric: str = "cosine",
) -> np.ndarray:
    """Centres of the lists by distributed k-means over all vectors, in the metric's space.

    Dot products take the lists of the cosine: vectors of any length in the query's direction.
    """
    rows = docs.filter(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v"))
    if metric != "l2":
        size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda total, x: total + x * x))
        rows = rows.select(size.alias("size"), "v").select(
            F.when(F.col("size") > 0, F.transform("v", lambda x: x / F.col("size"))).otherwise(F.col("v")).alias("v")
        )
    model = KMeans(k=lists, seed=seed, maxIter=iterations).fit(rows.select(array_to_vector("v").alias("features")))
    return np.array(model.clusterCenters())


def assign_lists(
    docs: DataFrame, centres: np.ndarray, vector: str = "embedding", metric: str = "cosine"
) -> DataFrame:
    """Append ``list_id``, the nearest centre. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(centres)
    schema = StructType(docs.schema.fields + [StructField("list_id", IntegerType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle = shared.value
        for part in batches:
            rows = _space(_matrix(part.column(vector), middle.shape[1]), metric)
            gaps = (middle**2).sum(1)[None, :] - 2 * rows @ middle.T
            nearest = pa.array(gaps.argmin(1).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [*part.columns, nearest], [*part.schema.names, "list_id"]
            )

    fits = F.col(vector).isNotNull() & (F.size(vector) == centres.shape[1])
    return docs.filter(fits).mapInArrow(run, schema)


def write_index(indexed: DataFrame, path: str) -> None:
    """One folder per list; a large list is split over tasks."""
    indexed.hint("rebalance", "list_id").write.mode("overwrite").partitionBy("list_id").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def knn_approx(
    indexed: DataFrame,
    centres: np.ndarray,
    queries: DataFrame,
    k: int = 6,
    nprobe: int = 8,
    metric: str = "cosine",
    key: str = "vec_id",
    vector: str = "embedding",
    query: str = "query_id",
    query_vector: str = "query_vector",
) -> DataFrame:
    """k best documents per query among its ``nprobe`` nearest lists."""
    nprobe = min(nprobe, len(centres))
    lean = indexed.select(key, vector, "list_id")
    stored = store_queries(queries, query, query_vector)
    if stored is None:
        return _no_hits(lean.drop("list_id"), vector, query, queries)
    shared = queries.sparkSession.sparkContext.broadcast(centres)  # as many rows as lists

    def nearest(matrix: np.ndarray) -> np.ndarray:
        middle = shared.value
        gaps = (middle**2).sum(1)[None, :] - 2 * _space(matrix, metric) @ middle.T
        return np.argpartition(gaps, nprobe - 1, axis=1)[:, :nprobe]

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = np.unique(nearest(_matrix(batch.column(query_vector), centres.shape[1])))
            yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int32))], ["list_id"])

    def pairs(buffer: pa.Table, matrix: np.ndarray):
        near = nearest(matrix)
        lists = buffer.column("list_id").to_numpy()
        for number in np.unique(lists):
            asked = np.flatnonzero((near == number).any(axis=1))
            if len(asked):
                yield buffer.filter(pa.array(lists == number)).combine_chunks(), asked

    # Folders of lists that no query probes are not read; at most one row per list comes back.
    asked = queries.sparkSession.read.parquet(stored.folder).select(query_vector)
    wanted = [row[0] for row in asked.mapInArrow(probed, "list_id int").distinct().collect()]
    found = score_stored(
        lean.filter(F.col("list_id").isin(wanted)), stored, k, metric, key, vector, pairs
    )
    hits = topk_per_query(found, k, stored.label, key, score=F.desc("_order"))
    if metric == "l2":
        hits = hits.withColumn("score", -F.col("score"))
    return stored.named(hits).select(query, "rank", key, "score")
