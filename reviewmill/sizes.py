"""Size checks that decide whether a side may be broadcast."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 32 * 1024 * 1024
ADVISORY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"


def broadcast_if_small(
    df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Broadcast a side whose size is proven, else leave it to a shuffled join.

    The side is evaluated once, up to a little past the limits. If it fits, the fetched rows
    stand in for it, so its plan (often an aggregate over the other side) does not run again.
    If not, the join shuffles, and adaptive execution splits skewed keys.
    """
    fetched = _fetched(df, max_rows + 1, max_bytes)
    if fetched.num_rows > max_rows or fetched.nbytes > max_bytes:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(fetched, df.schema))


def _fetched(df: DataFrame, max_rows: int, max_bytes: int) -> pa.Table:
    """Rows up to a number, or until they pass ``max_bytes`` by an eighth at most, or by one row.

    The task that holds the rows counts their bytes, so long texts do not come to the driver.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 0
        for batch in batches:
            rows = batch.num_rows
            if size + batch.nbytes > max_bytes:
                rows = max(1, batch.num_rows * max_bytes // (8 * batch.nbytes))
            for start in range(0, batch.num_rows, max(rows, 1)):
                if size > max_bytes:
                    break
                part = batch.slice(start, rows)
                size += part.nbytes
                yield part

    # A limit is one task already, but is dropped where the plan tells that there are fewer rows.
    return df.limit(max_rows).coalesce(1).mapInArrow(cut, df.schema).toArrow()


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash rows over all cores when the input has fewer files than there are cores.

    For work that costs far more than a shuffle of its input (chunking, embedding). An input of
    many files is left as it is. ``key`` is unique, so the parts are even.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if 0 < len(df.inputFiles()) < cores else df


@contextmanager
def finer_partitions(spark: SparkSession, size: str = "16m") -> Iterator[None]:
    """Inside the block, adaptive execution joins shuffled partitions up to ``size`` only.

    For work that costs far more than reading its rows. The default makes about one part per core,
    often one more, for which all other cores then wait. A size that the session sets is kept.
    """
    if spark.conf.get(ADVISORY, None) is not None:
        yield
        return
    spark.conf.set(ADVISORY, size)
    try:
        yield
    finally:
        spark.conf.unset(ADVISORY)
