"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "reviewmill", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_scratch(spark: SparkSession) -> None:
    """Give a local session a scratch folder if it names none; a cluster must name a shared one."""
    if _shared(spark):
        return
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="reviewmill-"))


def _shared(spark: SparkSession) -> str | None:
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new folder path below the shared folder named in ``spark.checkpoint.dir``.

    Tables cut from a long lineage and staged text files go here. There is no other place for
    them: without a shared folder this fails.
    """
    shared = _shared(spark)
    if not shared:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return os.path.join(shared, f"{label}-{uuid.uuid4().hex[:12]}")


def file_store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system that holds a shared path and the path inside it, for reads in a task."""
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[len("file:") :].lstrip("/")
    return pafs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
