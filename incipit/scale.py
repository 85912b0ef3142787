"""Cluster-safe helpers shared by the operators: materialised cuts and joins whose broadcast side is size-checked."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when a count shows at most this many rows and this many bytes of them, as JSON.
BROADCAST_ROWS, BROADCAST_BYTES = 20_000, 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's checkpoint folder.

    Where neither is set, a temporary folder serves local masters; elsewhere executors could not see it, so that is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="incipit-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/incipit/{label}-{uuid.uuid4().hex}"


def _on(spark: SparkSession, path: str, action: str, *args) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    getattr(p.getFileSystem(spark._jsc.hadoopConfiguration()), action)(p, *args)


def written(df: DataFrame, label: str = "cut") -> tuple[DataFrame, str]:
    """Write df as Parquet in the shared folder and read it again; the lineage ends there. Returns the frame and its path."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)  # its streams need no direct buffers, which only a collection frees
    _on(spark, path, "deleteOnExit")  # at the end of the driver
    return spark.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """written() for tables that the caller's result may still read: they go when the driver ends."""
    return written(df, label)[0]


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a folder made by written() that nothing reads any more."""
    _on(spark, path, "delete", True)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """At most this many rows in a batch for Python of the jobs that run inside: rows may be large, and a task holds a batch on both sides."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def planned_once(spark: SparkSession) -> Iterator[None]:
    """Jobs that run inside keep the plan they begin with. Loops of many small jobs gain nothing from adaptive plans, which are made,
    compiled and kept anew after every shuffle and broadcast: that is the driver's memory."""
    name = "spark.sql.adaptive.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """df marked for broadcast if its rows, and then the sum of their bytes as JSON, prove it small, else unmarked: the join then shuffles.

    Call it on a frame that is cheap to read, e.g. one from cut(): its rows are counted from the files' footers, its bytes
    summed by partition.
    """
    if df.count() > rows:
        return df
    total = df.agg(F.sum(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))).first()[0]
    return F.broadcast(df) if (total or 0) <= size else df
