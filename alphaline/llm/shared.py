"""Shared folder, lineage cuts and small column helpers of the corpus operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_folder: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only a single-JVM session (master ``local[...]``), as in tests, may go without the
    setting; it then gets one temporary folder, removed at its end. Anywhere else a missing setting is an error.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folder:
        folder = tempfile.mkdtemp(prefix="alphaline-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _own_folder[app] = f"file://{folder}"
    return _own_folder[app]


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: ends its lineage.

    The files outlive any executor. ``drop_cut`` removes them once they are no longer needed; what
    a result still reads from goes when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    system, at = _located(spark, path)
    system.deleteOnExit(at)
    again = spark.read.schema(df.schema).parquet(path)
    again._cut_path = path  # type: ignore[attr-defined]
    return again


def drop_cut(df: DataFrame | None) -> None:
    """Remove the files behind a frame that ``cut`` returned."""
    path = getattr(df, "_cut_path", None)
    if path is None:
        return
    system, at = _located(df.sparkSession, path)
    system.delete(at, True)


def _located(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def shuffle_partitions(spark: SparkSession) -> int:
    """The session's shuffle width; bucket counts follow it, so they grow with the cluster's setting."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else; pure ASCII texts take the fast path."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, upper, upper.lower())
    )


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
