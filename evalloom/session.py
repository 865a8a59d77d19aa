"""A session with the settings that the library's results rely on."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def session(name: str = "evalloom", **settings: str) -> SparkSession:
    """UTC, ANSI and adaptive execution; other settings by keyword, with _ for the dots of their names."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.ansi.enabled", "true").config("spark.sql.adaptive.enabled", "true")
    for key, value in settings.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, spark.checkpoint.dir. Where that is not set, a local one serves a local master; on a cluster each executor would write to its own disk."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.evalloom.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="evalloom-")
        spark.conf.set("spark.evalloom.dir", folder)
    return folder.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def settled(frame: DataFrame, name: str = "settled", schema: StructType | None = None) -> DataFrame:
    """The frame, worked out once and written to the shared folder: its lineage ends there, and what reads it sees the same rows even if executors are lost. Parts of vectors are read as vectors by a schema that says so."""
    path = shared_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(schema or frame.schema).parquet(path)


def dropped(*frames: DataFrame) -> None:
    """Deletes the files of settled frames that nothing is to read again."""
    for frame in frames:
        for folder in {file.rsplit("/", 1)[0] for file in frame.inputFiles()}:
            at = frame.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            at.getFileSystem(frame.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
