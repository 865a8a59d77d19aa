"""Scores of runs as they arrive: each finished run adds files, and means over runs follow without reading old ones again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCORES = "session string, run int, model string, metric string, value double"


def arriving(spark: SparkSession, path: str, schema: str = SCORES, files_at_once: int = 1000) -> DataFrame:
    """Score files (JSON lines) below path, each read once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).option("recursiveFileLookup", True).json(path)


def mean_std(scores: DataFrame) -> DataFrame:
    """(session, model, metric, runs, mean, std) so far; the state is a few numbers for each of these."""
    found = scores.groupBy("session", "model", "metric").agg(F.count("value").alias("runs"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    return found.withColumn("std", F.coalesce("std", F.lit(0.0)))


def kept_up(results: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Writes what a batch has changed to path/batch=<n>; a batch that is repeated after a failure replaces itself. The latest batch of a key holds."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    writer = results.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if once else writer).start()


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest row of each (session, model, metric) that kept_up wrote."""
    rows = spark.read.parquet(path)
    newest = rows.groupBy("session", "model", "metric").agg(F.max_by(F.struct("runs", "mean", "std"), "batch").alias("x"))
    return newest.select("session", "model", "metric", "x.*")


def resumed(samples: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """work over a stream of samples, so that a broken run goes on after the last whole batch; rows that work drops do not shift what comes next."""
    return work(samples).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, time: str = "ts", every: str = "1 day", late: str = "1 day") -> DataFrame:
    """(start, model, n, mean): scores by time windows; events later than the watermark are left out, so that old windows leave the state."""
    rows = events.withWatermark(time, late).groupBy(F.window(time, every).alias("w"), "model").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return rows.select(F.col("w.start").alias("start"), "model", "n", "mean")
