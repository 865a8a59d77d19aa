"""Streams that don't arrive in order: predictions whose truths come later, and runs that arrive out of order or twice."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

#: The store that keeps values by key and name; without it a stream of runs can't be kept up.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RUNS = "session string, model string, metric string, runs long, mean double, std double"


def with_truths(predictions: DataFrame, truths: DataFrame, within: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Predictions (id, model, prediction, said_at) with the truth (id, label, known_at) that becomes known within so long after them. A prediction whose truth doesn't is given out without a label once the watermarks have passed,
    so that its state ends; rows later than the watermark are left out. Works on streams and on tables alike.
    """
    said = predictions.withWatermark("said_at", late).alias("p")
    known = truths.withWatermark("known_at", late).select(F.col("id").alias("truth_id"), "label", "known_at").alias("t")
    near = (F.col("p.id") == F.col("t.truth_id")) & (F.col("t.known_at") >= F.col("p.said_at")) & (F.col("t.known_at") <= F.col("p.said_at") + F.expr(f"INTERVAL {within}"))
    return said.join(known, near, "left_outer").select("p.id", "p.model", "p.prediction", "p.said_at", "t.label", "t.known_at")


def scored(rows: DataFrame) -> DataFrame:
    """(model, n, known, accuracy) of with_truths rows: all predictions, those with a truth, and the share of these that are right."""
    right = F.count_if(F.col("prediction") == F.col("label"))
    return rows.groupBy("model").agg(F.count("*").alias("n"), F.count("label").alias("known"), F.coalesce(F.try_divide(right.cast("double"), F.count("label").cast("double")), F.lit(0.0)).alias("accuracy"))


class LatestRuns(StatefulProcessor):
    """Keeps the newest value of each run of a (session, model, metric) and gives out their number, mean and deviation whenever rows of it arrive. A row that comes again, or an attempt older than the one that is kept, changes nothing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.values = handle.getMapState("values", "run int", "attempt long, value double")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        newest: dict[int, tuple[int, float]] = {}
        for part in rows:
            for run, attempt, value in zip(part["run"].tolist(), part["attempt"].tolist(), part["value"].tolist(), strict=True):
                if run not in newest or (attempt, value) > newest[run]:
                    newest[run] = attempt, value
        for run, (attempt, value) in newest.items():
            known = self.values.getValue((run,)) if self.values.containsKey((run,)) else None
            if known is None or (attempt, value) > (known[0], known[1]):
                self.values.updateValue((run,), (attempt, value))
        values = [v for _, (_, v) in sorted((k[0], tuple(v)) for k, v in self.values.iterator())]  # tens of runs
        mean = sum(values) / len(values)
        std = (sum((v - mean) ** 2 for v in values) / (len(values) - 1)) ** 0.5 if len(values) > 1 else 0.0
        yield pd.DataFrame([(*key, len(values), mean, std)], columns=[c.split()[0] for c in RUNS.split(", ")])

    def close(self) -> None:
        pass


def latest_runs(scores: DataFrame) -> DataFrame:
    """(session, model, metric, runs, mean, std) of a stream of (session, run, attempt, model, metric, value), null values left out; update mode, kept by LatestRuns."""
    whole = scores.where("value IS NOT NULL AND run IS NOT NULL AND attempt IS NOT NULL")
    return whole.groupBy("session", "model", "metric").transformWithStateInPandas(LatestRuns(), RUNS, "Update", "None")


def kept_up(spark: SparkSession, scores: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """latest_runs of what has arrived, each batch written to path/batch=<n>, where a batch that is repeated replaces itself. The session's store of state is set for the query's start and put back."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, STORE)
    try:
        query = latest_runs(scores).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
    finally:
        spark.conf.set(name, before)
    return query


def batch_runs(scores: DataFrame) -> DataFrame:
    """What latest_runs has given out last, of a table."""
    newest = scores.where("value IS NOT NULL AND run IS NOT NULL AND attempt IS NOT NULL").groupBy("session", "model", "metric", "run").agg(F.max(F.struct("attempt", "value"))["value"].alias("value"))
    found = newest.groupBy("session", "model", "metric").agg(F.count("*").alias("runs"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    return found.withColumn("std", F.coalesce("std", F.lit(0.0)))
