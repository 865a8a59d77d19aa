"""Distributions and how far two of them are apart. A distribution is a long frame (by, key, p)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vocab import SIGNALS


def smoothed(counts: DataFrame, key: str, vocabulary: Sequence[str], alpha: float = 0.5) -> DataFrame:
    """(key, n, p) of the whole vocabulary with alpha added to each count."""
    spark = counts.sparkSession
    every = spark.createDataFrame([(v,) for v in vocabulary], f"{key} string")
    n = F.coalesce("n", F.lit(0)).cast("long")
    found = every.join(counts.select(key, "n"), key, "left").select(key, n.alias("n"))
    return found.withColumn("p", (F.col("n") + alpha) / F.sum(F.col("n") + alpha).over(Window.partitionBy()))


def signal_distributions(rows: DataFrame, text: str = "text", most: int = 5, least_rows: int = 5, alpha: float = 0.5) -> tuple[DataFrame, DataFrame] | None:
    """Smoothed shares of signals, and shares of how many a text has, over texts that have one; None if these are too few."""
    with_any = rows.select(T.signals(F.col(text)).alias("s")).where(F.size("s") > 0)
    if with_any.limit(least_rows).count() < least_rows:
        return None
    kinds = with_any.select(F.explode("s").alias("signal")).groupBy("signal").agg(F.count("*").alias("n"))
    return smoothed(kinds, "signal", SIGNALS, alpha), signal_counts(with_any, "s", most)


def signal_counts(rows: DataFrame, signals: str, most: int = 5) -> DataFrame:
    counts = rows.groupBy(F.least(F.size(signals), F.lit(most)).alias("signals")).agg(F.count("*").alias("n"))
    return counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy()))


def edit_distribution(rows: DataFrame, supported: Sequence[str], edits: str = "edits", most: int = 5, alpha: float = 0.5, least_rows: int = 5) -> tuple[DataFrame, DataFrame] | None:
    """Smoothed shares of supported types of edits, and shares of how many a row has, over rows that have one; None if these are too few."""
    known = rows.select(F.filter(F.col(edits), lambda e: e["type"].isin(*supported)).alias("s")).where(F.size("s") > 0)
    if known.limit(least_rows).count() < least_rows:
        return None
    kinds = known.select(F.explode("s.type").alias("type")).groupBy("type").agg(F.count("*").alias("n"))
    return smoothed(kinds, "type", supported, alpha), signal_counts(known, "s", most)


def jensen_shannon(a: DataFrame, b: DataFrame, key: str, by: Sequence[str] = (), p: str = "p") -> DataFrame:
    """(by, jsd) to base 2, of normalised shares; keys of one side count as 0 on the other."""
    part = Window.partitionBy(*by)
    x, y = (d.select(*by, key, (F.col(p) / F.nullif(F.sum(p).over(part), F.lit(0.0))).alias(n)) for d, n in ((a, "x"), (b, "y")))
    zero = F.lit(0.0)
    both = x.join(y, [*by, key], "full_outer").select(*by, key, F.coalesce("x", zero).alias("x"), F.coalesce("y", zero).alias("y"))
    middle = (F.col("x") + F.col("y")) / 2

    def part_of(side: str):
        return F.when(F.col(side) > 0, F.col(side) * F.log2(F.col(side) / middle)).otherwise(0.0)

    empty = (F.sum("x") == 0) | (F.sum("y") == 0)
    jsd = F.least(F.greatest(F.sum(part_of("x") + part_of("y")) / 2, zero), F.lit(1.0))
    return both.groupBy(*by).agg(F.coalesce(F.when(empty, 0.0).otherwise(jsd), zero).alias("jsd"))


def deltas(real: DataFrame, generated: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """(by, metric, delta): generated less real; a missing side is 0."""
    long = [d.unpivot([*by], [*values], "metric", v) for d, v in ((real, "r"), (generated, "g"))]
    both = long[0].join(long[1], [*by, "metric"], "full_outer")
    return both.select(*by, "metric", (F.coalesce("g", F.lit(0.0)) - F.coalesce("r", F.lit(0.0))).alias("delta"))
