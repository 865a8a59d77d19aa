"""Statistics over runs and sessions. Scores are long frames (session, run, model, metric, value)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mean_std(scores: DataFrame, by: Sequence[str], value: str = "value", population: bool = False) -> DataFrame:
    """(by, runs, mean, std): the sample's deviation, 0 for one run; the population's if asked for."""
    std = F.stddev_pop(value) if population else F.stddev_samp(value)
    return scores.groupBy(*by).agg(F.count(value).alias("runs"), F.avg(value).alias("mean"), F.coalesce(std, F.lit(0.0)).alias("std"))


def eta_squared(scores: DataFrame, group: Sequence[str], by: Sequence[str] = (), value: str = "value") -> DataFrame:
    """(by, eta2): the share of variance between groups; null for one group or no variance."""
    one = scores.groupBy(*by, *group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v")).where("n > 0")
    all_of = Window.partitionBy(*by)  # some tens of groups
    one = one.withColumn("a", F.sum(F.col("n") * F.col("m")).over(all_of) / F.sum("n").over(all_of))
    between, within = F.sum(F.col("n") * (F.col("m") - F.col("a")) ** 2), F.sum(F.col("n") * F.col("v"))
    negligible = F.lit(1e-24) * F.sum(F.col("n") * F.col("m") ** 2)
    return one.groupBy(*by).agg(F.when((F.count("*") > 1) & (between + within > negligible), between / (between + within)).alias("eta2"))


def kendall_tau_b(pairs: DataFrame, key: str, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, tau): over all pairs of a few models; null if one side is constant."""
    a, b = (pairs.select(*by, F.col(key).alias(f"k{s}"), F.col(x).alias(f"x{s}"), F.col(y).alias(f"y{s}")) for s in "ab")
    both = a.join(b, [*by]) if by else a.crossJoin(b)  # models are tens
    both = both.where("ka < kb").select(*by, F.signum(F.col("xa") - F.col("xb")).alias("dx"), F.signum(F.col("ya") - F.col("yb")).alias("dy"))
    spread = F.sqrt(F.sum(F.abs("dx"))) * F.sqrt(F.sum(F.abs("dy")))
    return both.groupBy(*by).agg(F.try_divide(F.sum(F.col("dx") * F.col("dy")), spread).alias("tau"))


def best_sessions(sessions: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """sessions with rank; rank 1 is kept, the others are superseded."""
    return sessions.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def mode_deltas(means: DataFrame, by: Sequence[str], mode: str, low: str, high: str, value: str = "value") -> DataFrame:
    """(by, delta): high less low, where both are."""
    of = {m: F.max(F.when(F.col(mode) == m, F.col(value))) for m in (low, high)}
    return means.groupBy(*by).agg((of[high] - of[low]).alias("delta")).where("delta IS NOT NULL")


def ordering(means: DataFrame, by: Sequence[str], model: str = "model", value: str = "value") -> DataFrame:
    """Models by value, largest first; of equal ones the first name first."""
    return means.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(value), model)))


def drift(old: DataFrame, new: DataFrame, keys: Sequence[str], beyond: float = 0.005, value: str = "value") -> DataFrame:
    """(keys, old, new) of means that differ by more than beyond."""
    both = old.select(*keys, F.col(value).alias("old")).join(new.select(*keys, F.col(value).alias("new")), [*keys])
    return both.where(F.abs(F.col("old") - F.col("new")) > beyond)


def fidelity_gap(rows: DataFrame, headline: dict[str, str], by: Sequence[str] = ("task", "strategy", "gen_model")) -> DataFrame:
    """(by, mean_abs_gap, mean_headline_gap, harder) of (task, metric, gen_mean, real)."""
    gap = F.col("gen_mean") - F.col("real")
    main = F.create_map(*(F.lit(x) for kv in headline.items() for x in kv))[F.col("task")]
    signed = F.avg(F.when(F.col("metric") == main, gap))
    return rows.where(F.col("real").isNotNull()).groupBy(*by).agg(F.avg(F.abs(gap)).alias("mean_abs_gap"), signed.alias("mean_headline_gap"), (signed < 0).alias("harder"))


def model_impact(scores: DataFrame, group: str, by: Sequence[str] = (), value: str = "value") -> DataFrame:
    """(by, eta2, spread, mean_within_std): the range of the groups' means and the mean of their population deviations."""
    means = scores.groupBy(*by, group).agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("w"))
    spread = means.groupBy(*by).agg((F.max("m") - F.min("m")).alias("spread"), F.avg("w").alias("mean_within_std"))
    eta = eta_squared(scores, [group], by, value)
    return eta.join(spread, [*by]) if by else eta.crossJoin(spread)


def strategy(mode: Column, shape: Column, seedless: Column) -> Column:
    """The mode, or what the shape of the task implies, and whether it ran without seeds."""
    base = F.coalesce(F.nullif(mode, F.lit("")), F.when(shape == "class_conditional", "inverse").otherwise("forward"))
    return F.when(F.coalesce(seedless, F.lit(False)), F.concat(base, F.lit("+seedless"))).otherwise(base)


def tally(rows: DataFrame, technique: Column, error_type: Column) -> DataFrame:
    """(kind, n): techniques are lists by commas."""
    kinds = F.filter(F.transform(F.split(F.coalesce(technique, error_type, F.lit("unknown")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return rows.select(F.explode(kinds).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))
