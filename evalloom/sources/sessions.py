"""Archived sessions: a folder each, with results.json, generated/run_<n>.json, and a profile.json perhaps.

Documents are read whole, one row a file, and become long frames: one row a session, model, metric and run.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import runs as R

META = "STRUCT<task STRING, mode STRING, strategy STRING, seedless BOOLEAN, model STRING, provider STRING, runs_completed INT, created STRING, partial BOOLEAN>"
RESULTS = "MAP<STRING, STRUCT<generated: MAP<STRING, STRING>, real: MAP<STRING, STRING>, runs: ARRAY<MAP<STRING, STRING>>>>"
#: A fixed value: this metric is never shown.
HIDDEN = "fpr"


def documents(spark: SparkSession, roots: Sequence[str], name: str) -> DataFrame:
    """(dir, file, value): every file of this name (a glob) below the roots, whole."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).text([*roots], wholetext=True)
    path = F.col("_metadata.file_path")
    return rows.select(F.regexp_replace(path, "/[^/]*$", "").alias("dir"), F.regexp_extract(path, "[^/]*$", 0).alias("file"), "value")


def discover(spark: SparkSession, roots: Sequence[str], profiles: bool = False) -> DataFrame:
    """(dir, meta, results, strategy[, profile]): sessions whose document has meta and results; folders named comparison are none."""
    rows = documents(spark, roots, "results.json").where(~F.col("dir").rlike("/comparison$"))
    rows = rows.select("dir", F.from_json("value", f"STRUCT<meta: {META}, results: {RESULTS}>").alias("d")).where("d.meta IS NOT NULL AND d.results IS NOT NULL")
    meta = F.col("meta")
    rows = rows.select("dir", "d.meta", "d.results").withColumn("strategy", R.strategy(meta["mode"], meta["strategy"], meta["seedless"]))
    if profiles:
        found = documents(spark, roots, "profile.json").select("dir", F.col("value").alias("profile"))
        rows = rows.join(found, "dir", "left")
    return rows


def quarantined(spark: SparkSession, roots: Sequence[str], name: str = "results.json") -> DataFrame:
    """unusable of the documents of this name (a glob). A file of no bytes is none of them, as Spark's scans pass it over."""
    return unusable(documents(spark, roots, name))


def unusable(rows: DataFrame) -> DataFrame:
    """(dir, file, reason, value) of documents (dir, file, value), each a file's or a row of a table that holds many: those that discover leaves out, whole, with why: broken (no JSON object, or one that breaks off), no meta, no results."""
    schema = f"STRUCT<meta: {META}, results: {RESULTS}, __broken: STRING>"
    read = rows.withColumn("d", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__broken"}))
    object_ = F.regexp_like(F.col("value"), F.lit(r"(?s)^\s*\{.*\}\s*$"))
    reason = F.when(F.col("d.__broken").isNotNull() | F.col("d").isNull() | ~object_, "broken").when(F.col("d.meta").isNull(), "no meta").when(F.col("d.results").isNull(), "no results")
    return read.select("dir", "file", reason.alias("reason"), "value").where("reason IS NOT NULL")


def quarantine(spark: SparkSession, roots: Sequence[str], path: str, name: str = "results.json") -> DataFrame:
    """quarantined, written to path (what is there is replaced) and read again."""
    quarantined(spark, roots, name).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def strict(spark: SparkSession, folder: str) -> DataFrame:
    """The one session of a folder; ValueError if it is missing or no such document."""
    try:
        rows = discover(spark, [folder]).where(F.endswith(F.col("dir"), F.lit(folder.rstrip("/").removeprefix("file://"))))
        if rows.limit(1).isEmpty():
            raise ValueError(f"{folder}: results.json is missing or has no meta and results")
    except Exception as error:
        if isinstance(error, ValueError):
            raise
        raise ValueError(f"{folder}: {error}") from error
    return rows


def with_profile(spark: SparkSession, folder: str) -> DataFrame:
    """The strict session of a folder with its profile; a profile that is no JSON object is null, and a warning says so."""
    found = strict(spark, folder)
    profile = documents(spark, [folder], "profile.json").select("dir", F.col("value").alias("profile"))
    read = found.join(profile, "dir", "left").withColumn("__ok", F.coalesce(F.from_json("profile", "MAP<STRING, STRING>", {"mode": "PERMISSIVE"}).isNotNull() & F.rlike(F.trim("profile"), F.lit(r"(?s)^\{.*\}$")), F.lit(False)))
    if not read.where("profile IS NOT NULL AND NOT __ok").isEmpty():
        warnings.warn(f"{folder}: profile.json is no JSON object and is left out", stacklevel=2)
    return read.withColumn("profile", F.when(F.col("__ok"), F.col("profile"))).drop("__ok")


def latest(sessions: DataFrame) -> DataFrame:
    """The session whose folder has the largest name; names begin with the time."""
    newest = sessions.agg(F.max(F.struct(F.regexp_extract("dir", "[^/]*$", 0), "dir"))["dir"].alias("dir"))
    return sessions.join(newest, "dir", "left_semi")


def kept_and_superseded(sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One session for each task, strategy and model: most runs, then the newest, then the first folder; and the others."""
    order = [F.desc(F.coalesce("meta.runs_completed", F.lit(0))), F.desc(F.coalesce("meta.created", F.lit(""))), F.asc("dir")]
    ranked = R.best_sessions(sessions.withColumns({"__t": F.col("meta.task"), "__m": F.col("meta.model")}), ["__t", "strategy", "__m"], order).drop("__t", "__m")
    return ranked.where("rank = 1").drop("rank"), ranked.where("rank > 1").drop("rank")


def _leaves(values: Column, is_leaf) -> Column:
    """(metric, json) of a map of numbers or of maps one level down, those as name.sub."""

    def one(e: Column) -> Column:
        below = F.map_entries(F.from_json(e["value"], "MAP<STRING, STRING>"))
        nested = F.startswith(F.ltrim(e["value"]), F.lit("{")) & ~is_leaf(e["value"])
        return F.when(nested, F.transform(below, lambda s: F.struct(F.concat_ws(".", e["key"], s["key"]).alias("metric"), s["value"].alias("json")))).otherwise(F.array(F.struct(e["key"].alias("metric"), e["value"].alias("json"))))

    return F.flatten(F.transform(F.map_entries(F.coalesce(values, F.create_map().cast("map<string,string>"))), one))


def points(values: Column) -> Column:
    """A map of name (name.sub) and number; what is no number is left out."""
    found = F.transform(_leaves(values, lambda _: F.lit(False)), lambda x: F.struct(x["metric"], x["json"].try_cast("double").alias("value")))
    return F.map_from_entries(F.filter(found, lambda x: x["value"].isNotNull()))


def means(values: Column) -> Column:
    """An array of (metric, mean, std) from leaves of mean and std; a missing std is 0."""

    def read(json: Column) -> Column:
        return F.from_json(json, "STRUCT<mean: DOUBLE, std: DOUBLE>")

    found = F.transform(_leaves(values, lambda v: read(v)["mean"].isNotNull()), lambda x: F.struct(x["metric"], read(x["json"])["mean"].alias("mean"), F.coalesce(read(x["json"])["std"], F.lit(0.0)).alias("std")))
    return F.filter(found, lambda x: x["mean"].isNotNull())


def tidy(sessions: DataFrame, hidden: str = HIDDEN) -> DataFrame:
    """(dir, task, strategy, gen_model, eval_model, metric, gen_mean, gen_std, real, runs), a row for each generated metric that is shown."""

    def of_model(e: Column) -> Column:
        real, by_run = points(e["value"]["real"]), F.transform(F.coalesce(e["value"]["runs"], F.array().cast("array<map<string,string>>")), points)

        def row(g: Column) -> Column:
            of_run = F.array_compact(F.transform(by_run, lambda m: F.try_element_at(m, g["metric"])))
            return F.struct(e["key"].alias("eval_model"), g["metric"].alias("metric"), g["mean"].alias("gen_mean"), g["std"].alias("gen_std"), F.try_element_at(real, g["metric"]).alias("real"), of_run.alias("runs"))

        return F.transform(F.filter(means(e["value"]["generated"]), lambda g: g["metric"] != hidden), row)

    rows = F.flatten(F.transform(F.map_entries("results"), of_model))
    return sessions.select("dir", F.col("meta.task").alias("task"), "strategy", F.col("meta.model").alias("gen_model"), F.inline(rows))


def run_scores(tidy_rows: DataFrame) -> DataFrame:
    """One row a run: tidy rows with (run, value) in place of runs."""
    return tidy_rows.select("*", F.posexplode("runs").alias("run", "value")).withColumn("run", F.col("run") + 1).drop("runs")


def run_files(spark: SparkSession, roots: Sequence[str], schema: str) -> DataFrame:
    """The rows of all generated/run_<n>.json, with dir and run."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "run_*.json").schema(schema).json([*roots], multiLine=True)
    path = F.col("_metadata.file_path")
    return rows.select("*", F.regexp_replace(path, "(/generated)?/[^/]*$", "").alias("dir"), F.regexp_extract(path, r"run_(\d+)\.json$", 1).cast("int").alias("run"))


def renumbered(rows: DataFrame, sources: Sequence[str]) -> DataFrame:
    """Runs of several sessions as runs of one: in the order of sources, then of their numbers. The list of runs, not of rows, is ordered in one task."""
    place = F.array_position(F.array(*map(F.lit, sources)), F.regexp_replace("dir", "^file:(//)?", ""))
    numbers = rows.select("dir", "run").distinct().withColumn("new_run", F.row_number().over(Window.orderBy(place, "dir", "run")))
    return rows.join(numbers, ["dir", "run"]).withColumn("run", F.col("new_run")).drop("new_run", "dir")


def same_cell(sessions: DataFrame) -> bool:
    """Whether all are of one task, model and strategy, as merged sessions must be."""
    return sessions.select("meta.task", "meta.model", "strategy").distinct().limit(2).count() == 1


def merged(spark: SparkSession, folders: Sequence[str], schema: str) -> DataFrame:
    """The generated rows of several sessions as runs of one; ValueError unless there are two sessions at least and all are of one task, model and strategy."""
    if len(folders) < 2 or len({*folders}) < len(folders):
        raise ValueError("name two different sessions at least")
    if not same_cell(discover(spark, folders)):
        raise ValueError("sessions of different tasks, models or strategies are not merged")
    return renumbered(run_files(spark, folders, schema), [f.removeprefix("file://") for f in folders])


def differing_rows(a: DataFrame, b: DataFrame) -> int:
    """How many rows only one of two samples has, repeated rows counted."""
    return a.exceptAll(b).unionByName(b.exceptAll(a)).count()
