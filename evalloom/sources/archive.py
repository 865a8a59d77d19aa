"""Sinks: runs, scores and profiles of a session, each written once or appended, so that a run can be taken up again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def session_path(base: str, task: str, session: str, variant: str = "") -> str:
    return "/".join([base.rstrip("/"), f"{task}_{variant}" if variant else task, session])


def archive_run(rows: DataFrame, path: str, run: int) -> None:
    """generated/run=<n> as JSON lines; writing a run again replaces it."""
    rows.write.mode("overwrite").json(f"{path}/generated/run={run}")


def append_scores(scores: DataFrame, path: str) -> None:
    """Scores (model, metric, run, value), added to those that are there; a model's earlier scores of one of these runs are replaced, those of other models stay. Results are views of this table."""
    at = scores.withColumn("of", F.col("model"))  # names a folder; the model's own column keeps its type and spelling
    at.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run", "of").parquet(f"{path}/scores")


def scores_of(spark: SparkSession, path: str) -> DataFrame:
    """(model, metric, run, value) that append_scores has kept."""
    return spark.read.parquet(f"{path}/scores").drop("of")


def save_document(spark: SparkSession, path: str, text: str) -> None:
    """A small document, such as a session's results, written whole by the driver; one that is there is replaced."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(text.encode()))
    out.close()


def write_once(rows: DataFrame, path: str) -> None:
    """Nothing if the path is there already."""
    rows.write.mode("ignore").parquet(path)


def unfinished(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key has no result yet; those that were filtered out count as done if done lists them."""
    return rows.join(done.select(key), key, "left_anti")


def profile_document(blocks: dict[str, DataFrame]) -> DataFrame:
    """One row, one JSON text: each block is the list of its frame's rows. Profiles are some hundred rows."""
    parts = [b.select(F.to_json(F.collect_list(F.struct("*"))).alias(n)) if b.columns else b for n, b in blocks.items()]
    found = parts[0]
    for part in parts[1:]:
        found = found.crossJoin(part)  # one row each
    body = F.concat_ws(",", *(F.concat(F.lit(f'"{n}":'), F.col(f"`{n}`")) for n in blocks))
    return found.select(F.concat(F.lit('{"profile_version":2,'), body, F.lit("}")).alias("value"))


def save_profile(blocks: dict[str, DataFrame], path: str) -> None:
    profile_document(blocks).coalesce(1).write.mode("overwrite").text(path)


def fidelity_document(real: dict[str, DataFrame], generated: dict[str, DataFrame], compared: DataFrame) -> DataFrame:
    """One row, one JSON text: the profiles of a real and of a generated corpus, and the rows that compare them."""
    sides = [profile_document(blocks).select(F.col("value").alias(n)) for n, blocks in (("real", real), ("generated", generated))]
    fidelity = compared.agg(F.to_json(F.collect_list(F.struct("*"))).alias("fidelity"))  # some hundred rows
    body = F.concat_ws(",", *(F.concat(F.lit(f'"{n}":'), F.col(n)) for n in ("real", "generated", "fidelity")))
    return sides[0].crossJoin(sides[1]).crossJoin(fidelity).select(F.concat(F.lit("{"), body, F.lit("}")).alias("value"))  # one row each


def save_fidelity(real: dict[str, DataFrame], generated: dict[str, DataFrame], compared: DataFrame, folder: str) -> None:
    """profile.json of a session; one that is there is replaced."""
    save_document(compared.sparkSession, f"{folder}/profile.json", fidelity_document(real, generated, compared).first()["value"])


def comparison_cells(tidy_rows: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """(task, strategy, gen_model, eval_model, column, cell): gen.<metric> as mean±std, real.<metric> of metrics that are not nested, to three places; models that failed (gen_model, error) have their error alone."""
    by = ["task", "strategy", "gen_model", "eval_model"]
    nothing = F.lit(None).cast("string")
    gen = F.struct(F.concat(F.lit("gen."), "metric").alias("column"), F.when(F.col("gen_mean").isNotNull(), F.format_string("%.3f±%.3f", "gen_mean", "gen_std")).alias("cell"))
    real = F.struct(F.concat(F.lit("real."), "metric").alias("column"), F.when(~F.contains("metric", F.lit(".")) & F.col("real").isNotNull(), F.format_string("%.3f", "real")).alias("cell"))
    cells = tidy_rows.select(*by, F.inline(F.array(gen, real))).where("cell IS NOT NULL")
    if failed is None:
        return cells
    return cells.unionByName(failed.select(nothing.alias("task"), nothing.alias("strategy"), "gen_model", nothing.alias("eval_model"), F.lit("error").alias("column"), F.col("error").alias("cell")))


def comparison(tidy_rows: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """A row for each model, a column for each of its cells."""
    return comparison_cells(tidy_rows, failed).groupBy("task", "strategy", "gen_model", "eval_model").pivot("column").agg(F.first("cell"))


def result_lines(tidy_rows: DataFrame) -> DataFrame:
    """(line): what a run prints, a line for each metric."""
    real = F.when(F.col("real").isNotNull(), F.format_string(" (real %.4f)", "real")).otherwise("")
    return tidy_rows.select(F.concat(T.last_segment(F.col("eval_model")), F.lit(" "), F.col("metric"), F.format_string(": %.4f ± %.4f", "gen_mean", "gen_std"), real).alias("line"))
