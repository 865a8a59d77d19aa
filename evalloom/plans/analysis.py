"""Sessions scored again, compared by generation model and data set, and written up: small frames, and the documents made of them."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vocab import HEADLINE
from ..operators import metrics, models, runs
from ..session import settled
from ..sources import archive
from . import report
from .tasks import Task

# What stands in place of a text that a model failed to give, and the older name of a column.
GENERATION_FAILED, CORRECTION_FAILED = "[GENERATION FAILED]", "[CORRECTION FAILED]"
OLD_TRUTH = {"ground_truth": "fce_ground_truth"}
_BETWEEN = "\x1f"


def run_scores(task: Task, samples: DataFrame, predictors: Mapping[str, models.Predictor]) -> DataFrame:
    """(run, model, metric, value) of generated rows with a run: all runs in one pass, as each run's rows of a model are a model of their own."""
    said = models.predicted(task.samples(samples), dict(predictors)).withColumn("model", F.concat_ws(_BETWEEN, "run", "model"))
    parts = F.split("model", _BETWEEN, 2)
    return task.scores(said).select(parts[0].cast("int").alias("run"), parts[1].alias("model"), "metric", "value")


def nested(generated: DataFrame, real: DataFrame | None = None) -> DataFrame:
    """(model, metric, gen_mean, gen_std, real, runs, run_numbers) of generated (run, model, metric, value) and real (model, metric, value). Models and metrics that only one side has stay.

    runs are the values in the order of their runs, run_numbers these runs: a run in which a model has no value is lacking in both.
    """
    of = runs.mean_std(generated, ["model", "metric"]).select("model", "metric", F.col("mean").alias("gen_mean"), F.col("std").alias("gen_std"))
    by_run = generated.where("value IS NOT NULL").groupBy("model", "metric").agg(F.sort_array(F.collect_list(F.struct("run", "value"))).alias("x"))  # some tens of runs
    of = of.join(by_run.select("model", "metric", F.col("x.value").alias("runs"), F.col("x.run").alias("run_numbers")), ["model", "metric"], "left")
    if real is None:
        return of.select("model", "metric", "gen_mean", "gen_std", F.lit(None).cast("double").alias("real"), "runs", "run_numbers")
    return of.join(real.select("model", "metric", F.col("value").alias("real")), ["model", "metric"], "full_outer").select("model", "metric", "gen_mean", "gen_std", "real", "runs", "run_numbers")


def rescored(task: Task, samples: DataFrame, predictors: Mapping[str, models.Predictor], real: DataFrame | None = None, stored: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """The nested scores of archived runs (rows with a run), worked out again, and what differs from stored ones (model, metric, value): (model, metric, old, new). real is a sample that is scored once."""
    found = nested(run_scores(task, samples, predictors), None if real is None else task.scores(models.predicted(real, dict(predictors))))
    if stored is None:
        return found, None
    found = settled(found, "rescored")  # the models answer once
    return found, runs.drift(stored, found.select("model", "metric", F.col("gen_mean").alias("value")), ["model", "metric"])


def results(rows: DataFrame) -> dict[str, dict]:
    """Nested scores as a session's document has them; a metric a.b is b below a. A model's runs have a block each, an empty one where a run of the session has none of its values. For models and metrics, some hundred rows."""
    found: dict[str, dict] = {}
    if "run_numbers" not in rows.columns:  # no run is lacking
        rows = rows.withColumn("run_numbers", F.transform("runs", lambda _, k: k + 1))
    rows = rows.orderBy("model", "metric").collect()
    place = {run: k for k, run in enumerate(sorted({n for r in rows for n in r["run_numbers"] or ()}))}

    def put(block: dict, metric: str, value) -> None:
        *above, name = metric.split(".", 1)
        for a in above:
            block = block.setdefault(a, {})
        block[name] = value

    for r in rows:
        of = found.setdefault(r["model"], {})
        if r["gen_mean"] is not None:
            put(of.setdefault("generated", {}), r["metric"], {"mean": r["gen_mean"], "std": r["gen_std"]})
        if r["real"] is not None:
            put(of.setdefault("real", {}), r["metric"], r["real"])
        for run, value in zip(r["run_numbers"] or (), r["runs"] or (), strict=True):
            put(of.setdefault("runs", [{} for _ in place])[place[run]], r["metric"], value)
    return found


def save_results(rows: DataFrame, meta: Mapping, folder: str) -> None:
    """results.json of a session; one that is there is replaced."""
    archive.save_document(rows.sparkSession, f"{folder}/results.json", json.dumps({"meta": dict(meta), "results": results(rows)}, indent=2))


def over_models(spark: SparkSession, entries: Mapping[str, Mapping], run: Callable[[Mapping], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """run(settings) for each generation model: all nested scores with gen_model, and (gen_model, error) of those that failed, which don't stop the others. RuntimeError if all do."""
    found, failed = None, []
    for name, settings in entries.items():
        try:
            rows = settled(run(settings).withColumn("gen_model", F.lit(name)), "compared")
        except (RuntimeError, ValueError) as error:
            failed.append((name, str(error)))
            continue
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        raise RuntimeError("every generation model failed: " + "; ".join(f"{n}: {e}" for n, e in failed) if failed else "no generation models")
    return found, spark.createDataFrame(failed, "gen_model string, error string")


def filled(rows: DataFrame) -> DataFrame:
    """Rows of generated texts and truths with older names made new and nothing null: a generated text that is lacking is a failed one, a truth is empty."""
    for old, new in OLD_TRUTH.items():
        if old in rows.columns and new not in rows.columns:
            rows = rows.withColumnRenamed(old, new)
    for name in ("gen_ground_truth", *OLD_TRUTH.values()):
        rows = rows.withColumn(name, F.coalesce(F.col(name), F.lit("")) if name in rows.columns else F.lit(""))
    return rows.withColumn("generated", F.coalesce("generated", F.lit(GENERATION_FAILED)))


def usable_truth(truth: Column) -> Column:
    return F.coalesce(~truth.isin("", GENERATION_FAILED, CORRECTION_FAILED), F.lit(False))


def dataset_summary(rows: DataFrame, reference: DataFrame, key: str = "id") -> DataFrame:
    """(model, dataset, errant_f05, errant_f05_gt, gleu_gt, cola_input, cola_corrected, cola_delta, correction_extent, n_edits): how each model corrects each data set.

    rows: (key, model, dataset, input, corrected, truth, input_score, corrected_score, predicted, gold), the last two arrays of edits of input to corrected and to truth.
    reference: (edits), the edits whose types a model's should be distributed as. Rows whose truth is empty or failed are left out of what needs a truth.
    """
    by = ["model", "dataset"]
    rows = rows.withColumn("corrected", F.coalesce("corrected", F.lit(CORRECTION_FAILED)))
    true = rows.where(usable_truth(F.col("truth")))
    ours = rows.select(*by, F.explode("predicted.type").alias("type")).groupBy(*by, "type").agg(F.count("*").alias("n"))
    ours = ours.join(ours.groupBy(*by).agg(F.sum("n").alias("all")), by)
    theirs = reference.select(F.explode("edits.type").alias("type")).groupBy("type").agg(F.count("*").alias("m"))
    theirs = theirs.crossJoin(theirs.agg(F.sum("m").alias("of")))  # one row
    both = ours.join(theirs, "type").groupBy(*by).agg(F.sum(F.least(F.col("n") / F.col("all"), F.col("m") / F.col("of"))).alias("shared"))
    dist = both.select(*by, metrics.f_half(F.col("shared"), F.col("shared")).alias("errant_f05"))
    of_truth = metrics.edit_type_scores(true, [key], by=by).select(*by, F.col("f05").alias("errant_f05_gt"))
    gleu = metrics.geometric_gleu(true, [*by, key], "truth", "corrected").groupBy(*by).agg(F.avg("gleu").alias("gleu_gt"))
    cola = metrics.acceptability(rows, "input_score", "corrected_score", by).select(*by, *(F.col(c).alias(f"cola_{c}") for c in ("input", "corrected", "delta")))
    extent = metrics.correction_extent(rows, "input", "corrected", by).select(*by, F.col("extent").alias("correction_extent"))
    found = rows.select(*by).distinct()
    for part in (dist, of_truth, gleu, cola, extent, metrics.mean_edits(rows, by=by)):
        found = found.join(part, by, "left")
    return found.fillna(0.0)


def flagged(rows: DataFrame, a: str = "cola_a", b: str = "cola_b", c: str = "cola_c") -> DataFrame:
    """Adds b_below_a and c_above_b: whether generated texts are less acceptable than the originals, and corrected ones more than the generated."""
    return rows.withColumns({"b_below_a": F.coalesce(F.col(b) < F.col(a), F.lit(False)), "c_above_b": F.coalesce(F.col(c) > F.col(b), F.lit(False))})


def heatmap(rows: DataFrame, across: str, value: str, down: str, columns: Sequence[str]) -> DataFrame:
    """A row for each value of down, a column for each of these values of across, and the mean of value in the cells."""
    return rows.groupBy(down).pivot(across, [*columns]).agg(F.avg(value))


def busiest_words(bins: DataFrame, quantiles: DataFrame, order: Sequence[str], by: Sequence[str]) -> DataFrame:
    """(by, line): which bin (by, bin, n) most texts are in, the first of equal ones, and two quantiles (by, p50, p90)."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("bin"))
    most = bins.groupBy(*by).agg(F.max_by("bin", F.struct("n", (-place).alias("p"))).alias("bin"))
    return most.join(quantiles, [*by]).select(*by, F.concat(F.lit("mostly "), "bin", F.lit(" words (p50 "), F.col("p50").cast("string"), F.lit(", p90 "), F.col("p90").cast("string"), F.lit(")")).alias("line"))


def style_line(rates: Mapping[str, Column], density: Column, most: int = 4) -> Column:
    """The styles with the highest rates, the first of equal ones first, and the density of punctuation."""
    all_of = F.array(*(F.struct((-r).alias("r"), F.lit(k).alias("k"), F.lit(n.removesuffix("_rate").replace("_", " ")).alias("n")) for k, (n, r) in enumerate(rates.items())))
    shown = F.transform(F.slice(F.sort_array(F.filter(all_of, lambda x: x["r"] < 0)), 1, most), lambda x: F.format_string("%s %.0f%%", x["n"], -100 * x["r"]))
    return F.concat(F.when(F.size(shown) > 0, F.array_join(shown, ", ")).otherwise("none"), F.format_string("; punct density %.2f", density))


def vocabulary_line(ratio: Column, hapax: Column, length: Column) -> Column:
    return F.format_string("TTR %.3f, hapax %.0f%%, avg word %.1f chars", ratio, 100 * hapax, length)


def topics_line(topics: DataFrame, most: int = 3) -> DataFrame:
    """(line): the topics (topic, fraction) with the largest shares."""
    first = topics.orderBy(F.desc("fraction"), "topic").limit(most)
    shown = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("fraction")).alias("f"), "topic"))), lambda x: F.format_string("%s (%.0f%%)", x["topic"], -100 * x["f"]))
    return first.agg(shown.alias("x")).select(F.when(F.size("x") > 0, F.array_join("x", ", ")).otherwise("none").alias("line"))


def _row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def headline_lines(tidy: DataFrame) -> DataFrame:
    """(task, strategy, gen_model, eval_model, line): a line of a table for each headline score, with the gap between generated and real."""
    main = F.create_map(*(F.lit(x) for kv in HEADLINE.items() for x in kv))[F.col("task")]
    gap = F.col("gen_mean") - F.col("real")
    real, by_how_much = (F.coalesce(x, F.lit("-")) for x in (F.when(gap.isNotNull(), F.format_string("%.3f", "real")), F.when(gap.isNotNull(), F.format_string("%+.3f", gap))))
    line = _row(F.col("strategy"), T.last_segment(F.col("gen_model")), T.last_segment(F.col("eval_model")), F.format_string("%.3f ± %.3f", "gen_mean", "gen_std"), real, by_how_much)
    return tidy.where(F.col("metric") == main).select("task", "strategy", "gen_model", "eval_model", line.alias("line"))


def inventory_lines(sessions: DataFrame) -> DataFrame:
    """(task, strategy, gen_model, line): a line of a table for each session, as discovered with profiles."""
    scores = F.exists(F.map_values("results"), lambda m: F.coalesce(F.size(m["runs"]) > 0, F.lit(False)))
    yes = [F.when(c, "yes").otherwise("no") for c in (scores, F.col("profile").isNotNull() if "profile" in sessions.columns else F.lit(False))]
    cells = (F.col("meta.task"), F.col("strategy"), F.col("meta.model"), F.coalesce("meta.runs_completed", F.lit(0)).cast("string"))
    return sessions.select(F.col("meta.task").alias("task"), "strategy", F.col("meta.model").alias("gen_model"), _row(*cells, *yes).alias("line"))


def _table(title: str, heads: Sequence[str], lines: Sequence[str]) -> list[str]:
    return [f"## {title}", "", "| " + " | ".join(heads) + " |", "|" + "---|" * len(heads), *lines, ""]


def _text(value) -> str:
    return "-" if value is None else f"{value:.3f}" if isinstance(value, float) else str(value)


def markdown(tidy: DataFrame, sessions: DataFrame) -> str:
    """The analysis of tidy rows as a document: the sessions, the headline scores of each task, and a table for each question of report.summary. All are tables of tens of rows."""
    lines = ["# Generated and real benchmarks", ""]
    lines += _table("Sessions", ("task", "strategy", "generation model", "runs", "scores by run", "profile"), [r.line for r in inventory_lines(sessions).orderBy("task", "strategy", "gen_model").collect()])
    by_task: dict[str, list[str]] = {}
    for r in headline_lines(tidy).orderBy("task", "strategy", "gen_model", "eval_model").collect():
        by_task.setdefault(r.task, []).append(r.line)
    for task, found in by_task.items():
        lines += _table(f"{task}: {HEADLINE[task]}", ("strategy", "generation model", "evaluated model", "generated", "real", "gap"), found)
    for name, rows in report.summary(tidy).items():
        rows = rows.select([c for c, kind in rows.dtypes if not kind.startswith(("array", "map", "struct"))])
        lines += _table(name.replace("_", " "), rows.columns, ["| " + " | ".join(map(_text, r)) + " |" for r in rows.orderBy(*rows.columns).collect()])
    return "\n".join(lines)


def save_analysis(tidy: DataFrame, sessions: DataFrame, folder: str) -> None:
    """analysis.md and analysis.json; those that are there are replaced."""
    blocks = {"sessions": inventory_lines(sessions).drop("line"), **report.summary(tidy)}
    spark = tidy.sparkSession
    archive.save_document(spark, f"{folder}/analysis.json", archive.profile_document(blocks).first()["value"])
    archive.save_document(spark, f"{folder}/analysis.md", markdown(tidy, sessions))
