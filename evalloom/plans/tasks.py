"""The three tasks: how each reads rows, makes samples to evaluate, which scores it reports, and how samples are generated."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vocab import EDIT_TYPES, SIGNALS, edit_phrases
from ..operators import edits as E
from ..operators import fidelity, generate, metrics, models
from ..sources import corpora


@dataclass(frozen=True)
class Task:
    name: str
    strategy: str
    parse: Callable[[DataFrame, tuple], DataFrame]
    samples: Callable[[DataFrame], DataFrame]
    real_samples: Callable[[DataFrame, tuple], DataFrame]
    scores: Callable[[DataFrame], DataFrame]
    labels: tuple[str, ...] = ()
    descriptions: Mapping[str, str] = field(default_factory=dict)


def _long(wide: DataFrame, by: tuple, names: list[str]) -> DataFrame:
    return wide.unpivot([*by], names, "metric", "value")


def _spam_scores(rows: DataFrame) -> DataFrame:
    by = ("model",)
    return _long(metrics.binary_scores(rows, "SPAM", by), by, ["accuracy", "precision", "recall", "f1", "fpr"])


def _sentiment_scores(rows: DataFrame) -> DataFrame:
    by, labels = ("model",), ("NEGATIVE", "NEUTRAL", "POSITIVE")
    accuracy = metrics.accuracy_by(rows, by).select("model", "accuracy")
    return _long(metrics.macro_scores(rows, labels, by).join(accuracy, "model"), by, ["accuracy", "macro_precision", "macro_recall", "macro_f1"])


def _pair_scores(rows: DataFrame) -> DataFrame:
    """Of (id, model, text, original, prediction). Edits are found once and shared by the three scores that read them."""
    by, find = ("model",), E.annotator()
    gleu = metrics.gleu(rows, ["model", "id"], "original", "prediction").groupBy(*by).agg(F.avg("gleu").alias("gleu"))
    with_edits = rows.select("model", find(F.col("text"), F.col("prediction")).alias("e"), find(F.col("text"), F.col("original")).alias("g"))
    bare = with_edits.select("model", *(F.transform(c, lambda x: F.struct(x["start"], x["end"], x["type"])).alias(n) for c, n in (("e", "predicted"), ("g", "gold"))))
    scored = metrics.edit_scores(bare.where("predicted IS NOT NULL AND gold IS NOT NULL"), by=by)
    scored = scored.select("model", F.col("precision").alias("errant.precision"), F.col("recall").alias("errant.recall"), F.col("f05").alias("errant.f0.5"))
    n_edits, extent = metrics.mean_edits(bare, by=by), metrics.correction_extent(rows, "text", "prediction", by).select("model", F.col("extent").alias("correction_extent"))
    dist = metrics.type_distribution_scores(bare, by=by).select("model", *(F.col(c).alias(f"errant_dist.{n}") for c, n in (("precision", "precision"), ("recall", "recall"), ("f05", "f0.5"))))
    wide = gleu.join(scored, "model").join(n_edits, "model").join(extent, "model").join(dist, "model", "left").fillna(0.0)
    if {"input_score", "corrected_score"} <= {*rows.columns}:  # what a scorer of acceptability gave
        cola = metrics.acceptability(rows, "input_score", "corrected_score", by)
        wide = wide.join(cola.select("model", *(F.col(c).alias(f"cola.{c}") for c in ("input", "corrected", "delta"))), "model")
    values = [F.col(f"`{n}`").cast("double").alias(n) for n in wide.columns if n != "model"]
    return wide.select("model", *values).unpivot(["model"], [F.col(f"`{n}`") for n in wide.columns if n != "model"], "metric", "value")


def _pair_samples(rows: DataFrame) -> DataFrame:
    return rows.withColumn("text", F.col("corrupted"))


def _opinion_samples(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"text": F.col("corrupted"), "label": T.sentiment_truth(F.col("error_type"))}).where("label IS NOT NULL")


def legacy_spam_label(error_type: Column) -> Column:
    return F.when(error_type == "paraphrase", "HAM").otherwise("SPAM")


TASKS = {
    "gec": Task("gec", "pairs", corpora.pairs, _pair_samples, lambda rows, keep=(): corpora.pairs(rows, keep).select(*keep, F.col("incorrect").alias("text"), F.col("incorrect").alias("corrupted"), F.col("correct").alias("original")), _pair_scores, descriptions=edit_phrases()),
    "spam": Task("spam", "class_conditional", corpora.ham, lambda rows: rows, corpora.messages, _spam_scores, ("SPAM", "HAM"), {s: s.replace("_", " ") for s in SIGNALS}),
    "sentiment": Task("sentiment", "pairs", corpora.opinions, _opinion_samples, lambda rows, keep=(): corpora.opinions(rows, keep).select(*keep, F.col("incorrect").alias("text"), F.col("sentiment_label").alias("label")), _sentiment_scores),
}

#: The scores that each task reports, as functions of prediction rows (model, ...) that give (model, metric, value).
EVALUATORS = {name: task.scores for name, task in TASKS.items()}


def evaluated(task: Task, samples: DataFrame, predictors: Mapping[str, models.Predictor]) -> DataFrame:
    """(model, metric, value)."""
    return task.scores(models.predicted(samples, dict(predictors)))


def seed_pool(task: Task, rows: DataFrame, mode: str, keep: tuple = ()) -> DataFrame:
    """What a mode draws its seeds from: forward class-conditional generation imitates labelled messages (text, label), all else starts from the rows that the task's parser keeps."""
    if task.strategy == "class_conditional" and mode == "forward":
        return task.real_samples(rows, keep)
    return task.parse(rows, keep)


def planned(spark: SparkSession, task: Task, client: generate.Client, settings: Mapping, seeds: DataFrame | None) -> DataFrame:
    """The generation that task, mode and seedless stand for: one of eight, with rejected samples marked.

    Settings: mode (forward, inverse), seedless, sample_size, seed, prompts, types, counts, positive_share, judge_prompt.
    Class-conditional tasks: inverse injects into seeds of either class, forward imitates seeds of the class, seedless goes by specs.
    """
    mode, seedless = settings.get("mode") or ("inverse" if task.strategy == "class_conditional" else "forward"), bool(settings.get("seedless"))
    prompts, n, seed = settings.get("prompts") or {}, settings["sample_size"], settings.get("seed", 0)
    if seeds is None:
        raise ValueError(f"{task.name}: {mode}{'+seedless' if seedless else ''} needs {'specs' if seedless else 'seeds'}")
    shared = {"seeds": seeds, "seed": seed, "judge_prompt": None if seedless else settings.get("judge_prompt")}
    if task.strategy == "class_conditional":
        policy = "none" if seedless else {"inverse": "cross_class", "forward": "same_class"}[mode]
        return generate.class_conditional(
            spark, client, n, labels=task.labels[:2], positive_share=settings.get("positive_share", 0.5), types=settings.get("types") or dict.fromkeys(task.descriptions, 1.0), counts=settings.get("counts") or {1: 1.0},
            descriptions=task.descriptions, prompts=prompts, policy=policy, **shared,
        )
    kind = "seedless" if seedless and mode == "forward" else mode
    name = f"{mode}_seedless" if seedless else mode
    if not prompts.get(name):
        raise ValueError(f"{task.name}: no prompt for {name}")
    if seedless and mode == "inverse":  # clean texts first, then faults put into them
        if not prompts.get("carrier"):
            raise ValueError(f"{task.name}: no prompt for carrier")
        from ..session import settled

        clean = settled(generate.some_accepted(generate.carriers(spark, client, n, prompt=prompts["carrier"], specs=seeds)))
        shared["seeds"] = generate.numbered(clean.select("i", F.col("text").alias("seed")), "i").select("n", "seed")
    return generate.pairs(
        spark, client, n, prompt=prompts[name], mode=kind, types=settings.get("types") or dict.fromkeys(task.descriptions or EDIT_TYPES, 1.0), counts=settings.get("counts") or {1: 1.0},
        descriptions=task.descriptions, error_types=settings.get("error_types") or EDIT_TYPES, **shared,
    )


def spam_distributions(reference: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distributions of signals and of their number in the spam of a reference; ValueError if it has too little."""
    found = fidelity.signal_distributions(reference.where("label = 'SPAM'"))
    if found is None:
        raise ValueError("the reference has fewer than 5 rows with a signal")
    return found


def pair_distributions(reference: DataFrame, annotate: Callable | None = None) -> tuple[DataFrame, DataFrame]:
    """Distributions of supported types of edits and of their number in a reference of (incorrect, correct); ValueError if it has too few pairs with one."""
    rows = reference.select((annotate or E.annotator())(F.col("incorrect"), F.col("correct")).alias("edits"))
    found = fidelity.edit_distribution(rows, EDIT_TYPES)
    if found is None:
        raise ValueError("the reference has fewer than 5 pairs with a supported edit")
    return found


#: The distributions that each task loads from a reference.
DISTRIBUTIONS = {"spam": spam_distributions, "gec": pair_distributions}


def loaded_distributions(task: str, reference: DataFrame, **options) -> tuple[dict[str, float], dict[int, float]]:
    """(types, counts) of a task's reference as settings of planned(); some tens of numbers. ValueError for a task without such distributions."""
    if task not in DISTRIBUTIONS:
        raise ValueError(f"{task}: no distribution is loaded; there are {sorted(DISTRIBUTIONS)}")
    kinds, counts = (rows.collect() for rows in DISTRIBUTIONS[task](reference, **options))
    return {r[0]: r["p"] for r in kinds}, {int(r[0]): r["p"] for r in counts}
