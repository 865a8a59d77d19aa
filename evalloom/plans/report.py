"""What sessions add up to: tables of fidelity, of the effects of models and modes, and those that charts draw."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vocab import HEADLINE, SIGNAL_RATES, STYLES, WORD_BINS
from ..operators import fidelity, profile, runs


def _shares(rows: DataFrame, what, name: str, by: tuple = ()) -> DataFrame:
    counts = rows.groupBy(*by, what.alias("key")).agg(F.count("*").alias("p"))
    return counts.select(F.lit(name).alias("dist"), *by, F.col("key").cast("string").alias("key"), "p")


def message_distributions(rows: DataFrame) -> DataFrame:
    """(dist, label, key, p) of (text, label): signals that fire on spam, how many do, and word counts by label."""
    with_signals = rows.withColumn("s", T.signals(F.col("text")))
    spam = with_signals.where("label = 'SPAM'")
    parts = [
        _shares(spam.select(F.explode("s").alias("x")), F.col("x"), "signals").withColumn("label", F.lit("SPAM")),
        _shares(spam, F.least(F.size("s"), F.lit(5)), "signal_counts").withColumn("label", F.lit("SPAM")),
        profile.histogram(rows, F.size(T.tokens(F.col("text"))), WORD_BINS, ["label"]).select(F.lit("words").alias("dist"), "label", F.col("bin").alias("key"), F.col("n").alias("p")),
    ]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def compare_messages(real: DataFrame, generated: DataFrame) -> DataFrame:
    """(name, label, value): the difference in class balance, in rates of signals over spam and of styles by label, and divergences of distributions. Generated less real."""
    jsd = fidelity.jensen_shannon(message_distributions(real), message_distributions(generated), "key", ["dist", "label"])
    jsd = jsd.select(F.concat(F.col("dist"), F.lit("_jsd")).alias("name"), "label", F.col("jsd").alias("value"))
    sides = [profile.style_rates(d, by=["label"]) for d in (real, generated)]
    styles = fidelity.deltas(*sides, ["label"], [*STYLES, "punctuation_density"]).select(F.concat(F.lit("style."), "metric").alias("name"), "label", F.round("delta", 4).alias("value"))
    rates = [profile.signal_rates(d.where("label = 'SPAM'"), by=["label"]) for d in (real, generated)]
    signals = fidelity.deltas(*rates, ["label"], [*SIGNAL_RATES.values()]).select(F.concat(F.lit("signal."), "metric").alias("name"), "label", F.col("delta").alias("value"))
    share = F.coalesce(F.avg((F.col("label") == "SPAM").cast("double")), F.lit(0.0))
    balance = [d.agg(share.alias("spam_fraction")) for d in (real, generated)]
    balanced = fidelity.deltas(*balance_with_key(*balance), ["one"], ["spam_fraction"]).select(F.lit("class_balance").alias("name"), F.lit(None).cast("string").alias("label"), F.col("delta").alias("value"))
    return balanced.unionByName(signals).unionByName(jsd).unionByName(styles)


def balance_with_key(*frames: DataFrame) -> list[DataFrame]:
    return [f.withColumn("one", F.lit(1)) for f in frames]


def edit_distributions(rows: DataFrame, supported, edits: str = "edits", text: str = "corrupted", most: int = 5) -> DataFrame:
    """(dist, key, p) of rows with edits: supported types, how many a pair, and word counts."""
    real = rows.where(F.col(edits).isNotNull()).withColumn("__e", F.filter(edits, lambda e: e["type"] != "noop"))
    types = _shares(real.select(F.explode("__e.type").alias("x")).where(F.col("x").isin(*supported)), F.col("x"), "types")
    counts = _shares(real, F.least(F.size("__e"), F.lit(most)), "edit_counts")
    words = profile.histogram(rows, F.size(T.tokens(F.col(text))), WORD_BINS).select(F.lit("words").alias("dist"), F.col("bin").alias("key"), F.col("n").alias("p"))
    return types.unionByName(counts).unionByName(words)


def compare_pairs(real: DataFrame, generated: DataFrame, supported, edits: str = "edits", text: str = "corrupted") -> DataFrame:
    """(name, value) of rows with edits: differences in edits a pair, share of supported types, types and styles, and divergences. Generated less real."""
    dists = [edit_distributions(d, supported, edits, text) for d in (real, generated)]
    jsd = fidelity.jensen_shannon(*dists, "key", ["dist"]).select(F.concat(F.col("dist"), F.lit("_jsd")).alias("name"), F.col("jsd").alias("value"))
    totals = [profile.edit_profile(d, supported, edits)["totals"] for d in (real, generated)]
    of_totals = fidelity.deltas(*balance_with_key(*totals), ["one"], ["mean_edits", "supported_fraction"]).select(F.col("metric").alias("name"), F.col("delta").alias("value"))
    shares = [d.where("dist = 'types'").select("key", (F.col("p") / F.sum("p").over(_all())).alias("share")) for d in dists]
    types = fidelity.deltas(*shares, ["key"], ["share"]).select(F.concat(F.lit("type."), "key").alias("name"), F.col("delta").alias("value"))
    sides = [profile.style_rates(d, text) for d in (real, generated)]
    styles = fidelity.deltas(*balance_with_key(*sides), ["one"], [*STYLES, "punctuation_density"]).select(F.concat(F.lit("style."), "metric").alias("name"), F.round("delta", 4).alias("value"))
    return of_totals.unionByName(types).unionByName(jsd).unionByName(styles)


def _all():
    from pyspark.sql import Window

    return Window.partitionBy()  # some tens of types


def summary(tidy: DataFrame) -> dict[str, DataFrame]:
    """The analysis of tidy rows (task, strategy, gen_model, eval_model, metric, gen_mean, gen_std, real, runs), a small frame for each question."""
    main = F.create_map(*(F.lit(x) for kv in HEADLINE.items() for x in kv))[F.col("task")]
    head = tidy.where(F.col("metric") == main)
    by = ["task", "strategy", "gen_model"]
    long = head.select(*by, "eval_model", F.explode("runs").alias("value"))
    both = head.where("real IS NOT NULL")
    modes = tidy.groupBy("task", "gen_model", "eval_model", "metric").agg(F.max(F.when(F.col("strategy") == "forward", F.col("gen_mean"))).alias("forward"), F.max(F.when(F.col("strategy") == "inverse", F.col("gen_mean"))).alias("inverse"))
    return {
        "fidelity": runs.fidelity_gap(tidy, HEADLINE, by),
        "eval_model_effect": runs.model_impact(long, "eval_model", by),
        "generation_model_effect": runs.model_impact(long, "gen_model", ["task", "strategy", "eval_model"]),
        "ranks": runs.kendall_tau_b(both, "eval_model", "gen_mean", "real", by),
        "order": runs.ordering(both, by, "eval_model", "gen_mean").select(*by, "eval_model", "place"),
        "mode_effect": modes.where("forward IS NOT NULL AND inverse IS NOT NULL").withColumn("delta", F.col("inverse") - F.col("forward")),
    }


def leaderboard(rows: DataFrame, by: list[str], score: str = "f05") -> DataFrame:
    """(by, score, place), the best first."""
    return runs.ordering(rows, [], by[0], score).orderBy("place")


def bars(tidy: DataFrame) -> DataFrame:
    """Generated and real values of each model and metric; scale says whether a metric stays within 1."""
    within = F.greatest(F.col("gen_mean"), F.coalesce("real", F.lit(0.0))) <= 1
    scale = F.min(within.cast("int")).over(_by("metric"))
    return tidy.select("eval_model", "metric", "gen_mean", "gen_std", "real", F.when(scale == 1, "unit").otherwise("large").alias("scale"))


def _by(*names: str):
    from pyspark.sql import Window

    return Window.partitionBy(*names)


def expected_types(tally: DataFrame, rates: DataFrame) -> DataFrame:
    """(kind, n, expected): how often each kind is, and would be at the real rates (kind, rate)."""
    total = tally.agg(F.sum("n").alias("total"))  # one row
    return tally.join(rates, "kind", "left").crossJoin(F.broadcast(total)).select("kind", "n", (F.coalesce("rate", F.lit(0.0)) * F.col("total")).alias("expected"))
