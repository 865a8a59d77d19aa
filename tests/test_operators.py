import math

import pytest
from pyspark.sql import functions as F

from evalloom.functions.vocab import WORD_BINS
from evalloom.operators import edits, fidelity, metrics, models, profile, runs, sampling


def texts(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "doc_id long, text string")


def test_histogram_and_quantiles(spark):
    rows = spark.createDataFrame([(x,) for x in (3, 8, 8, 60)], "v int")
    found = {r.bin: r.share for r in profile.histogram(rows, F.col("v"), WORD_BINS).collect()}
    assert found["6-10"] == 0.5 and found["51+"] == 0.25 and sum(found.values()) == 1
    q = profile.quantiles(spark.range(1, 101), F.col("id")).first()
    assert (q.p50, q.p90) == (50.5, pytest.approx(90.1))
    assert profile.quantiles(spark.range(0), F.col("id")).first().p50 == 0


def test_style_and_vocabulary(spark):
    style = profile.style_rates(texts(spark, "Are you FREE now?", "i'm at home", "call her 2day plz!")).first().asDict()
    density = style.pop("punctuation_density")
    assert {round(v, 9) for v in style.values()} == {round(1 / 3, 9)} and density > 0
    v = profile.vocabulary_stats(texts(spark, "the cat sat", "the cat ran")).first()
    assert (v.total_tokens, v.types, v.avg_word_length) == (6, 4, 3.0)
    assert (v.type_token_ratio, v.hapax_fraction, v.stopword_fraction) == (pytest.approx(4 / 6), 0.5, pytest.approx(2 / 6))
    assert [(r.ngram, r.n) for r in profile.top_ngrams(texts(spark, "a b", "c d", "a b"), 5, 2).collect()] == [("a b", 2), ("c d", 1)]


def test_edit_profile(spark):
    e = "edits array<struct<start: int, end: int, type: string>>"
    rows = spark.createDataFrame([([(0, 1, "SPELL")],), ([(0, 1, "SPELL"), (1, 2, "DET")],), ([],), (None,), ([(0, 0, "noop")],)], e)
    found = profile.edit_profile(rows, ["SPELL", "DET"])
    assert {r["type"]: r.n for r in found["types"].collect()} == {"SPELL": 2, "DET": 1}
    assert found["totals"].first().mean_edits == 0.75


def test_divergence(spark):
    def jsd(a, b):
        sides = [spark.createDataFrame([*d.items()], "key string, p double") for d in (a, b)]
        rows = fidelity.jensen_shannon(*sides, "key").collect()
        return rows[0].jsd if rows else 0.0

    assert jsd({"a": 0.7, "b": 0.3}, {"a": 0.2, "b": 0.6, "c": 0.2}) == pytest.approx(0.2428748467466007)
    assert jsd({"a": 1.0}, {"a": 1.0}) == 0 and jsd({"a": 1.0}, {"b": 1.0}) == pytest.approx(1)
    assert jsd({}, {"a": 1.0}) == 0 and jsd({}, {}) == 0


def test_signal_distributions(spark):
    types, counts = fidelity.signal_distributions(texts(spark, *["visit http://x.com please here"] * 6))
    p = {r.signal: r.p for r in types.collect()}
    assert len(p) == 5 and max(p, key=p.get) == "phishing_link" and sum(p.values()) == pytest.approx(1)
    assert [(r.signals, r.p) for r in counts.collect()] == [(1, 1.0)]
    assert fidelity.signal_distributions(texts(spark, "http://a.b", "http://c.d")) is None


def test_edit_scores(spark):
    s = "gold array<struct<start: int, end: int, type: string>>"
    rows = spark.createDataFrame([([(0, 1, "R:VERB")], [(0, 1, "R:VERB")]), ([], [(1, 2, "M:DET")])], s.replace("gold", "predicted") + ", " + s)
    found = metrics.edit_scores(rows).first()
    assert (found.precision, found.recall) == (1.0, 0.5)
    assert metrics.mean_edits(rows).first().n_edits == 0.5
    by_type = metrics.edit_type_scores(rows.withColumn("k", F.monotonically_increasing_id()), ["k"]).first()
    assert (by_type.tp, by_type.fp, by_type.fn) == (1, 0, 1)
    assert metrics.type_distribution_scores(rows).first().tp == 0.5


def test_gleu(spark):
    rows = spark.createDataFrame([(1, "He goes to school .", "He go to school ."), (2, "a b", "a b"), (3, "the the cat", "the cat the the"), (4, "", "a")], "k int, r string, h string")
    found = {x.k: x.gleu for x in metrics.gleu(rows, ["k"], "r", "h").collect()}
    assert found == {1: pytest.approx(0.5), 2: 1.0, 3: pytest.approx(0.5), 4: 0.0}


def test_classification_edges(spark):
    empty = spark.createDataFrame([], "label string, prediction string")
    assert metrics.binary_scores(empty, "SPAM").first().asDict() == dict.fromkeys(("accuracy", "precision", "recall", "f1", "fpr"), 0.0)
    rows = spark.createDataFrame([("NEG", "NEG"), ("POS", "NEG"), ("NEU", "NEU")], "label string, prediction string")
    m = metrics.macro_scores(rows, ("NEG", "NEU", "POS")).first()
    assert (m.macro_precision, m.macro_recall) == (pytest.approx(0.5), pytest.approx(2 / 3))
    assert m.macro_f1 == pytest.approx(2 * 0.5 * (2 / 3) / (0.5 + 2 / 3))


def test_runs(spark):
    rows = spark.createDataFrame([("a", 0.2), ("a", 0.4), ("a", 0.6), ("b", 0.5)], "model string, value double")
    found = {r.model: (r.mean, r.std) for r in runs.mean_std(rows, ["model"]).collect()}
    assert found == {"a": (pytest.approx(0.4), pytest.approx(0.2)), "b": (0.5, 0.0)}

    def eta(*groups):
        flat = [(g, float(v)) for g, values in enumerate(groups) for v in values]
        return runs.eta_squared(spark.createDataFrame(flat, "g int, value double"), ["g"]).first().eta2

    assert (eta([1, 1], [2, 2]), eta([1, 2], [1, 2]), eta([1, 2]), eta([1, 1], [1, 1])) == (pytest.approx(1), pytest.approx(0), None, None)

    def tau(x, y):
        return runs.kendall_tau_b(spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "k int, x double, y double"), "k", "x", "y").first().tau

    assert tau([1, 1, 2, 3], [1, 2, 3, 4]) == pytest.approx(0.9128709291752769)
    assert (tau([1, 2, 3], [4, 5, 6]), tau([1, 2, 3], [6, 5, 4]), tau([1, 1], [1, 2])) == (pytest.approx(1), pytest.approx(-1), None)
    techniques = spark.createDataFrame([("a, b", None), ("a", None), (None, "x"), (None, None)], "technique string, error_type string")
    assert {r.kind: r.n for r in runs.tally(techniques, F.col("technique"), F.col("error_type")).collect()} == {"a": 2, "b": 1, "x": 1, "unknown": 1}


def test_draws(spark):
    weights = {"a": 0.7, "b": 0.2, "c": 0.1, "none": 0.0}
    rows = spark.range(4000).select(sampling.choice(sampling.uniform(F.col("id"), "x", 1), weights).alias("k"), sampling.distinct_choices(F.col("id"), F.lit(2), weights, 1).alias("two"), sampling.distinct_choices(F.col("id"), F.lit(5), weights, 1).alias("five")).collect()
    share = sum(r.k == "a" for r in rows) / len(rows)
    assert abs(share - 0.7) < 4 * math.sqrt(0.21 / len(rows)) and not any(r.k == "none" for r in rows)
    assert all(len({*r.two}) == 2 for r in rows) and all(len(r.five) == 5 for r in rows)
    first = sum(r.two[0] == "a" for r in rows) / len(rows)
    assert abs(first - 0.7) < 4 * math.sqrt(0.21 / len(rows))
    with pytest.raises(ValueError):
        sampling.choice(F.lit(0.5), {"a": 0.0})
    assert sampling.sample(spark.range(100), "id", 7, 1).count() == 7


def test_annotator_and_models(spark):
    rows = spark.createDataFrame([("He go to school .", "He goes to the school ."), ("a b", "a b"), (None, "x"), ("cat the", "the cat")], "s string, t string")
    found = [r.e for r in rows.select(edits.annotator()(F.col("s"), F.col("t")).alias("e")).collect()]
    assert [(e.start, e.end, e.type, e.correction) for e in found[0]] == [(1, 2, "R:VERB:SVA", "goes"), (3, 3, "M:DET", "the")]
    assert found[1] == [] and found[2] is None
    rows = texts(spark, "win $5 now!", "hello there")
    said = models.predicted(rows, {"s": models.predictor("spam", "signals"), "p": models.loaded(lambda: lambda ts: [t.upper() for t in ts])}).collect()
    assert {(r.doc_id, r.model): r.prediction for r in said} == {(0, "s"): "SPAM", (1, "s"): "HAM", (0, "p"): "WIN $5 NOW!", (1, "p"): "HELLO THERE"}
    with pytest.raises(ValueError):
        models.predictor("spam", "none")


def test_whole_profiles(spark):
    from evalloom.plans import profiles

    rows = spark.createDataFrame([(1, "win $5 now!", "SPAM"), (2, "see you at lunch", "HAM"), (3, None, "HAM"), (4, "x", None)], "doc_id long, text string, label string")
    found = profiles.rows_profile(rows, ["text"])
    assert found["count"].first().n == 4 and {r.column: r.missing for r in found["missing"].collect()} == {"doc_id": 0, "text": 1, "label": 1}
    classes = profiles.classes_profile(rows)
    assert {r.label: (r.n, r.percent) for r in classes["labels"].collect()} == {"SPAM": (1, 50.0), "HAM": (1, 50.0)}
    whole = profiles.messages_profile(rows.where("label IS NOT NULL"))
    assert {r.signals: r.n for r in whole["signal_counts"].collect()} == {3: 1} and all(b.count() >= 0 for b in whole.values())
    pairs = spark.createDataFrame([(1, "He go home", "He goes home"), (2, "a b c", "x y z")], "doc_id long, incorrect string, correct string")
    found = profiles.pairs_profile(pairs)
    assert {r.complexity: r.n for r in found["complexity"].collect()} == {"low": 1, "high": 1}
    assert found["edits.totals"].first().mean_edits == 1.0
