"""Fitted models, mergeable profiles, syntax and rounding against plain versions."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from evalloom.functions.numbers import rounded
from evalloom.operators import models, sketches, syntax, trained
from evalloom.plans import tasks


def labelled(spark, n=120, seed=1):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        spam = k % 2
        words = [rng.choice("free prize money cash".split() if spam and rng.random() < 0.4 else "see you at lunch tomorrow maybe home".split()) for _ in range(12)]
        rows.append((k, " ".join(words), "SPAM" if spam else "HAM"))
    return spark.createDataFrame(rows, "id long, text string, label string")


@pytest.mark.parametrize("kind", ["logistic", "bayes"])
def test_fit_on_one_half_and_read_again(spark, tmp_path, kind):
    rows = labelled(spark)
    model = trained.fit(rows.where("id % 4 < 2"), "text", "label", kind)
    trained.save(model, f"{tmp_path}/model")
    trained.save(model, f"{tmp_path}/model")  # replaces
    others = rows.where("id % 4 >= 2").withColumn("__text", F.lit("a column of the caller's"))
    found = trained.Trained(model).add(others, F.col("text"), "said", "scores")
    again = models.predictor("spam", "trained", path=f"{tmp_path}/model").add(others, F.col("text"), "said", "scores")
    one, two = ({r.id: (r.said, r.scores) for r in f.collect()} for f in (found, again))
    assert one == two and len(one) == 60 and "__words" not in found.columns
    right = found.where("said = label").count()
    assert right >= 55
    assert found.orderBy("id").select("said").collect() == trained.Trained(trained.fit(rows.where("id % 4 < 2"), "text", "label", kind)).add(others, F.col("text"), "said").orderBy("id").select("said").collect()


def test_a_fitted_model_beside_rules(spark):
    rows = labelled(spark)
    fitted = trained.Trained(trained.fit(rows, "text", "label", "bayes"))
    found = tasks.evaluated(tasks.TASKS["spam"], rows, {"fitted": fitted, "signals": models.by_signals()})
    scores = {(r.model, r.metric): r.value for r in found.collect()}
    assert scores["fitted", "accuracy"] > 0.9 and scores["signals", "fpr"] == 0
    said = models.predicted(rows.where("id < 2"), {"fitted": fitted})
    assert said.columns == ["id", "text", "label", "model", "prediction"]


def test_texts_without_words_and_bad_labels(spark):
    rows = labelled(spark)
    model = trained.fit(rows.unionByName(spark.createDataFrame([(-1, None, "HAM"), (-2, " ", "HAM"), (-3, "x", None)], rows.schema)), "text", "label", "bayes")
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "unknown words"), (4, "free prize " * 50_000)], "id int, text string")
    assert {r.id: r.said for r in trained.Trained(model).add(odd, F.col("text"), "said").collect()} == {1: "HAM", 2: "HAM", 3: "HAM", 4: "SPAM"}
    with pytest.raises(ValueError):
        trained.fit(rows.where("label = 'HAM'"), "text", "label")
    with pytest.raises(ValueError):
        trained.fit(rows.select("text", F.col("id").alias("label")), "text", "label")
    assert trained.Trained(model).add(odd.limit(0), F.col("text"), "said").collect() == []


def test_acceptability(spark):
    pairs = spark.createDataFrame([(k, "he go to the school of town", "he goes to the school of town") for k in range(20)] + [(99, "same", "same")], "id int, text string, prediction string")
    scorer = trained.acceptability_scorer(pairs, "text", "prediction")
    assert trained.acceptability(pairs.where("id < 99"), scorer, "text", "prediction").first() == (0.0, 1.0, 1.0)
    rows = trained.with_acceptability(pairs.where("id < 3"), scorer)
    assert [(r.input_score, r.corrected_score) for r in rows.collect()] == [(0.0, 1.0)] * 3
    scored = tasks.TASKS["gec"].scores(rows.select("id", F.lit("m").alias("model"), "text", F.col("prediction").alias("original"), "prediction", "input_score", "corrected_score"))
    assert {r.metric: r.value for r in scored.collect()}["cola.delta"] == 1.0


def test_sketches_of_parts_make_the_whole(spark):
    rng = random.Random(4)
    texts = [" ".join(f"w{int(rng.paretovariate(1.2)) % 3000}" for _ in range(rng.randrange(1, 400))) for _ in range(1500)]
    rows = spark.createDataFrame([(k % 7, t) for k, t in enumerate(texts)] + [(0, None), (1, "  "), (2, "...")], "part int, text string").repartition(5)
    whole = sketches.merged(sketches.merged(sketches.sketched(rows, ["part"]), ["part"]))
    sizes = sorted([len(t.split()) for t in texts] + [0])
    r = sketches.numbers_of(whole, "words").first()
    assert (r.n, r.min, r.max) == (1501, sizes[0], sizes[-1]) and r.mean == pytest.approx(statistics.mean(sizes)) and r.std == pytest.approx(statistics.pstdev(sizes))
    for q in (10, 25, 50, 75, 90):
        below, upto = (sum(f(s) for s in sizes) / len(sizes) for f in (lambda s: s < r[f"p{q}"], lambda s: s <= r[f"p{q}"]))
        assert below <= q / 100 + sketches.RANK_ERROR and upto >= q / 100 - sketches.RANK_ERROR
    counts = {}
    for t in texts:
        for w in t.split():
            counts[w] = counts.get(w, 0) + 1
    words = sketches.words_of(whole, 5).first()
    assert words.tokens == sum(counts.values()) and abs(words.types - len(counts)) <= sketches.DISTINCT_ERROR * len(counts)
    assert [(t.word, t.n) for t in words.top] == sorted(counts.items(), key=lambda x: -x[1])[:5]  # fewer distinct words than are tracked
    assert sketches.numbers_of(sketches.merged(sketches.sketched(rows.limit(0), ["part"]), ["part"]), "words", ["part"]).collect() == []


def test_syntax(spark):
    rng = random.Random(6)
    trees = []
    for k in range(60):
        n = rng.choice([1, 2, 5, 40, 300])
        heads = [-1 if i == 0 or rng.random() < 0.05 else rng.randrange(i) for i in range(n)]
        order = list(range(n))
        rng.shuffle(order)  # heads before and after
        moved = [0] * n
        for i, h in enumerate(heads):
            moved[order[i]] = rng.choice([-1, order[i]]) if h < 0 else order[h]
        trees.append((k, moved))
    trees += [(900, list(range(-1, 2000))), (901, [1, 0, -1, 2]), (902, []), (903, None), (904, [7, None, 2])]

    def depth(h, i):
        for d in range(len(h) + 1):
            if h[i] is None or h[i] >= len(h) or h[i] < -1:
                return None
            if h[i] in (-1, i):
                return d
            i = h[i]
        return None

    frame = spark.createDataFrame(trees, "id int, heads array<int>")
    found = {r.id: r.d for r in frame.select("id", syntax.depths(F.col("heads")).alias("d")).collect()}
    assert found == {k: None if h is None else [depth(h, i) for i in range(len(h))] for k, h in trees}
    rows = spark.createDataFrame([(1, [1, -1, 1, 1], ["nsubj", "ROOT", "conj", "conj"], ["PRON", "VERB", "VERB", "NOUN"])], "id int, heads array<int>, labels array<string>, kinds array<string>")
    r = syntax.measured(rows).first()
    assert (r.depth, r.clauses, r.sentences) == (1, 2, 1) and r.arcs == pytest.approx(4 / 3)
    blocks = syntax.syntax_profile(rows)
    assert blocks["depth"].first()["mean"] == 1.0 and {x.kind: x.n for x in blocks["kinds"].collect()} == {"PRON": 1, "VERB": 2, "NOUN": 1}


def test_rounding_is_pythons(spark):
    rng = random.Random(7)
    values = [rng.uniform(-1, 1) * 10 ** rng.randrange(-8, 9) for _ in range(200_000)]
    values += [k / 20_000 for k in range(-20_001, 20_001)] + [k + 0.5 for k in range(-50, 50)] + [k / 64 / 100 for k in range(5000)] + [2.675, 1e300, -1e16, 5e-324, 0.0, -0.0, float("inf"), -0.00004]
    for places in (0, 2, 4):
        found = [r.v for r in spark.createDataFrame([(v,) for v in values], "v double").select(rounded(F.col("v"), places).alias("v")).collect()]
        want = [v if v in (float("inf"),) else float(round(v, places)) for v in values]
        assert [repr(x) for x in found] == [repr(x) for x in want]
    assert spark.createDataFrame([(None,), (float("nan"),)], "v double").select(rounded(F.col("v")).alias("v")).collect()[0].v is None
