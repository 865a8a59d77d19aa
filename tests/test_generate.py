import pytest
from pyspark.sql import functions as F

from evalloom.operators import generate as G
from evalloom.operators import models, runs, specs, topics
from evalloom.plans import config, report, tasks

PROFILE = {
    "profile_version": 2,
    "topics": {"topics": {"travel": {"fraction": 0.75, "description": "trips"}, "school": {"fraction": 0.25}}},
    "length_distributions": {"correct": {"words": {"bins": {"6-10": 0.5, "51+": 0.5}, "quantiles": {"p90": 60}}}},
    "style": {"correct": {"question_rate": 1.0, "exclaim_rate": 0.0, "punctuation_density": 0.4}},
}


def seeds(spark, n=5):
    return spark.createDataFrame([(i, f"seed number {i} has some words") for i in range(1, n + 1)], "n long, seed string")


def test_prompts(spark):
    row = spark.createDataFrame([("x {b}", None)], "a string, b string").select(G.filled("{{k}} {a}-{b}|{a}", a=F.col("a"), b=F.col("b")).alias("p")).first()
    assert row.p == "{k} x {b}-|x {b}"


def test_numbers_and_turns(spark):
    rows = spark.range(100).select((F.col("id") * 7 % 101).alias("k"), (F.col("id") % 3).alias("g")).repartition(7)
    found = sorted((r.k, r.n) for r in G.numbered(rows, "k").collect())
    assert [n for _, n in found] == [*range(1, 101)]
    by = {}
    for r in G.numbered(rows, "k", ["g"]).collect():
        by.setdefault(r.g, []).append((r.k, r.n))
    assert all([n for _, n in sorted(v)] == [*range(1, len(v) + 1)] for v in by.values())
    turns = sorted((r.i, r.seed) for r in G.cycled(G.samples(spark, 12), seeds(spark)).collect())
    assert [s for _, s in turns] == [f"seed number {(i - 1) % 5 + 1} has some words" for i in range(1, 13)]


def test_client_failures(spark):
    def flaky(prompt):
        if "2" in prompt:
            raise OSError("down")
        return prompt

    rows = G.answered(seeds(spark, 3), F.col("seed"), G.Client(flaky, tries=2, pause=0.0, parallel=2), "said")
    assert sorted((r.n, r.said is None) for r in rows.collect()) == [(1, False), (2, True), (3, False)]


def settings(**more):
    return {"sample_size": 40, "seed": 3, "positive_share": 0.5, "types": {"phishing_link": 0.5, "urgency": 0.5}, "counts": {1: 0.5, 2: 0.5}} | more


def test_class_conditional_cells(spark):
    task, client = tasks.TASKS["spam"], G.Client(G.offline)
    prompts = {"inject": "do {error_spec}\n{sentence}", "rewrite": "again\n{sentence}", "imitate": "as {class_name}\n{sentence}", "SPAM": "{error_spec}\n{spec} and more words", "HAM": "x\n{spec} and more words"}
    rows = tasks.planned(spark, task, client, settings(prompts=prompts, judge_prompt="{sentence}\n{correction}"), seeds(spark)).collect()
    assert len(rows) == 40 and all(r.rejected is None for r in rows)
    assert {r.label for r in rows} == {"SPAM", "HAM"}
    assert all(r.technique == "paraphrase" if r.label == "HAM" else {*r.technique.split(", ")} <= {"phishing_link", "urgency"} for r in rows)
    assert all(r.seed == f"seed number {(r.i - 1) % 5 + 1} has some words" for r in rows)
    both = seeds(spark).select(F.lit("SPAM").alias("label"), "n", "seed").union(seeds(spark, 2).select(F.lit("HAM").alias("label"), "n", "seed"))
    same = tasks.planned(spark, task, client, settings(prompts=prompts, mode="forward"), both).collect()
    assert {r.technique for r in same} == {"imitation"}
    none = tasks.planned(spark, task, client, settings(prompts=prompts, seedless=True), both).collect()
    assert {r.seed for r in none} == {""} and all(r.rejected is None for r in none)
    for bad in (dict(prompts={}), dict(prompts=prompts, mode="forward")):
        with pytest.raises(ValueError):
            tasks.planned(spark, task, client, settings(**bad), both.where("label = 'SPAM'")).count()


def test_pair_cells(spark):
    task, client = tasks.TASKS["gec"], G.Client(G.offline)
    prompts = {"forward": "{sentence}", "inverse": "{error_spec}\n{sentence}", "forward_seedless": "{error_spec}\n{spec}", "inverse_seedless": "{error_spec}\n{sentence}", "carrier": "{spec} in plain words"}
    for more in ({}, {"mode": "inverse"}, {"seedless": True}, {"mode": "inverse", "seedless": True}):
        rows = tasks.planned(spark, task, client, settings(prompts=prompts, types={"R:SPELL": 1.0}, counts={1: 1.0}, sample_size=6, **more), seeds(spark)).collect()
        assert len(rows) == 6 and all(r.rejected is None and r.original != r.corrupted and r.error_type == "R:SPELL" for r in rows), more


def test_rejections_are_counted(spark):
    def answer(prompt):
        n = int(prompt.split()[2])
        return ["I'm sorry, I can't", "Rewritten: too short", "no\ntag", f"Rewritten: {prompt}", "Rewritten: a good long answer"][n - 1]

    rows = G.class_conditional(spark, G.Client(answer, tries=1), 10, labels=("SPAM", "HAM"), positive_share=0.0, types={"a": 1.0}, counts={1: 1.0}, descriptions={}, prompts={"inject": "{sentence}", "rewrite": "{sentence}"}, seeds=seeds(spark))
    assert {r.rejected: r.n for r in G.drops(rows).collect()} == {"refused": 2, "too short": 2, "parse failed": 2, "identical to seed": 2, None: 2}
    with pytest.raises(RuntimeError):
        G.some_accepted(rows.where("rejected IS NOT NULL"))


def test_specs(spark):
    rows = specs.drawn(G.samples(spark, 400), specs.usable(PROFILE), 5).collect()
    assert {r.spec.topic for r in rows} == {"travel", "school"} and 0.65 < sum(r.spec.topic == "travel" for r in rows) / 400 < 0.85
    assert {6 <= r.spec.target_words <= 10 or 51 <= r.spec.target_words <= 60 for r in rows} == {True}
    assert all(r.spec.style_features == ["question_rate"] for r in rows)
    travel = next(r for r in rows if r.spec.topic == "travel")
    assert travel.seed == f"Topic: travel (trips); roughly {travel.spec.target_words} words; phrase it as a question"
    for lacking in ("topics", "style", "profile_version"):
        with pytest.raises(RuntimeError):
            specs.usable({k: v for k, v in PROFILE.items() if k != lacking})


def test_topics(spark):
    texts = spark.createDataFrame([(i, f"text {i}") for i in range(8)], "doc_id long, text string")

    def answer(prompt):
        if prompt.startswith("merge"):
            return '{"greetings": {"description": "hi", "members": ["Hello", "bye"]}, "offers": {"description": "", "members": ["bye"]}}'
        return "\n".join(f"{k}: {['hello', 'bye', 'offers', 'odd'][k % 4]}" for k in range(1, 5))

    found = {r.topic: (r.n, r.fraction, len(r.examples)) for r in topics.profile(texts, "doc_id", "{texts}", "merge {labels}", G.Client(answer), 4).collect()}
    assert found == {"greetings": (4, 0.5, 3), "offers": (2, 0.25, 2), "odd": (2, 0.25, 2)}
    bare = spark.createDataFrame([(1, "a", "x"), (2, "b", None), (3, "c", "x")], "doc_id long, text string, label string")
    assert [(r.topic, r.fraction) for r in topics.topics(bare).collect()] == [("x", 1.0)]


def test_scores_of_tasks(spark):
    spam = spark.createDataFrame([("win $5!", "SPAM"), ("hi there", "HAM"), ("ok!", "HAM")], "text string, label string")
    found = {(r.model, r.metric): r.value for r in tasks.evaluated(tasks.TASKS["spam"], spam, {"s": models.by_signals(), "t": models.by_signals(2)}).collect()}
    assert found["s", "recall"] == 1 and found["s", "fpr"] == 0.5 and found["t", "precision"] == 1
    pairs = spark.createDataFrame([(1, "He go home", "He goes home")], "id int, text string, original string")
    found = {(r.model, r.metric): r.value for r in tasks.evaluated(tasks.TASKS["gec"], pairs, {"same": models.unchanged(), "good": models.words_replaced({"go": "goes"})}).collect()}
    assert found["good", "errant.f0.5"] == 1 and found["good", "gleu"] == 1 and found["same", "n_edits"] == 0 and found["same", "errant.recall"] == 0
    opinions = spark.createDataFrame([("good", "POSITIVE"), ("bad", "NEGATIVE"), ("eh", "NEUTRAL")], "text string, label string")
    found = {r.metric: r.value for r in tasks.evaluated(tasks.TASKS["sentiment"], opinions, {"w": models.by_words()}).collect()}
    assert found == {"accuracy": 1.0, "macro_precision": 1.0, "macro_recall": 1.0, "macro_f1": 1.0}


def test_comparisons(spark):
    real = spark.createDataFrame([("win $500 http://x.com NOW!", "SPAM"), ("see you at lunch", "HAM")], "text string, label string")
    same = {(r.name, r.label): r.value for r in report.compare_messages(real, real).collect()}
    assert len(same) > 20 and not any(same.values())
    other = spark.createDataFrame([("claim your free prize", "SPAM")], "text string, label string")
    found = {(r.name, r.label): r.value for r in report.compare_messages(real, other).collect()}
    assert found["class_balance", None] == 0.5 and found["signal.url_rate", "SPAM"] == -1
    e = "corrupted string, edits array<struct<start: int, end: int, type: string>>"
    a = spark.createDataFrame([("a bad", [(0, 1, "SPELL")])], e)
    b = spark.createDataFrame([("b bad", [(0, 1, "SPELL"), (1, 2, "DET")])], e)
    found = {r.name: r.value for r in report.compare_pairs(a, b, ["SPELL", "DET"]).collect()}
    assert (found["mean_edits"], found["type.DET"], found["type.SPELL"], found["words_jsd"]) == (1.0, 0.5, -0.5, 0.0)


def test_summary(spark):
    rows = [("spam", s, "g", m, "f1", x, 0.0, y, [x, x]) for s, m, x, y in (("forward", "a", 0.5, 0.6), ("forward", "b", 0.7, 0.8), ("inverse", "a", 0.4, 0.6))]
    tidy = spark.createDataFrame(rows, "task string, strategy string, gen_model string, eval_model string, metric string, gen_mean double, gen_std double, real double, runs array<double>")
    found = report.summary(tidy)
    assert {(r.eval_model, round(r.delta, 6)) for r in found["mode_effect"].collect()} == {("a", -0.1)}
    assert {r.strategy: r.tau for r in found["ranks"].collect()}["forward"] == pytest.approx(1)
    assert {r.strategy: r.harder for r in found["fidelity"].collect()} == {"forward": True, "inverse": True}
    assert [r.eval_model for r in found["order"].where("strategy = 'forward'").orderBy("place").collect()] == ["b", "a"]
    assert {r.scale for r in report.bars(tidy).collect()} == {"unit"}
    kinds = runs.tally(spark.createDataFrame([("a",), ("a",), ("b",)], "k string"), F.col("k"), F.lit(None).cast("string"))
    assert {r.kind: r.expected for r in report.expected_types(kinds, spark.createDataFrame([("a", 0.5)], "kind string, rate double")).collect()} == {"a": 1.5, "b": 0.0}


def test_config():
    assert config.expanded({"a": ["${X}-${Y}"]}, {"X": "1"}) == {"a": ["1-"]}
    assert config.overridden({"g": {"m": 1}}, {"g.m": 2, "g.k": 3, "z": None}) == {"g": {"m": 2, "k": 3}}
    good = {"task": "spam", "models": [{"name": "m"}], "num_runs": 2}
    assert config.checked(good) is good and config.provenance(good, 1, "c", "s")["partial"]
    with pytest.raises(ValueError, match=r"task.*num_runs.*models\[0\].name.*profile"):
        config.checked({"task": "x", "num_runs": 0, "models": [{}], "seedless": True})
