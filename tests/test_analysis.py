"""Sessions scored again and written up, failures of models, and the parts of profiles that no SQL covers."""

import json

import pytest

from evalloom.operators import generate as G
from evalloom.operators import models, profile, topics
from evalloom.plans import analysis, profiles, report, tasks
from evalloom.sources import archive, corpora, sessions

RUNS = [(1, "win $5!", "SPAM"), (1, "hi there", "HAM"), (2, "ok!", "HAM"), (2, "lunch?", "SPAM")]


def spam_runs(spark):
    return spark.createDataFrame(RUNS, "run int, text string, label string")


def test_scored_again(spark, tmp_path):
    real = spark.createDataFrame([("free prize", "SPAM")], "text string, label string")
    stored = spark.createDataFrame([("s", "accuracy", 0.5), ("s", "recall", 0.9), ("gone", "f1", 1.0)], "model string, metric string, value double")
    rows, drift = analysis.rescored(tasks.TASKS["spam"], spam_runs(spark), {"s": models.by_signals()}, real, stored)
    found = {r.metric: r for r in rows.collect()}
    assert found["accuracy"].runs == [1.0, 0.0] and found["accuracy"].gen_mean == 0.5 and found["recall"].real == 1.0
    assert [(r.model, r.metric, r.old, r.new) for r in drift.collect()] == [("s", "recall", 0.9, 0.5)]
    analysis.save_results(rows, {"task": "spam", "mode": "inverse", "model": "g", "runs_completed": 2}, f"file://{tmp_path}/one")
    read = json.loads((tmp_path / "one/results.json").read_text())
    assert read["results"]["s"]["runs"][1]["accuracy"] == 0.0 and read["results"]["s"]["real"]["f1"] == 1.0
    again = {r.metric: (r.gen_mean, r.real, r.runs) for r in sessions.tidy(sessions.discover(spark, [f"file://{tmp_path}"])).collect()}
    assert again["recall"] == (0.5, 1.0, [1.0, 0.0]) and "fpr" not in again


def test_results_nest_by_the_first_dot(spark):
    rows = spark.createDataFrame([("m", "errant.f0.5", 0.5, 0.1, None, [0.4, 0.6]), ("r", "gleu", None, None, 0.25, None)], "model string, metric string, gen_mean double, gen_std double, real double, runs array<double>")
    assert analysis.results(rows) == {"m": {"generated": {"errant": {"f0.5": {"mean": 0.5, "std": 0.1}}}, "runs": [{"errant": {"f0.5": 0.4}}, {"errant": {"f0.5": 0.6}}]}, "r": {"real": {"gleu": 0.25}}}


def test_failed_models_do_not_stop_others(spark):
    def run(settings):
        if settings["bad"]:
            raise ValueError("no key")
        return analysis.nested(analysis.run_scores(tasks.TASKS["spam"], spam_runs(spark), {"s": models.by_signals()}))

    found, failed = analysis.over_models(spark, {"a": {"bad": True}, "b": {"bad": False}}, run)
    assert {r.gen_model for r in found.collect()} == {"b"} and [tuple(r) for r in failed.collect()] == [("a", "no key")]
    with pytest.raises(RuntimeError, match="no key"):
        analysis.over_models(spark, {"a": {"bad": True}}, run)


def test_analysis_is_written(spark, tmp_path):
    root = f"file://{tmp_path}"
    for mode, mean in (("forward", 0.4), ("inverse", 0.6)):
        results = {"x/m": {"generated": {"f1": {"mean": mean, "std": 0.1}}, "real": {"f1": 0.5}, "runs": [{"f1": mean}, {"f1": mean}]}}
        archive.save_document(spark, f"{root}/{mode}/results.json", json.dumps({"meta": {"task": "spam", "mode": mode, "model": "g", "runs_completed": 2}, "results": results}))
    kept, _ = sessions.kept_and_superseded(sessions.discover(spark, [root], profiles=True))
    analysis.save_analysis(sessions.tidy(kept), kept, f"{root}/analysis")
    text = (tmp_path / "analysis/analysis.md").read_text()
    assert "| inverse | g | m | 0.600 ± 0.100 | 0.500 | +0.100 |" in text and "| spam | forward | g | 2 | yes | no |" in text and "## mode effect" in text
    blocks = json.loads((tmp_path / "analysis/analysis.json").read_text())
    assert [round(r["delta"], 9) for r in blocks["mode_effect"]] == [0.2] and len(blocks["sessions"]) == 2


def test_bad_profile_is_left_out(spark, tmp_path):
    for name, profile in (("good", '{"n": 1}'), ("bad", "not json")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "results.json").write_text('{"meta": {"task": "spam"}, "results": {"m": {}}}')
        (tmp_path / name / "profile.json").write_text(profile)
    assert sessions.with_profile(spark, f"file://{tmp_path}/good").first().profile == '{"n": 1}'
    with pytest.warns(UserWarning, match="profile.json"):
        assert sessions.with_profile(spark, f"file://{tmp_path}/bad").first().profile is None


def test_labels_are_consolidated_in_several_questions(spark):
    counts = spark.createDataFrame([("hello", 5), ("bye", 4), ("offer", 3), ("odd", 1)], "label string, n long")

    def answer(prompt):
        if "hello" in prompt:
            return '{"greetings": {"description": "hi", "members": ["hello", "bye"]}}'
        return '{"offers": {"description": "", "members": ["offer"]}, "greetings": {"description": "later", "members": ["odd"]}}'

    blocks = topics.consolidations(counts, "merge {labels}", G.Client(answer), most=2)
    found = {r.label: (r.topic, r.description) for r in topics.claimed(counts, blocks).collect()}
    assert found == {"hello": ("greetings", "hi"), "bye": ("greetings", "hi"), "offer": ("offers", ""), "odd": ("greetings", "later")}
    none = topics.consolidations(counts, "merge {labels}", G.Client(lambda _: "no"), most=2)
    assert {r.label: r.topic for r in topics.claimed(counts, none).collect()} == {x: x for x in ("hello", "bye", "offer", "odd")}


def test_lines_of_topics(spark):
    rows = spark.createDataFrame([("b", 0.5), ("a", 0.25), ("c", 0.25)], "topic string, fraction double")
    assert analysis.topics_line(rows, 2).first().line == "b (50%), a (25%)"
    assert analysis.topics_line(rows.where("false")).first().line == "none"


def test_seeds(spark):
    rows = spark.createDataFrame([("a b", "spam"), ("c d", "ham")], "text string, label string")
    spam = tasks.TASKS["spam"]
    assert sorted(r.label for r in tasks.seed_pool(spam, rows, "forward").collect()) == ["HAM", "SPAM"]
    assert [r.incorrect for r in tasks.seed_pool(spam, rows, "inverse").collect()] == ["c d"]
    with pytest.warns(UserWarning, match="2 usable rows of 3"):
        assert corpora.first_usable(rows, "text", 3, told=True).count() == 2


def test_grid_of_prompts(spark):
    grid = G.prompt_grid(spark, {"w": "do"}, [("a", "b")], (0, 1), (0.0, 0.7)).collect()
    assert [r.variant for r in grid] == ["w_0_0", "w_0_0.7", "w_1_0", "w_1_0.7"] and grid[2].examples == "Example 1:\nInput: a\nOutput: b\n\n"
    with pytest.raises(ValueError):
        G.prompt_grid(spark, {"w": "do"}, [], (1,))


def test_summary_without_usable_truths(spark):
    edits = "array<struct<start: int, end: int, type: string>>"
    rows = spark.createDataFrame([(1, "m", "d", "a b", None, "[GENERATION FAILED]", 0.5, 0.25, [(0, 1, "DET")], [])], f"id int, model string, dataset string, input string, corrected string, truth string, input_score double, corrected_score double, predicted {edits}, gold {edits}")
    r = analysis.dataset_summary(rows, spark.createDataFrame([([(0, 1, "DET")],)], f"edits {edits}")).first()
    assert (r.errant_f05, r.errant_f05_gt, r.gleu_gt, r.cola_delta, r.correction_extent, r.n_edits) == (1.0, 0.0, 0.0, -0.25, 1.0, 1.0)


def test_profiles_by_label(spark):
    rows = spark.createDataFrame([(1, "Win win now", "SPAM"), (2, "now now", "HAM"), (3, "x", None)], "doc_id long, text string, label string")
    blocks = profiles.messages_profile(rows)
    assert [(r.label, r.ngram, r.n) for r in blocks["classes.top_words"].where("rank = 1").orderBy("label").collect()] == [("HAM", "now", 2), ("SPAM", "win", 2)]
    assert {r.ngram for r in blocks["label.top_2_grams"].collect()} == {"win win", "win now", "now now"}


def test_fidelity_document(spark, tmp_path):
    rows = spark.createDataFrame([("win $5 now!", "SPAM"), ("see you", "HAM")], "text string, label string")
    blocks = {"signals": profile.signal_rates(rows), "styles": profile.style_rates(rows)}
    archive.save_fidelity(blocks, blocks, report.compare_messages(rows, rows), f"file://{tmp_path}")
    read = json.loads((tmp_path / "profile.json").read_text())
    assert read["real"] == read["generated"] and len(read["real"]["signals"]) == 2
    assert len(read["fidelity"]) > 20 and not any(r["value"] for r in read["fidelity"])
    assert sessions.documents(spark, [f"file://{tmp_path}"], "profile.json").count() == 1
