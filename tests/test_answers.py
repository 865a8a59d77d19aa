"""Stored answers, modelled topics, quarantined documents, loaded distributions, runs with gaps and several models."""

import json

import pytest
from pyspark.sql import functions as F

from evalloom import queries_models
from evalloom.operators import answers, generate, topics
from evalloom.plans import analysis, profiles, tasks
from evalloom.sources import archive, sessions


def test_a_second_run_asks_nothing(spark, tmp_path):
    """Calls are counted by files, for the client is on executors."""
    asked = f"{tmp_path}/asked"

    def answer(prompt):
        with open(asked, "a") as f:
            f.write(prompt + "\n")
        if prompt == "bad":
            raise ValueError
        return f"said {prompt}"

    def calls():
        try:
            with open(asked) as f:
                return sorted(f.read().splitlines())
        except FileNotFoundError:
            return []

    client = generate.Client(answer, tries=1)
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None), (5, "bad")], "id int, q string").withColumn("response", F.lit("the caller's"))
    path = f"{tmp_path}/table"
    want = {1: "said a", 2: "said b", 3: "said a", 4: None, 5: None}
    first = answers.remembered(rows, F.col("q"), client, "m", path)
    assert {r.id: r.response for r in first.collect()} == want and calls() == ["a", "b", "bad"]
    assert first.columns == ["id", "q", "response"]
    again = answers.remembered(rows, F.col("q"), client, "m", path)
    assert {r.id: r.response for r in again.collect()} == want and calls() == ["a", "b", "bad", "bad"]  # only what failed
    assert [(r.prompt, r.tries) for r in answers.kept(spark, path, failed=True).collect()] == [("bad", 2)]
    answers.remembered(rows.where("id = 1"), F.col("q"), client, "another model", path)
    assert calls().count("a") == 2 and answers.kept(spark, path).count() == 3
    assert answers.remembered(rows.limit(0), F.col("q"), client, "m", path).collect() == []


def test_topics_of_each_language(spark, small):
    """Each language has a model and a vocabulary of its own, and shares of its own documents."""
    words = {"en": "flight hotel beach ticket", "de": "Lehrer Heft Klasse Pause", None: "uno dos tres cuatro"}
    rows = [(k, lang, " ".join(w.split()[(k + j) % 4] for j in range(6))) for n, (lang, w) in enumerate(words.items()) for k in range(100 * n, 100 * n + 30 * (n + 1))] + [(900, "en", None), (901, "xx", "alone")]
    texts = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    found = topics.topics_by(texts, "lang", "doc_id", 2, iterations=5).collect()
    assert {lang: sum(r.n for r in found if r.lang == lang) for lang in (*words, "xx")} == {"en": 30, "de": 60, None: 90, "xx": 0}
    assert {lang: round(sum(r.fraction for r in found if r.lang == lang), 3) for lang in words} == dict.fromkeys(words, 1)
    assert all(w in words[r.lang].lower() for r in found for w in r.topic.split()) and all(r.examples for r in found)
    assert topics.topics_by(texts.limit(0), "lang", "doc_id", 2).collect() == []
    found = queries_models.modelled_topics(spark, small).groupBy("lang").agg(F.count("*").alias("k"), F.sum("n").alias("n")).collect()
    docs = {r.lang: r["count"] for r in spark.read.parquet(f"{small}/documents.parquet").groupBy("lang").count().collect()}
    assert {r.lang for r in found} == set(docs) and all(r.k <= 8 and r.n <= docs[r.lang] for r in found) and any(r.k > 1 for r in found)


def test_topics_of_a_model(spark):
    words = {"travel": "flight hotel beach ticket airport luggage", "school": "teacher homework lesson exam pupil classroom"}
    rows = [(k, " ".join(words["travel" if k % 4 else "school"].split()[(k + j) % 6] for j in range(8))) for k in range(80)] + [(900, None), (901, "the of")]
    texts = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = topics.modelled(texts, "doc_id", 2, iterations=40)
    labels = {r.doc_id: r.label for r in found.collect()}
    assert labels[900] is None and labels[901] is None and len(labels) == 82
    of = [{labels[k] for k in range(80) if (k % 4 == 0) == school} for school in (True, False)]
    assert len(of[0]) == len(of[1]) == 1 and of[0] != of[1]
    assert all(w in words["school"] for w in next(iter(of[0])).split())
    assert {r.doc_id: r.label for r in topics.modelled(texts, "doc_id", 2, iterations=40).collect()} == labels
    shares = topics.topics(found)
    assert shares.agg(F.sum("fraction")).first()[0] == pytest.approx(1.0, abs=1e-3)
    messages = texts.withColumn("label", F.when(F.col("doc_id") % 2 == 0, "SPAM").otherwise("HAM"))
    blocks = profiles.messages_profile(messages, labels=found)
    assert blocks["topics"].agg(F.sum("n")).first()[0] == 80 and blocks["class_topics"].groupBy("class").agg(F.round(F.sum("share"), 6).alias("x")).select("x").distinct().collect() == [(1.0,)]
    assert "topics" not in profiles.messages_profile(messages)


def test_quarantine(spark, tmp_path):
    good = {"meta": {"task": "spam", "model": "m"}, "results": {"m": {}}}
    for name, text in {"a": json.dumps(good), "b": json.dumps(good)[:-9], "c": '{"meta": {"task": "x"}}', "d": '{"results": {}}', "e": " ", "f": "[1, 2]", "g": '{"meta": null, "results": null}'}.items():
        archive.save_document(spark, f"file://{tmp_path}/{name}/results.json", text)
    found = sessions.quarantine(spark, [f"file://{tmp_path}"], f"file://{tmp_path}/bad")
    assert {r.dir[-1]: r.reason for r in found.collect()} == {"b": "broken", "c": "no results", "d": "no meta", "e": "broken", "f": "broken", "g": "no meta"}
    assert {r.value for r in found.where("reason = 'no meta'").collect()} == {'{"results": {}}', '{"meta": null, "results": null}'}
    assert [r.dir[-1] for r in sessions.discover(spark, [f"file://{tmp_path}"]).collect()] == ["a"]


def test_distributions_of_pairs(spark):
    pairs = [("I saw cat", "I saw a cat"), ("He go home", "He goes home"), ("I saw two cat", "I saw two cats"), ("You recieve mail", "You receive mail"), ("What you are doing", "What are you doing"), ("same", "same"), (None, "x")]
    rows = spark.createDataFrame(pairs, "incorrect string, correct string")
    kinds, counts = tasks.loaded_distributions("gec", rows)
    assert sum(kinds.values()) == pytest.approx(1) and kinds["M:DET"] == kinds["R:VERB:SVA"] > kinds["R:PUNCT"] > 0 and counts == {1: 1.0}
    with pytest.raises(ValueError):
        tasks.loaded_distributions("gec", rows.limit(2))
    with pytest.raises(ValueError):
        tasks.loaded_distributions("sentiment", rows)


def test_a_run_without_a_value_keeps_its_place(spark):
    scores = spark.createDataFrame([(k, m, "f1", k / 10) for k in (1, 2, 3) for m in ("a", "b") if (k, m) != (1, "b")] + [(2, "a", "errant.recall", 0.5), (1, "b", "f1", None)], "run int, model string, metric string, value double")
    found = analysis.results(analysis.nested(scores))
    assert [r.get("f1") for r in found["b"]["runs"]] == [None, 0.2, 0.3] and [r.get("f1") for r in found["a"]["runs"]] == [0.1, 0.2, 0.3]
    assert found["a"]["runs"][1]["errant"] == {"recall": 0.5} and found["b"]["runs"][0] == {}
    assert found["b"]["generated"]["f1"]["mean"] == pytest.approx(0.25)


def test_models_scored_one_after_another(spark, tmp_path):
    """Scores of one model don't take away another's of the same run; a model's own are replaced."""
    schema = "model string, metric string, run int, value double"
    for rows in ([("007", "f1", 1, 0.1), ("007", "f1", 2, 0.2)], [("org/b=c", "f1", 1, 0.3)], [("007", "f1", 1, 0.9), ("007", "gleu", 1, 0.8)]):
        archive.append_scores(spark.createDataFrame(rows, schema), str(tmp_path))
    found = sorted(map(tuple, archive.scores_of(spark, str(tmp_path)).select("model", "metric", "run", "value").collect()))
    assert found == [("007", "f1", 1, 0.9), ("007", "f1", 2, 0.2), ("007", "gleu", 1, 0.8), ("org/b=c", "f1", 1, 0.3)]


def test_seeds_by_any_name(spark):
    from evalloom.sources import corpora

    rows = spark.createDataFrame([("", None, "c"), (None, "b", "c"), ("a", "b", "c"), (None, "", None)], "text string, correct string, target string")
    assert [r.seed for r in corpora.seeds(rows).collect()] == ["c", "b", "a"]
    assert [r.seed for r in corpora.seeds(rows.select("target")).collect()] == ["c", "c", "c"]
    with pytest.raises(ValueError):
        corpora.seeds(rows.select(F.col("text").alias("body")))
