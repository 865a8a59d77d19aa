"""What keeps queries bounded on larger tables."""

from __future__ import annotations

from collections import Counter

from pyspark.ml.feature import CountVectorizer, StopWordsRemover
from pyspark.sql import functions as F

from evalloom import queries_analysis, queries_files, queries_models
from evalloom.functions import text as T
from evalloom.functions.vocab import STOPWORDS
from evalloom.operators import edits, generate, metrics, profile, topics
from evalloom.sources import sessions


def _plan(frame) -> str:
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_edits_keep_their_texts_without_a_join(spark, small):
    rows = queries_files.edited(spark, small, "input")
    assert "Join" not in _plan(rows)
    assert sorted(rows.select("pair_id", "input").collect()) == sorted(queries_files.turns(spark, small).select("pair_id", "input").collect())


def test_corrected_rows_are_read_without_a_join(spark, small):
    assert "Join" not in _plan(queries_analysis._corrected(spark, small))


def test_gleu_compares_within_a_row(spark):
    rows = spark.createDataFrame([(1, "a b a b a", "a b a c"), (2, "", None), (3, "A b c d", "a b c d"), (4, "x", "x")], "k int, r string, h string")
    found, geometric = metrics.gleu(rows, ["k"], "r", "h"), metrics.geometric_gleu(rows, ["k"], "r", "h")
    for frame in (found, geometric):
        assert not any(w in _plan(frame) for w in ("Aggregate", "Join"))
    assert {r.k: round(r.gleu, 9) for r in found.collect()} == {1: round(6 / 14, 9), 2: 0.0, 3: 0.6, 4: 1.0}
    assert {r.k: round(r.gleu, 9) for r in geometric.collect()} == {1: 0.0, 2: 0.0, 3: 1.0, 4: 1.0}
    matches = metrics.ngram_matches(rows, ["k"], "r", "h").where("k = 1").orderBy("n").collect()
    assert [tuple(r)[1:] for r in matches] == [(1, 3, 5, 4), (2, 2, 4, 3), (3, 1, 3, 2), (4, 0, 2, 1)]


def test_rare_ngrams_are_left_out_before_they_are_counted(spark, monkeypatch):
    monkeypatch.setattr(profile, "BUCKETS", 64)
    monkeypatch.setattr(profile, "BOUND_OF", 2)
    rows = spark.range(300).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 200, "l").alias("lang"), F.concat(F.lit("the same words "), F.col("id"), F.lit(" x"), F.col("id")).alias("text"))
    grams = rows.select("lang", "doc_id", F.explode(T.ngrams(T.tokens(F.col("text")), 2)).alias("ngram"))
    assert 600 <= profile._frequent(grams, 2, "doc_id").count() < grams.count()
    assert [tuple(r) for r in profile.top_ngrams(rows, 3, 2).collect()] == [("the same", 300), ("same words", 300), ("words 0", 1)]
    found = profile.top_ngrams_by(rows, 2, ["lang"], 2).orderBy("lang", "rank").collect()
    assert [tuple(r) for r in found] == [(None, 1, "the same", 100), (None, 2, "same words", 100), ("l", 1, "the same", 200), ("l", 2, "same words", 200)]


def test_packed_documents_are_judged_as_files(spark, tmp_path):
    values = {"a": "no document", "b": '{"results": {}}', "c": '{"meta": {"task": "spam"}}', "d": '{"meta": {"task": "spam"}, "results": {}}'}
    for name, value in values.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "results.json").write_text(value)
    packed = spark.createDataFrame([(n, "results.json", v) for n, v in values.items()], "dir string, file string, value string")
    found = {r.dir: r.reason for r in sessions.unusable(packed).collect()}
    assert found == {r.dir[-1]: r.reason for r in sessions.quarantined(spark, [f"file://{tmp_path}"]).collect()} == {"a": "broken", "b": "no meta", "c": "no results"}


def test_quarantined_documents_are_not_a_file_each(spark, small):
    found = queries_models.quarantined_documents(spark, small)
    assert found.count() == 16 and len(found.inputFiles()) < 16


def test_costs_of_many_words_are_those_of_each_pair():
    a, b = "The walked café İx .. children a".split(), "the walking cafés ix . child an children".split()
    assert edits.costs_of(a, b).tolist() == [[edits.cost(x, y) for y in b] for x in a]


def test_responses_are_passed_on_before_a_batch_ends(spark, monkeypatch):
    monkeypatch.setattr(generate, "PASSED_ON", 100)
    rows = spark.range(500).select("id", F.when(F.col("id") % 7 > 0, F.repeat(F.col("id").cast("string"), F.lit(20))).alias("p"))
    found = generate.answered(rows, F.col("p"), generate.Client(lambda p: p), "said").collect()
    assert len(found) == 500 and all(r.said == r.p for r in found)


def test_sketches_are_held_against_exact_values_in_one_pass(spark, small):
    assert not any("documents.parquet" in f for f in queries_models.merged_profiles(spark, small).inputFiles())
    docs = spark.createDataFrame([("l", "a b a"), ("l", "A"), ("l", "#3 c"), ("l", "..."), ("l", " "), ("m", "b b"), (None, "a")], "lang string, text string")
    words = spark.createDataFrame([("l", [("a", 4)]), ("m", [("b", 2)])], "lang string, top array<struct<word: string, n: long>>")
    found = queries_models._exact(docs, words)
    texts = {("l", 3, 1), ("l", 1, 1), ("l", 2, 1), ("l", 0, 1), ("m", 2, 1), (None, 1, 1)}
    assert {(r.lang, r.value, r.rows) for r in found.where("of = 'texts'").collect()} == texts
    counts = {("l", 3, 4, 1), ("l", 1, None, 3), ("m", 2, 2, 1), (None, 1, None, 1)}
    assert {(r.lang, r.value, r.said, r.rows) for r in found.where("of = 'words'").collect()} == counts


def test_words_of_topics_are_counted_as_a_count_vectorizer_does(spark, small, monkeypatch):
    monkeypatch.setattr(topics, "AT_ONCE", 7)
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(-1, None), (-2, "the of"), (-3, "The THE thE er er")], "doc_id long, text string"))
    read = StopWordsRemover(inputCol="w", outputCol="kept", stopWords=STOPWORDS).transform(docs.withColumn("w", T.tokens(F.col("text"))))
    for most, least in ((1 << 16, 2), (50, 3)):
        plain = CountVectorizer(inputCol="kept", outputCol="v", vocabSize=most, minDF=least).fit(read)
        texts = [r.kept for r in read.select("kept").collect()]
        n, rows = Counter(w for t in texts for w in t), Counter(w for t in texts for w in set(t))
        order = sorted((w for w in n if rows[w] >= least), key=lambda w: (-n[w], w))[:most]
        assert topics._frequent(read.select("w"), most, least) == order and [n[w] for w in order] == [n[w] for w in plain.vocabulary]  # it leaves ties open
        parts = read.withColumn("p", topics._vectors(plain.vocabulary)("w"))
        for r in plain.transform(parts).select("v", "p").collect():
            assert (r.v.size, r.v.indices.tolist(), r.v.values.tolist()) == (r.p.size, r.p.indices, r.p["values"]) and r.p.type == 0


def test_texts_of_topics_are_labelled_without_a_join(spark):
    rows = [(k // 2 if k < 40 else None, "flight hotel beach" if k % 4 < 2 else "lesson exam pupil") for k in range(44)] + [(50, "alone"), (51, None)]
    texts = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = topics.modelled(texts, "doc_id", 2, iterations=5)
    assert "Join" not in _plan(found)
    assert topics.topics(found).agg(F.sum("n")).first()[0] == 44
    assert sorted(map(str, found.select("doc_id", "text").collect())) == sorted(map(str, texts.collect()))
    assert {r.text for r in found.where("label IS NULL").collect()} == {"alone", None}
    assert topics.modelled(texts.where("doc_id > 49"), "doc_id", 2).where("label IS NULL").count() == 2
