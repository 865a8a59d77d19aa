import pytest
from pyspark.sql import functions as F

from evalloom.functions import parse
from evalloom.functions import text as T


def values(spark, column, rows, schema="t string"):
    return [r.v for r in spark.createDataFrame(rows, schema).select(column.alias("v")).collect()]


def test_tokens_and_ngrams(spark):
    rows = [("The cat's 2 CATS, naïve",), (None,), ("",), ("one",)]
    assert values(spark, T.tokens(F.col("t")), rows) == [["the", "cat's", "2", "cats", "na", "ve"], [], [], ["one"]]
    assert values(spark, T.ngrams(T.tokens(F.col("t")), 2), rows[:1])[0][:2] == ["the cat's", "cat's 2"]
    assert values(spark, T.ngrams(T.tokens(F.col("t")), 2), rows[1:]) == [[], [], []]
    assert values(spark, T.spaced(F.col("t")), [("a b c\n",)]) == [["a", "b", "c"]]


def test_signals(spark):
    rows = [("win $500 http://x.com NOW!",), ("free! stuff",), ("see you at lunch",), ("",)]
    found = values(spark, T.signals(F.col("t")), rows)
    assert {*found[0]} == {"phishing_link", "money_promise", "excessive_caps", "urgency", "spam_keywords"}
    assert found[1:] == [["urgency"], [], []]


def test_jaccard(spark):
    def j(a, b):
        return values(spark, T.jaccard(T.bigram_set(F.col("a")), T.bigram_set(F.col("b"))), [(a, b)], "a string, b string")[0]

    assert (j("one", "two"), j("a b c", "A b d"), j("a b", "a b")) == (0.0, pytest.approx(1 / 3), 1.0)


def test_labels(spark):
    assert values(spark, T.normalised_spam_label(F.col("t")), [(" Spam",), ("1",), ("ham",), ("x",), (None,)]) == ["SPAM", "SPAM", "HAM", "HAM", "HAM"]
    assert values(spark, T.sentiment_truth(F.col("t")), [("to_negative",), ("Positive shift",), ("sarcasm_injection",), ("intensity_reduction",), ("other",)]) == ["NEGATIVE", "POSITIVE", "NEGATIVE", "NEUTRAL", None]
    assert values(spark, T.slug(F.col("t")), [("--A b/C!",)]) == ["a_b_c"]


def test_responses(spark):
    said = [("<think>x\nCorrupted: no</think>\nCorrupted:  He go home ",), ("just one line",), ("two\nlines",), ("<think>open Corrupted: a\nso Corrupted: last one",), (None,)]
    assert values(spark, parse.tagged(F.col("t"), "Corrupted"), said) == ["He go home", "just one line", None, "last one", None]
    assert values(spark, parse.is_refusal(F.col("t")), [("I'm sorry, I can't",), ("Sure",), ("<think> I cannot",)]) == [True, False, False]
    full = values(spark, parse.generation(F.col("t")), [("Error type: R:SPELL\nGenerated: He goo\nGround truth: He goes",)])[0]
    assert full.asDict() == {"error_type": "R:SPELL", "corrupted": "He goo", "gold": "He goes"}
    assert values(spark, parse.judge_keeps(F.col("t")), [("Redundancy: valid\nCorrection: correct",), ("Redundancy: trivial",), ("Correction: incorrect",), ("?",)]) == [True, False, False, True]
    assert values(spark, parse.numbered(F.col("t"), F.lit(2)), [("1. a\n2) b",), ("a\nb",), ("a",)]) == [["a", "b"], ["a", "b"], None]
    labels = values(spark, parse.labels(F.col("t"), F.lit(3)), [("1: greetings\n2. spam offer\nnot a label line\n3) Daily chat\n9: no",)])[0]
    assert [(x.place, x.label) for x in labels] == [(1, "greetings"), (2, "spam offer"), (3, "daily chat")]
    assert values(spark, parse.topics(F.col("t")), [('```json\n{"travel": {"description": "d", "members": ["a"]}}\n```',)])[0]["travel"].members == ["a"]
    reasons = spark.createDataFrame([("", "a"), ("a b c", " a b c"), ("a b", "a c"), ("a b c", "a b d")], "a string, b string").select(parse.rejection(F.col("a"), F.col("b")).alias("r")).collect()
    assert [r.r for r in reasons] == ["parse failed", "identical corrupted/gold", "too short", None]
