"""The annotator: its alignment against a plain dynamic programme, its types against sentences, its base forms against the columns'."""

import random
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from evalloom.functions.vocab import EDIT_TYPES
from evalloom.operators import edits

SENTENCES = [
    ("M:DET", "I saw cat", "I saw a cat"),
    ("U:DET", "I like the music", "I like music"),
    ("R:DET", "It is a apple", "It is an apple"),
    ("M:PREP", "He listens music", "He listens to music"),
    ("U:PREP", "We discuss about plans", "We discuss plans"),
    ("R:PREP", "She is good in maths", "She is good at maths"),
    ("R:VERB:TENSE", "I go home yesterday", "I went home yesterday"),
    ("R:VERB:TENSE", "I walk home yesterday", "I walked home yesterday"),
    ("R:VERB:TENSE", "He called her before", "He has called her before"),
    ("R:VERB:FORM", "I enjoy swim here", "I enjoy swimming here"),
    ("R:VERB:FORM", "He has went home", "He has gone home"),
    ("R:VERB:FORM", "I am used to write", "I am used to writing"),
    ("R:VERB:SVA", "He go home", "He goes home"),
    ("R:VERB:SVA", "They was late", "They were late"),
    ("R:VERB:SVA", "My friends likes it and she like it", "My friends likes it and she likes it"),
    ("R:NOUN:NUM", "I saw two cat today", "I saw two cats today"),
    ("R:NOUN:NUM", "I saw two child today", "I saw two children today"),
    ("R:PRON", "Me went home", "I went home"),
    ("R:SPELL", "You recieve mail", "You receive mail"),
    ("R:WO", "What you are doing", "What are you doing"),
    ("M:PUNCT", "Hello world", "Hello , world"),
    ("U:PUNCT", "Hello , world", "Hello world"),
    ("R:PUNCT", "Are you here .", "Are you here ?"),
    ("R:ADJ", "It is a more big house", "It is a bigger house"),
    ("R:ADJ", "This is big than that", "This is bigger than that"),
    ("R:MORPH", "He talks quick now", "He talks quickly now"),
    ("R:MORPH", "The govern said so", "The government said so"),
    ("R:ORTH", "we met paul", "we met Paul"),
    ("R:ORTH", "It happens every day now", "It happens everyday now"),
    ("R:OTHER", "He bought a car", "He bought a bicycle"),
]


def test_every_supported_type(spark):
    frame = spark.createDataFrame([(k, s, t) for k, (_, s, t) in enumerate(SENTENCES)], "k int, s string, t string")
    found = {r.k: [e.type for e in r.e] for r in frame.select("k", edits.annotator()(F.col("s"), F.col("t")).alias("e")).collect()}
    want = {k: ["M:VERB:TENSE" if "has called" in t else kind] for k, (kind, _, t) in enumerate(SENTENCES)}
    assert found == want
    assert {k for k, _, _ in SENTENCES} >= set(EDIT_TYPES)


def test_several_edits_of_a_sentence(spark):
    row = spark.createDataFrame([("He go to school in the every days .", "Every day he goes to a school !")], "s string, t string").select(edits.annotator()(F.col("s"), F.col("t")).alias("e")).first()
    words, at = "He go to school in the every days .".split(), 0
    rebuilt = []
    for e in row.e:
        rebuilt += words[at : e.start] + e.correction.split()
        at = e.end
    assert " ".join(rebuilt + words[at:]) == "Every day he goes to a school !" and len(row.e) > 2


def plain_cost(a, b):
    @lru_cache(None)
    def least(i, j):
        if not i or not j:
            return 100 * (i + j)
        options = [least(i - 1, j) + 100, least(i, j - 1) + 100, least(i - 1, j - 1) + edits.cost(a[i - 1], b[j - 1])]
        for k in range(2, min(i, j, edits.RUN) + 1):
            x, y = [w.lower() for w in a[i - k : i]], [w.lower() for w in b[j - k : j]]
            if x != y and sorted(x) == sorted(y):
                options.append(least(i - k, j - k) + 100 * (k - 1))
        return min(options)

    return least(len(a), len(b))


def test_alignment_is_the_plain_programme():
    rng = random.Random(2)
    words = "the The a cat cats go goes went going . , in on quick quickly he him recieve receive x".split()
    for _ in range(600):
        a, b = ([rng.choice(words) for _ in range(rng.randrange(9))] for _ in range(2))
        if rng.random() < 0.5:
            b = a[:]
            rng.shuffle(b)
        total, steps = edits.aligned(a, b)
        assert total == plain_cost(tuple(a), tuple(b))
        spent = sum({"=": 0, "D": 100, "I": 100, "T": 100 * (k - i - 1)}.get(op, edits.cost(a[i], b[j]) if op == "R" else 0) for op, i, k, j, m in steps)
        assert spent == total
        i = j = 0
        for op, x, y, u, v in steps:
            assert (x, u) == (i, j) and (op != "=" or a[x:y] == b[u:v])
            i, j = y, v
        assert (i, j) == (len(a), len(b))
        found = edits.merged(a, b, steps)
        rebuilt, at = [], 0
        for x, y, u, v in found:
            rebuilt += a[at:x] + b[u:v]
            at = y
        assert rebuilt + a[at:] == b


def test_long_texts_are_aligned_as_short_ones(monkeypatch):
    """The steps are the same however few cells of the table are held, so no text is long enough for another method."""
    rng = random.Random(3)
    words = "the The a cat cats go goes went going . , in on quick quickly he him has have to more recieve receive x".split()
    for n in [9] * 40 + [70] * 20:
        a = [rng.choice(words) for _ in range(rng.randrange(n))]
        b = [w for w in a if rng.random() < 0.8] + [rng.choice(words) for _ in range(rng.randrange(n))]
        at = rng.randrange(n)
        b[at : at + 4] = reversed(b[at : at + 4])
        whole = edits.spans(a, b), edits.aligned(a, b)
        for cells in (1, 50, 500):
            with monkeypatch.context() as held:
                held.setattr(edits, "CELLS", cells)
                assert (edits.spans(a, b), edits.aligned(a, b)) == whole


def test_types_of_a_long_text(spark):
    """Words that differ in case only stand for each other, also beside a block that both texts have."""
    words, block = [f"w{k}x" for k in range(2050)], [f"b{k}" for k in range(9)]
    frame = spark.createDataFrame([(" ".join(words + block), " ".join(block + [w.upper() for w in words]))], "s string, t string")
    found = frame.select(F.explode(edits.annotator()(F.col("s"), F.col("t"))).alias("e")).groupBy("e.type").count().collect()
    assert {r.type: r["count"] for r in found}["R:ORTH"] == len(words)


def test_base_forms_are_those_of_the_columns(spark):
    words = "go goes went making make makes boxes box horse horses running run called call happily happy cities city bigger biggest big is are s es ing being children was ss aed bus buses naïve ü".split()
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", edits.word_form(F.col("w")).alias("f")).collect()
    assert {r.w: r.f.base for r in rows} == {w: edits.base(w) for w in words}


def test_nulls_equal_long_and_empty_texts(spark, monkeypatch):
    long = " ".join(f"w{k % 977}" for k in range(3000))
    rows = [("a b", "a b"), (None, "x"), ("x", None), (None, None), ("", ""), ("", "a"), ("a", ""), ("  ", "\n"), (long, long + " end"), (long, "none of it " * 1000)]
    frame = spark.createDataFrame(rows, "s string, t string")
    found = [r.e for r in frame.select(edits.annotator()(F.col("s"), F.col("t")).alias("e")).collect()]
    assert [None if e is None else len(e) for e in found[:9]] == [0, None, None, None, 0, 1, 1, 0, 1]
    assert found[8][0].start == 3000 and found[8][0].correction == "end" and found[9]
    assert edits.spans("a b c".split() + ["x"] * 3000, "a b c".split() + ["y"] * 3000) == [(3, 3003, 3, 3003)]
    assert frame.limit(0).select(edits.annotator()(F.col("s"), F.col("t"))).collect() == []


def test_a_given_aligner(spark):
    def align(a, b):
        if a == "bad":
            raise ValueError
        return [(0, 1, "R:X", b)]

    rows = spark.createDataFrame([("a", "b"), ("bad", "b"), (None, "b")], "s string, t string").select(edits.annotator(align)(F.col("s"), F.col("t")).alias("e")).collect()
    assert [None if r.e is None else [tuple(e) for e in r.e] for r in rows] == [[(0, 1, "R:X", "b")], None, None]


def test_by_place(spark):
    rows = spark.createDataFrame([("he go to school now", "He goes at school"), ("x", "x"), ("", "the . has"), (None, "x"), ("", "")], "s string, t string").select(edits.by_place(F.col("s"), F.col("t")).alias("e")).collect()
    found = [None if r.e is None else [(e.start, e.end, e.type, e.correction) for e in r.e] for r in rows]
    assert found == [[(0, 1, "R:ORTH", "He"), (1, 2, "R:VERB:SVA", "goes"), (2, 3, "R:PREP", "at"), (4, 5, "U:OTHER", "")], [], [(0, 0, "M:DET", "the"), (0, 0, "M:PUNCT", "."), (0, 0, "M:VERB:TENSE", "has")], None, []]


@pytest.mark.parametrize("kind", EDIT_TYPES)
def test_profiles_see_each_type(kind):
    assert any(k == kind for k, _, _ in SENTENCES)
