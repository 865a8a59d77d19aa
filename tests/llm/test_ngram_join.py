"""The n-gram join against all pairs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from evalloom.llm import ngram_join


def shingles(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {" ".join(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {" ".join(words)} if words else set()


def brute(rows, width=5):
    """Size and component of each id; ids may be repeated."""
    sets = [(i, shingles(t, width)) for i, t in rows]
    of = {i: i for i, _ in rows}

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[k + 1 :]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                low, high = sorted((root(i), root(j)))
                of[high] = low
    return sorted((i, len(s), root(i)) for i, s in sets)


def found(frame):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in frame.collect())


def corpus(seed):
    """Copies with few to many changes, a passage in most texts, short texts."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(2000)]
    passage = [rng.choice(words) for _ in range(30)]
    rows = []
    for _ in range(30):
        text = [rng.choice(words) for _ in range(rng.choice([2, 4, 5, 9, 14, 40, 200]))]
        for _ in range(rng.choice([1, 2, 7])):
            rate = rng.choice([0, 0.005, 0.01, 0.03, 0.1])
            copy = [rng.choice(words) if rng.random() < rate else w for w in text]
            rows.append(" ".join(copy + passage if rng.random() < 0.6 else copy))
    rows += ["", " \t\n", "one", "ONE", "a b c d", "A b\x0bc d", "a b c d e", "a b c d e f", "é è x y z", "é è X y z", " ".join(passage), " ".join(passage + ["x"])]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_all_pairs(spark, seed):
    rows = corpus(seed)
    assert found(ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


@pytest.mark.parametrize("width", [1, 2, 3])
def test_other_widths(spark, width):
    rows = corpus(3)
    assert found(ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"), width)) == brute(rows, width)


def test_sizes_at_the_threshold(spark):
    """Sets of all small sizes of which just enough, or one too few, is shared: the first hashes must not lose any."""
    rows = []
    for n in range(1, 60):
        for gone in {0, n // 5, n // 5 + 1, n // 9, n // 9 + 1}:
            base = [f"t{n}x{k}" for k in range(n)]
            rows.append(" ".join(base))
            rows.append(" ".join(base[: n - gone] if gone < n else ["z"]))
            rows.append(" ".join(base[: n - gone] + [f"q{n}x{gone}x{k}" for k in range(gone)]))
    rows = list(enumerate(rows))
    assert found(ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"), 1)) == brute(rows, 1)


def test_a_chain_in_one_bucket(spark):
    """Each text differs from the next by little, and the first from the last by much."""
    words, rows = [f"t{i}" for i in range(100)], []
    for i in range(90):
        words[i] = f"s{i}"
        rows.append((i, " ".join(words)))
    assert found(ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_nulls_repeats_clashes_and_a_long_text(spark):
    long = " ".join(f"v{k % 7919}x{k % 13}" for k in range(200_000))
    rows = [(1, "a b c d e f g h"), (1, "p q r s t"), (4, "P q r s t"), (5, "a b c d e f g h"), (7, None), (7, None), (8, long), (9, long + " end")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").select("*", *(F.lit(0).alias(c) for c in ("rep", "one", "n", "first", "bucket", "hash")))
    assert found(ngram_join.join(frame)) == brute(rows)
    nulls = spark.createDataFrame([(None, "a b c d e"), (3, "a b c d e"), (None, None)], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in ngram_join.join(nulls).collect()} == {(None, None), (3, 3)}
    assert ngram_join.join(frame.limit(0)).collect() == []


def test_a_passage_that_all_have_leaves_no_entries(spark):
    """Entries grow with what documents share at most, not with the passage's number of pairs."""
    rng = random.Random(5)
    passage = " ".join(f"p{k}" for k in range(30))
    rows = [(i, " ".join(rng.choice("abcdefghij") + str(rng.randrange(10**6)) for _ in range(300)) + " " + passage) for i in range(300)]
    schema = "doc_id long, n long, one long, two long, first array<long>, bits array<long>"
    sets = spark.createDataFrame(rows, "doc_id long, text string").mapInArrow(lambda b: ngram_join._sets(b, 5, True), schema).withColumnRenamed("doc_id", "row")
    assert ngram_join.rare_first(sets).count() == 0


def test_what_is_broadcast_does_not_grow(spark, monkeypatch):
    """Nothing larger than a map of keys, also where all of a map's bits are set; one that is small lets through what others would not, and the result is the same."""
    sizes, real = [], F.broadcast
    monkeypatch.setattr(ngram_join, "MARKS", 2, raising=False)
    monkeypatch.setattr(F, "broadcast", lambda frame: sizes.append(frame.count()) or real(frame))
    rows = corpus(4)
    rows += [(1000 + i, t) for i, t in rows[::3]] + [(2000 + i, f"{t} {t}") for i, t in rows[::5]]
    assert found(ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
    assert sizes and max(sizes) <= 2
