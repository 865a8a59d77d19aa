"""Substring dedup against all windows."""

import random
import re

from evalloom.llm import anchors

SCHEMA = "doc_id long, text string, g int, r string, hits string"


def brute(rows, n=50):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    owner = {}
    for i, w in words:
        if i is not None:
            for k in range(len(w) - n + 1):
                key = tuple(w[k : k + n])
                owner[key] = min(owner.get(key, i), i)
    found = []
    for i, w in words:
        gone = {k + j for k in range(len(w) - n + 1) if i is not None and owner[tuple(w[k : k + n])] < i for j in range(n)}
        found.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(found, key=str)


def fixture(seed=4):
    rng = random.Random(seed)

    def some(k):
        return [f"v{rng.randrange(3000)}" for _ in range(k)]

    passages = [some(k) for k in (49, 50, 51, 74, 75, 120, 300)]
    rows = []
    for i in range(60):
        text = some(rng.randrange(0, 90))
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(passages)
            a = rng.randrange(0, len(p) // 3)
            text = text + p[a : len(p) - rng.randrange(0, 5)] + some(rng.randrange(0, 40))
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(text)))
    rows += [(100, None), (101, ""), (102, " ".join(passages[-1])), (103, " ".join(passages[-1])), (104, " ".join(["x"] * 200)), (105, " ".join(["x"] * 130)), (106, "é è " * 60), (107, "é è " * 70)]
    rng.shuffle(rows)
    return rows


def result(frame):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in frame.collect()), key=str)


def test_all_windows(spark):
    rows = fixture()
    frame = spark.createDataFrame([(i, t, 1, "r", "h") for i, t in rows], SCHEMA)
    assert result(anchors.remove_repeats(frame)) == brute(rows)


def test_many_small_groups(spark, monkeypatch):
    monkeypatch.setattr(anchors, "GROUP_BYTES", 2000)
    monkeypatch.setattr(anchors, "RANGE_WORDS", 500)
    rows = fixture(9)
    frame = spark.createDataFrame([(i, t, 1, "r", "h") for i, t in rows], SCHEMA)
    found = anchors.remove_repeats(frame)
    assert result(found) == brute(rows)
    for r in found.collect():
        assert sum(x["last"] - x["first"] for x in r.repeats) == r.n_removed


def test_edges(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(None, passage), (3, passage), (3, passage), (2, passage + " " + passage), (None, None)]
    assert result(anchors.remove_repeats(spark.createDataFrame([(i, t, 1, "", "") for i, t in rows], SCHEMA))) == brute(rows)
    assert anchors.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
