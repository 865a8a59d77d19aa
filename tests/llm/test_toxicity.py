"""Toxicity: held-out accuracy, and edges."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evalloom.llm import toxicity

DOCS, LABELS = "doc_id long, text string, score string, toxic string", "doc_id long, toxic int, text string"


def test_held_out_documents(spark, middle):
    """At this scale about half of the toxic documents are found; what is flagged is toxic."""
    from evalloom.llm.queries import op10_toxicity

    sf_dir = middle.replace("0.01", "0.1")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = op10_toxicity(spark, sf_dir).collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    out = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    flagged, toxic = sum(p for p, _ in out), sum(t for _, t in out)
    right = sum(p and t for p, t in out)
    assert right >= 0.9 * flagged and right >= 0.45 * toxic, (right, flagged, toxic)


def planted(n=160):
    words = [f"plain{i}" for i in range(50)]
    docs, labels = [], []
    for i in range(n):
        text = [words[(i * 7 + k * 3) % 50] for k in range(40)]
        if i % 4 == 0:
            text[10:10] = ["vile", "horrid", "scum"]
        docs.append((i, " ".join(text), "s", "t"))
        labels.append((i, int(i % 4 == 0), "label text"))
    return docs, labels


def test_planted_expressions(spark):
    docs, labels = planted()
    found = {r.doc_id: r.predicted for r in toxicity.score(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()}
    assert found == {i: int(i % 4 == 0) for i in found}


def test_labels_of_held_out_rows_teach_nothing(spark):
    docs, labels = planted()
    other = [(i, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t, x) for i, t, x in labels]
    frame = spark.createDataFrame(docs, DOCS)
    one, two = (sorted((r.doc_id, r.score) for r in toxicity.score(frame, spark.createDataFrame(x, LABELS)).collect()) for x in (labels, other))
    assert one == two


def test_edges(spark):
    docs, labels = planted()
    frame = spark.createDataFrame([*docs, (None, "plain1", "", ""), (900, None, "", ""), (901, "", "", ""), (901, "", "", "")], DOCS)
    known = spark.createDataFrame([*labels, (None, 1, ""), (3, None, "")], LABELS)
    rows = toxicity.score(frame, known).collect()
    assert len(rows) == len(docs) + 4
    assert len({r.score for r in rows if r.doc_id in (900, 901)}) == 1
    assert not next(r for r in rows if r.doc_id is None).held_out
    none = toxicity.score(frame, spark.createDataFrame([], LABELS)).collect()
    assert {(r.score, r.predicted) for r in none} == {(0.0, 0)}
    assert toxicity.score(spark.createDataFrame([], DOCS), known).count() == 0
    kept = toxicity.rated(frame, frame, known)
    assert [c for c in kept.columns if c not in ("score", "predicted")] == ["doc_id", "text", "toxic"]


def test_context_totals_are_over_all_pairs(spark):
    """A word after which one word comes in each toxic document, and nine others in one document each, has a tenth of its mass on the first."""
    docs = [(i, "see " + " see ".join(["vile" if i % 2 else "plain", *(f"u{i}x{k}" for k in range(9))]), "s", "t") for i in range(240)]
    labels = spark.createDataFrame([(i, i % 2, "") for i in range(240)], LABELS).select("doc_id", "toxic")
    fitted = toxicity.fit(spark.createDataFrame(docs, DOCS).select("doc_id", "text"), labels)
    hashes, before, _ = toxicity._pairs(pa.array(["see vile"]))
    known, at = toxicity._place(fitted[0].pairs, toxicity._pair_key(before[1:], hashes[1:]))
    assert known[0] and 0 < fitted[0].pair_chances[at[0], 1] <= 0.1
    known, at = toxicity._place(fitted[0].contexts, before[1:])
    assert known[0] and fitted[0].context_rest[at[0], 1] >= 0.9


def plain_words(text):
    text = "".join(c.lower() if c.isascii() else c for c in text or "")
    return [w for w in re.split(r"[\x00-\x2f:-@\[-`{-\x7f]+", text) if w]


def plain_model(texts, errors):
    """A function that gives the mean log ratio of a text, from (text, toxic) and dictionaries alone."""
    counts, follow = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for text, toxic in texts:
        words = plain_words(text)
        for pair in {*zip([None, *words], words)}:
            counts[pair][toxic] += 1
    for (_, w), c in counts.items():
        for k in (0, 1):
            follow[w][k] += c[k] > 0

    def own(table):
        total = [sum(c[k] for c in table.values()) for k in (0, 1)]
        found = {}
        for name, c in table.items():
            rate = [total[k] / max(total[1 - k], 1) for k in (0, 1)]
            found[name] = [max(0, c[k] - c[1 - k] * rate[k] - errors * math.sqrt(c[k] + rate[k] ** 2 * (c[1 - k] + 1) + 1)) for k in (0, 1)]
        return found, total

    pairs, _ = own(counts)
    words, total = own(follow)
    context, kept = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for (v, w), c in counts.items():
        for k in (0, 1):
            context[v][k] += c[k]
            kept[v][k] += pairs[v, w][k]
    rest = [1 - sum(x[k] for x in words.values()) / max(1, total[k]) for k in (0, 1)]
    everything = max(1, sum(total) - sum(sum(x) for x in words.values()))

    def chance(v, w, k):
        shared = (sum(follow[w]) - sum(words[w]) + 0.5) / everything if w in follow else 1e-9
        backoff = (words[w][k] / max(1, total[k]) if w in follow else 0) + rest[k] * shared
        size = max(1, context[v][k]) if v in context else 1
        mine, left = pairs[v, w][k] if (v, w) in pairs else 0, 1 - kept[v][k] / size if v in context else 1
        return mine / size + left * backoff

    def ratio(text):
        found = plain_words(text)
        return sum(math.log(chance(v, w, 1)) - math.log(chance(v, w, 0)) for v, w in zip([None, *found], found)) / max(1, len(found))

    return ratio


def plain_scores(docs, labels, half):
    texts = {i: (t, labels[i]) for i, t in docs if i in labels and zlib.crc32(str(i).encode()) % 4 != 2}
    toxic = np.array([c for _, c in texts.values()], float)
    curves = []
    for errors in toxicity.ERRORS:
        models = [plain_model([x for i, x in texts.items() if half[i] == h], errors) for h in (0, 1)]
        values = np.array([models[1 - half[i]](t) for i, (t, _) in texts.items()])
        curves.append(toxicity._curve(values, toxic, toxic.mean()))
    best = min(range(len(curves)), key=lambda k: curves[k][0])
    model = plain_model([*texts.values()], toxicity.ERRORS[best])
    return {i: 1 / (1 + math.exp(-(curves[best][1] * model(t) + curves[best][2]))) for i, t in docs}


def test_scores_equal_a_plain_version(spark):
    draw = random.Random(5)
    names = [f"w{k}" for k in range(60)]
    docs, labels = [], {}
    for i in range(300):
        words = [names[min(int(draw.expovariate(0.08)), 59)] for _ in range(draw.randrange(1, 60))]
        labels[i] = int(draw.random() < 0.3)
        if draw.random() < (0.9 if labels[i] else 0.05):
            words[:0] = draw.choice([["vile", "scum"], ["horrid"], ["Vile-Thing"]])
        docs.append((i, " ".join(words)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    half = {r.doc_id: r.half for r in frame.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int").alias("half")).collect()}
    known = spark.createDataFrame([(i, c, "") for i, c in labels.items() if i % 10], LABELS)
    want = plain_scores(docs, {i: c for i, c in labels.items() if i % 10}, half)
    found = {r.doc_id: r.score for r in toxicity.score(frame, known, per_rarer=100.0).collect()}
    assert found == pytest.approx(want, rel=1e-6, abs=1e-9)
    assert len({round(x, 6) for x in found.values()}) > 100
