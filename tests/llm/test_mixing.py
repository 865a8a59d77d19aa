"""Mixing: targets against a plain version, and what the draws must keep."""

from collections import defaultdict

import pytest

from evalloom.llm import mixing

SCHEMA = "doc_id long, text string, source string, p double, xs string, bucket int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0.5, "x", 1) for r in rows], SCHEMA)


def plain_targets(sizes, most=3.0, weights=(1, 2, 3)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in fixed]
        unit = (total - sum(fixed.values())) / max(1, sum(weight[s] for s in rest))
        over = [s for s in rest if unit * weight[s] >= most * sizes[s] - 1e-9]
        if not over:
            return fixed | {s: unit * weight[s] for s in rest}
        fixed |= {s: most * sizes[s] for s in over}
        if len(over) == len(rest):
            return fixed


def rows(n=700):
    found = []
    for i in range(n):
        source = ["a", "a", "a", "a", "b", "b", "c", "d", None][i % 9] if i > 5 else "tiny"
        found.append((i, " ".join(["w"] * (1 + i * 37 % 90)) if i % 50 else ["", None][i // 50 % 2], source))
    return found


def test_targets_and_taken_words(spark):
    data = rows()
    found = mixing.mix(frame(spark, data)).collect()
    sizes = defaultdict(int)
    for _, text, source in data:
        sizes[source] += len((text or "").split())
    want = plain_targets(dict(sizes))
    taken, largest = defaultdict(int), defaultdict(int)
    assert sorted(r.doc_id for r in found) == [i for i, *_ in data]
    for r in found:
        assert r.size == len((data[r.doc_id][1] or "").split())
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0)
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for source in sizes:
        assert abs(taken[source] - want[source]) <= largest[source] + 1


def test_reruns_agree_whatever_the_partitions(spark):
    data = frame(spark, rows(200))
    one, two = (sorted((r.doc_id, r.taken) for r in mixing.mix(d).collect()) for d in (data, data.repartition(7)))
    assert one == two
    assert one != sorted((r.doc_id, r.taken) for r in mixing.mix(data, seed=8).collect())


def test_expected_copies(spark):
    """Over many seeds a document is taken as often as its source's target says."""
    data = [(i, "w w w w", "a") for i in range(6)] + [(10, "w " * 12, "b")]
    sums, draws = defaultdict(int), 12
    for seed in range(draws):
        found = mixing.mix(frame(spark, data), seed=seed).collect()
        assert {(r.source, r.target) for r in found} == {("a", 12.0), ("b", 24.0)}
        taken = {s: sum(r.taken for r in found if r.source == s) for s in "ab"}
        assert taken["b"] == 24 and abs(taken["a"] - 12) <= 4
        assert {r.copies for r in found if r.source == "a"} <= {0, 1}
        for r in found:
            sums[r.doc_id] += r.taken
    assert sum(sums[i] for i in range(6)) / draws == pytest.approx(12, abs=2.1)
    assert len({i for i in range(6) if sums[i]}) > 3  # not always the same ones


def test_edges(spark):
    assert mixing.mix(frame(spark, [])).count() == 0
    assert [(r.size, r.target, r.taken) for r in mixing.mix(frame(spark, [(1, None, None)])).collect()] == [(0, 0.0, 0)]
    assert mixing.mix(frame(spark, [(1, "a b", "s")] * 5)).count() == 5


def test_mixed_documents_repeat_as_drawn(spark):
    data = frame(spark, rows(150))
    want = {r.doc_id: r.copies for r in mixing.mix(data).collect() if r.copies}
    found = defaultdict(int)
    mixed = mixing.mixed_documents(data)
    assert mixed.columns == data.columns
    for r in mixed.collect():
        found[r.doc_id] += 1
    assert found == want
