"""Near-duplicates against all pairs."""

import random
import re

from evalloom.llm import minhash

SCHEMA = "doc_id long, text string, rep long, bucket string"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {" ".join(words[i : i + 2]) for i in range(len(words) - 1)} if len(words) > 1 else {*words}


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    of = {i: i for i in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(of[a], of[b])
            if (of[a], of[b]) != (low, low):
                of[a] = of[b] = low
                changed = True
    return {i: (len(sets[i]), of[i], of[i] == i) for i in sets}


def fixture(seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for base in range(25):
        text = [rng.choice(words) for _ in range(rng.choice([3, 10, 40, 120]))]
        for _ in range(rng.choice([1, 2, 6])):
            copy = [rng.choice(words) if rng.random() < rng.choice([0, 0.01, 0.05]) else w for w in text]
            text = copy if rng.random() < 0.5 else text  # chains
            rows.append(" ".join(copy))
    rows += ["", "  \n\t", "one", "ONE", "one two", "One\x0btwo", "é è x", "é è X"]
    rng.shuffle(rows)
    return [*enumerate(rows), (len(rows), None)]


def result(frame):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in frame.collect()}


def test_all_pairs(spark):
    rows = fixture()
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA)
    assert result(minhash.near_duplicates(frame)) == brute(rows)


def test_a_large_group_with_a_chain(spark):
    """A bucket of copies, of which each differs from the next by little and the first from the last by much."""
    words = [f"t{i}" for i in range(60)]
    rows, text = [], words[:]
    for i in range(120):
        rows.append((i, " ".join(text)))
        if i % 4 == 3:
            text[(7 * i) % 60] = f"n{i}"
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA)
    assert result(minhash.near_duplicates(frame)) == brute(rows)


def test_null_ids_repeated_rows_and_empty_table(spark):
    frame = spark.createDataFrame([(None, "a b c", 1, ""), (4, "a b c", 1, ""), (4, "a b c", 1, ""), (6, "a b c", 1, "")], SCHEMA)
    rows = sorted((r.doc_id or -1, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(frame).collect())
    assert rows == [(-1, 2, None, True), (4, 2, 4, True), (4, 2, 4, True), (6, 2, 4, False)]
    assert minhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sketches_never_rule_out_a_link():
    import numpy as np
    import pyarrow as pa

    rows = [t for _, t in fixture(5) if t]
    values, bounds = minhash.shingle_sets(pa.array(rows))
    bits = minhash.parities(values, bounds)
    sets = [values[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    out = 0
    for i in range(len(sets)):
        for j in range(i):
            apart = len(np.setxor1d(sets[i], sets[j]))
            found = int(np.bitwise_count(bits[i] ^ bits[j]).sum())
            assert found <= apart and (apart - found) % 2 == 0
            out += found > apart * 0.9
    assert out > 0


def test_several_rounds_in_buckets_of_unlinked_members(spark, monkeypatch):
    """Copies of one text with a quarter of its words changed share buckets, though most are not linked."""
    monkeypatch.setattr(minhash, "MORE", 2)
    rng = random.Random(8)
    base = [f"b{i}" for i in range(80)]
    rows = [(i, " ".join(f"c{i}x{k}" if rng.random() < rng.choice([0.02, 0.06, 0.12]) else w for k, w in enumerate(base))) for i in range(90)]
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA)
    assert result(minhash.near_duplicates(frame)) == brute(rows)


def test_rows_of_one_id_are_linked_by_any_of_their_texts(spark):
    text = [f"w{i}" for i in range(100)]
    near = [*text[:50], "other", *text[51:]]
    rows = [(1, "aaa bbb ccc"), (1, " ".join(text)), (2, " ".join(near)), (5, " ".join(text)), (5, "lone words here"), (7, "lone words here"), (9, "nothing like it")]
    found = minhash.near_duplicates(spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA)).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in found} == {(1, 1, True), (2, 1, False), (5, 1, False), (7, 1, False), (9, 9, True)}
    assert sorted(r.n_shingles for r in found if r.doc_id == 1) == [2, 99]


def test_large_buckets_are_dealt_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "DEALT", 4)
    rng = random.Random(3)
    base = [f"b{i}" for i in range(60)]
    rows = [(i, " ".join(f"c{i}x{k}" if rng.random() < 0.03 else w for k, w in enumerate(base))) for i in range(40)]
    assert result(minhash.near_duplicates(spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA))) == brute(rows)


def test_one_very_long_text(spark):
    long = " ".join(f"v{i % 5000}x{i % 7}" for i in range(200_000))
    found = minhash.near_duplicates(spark.createDataFrame([(3, long, 1, "x"), (8, long + " end", 1, "x"), (9, "short one", 1, "x")], SCHEMA)).collect()
    assert {(r.doc_id, r.component_id) for r in found} == {(3, 3), (8, 3), (9, 9)}
