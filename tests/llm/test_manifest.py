"""The manifest against a plain Merkle tree."""

import hashlib
import random
import zlib
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from evalloom.llm import manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    i, _, lang, source, n = row
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))


def up(nodes):
    return [sha(*nodes[k : k + 3]) for k in range(0, len(nodes), 3)]


def proof(nodes, at):
    """((before, after) of each level, the last node)."""
    steps = []
    while len(nodes) > 1:
        run = at // 3 * 3
        steps.append((nodes[run:at], nodes[at + 1 : run + 3]))
        nodes, at = up(nodes), at // 3
    return steps, nodes[0]


def plain(rows):
    rows = sorted(rows, key=lambda r: (r[3] is not None, (r[3] or "").encode(), r[0] is not None, r[0] or 0, leaf(r, r[1])))
    sources = [list(g) for _, g in groupby(rows, key=lambda r: r[3])]
    leaves = [[leaf(r, r[1]) for r in g] for g in sources]
    subroots = [proof(x, 0)[1] for x in leaves]
    result = []
    for s, g in enumerate(sources):
        for k, r in enumerate(g):
            below, subroot = proof(leaves[s], k)
            above, root = proof(subroots, s)
            text = r[1].replace("\n", "") if r[1] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[1]
            node = leaf(r, text)
            for before, after in below + above:
                node = sha(*before, node, *after)
            siblings = "".join("".join(before + after) for before, after in below + above)
            result.append((-1 if r[0] is None else r[0], leaves[s][k], subroot, root, sha(siblings), node, node == root))
    return sorted(result)


def corpus(n, sources, seed=1):
    rng = random.Random(seed)
    texts = ["", None, "a\nb", "no line end", "ä€😀\n\n", "x" * 5000 + "\n"]
    return [(k, rng.choice(texts), rng.choice(["de", None, ""]), rng.choice(sources), rng.choice([None, 3, 10**12])) for k in rng.sample(range(10 * n), n)]


def found(frame):
    rows = frame.withColumn("sha", F.sha2("proof", 256)).collect()
    return sorted((-1 if r.doc_id is None else r.doc_id, r.leaf, r.subroot, r.root, r.sha, r.folded_root, r.verified) for r in rows)


def tampered():
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace(F.col("text"), F.lit("\n"), F.lit("")))


@pytest.mark.parametrize("depth, top", [(8, 3**9), (1, 5), (2, 30), (1, 1)])
def test_plain_tree(spark, depth, top):
    """One distributed round, and many: over sources, and over the sources' nodes."""
    rows = corpus(120, [None, "", "a", "b", "ä", "Z"] + ["hot"] * 6)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert found(manifest.manifest(frame, tampered(), depth, top)) == plain(rows)


def test_many_sources(spark):
    rows = corpus(150, [f"s{k}" for k in range(90)])
    assert found(manifest.manifest(spark.createDataFrame(rows, SCHEMA), tampered(), 1, 10)) == plain(rows)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 27, 28])
def test_sizes_of_one_source(spark, n):
    rows = corpus(n, ["only"], n)
    assert found(manifest.manifest(spark.createDataFrame(rows, SCHEMA), tampered(), 2, 4)) == plain(rows)


def test_nulls_ties_repeats_and_clashes(spark):
    rows = [(1, "a\n", "de", "s", 1), (1, "b\n", "de", "s", 1), (1, "a\n", "de", "s", 1), (None, "x\ny", None, None, None), (None, None, None, None, None), (2, None, "en", "s", None)]
    frame = spark.createDataFrame(rows, SCHEMA).select("*", *(F.lit("?").alias(c) for c in ("tree", "at", "size", "node", "leaf", "now", "part", "root")))
    assert found(manifest.manifest(frame, tampered())) == plain(rows)
    assert all(r[-1] for r in found(manifest.manifest(frame)))
    assert manifest.manifest(frame.limit(0), tampered()).collect() == []


def test_a_changed_value_of_any_column_is_found(spark):
    rows = spark.createDataFrame([(k, f"t{k}", "de", "s", k) for k in range(10)], SCHEMA)
    hashed = rows.select("doc_id", "source", manifest.leaf([F.col(c) for c in manifest.COLUMNS]).alias("leaf"), manifest.leaf([F.col(c) if c != "lang" else F.when(F.col("doc_id") == 3, "en").otherwise(F.col("lang")) for c in manifest.COLUMNS]).alias("now"))
    assert [r.doc_id for r in manifest.proven(hashed).where("not verified").collect()] == [3]
