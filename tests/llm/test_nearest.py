"""Nearest neighbours against brute force."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from evalloom.llm import anisotropic

SCHEMA = "vec_id long, embedding array<double>, code string, v int"


def brute(rows, asks, k=20):
    """(query, [(score, id)]) with ties to the smaller id."""
    found = {}
    for q, x in rows:
        if asks(q):
            scored = sorted((-float((np.array(x) * np.array(y)).sum()), i) for i, y in rows if i != q)
            found[q] = [(i, -s) for s, i in scored[:k]]
    return found


def got(frame):
    found = {}
    for r in frame.orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return found


def test_small_table_is_exact_with_ties_and_bad_rows(spark):
    rng = np.random.default_rng(3)
    good = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(60)]
    good += [(i, good[i - 60][1]) for i in range(60, 90)]  # equal vectors: ties
    bad = [(1000, None), (1001, [0.0] * 8), (1002, [1.0, None] + [0.5] * 6), (1003, [float("nan")] * 8), (1004, [float("inf")] + [0.0] * 7), (1005, [1.0, 2.0]), (None, [1.0] * 8)]
    rows = [(i, v, "x", 1) for i, v in good + bad] + [(5, good[5][1], "x", 1)]  # a repeated row
    found = got(anisotropic.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0))
    want = brute(good, lambda q: q % 20 == 0)
    assert found.keys() == want.keys()
    for q, best in want.items():
        assert [i for i, _ in found[q]] == [i for i, _ in best]
        assert [s for _, s in found[q]] == pytest.approx([s for _, s in best], abs=1e-12)


def test_few_candidates_and_none(spark):
    rows = [(0, [1.0, 2.0, 3.0], "", 0), (1, [3.0, 2.0, 1.0], "", 0), (20, [0.0, 0.0, 1.0], "", 0)]
    found = got(anisotropic.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0))
    assert found == {0: [(1, 10.0), (20, 3.0)], 20: [(0, 3.0), (1, 1.0)]}
    assert anisotropic.nearest(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 20 == 0).count() == 0
    assert anisotropic.nearest(spark.createDataFrame([(7, [1.0], "", 0)], SCHEMA), F.col("vec_id") % 20 == 0).count() == 0


def test_recall_on_whole_table(spark, middle):
    from evalloom.llm.queries import op1_nearest

    table = spark.read.parquet(f"{middle}/embeddings.parquet").toPandas()
    ids, x = table.vec_id.to_numpy(), np.array([*table.embedding], np.float64)
    found, hits, all_of = got(op1_nearest(spark, middle)), 0, 0
    for q in ids[ids % 20 == 0]:
        scores = x @ x[ids == q][0]
        order = np.lexsort((ids, -scores))
        want = [i for i in ids[order] if i != q][:20]
        hits, all_of = hits + len({*want} & {i for i, _ in found[q]}), all_of + 20
        assert len(found[q]) == 20
    assert hits / all_of >= 0.9


def test_centroids_weigh_parallel_errors_more():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(800, 32))
    plain, aware = anisotropic.Quantiser.fit(x), anisotropic.Quantiser.fit(x)

    def parallel(quantiser, refine):
        codes = quantiser.codes(x, refine)
        rest = x - np.take_along_axis(quantiser.centroids[None], codes[:, :, None, None], 2)[:, :, 0].reshape(x.shape)
        return ((rest * x).sum(axis=1) ** 2 / (x**2).sum(axis=1)).mean()

    assert parallel(aware, True) < parallel(plain, False)


def test_recall_on_full_blocks_of_uneven_lengths(spark, tmp_path):
    """Six blocks' worth of rows, of which OPEN a block are ranked exactly."""
    rng = np.random.default_rng(11)
    n, d = 6 * anisotropic.ROWS, 32
    x = rng.normal(size=(n, d)) * rng.lognormal(sigma=0.3, size=(n, 1))
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": pa.FixedSizeListArray.from_arrays(x.ravel(), d).cast(pa.list_(pa.float64()))}), tmp_path / "v.parquet")
    found, hits = got(anisotropic.nearest(spark.read.parquet(str(tmp_path / "v.parquet")), F.col("vec_id") % 1024 == 0)), 0
    asking = range(0, n, 1024)
    for q in asking:
        scores = x @ x[q]
        scores[q] = -np.inf
        hits += len({*np.argpartition(-scores, 20)[:20].tolist()} & {i for i, _ in found[q]})
    recall = hits / (20 * len(asking))
    print("recall", recall)
    assert recall >= 0.9
