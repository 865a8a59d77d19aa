"""Nearest neighbours by inner product: score-aware anisotropic quantisation, four-bit table scans and exact reranking.

A vector is cut into pairs of components, and each pair is one of 16 centroids, four bits. Codes and centroids minimise an error that counts
the residual along the vector ETA times as much as that across it, as only the former moves the scores of its nearest
queries. For a query, tables hold its products with all centroids, those of two pairs joined, so that a byte of a code is
one look-up. Of each block of rows the best OPEN by table sums are ranked again by the exact product, in double precision.

Centroids are fitted on SAMPLE vectors at most, chosen by a hash of the id; every vector is coded and scanned. Equal vectors are one entry of the
index, with as many of their smallest ids as a result can hold. Query blocks meet row blocks in a join on both their numbers; every such
task has a bounded share of either.

Defined results: vectors that are null, zero, of a length other than the most common one (of equally common the least), or that hold a null or a non-finite
component take no part, neither do null ids; ties go to the smaller id; rows with equal id and vector are one candidate, and
a query's own id is none; other columns play no part; an empty table gives an empty one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLE = 8192
ROUNDS = 4
#: Scores from this share of the largest possible one on matter.
THRESHOLD = 0.2
#: A query block is as large as memory lets it be: rows are sent to each of these.
ROWS, QUERIES, STEP = 16384, 8192, 128
OPEN = 256
SALTS = 32
RESULT = "query_id long, vec_id long, score double"


class Quantiser:
    """centroids[m, c] is the c-th pair of components that the m-th pair of a vector can be."""

    def __init__(self, centroids: np.ndarray, eta: float):
        self.centroids, self.eta = centroids, eta

    @staticmethod
    def padded(vectors: np.ndarray) -> np.ndarray:
        """With zeros to a multiple of four components, so that codes are whole bytes."""
        return np.pad(vectors, ((0, 0), (0, -vectors.shape[1] % 4)))

    @classmethod
    def fit(cls, vectors: np.ndarray) -> Quantiser:
        vectors = cls.padded(vectors)
        n, d = vectors.shape
        eta = max(1.0, (d - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))
        parts = vectors.reshape(n, d // 2, 2)
        pick = np.linspace(0, n - 1, 16).round().astype(int)
        self = cls(parts[pick].transpose(1, 0, 2).copy(), eta)
        for round_ in range(2 * ROUNDS):
            codes = self.codes(vectors, refine=round_ >= ROUNDS)
            one_hot = codes[:, :, None] == np.arange(16)
            if round_ < ROUNDS:  # first plain means, then the weighted error
                sums = np.einsum("nmc,nmk->mck", one_hot.astype(np.float64), parts)
                counts = one_hot.sum(axis=0)
                self.centroids = np.where(counts[..., None] > 0, sums / np.maximum(counts, 1)[..., None], self.centroids)
            else:
                self._solve(parts, codes)
        return self

    def _solve(self, parts: np.ndarray, codes: np.ndarray) -> None:
        """The centroids that minimise the weighted error of given codes: one linear system."""
        n, m, _ = parts.shape
        size = m * 32
        lengths = np.sqrt((parts**2).sum(axis=(1, 2), keepdims=True))
        unit = parts / np.maximum(lengths, 1e-300)
        place = (np.arange(m)[None] * 16 + codes)[:, :, None] * 2 + np.arange(2)
        left, right = np.zeros((size, size)), np.zeros(size)
        for at in range(0, n, 1024):
            z = np.zeros((min(1024, n - at), size))
            np.put_along_axis(z, place[at : at + 1024].reshape(len(z), -1), unit[at : at + 1024].reshape(len(z), -1), axis=1)
            left += (self.eta - 1) * (z.T @ z)
        np.add.at(right, place.ravel(), (self.eta * parts).ravel())
        counts = np.bincount(place.ravel(), minlength=size)
        old = self.centroids.reshape(-1)
        left[np.arange(size), np.arange(size)] += counts + 1e-6
        self.centroids = np.linalg.solve(left, right + 1e-6 * old).reshape(self.centroids.shape)

    def codes(self, vectors: np.ndarray, refine: bool = True) -> np.ndarray:
        """The number of the chosen centroid of each pair; refine: choose again, pair by pair, by the weighted error of the whole."""
        parts = self.padded(vectors).reshape(len(vectors), -1, 2)
        rest = parts[:, :, None] - self.centroids[None]
        error = (rest**2).sum(axis=-1)
        codes = error.argmin(axis=2)
        if refine and len(vectors):
            unit = parts / np.maximum(np.sqrt((parts**2).sum(axis=(1, 2), keepdims=True)), 1e-300)
            along = (rest * unit[:, :, None]).sum(axis=-1)
            total = np.take_along_axis(along, codes[:, :, None], 2).sum(axis=(1, 2))
            for _ in range(2):
                for m in range(parts.shape[1]):
                    others = total - along[np.arange(len(parts)), m, codes[:, m]]
                    codes[:, m] = (error[:, m] + (self.eta - 1) * (others[:, None] + along[:, m]) ** 2).argmin(axis=1)
                    total = others + along[np.arange(len(parts)), m, codes[:, m]]
        return codes

    def packed(self, vectors: np.ndarray) -> np.ndarray:
        codes = [self.codes(vectors[at : at + 1024]) for at in range(0, len(vectors), 1024)]
        codes = np.concatenate(codes).astype(np.uint8)
        return codes[:, ::2] | codes[:, 1::2] << 4

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """For each byte of a code and each of its values, the sum of its two products with each query."""
        products = np.einsum("qmk,mck->mcq", self.padded(queries).reshape(len(queries), -1, 2), self.centroids)
        low, high = products[::2], products[1::2]
        return (high[:, :, None] + low[:, None]).reshape(len(low), 256, len(queries)).astype(np.float32)


def scan(quantiser: Quantiser, queries: np.ndarray, codes: np.ndarray, most: int = OPEN) -> list[np.ndarray]:
    """For each query the rows with the `most` largest table sums, and those that tie with the last."""
    tables = quantiser.tables(queries)
    sums = np.empty((len(codes), len(queries)), np.float32)
    for at in range(0, len(codes), 512):
        part = sums[at : at + 512]
        np.take(tables[0], codes[at : at + 512, 0], axis=0, out=part)
        for k in range(1, len(tables)):
            part += tables[k][codes[at : at + 512, k]]
    if len(codes) <= most:
        return [np.arange(len(codes))] * len(queries)
    found = []
    for row in np.ascontiguousarray(sums.T):
        least = np.partition(row, len(row) - most)[len(row) - most]
        found.append(np.flatnonzero(row >= least))
    return found


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def nearest(vectors: DataFrame, is_query, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest inner product found for each row where the condition is_query holds."""
    whole = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"), is_query.alias("asks"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = whole.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists("v", lambda x: x != 0))
    widths = whole.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "width").first()
    width = widths["width"] if widths else 4
    whole = whole.where(F.size("v") == width)

    # Equal vectors: the smallest ids of each, first by part of the ids, and one vector for all of them.
    narrow = whole.select("vec_id", F.xxhash64("v").alias("one"), F.xxhash64(F.lit(1), "v").alias("two"), F.pmod("vec_id", F.lit(SALTS)).alias("salt")).distinct()
    for keys in (["one", "two", "salt"], ["one", "two"]):
        narrow = narrow.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy("vec_id"))).where(F.col("k") <= k + 1).drop("k")
    entries = narrow.groupBy("one", "two").agg(F.min("vec_id").alias("vec_id"), F.sort_array(F.collect_list("vec_id")).alias("ids")).select("vec_id", "ids", "one")
    index = whole.select("vec_id", "v", F.xxhash64("v").alias("one")).dropDuplicates(["vec_id", "one"]).join(entries, ["vec_id", "one"]).drop("one")

    sample = whole.select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toPandas()["v"]
    fitted = Quantiser.fit(np.array([*sample], np.float64).reshape(-1, width)) if len(sample) else Quantiser(np.zeros((2, 16, 2)), 1.0)
    counts = whole.agg(F.count("*").alias("n"), F.sum(F.col("asks").cast("long")).alias("asking")).first()
    row_blocks, query_blocks = max(1, math.ceil(counts["n"] / ROWS)), max(1, math.ceil((counts["asking"] or 0) / QUERIES))

    def code(batches):
        for batch in batches:
            found = fitted.packed(_matrix(batch.column(1), width)) if len(batch) else np.zeros((0, 1), np.uint8)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x.tobytes() for x in found], pa.binary())], [*batch.schema.names, "code"])

    def rank(key: tuple[pa.Scalar, ...], rows: pa.Table, queries: pa.Table) -> pa.Table:
        found = ([], [], [])
        if rows.num_rows and queries.num_rows:
            x, q = _matrix(rows.column("v"), width), _matrix(queries.column("v"), width)
            codes = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(len(x), -1)
            ids, own = rows.column("ids").to_pylist(), queries.column("vec_id").to_pylist()
            for at in range(0, len(q), STEP):
                for j, open_rows in enumerate(scan(fitted, q[at : at + STEP], codes)):
                    exact = (x[open_rows] * q[at + j]).sum(axis=1)
                    least = np.partition(exact, len(exact) - k - 1)[len(exact) - k - 1] if len(exact) > k + 1 else -np.inf
                    best = sorted((-exact[i], one) for i in np.flatnonzero(exact >= least) for one in ids[open_rows[i]] if one != own[at + j])[:k]
                    for values, new in zip(found, ([own[at + j]] * len(best), [one for _, one in best], [-s for s, _ in best]), strict=True):
                        values += new
        return pa.table({"query_id": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.float64())})

    coded = index.mapInArrow(code, "vec_id long, v array<double>, ids array<long>, code binary")
    coded = coded.withColumn("rb", F.pmod(F.xxhash64("vec_id"), F.lit(row_blocks))).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    asking = whole.where("asks").select("vec_id", "v").distinct().withColumn("qb", F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int"))
    asking = asking.withColumn("rb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(row_blocks - 1).cast("long"))))
    near = coded.groupBy("rb", "qb").cogroup(asking.groupBy("rb", "qb")).applyInArrow(rank, RESULT)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    near = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
