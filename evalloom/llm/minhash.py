"""Near-duplicate documents by one-permutation MinHash, banded buckets and star-shaped candidate edges.

A document's set holds its distinct shingles of `width` words (2 unless the caller says otherwise), as 64-bit hashes; a text of fewer words is one shingle. One pass over a set keeps the least hash of each of BINS
bins; an empty bin takes the value of the first filled bin in an order of its own (optimal densification). Runs of ROWS
bins are bands, and equal bands put documents into one bucket. Documents of equal sets are one class, and only its smallest
id goes into buckets.

In each bucket one member is linked to all the others as a star. Each set has a sketch of PARITY bits, the parities of how many of its hashes fall on
each; two sets differ in as many hashes as their sketches in bits at least, so that most pairs are out by a few words' difference, and
the sets of all other pairs are compared in full. As a star can miss a link
between two of its points, buckets whose members are not all in one component are taken up again, with MORE times as many
centres each round, from outside the bucket's largest component, until each bucket is of one component or all members outside its largest one have been
centres: every pair of two components has such a member. Most buckets are done after the first star.

With 32 bands of 5 a pair of similarity 0.8 shares no bucket with a chance of 3 in a million; higher ones less.

Defined results: null and empty texts and those without words have empty sets and are linked with nothing; a row with a
null id is linked with nothing and kept, its component is null; rows with equal ids are one document, linked by any of its texts; other columns play no part;
an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import BASES, dropped, mixed, runs_hash, stored, text_slices, word_hash, words_of

BANDS, ROWS = 32, 5
BINS = BANDS * ROWS
#: Sets that a task has signatures of at once.
SETS = 1024
#: Bytes of text in the pairs that a task compares at once.
PAIR_BYTES = 2 << 20
#: Times as many centres a bucket in each round.
MORE = 64
PARITY = 1024
#: Words in a shingle, by op2's contract.
WIDTH = 2
SALTS = 8
#: Entries of a bucket that meet its centres in one task, about.
DEALT = 256
PERCENT = 80
_U = np.uint64

with np.errstate(over="ignore"):
    #: For each bin, all bins in the order in which it borrows from them.
    _ORDER = np.argsort(mixed(np.arange(BINS * BINS, dtype=_U) * _U(BASES[0])).reshape(BINS, BINS), axis=1)


def shingle_sets(column: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, one text after the other, and the bounds of each text's part."""
    words = words_of(column, lower=True)
    hashes, counts = word_hash(words), np.diff(words.bounds)
    runs = runs_hash(hashes, width)
    text = np.repeat(np.arange(len(column)), counts)
    inside = text[: len(runs)] == text[width - 1 :] if len(runs) else np.zeros(0, bool)
    short = np.flatnonzero((counts > 0) & (counts < width))
    alone = [runs_hash(hashes[words.bounds[d] : words.bounds[d + 1]], int(counts[d]), BASES[0])[0] for d in short]
    values = np.concatenate([runs[inside], np.array(alone, _U)])
    text = np.concatenate([text[: len(runs)][inside], short])
    order = np.lexsort((values, text))
    values, text = values[order], text[order]
    first = np.ones(len(values), bool)
    first[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
    values, text = values[first], text[first]
    return values, np.searchsorted(text, np.arange(len(column) + 1))


def signatures(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One row of BINS values for each set; sets must not be empty."""
    n = len(bounds) - 1
    text = np.repeat(np.arange(n), np.diff(bounds))
    bins = ((values >> _U(32)) * _U(BINS) >> _U(32)).astype(np.int64)
    first = np.ones(len(values), bool)
    first[1:] = (bins[1:] != bins[:-1]) | (text[1:] != text[:-1])
    found, filled = np.zeros((n, BINS), _U), np.zeros((n, BINS), bool)
    found[text[first], bins[first]] = values[first]
    filled[text[first], bins[first]] = True
    open_rows = np.flatnonzero(~filled.all(axis=1))
    given, have = found[open_rows], filled[open_rows]
    full, done = given.copy(), have.copy()
    for donors in _ORDER.T:
        take = have[:, donors] & ~done
        full[take] = given[:, donors][take]
        done |= take
        if done.all():
            break
    found[open_rows] = full
    return found


def parities(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """PARITY bits of each set, 64 to a number: the exclusive or of the bits that its hashes stand for."""
    n, words = len(bounds) - 1, PARITY // 64
    found = np.zeros(n * words, _U)
    if len(values):
        place = np.repeat(np.arange(n), np.diff(bounds)) * words + (values >> _U(64 - (words - 1).bit_length())).astype(np.int64)
        first = np.flatnonzero(np.diff(place, prepend=-1))
        found[place[first]] = np.bitwise_xor.reduceat(_U(1) << (values >> _U(64 - (PARITY - 1).bit_length()) & _U(63)), first)
    return found.reshape(n, words)


def maybe_linked(n: Column, m: Column, a: Column, b: Column) -> Column:
    """False only if sets of n and m hashes with the sketches a and b are surely not linked."""
    apart = F.lit(0)
    for k in range(PARITY // 64):
        apart = apart + F.bit_count(a[k].bitwiseXOR(b[k]))
    return (100 + PERCENT) * apart <= (100 - PERCENT) * (n + m)


def bands(rows: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        key = np.repeat(np.arange(BANDS, dtype=_U)[None], len(rows), axis=0)
        for k in range(ROWS):
            key = mixed(key * _U(BASES[1]) + rows[:, k::ROWS])
        return key


def _sketch(rows: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        texts = batch.column(1)
        for lo, hi in text_slices(texts):
            values, bounds = shingle_sets(texts.slice(lo, hi - lo), width)
            sizes = np.diff(bounds)
            some = np.flatnonzero(sizes)
            keys = np.zeros((hi - lo, BANDS), np.int64)
            one, two = np.zeros(hi - lo, np.int64), np.zeros(hi - lo, np.int64)
            for at in range(0, len(some), SETS):
                part = some[at : at + SETS]
                first, last = bounds[part[0]], bounds[part[-1] + 1]
                keys[part] = bands(signatures(values[first:last], np.append(bounds[part], last) - first)).view(np.int64)
            if len(some):
                one[some] = np.add.reduceat(mixed(values), bounds[some]).view(np.int64)
                two[some] = np.add.reduceat(mixed(values ^ _U(BASES[0])), bounds[some]).view(np.int64)
            lists = pa.ListArray.from_arrays(np.arange(hi - lo + 1, dtype=np.int32) * BANDS, keys.ravel())
            words = PARITY // 64
            bits = pa.ListArray.from_arrays(np.arange(hi - lo + 1, dtype=np.int32) * words, parities(values, bounds).view(np.int64).ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(sizes.astype(np.int64)), pa.array(one), pa.array(two), lists, bits], ["doc_id", "n_shingles", "one", "two", "bands", "bits"])


def _compare(rows: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Keeps the pairs (a, b, text_a, text_b) that are linked."""
    for batch in rows:
        sizes = np.cumsum(sum(pc.binary_length(batch.column(k)).to_numpy(zero_copy_only=False).astype(np.int64) for k in (2, 3)))
        cuts = np.flatnonzero(np.diff(sizes // PAIR_BYTES, prepend=0)).tolist()
        for at, to in pairwise(dict.fromkeys([0, *cuts, len(batch)])):
            part = batch.slice(at, to - at)
            left, right = (part.column(k).cast(pa.large_string()).cast(pa.string()) for k in (2, 3))
            (x, xs), (y, ys) = shingle_sets(left, width), shingle_sets(right, width)
            keep = []
            for k in range(len(part)):
                p, q = x[xs[k] : xs[k + 1]], y[ys[k] : ys[k + 1]]
                both = len(np.intersect1d(p, q, assume_unique=True))
                if both and 100 * both >= PERCENT * (len(p) + len(q) - both):
                    keep.append(k)
            yield pa.RecordBatch.from_arrays([part.column(k).take(pa.array(keep, pa.int32())) for k in (0, 1)], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for all nodes of edges (a, b): labels of neighbours and of labels are taken over while one gets smaller."""
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        moved = labels.join(near, "node").select("node", F.least("component", "near").alias("new"), F.col("component").alias("old"))
        of = moved.select(F.col("node").alias("new"), F.col("new").alias("further"))
        moved = stored(moved.join(of, "new", "left").select("node", F.least("new", "further").alias("component"), "old"), "labels")
        dropped(labels)
        labels = moved.select("node", "component")
        if moved.where("component <> old").isEmpty():
            dropped(both)
            return labels


def _everywhere(buckets: DataFrame) -> DataFrame:
    """A row of (bucket, parts) for each part of its bucket: the entries of a large bucket are dealt to several tasks."""
    return buckets.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")


def near_duplicates(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of (doc_id, text), by shingles of so many words."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sketch = stored(docs.mapInArrow(lambda rows: _sketch(rows, width), "doc_id long, n_shingles long, one long, two long, bands array<long>, bits array<long>"), "sketch")
    named = sketch.where("doc_id IS NOT NULL AND n_shingles > 0")
    same = ["one", "two", "n_shingles"]
    classes = named.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
    classes = stored(classes.where("n > 1").select(*same, "rep", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")), "classes")
    of = named.withColumn("salt", F.pmod("doc_id", F.lit(SALTS)).cast("int")).join(classes, [*same, "salt"], "left")
    alone = F.col("rep").isNull() | (F.col("rep") == F.col("doc_id"))
    of = stored(of.select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep"), "one", *(F.when(alone, F.col(c)).alias(c) for c in ("bands", "bits"))), "representatives")
    dropped(classes)

    members = of.where("bands IS NOT NULL").select("rep", "one", "n_shingles", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket", F.ceil(F.col("n") / DEALT).cast("int").alias("parts"))
    sketches = of.where("bands IS NOT NULL").select("rep", "one", "bits").dropDuplicates(["rep", "one"])  # only few bucket entries are left to be given them
    dealt = F.pmod(F.xxhash64("rep", "one"), F.col("parts")).cast("int").alias("part")
    members = members.join(shared, "bucket").join(sketches, ["rep", "one"])
    members = stored(members.select("bucket", "parts", dealt, "rep", "n_shingles", "bits", F.col("rep").alias("component")), "members")
    wanted = members.select(F.col("rep").alias("doc_id")).distinct()
    texts = stored(docs.join(wanted, "doc_id", "left_semi").distinct(), "texts")

    # Classes that one id's texts are in are linked by it.
    several = of.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("most")).where("a <> most").select("doc_id", "a")
    links = stored(of.select("doc_id", F.col("rep").alias("b")).join(several, "doc_id").where("a <> b").select("a", "b").distinct(), "links")
    tested, centres = None, 1
    labels = None if links.isEmpty() else components(links)
    first = True
    while not members.isEmpty():
        if first:
            chosen = members.groupBy("bucket", "parts").agg(F.min(F.struct("rep", "n_shingles", "bits")).alias("centre")).select("bucket", "parts", F.col("centre.rep").alias("its"), "centre")
        else:
            sizes = members.groupBy("bucket", "parts", "component").agg(F.count("*").alias("n"))
            largest = sizes.groupBy("bucket", "parts").agg(F.max(F.struct("n", "component"))["component"].alias("largest"), (F.sum("n") - F.max("n")).alias("others"))
            others = members.join(_everywhere(largest), ["bucket", "part"]).where("component <> largest")
            others = others.where(F.pmod(F.xxhash64("rep"), F.ceil(F.col("others") / centres)) == 0)
            chosen = others.select("bucket", "parts", F.col("component").alias("its"), F.struct("rep", "n_shingles", "bits").alias("centre"))
        chosen, first = stored(chosen, "centres"), False
        pairs = members.join(_everywhere(chosen), ["bucket", "part"]).where("component <> its")
        pairs = pairs.where(maybe_linked(F.col("n_shingles"), F.col("centre.n_shingles"), F.col("bits"), F.col("centre.bits")))
        pairs = pairs.where(100 * F.least("n_shingles", "centre.n_shingles") >= PERCENT * F.greatest("n_shingles", "centre.n_shingles"))
        pairs = pairs.select(F.least("rep", "centre.rep").alias("a"), F.greatest("rep", "centre.rep").alias("b")).distinct()
        pairs = stored(pairs.join(tested, ["a", "b"], "left_anti") if tested is not None else pairs, "pairs")
        tested = pairs if tested is None else tested.union(pairs)
        one, two = (texts.select(F.col("doc_id").alias(k), F.col("text").alias(f"text_{k}")) for k in "ab")
        found = pairs.join(two, "b").join(one, "a").select("a", "b", "text_a", "text_b")
        found = stored(found.mapInArrow(lambda rows: _compare(rows, width), "a long, b long"), "links")
        links = links.union(found)
        if labels is not None:
            dropped(labels)
        labels = components(links)
        now = members.join(chosen.select("bucket", F.col("centre.rep").alias("rep")), ["bucket", "rep"], "left_anti").drop("component")
        now = now.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        mixed_buckets = now.groupBy("bucket", "parts").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("bucket", "parts")
        left = stored(now.join(_everywhere(mixed_buckets), ["bucket", "part"]).select("bucket", "parts", "part", "rep", "n_shingles", "bits", "component"), "members")
        dropped(members, chosen)
        members = left
        centres *= MORE
    dropped(members, texts)

    result = of.select("doc_id", "rep").distinct()
    if labels is not None:
        result = result.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
        result = result.select("doc_id", F.coalesce("component", "rep").alias("component_id"))
    else:
        result = result.select("doc_id", F.col("rep").alias("component_id"))
    result = result.groupBy(F.col("doc_id").alias("its_id")).agg(F.min("component_id").alias("found"))
    rows = sketch.select("doc_id", "n_shingles").join(result, F.col("doc_id") == F.col("its_id"), "left")
    component = F.coalesce("found", "doc_id")
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
