"""Toxicity from class-conditional Kneser-Ney models.

Two bigram models, of toxic and of ordinary documents, back off to models of single words by continuation counts (after how many different words
a word comes), so that copies of a text count once. A count is discounted by what the other class leads to
expect and by some standard errors of the difference: what is left is a class's own, and everything else goes to one backoff that both classes
share, so that rare and evenly spread expressions count the same in either. The difference of the two log-likelihoods of
a text, over its number of words, becomes a probability by a logistic curve. Curve and discount are fitted to documents that were scored
by models of the other half of the sample, and weighted to the share of toxic labels.

The models are fitted on at most SAMPLE labelled documents a class, chosen by a hash of the id, and on at most PER_RARER times as many of
one class as the other has: numbers of different contexts do not grow with the text in proportion, so that models of
unequal sizes differ by more than their words. Labels are counted over all rows. Only what has something of its own under the least discount, with its context
and its word, is brought to the driver: anything else has the same chance in both models but for the backoff's share. Words are runs between white space and ASCII punctuation, A-Z as a-z; a document counts once for a pair of words.

Defined results: null and empty texts have a difference of 0 and the curve's value there; a row with a null id is not held out; a document with several labels
is toxic if one of them is; without labels of both classes all scores are 0; repeated rows get equal scores; other columns
play no part; an empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import PUNCTUATION, mixed, stored, text_slices, word_hash, words_of

SAMPLE = 4000
#: Documents of the commoner class for each of the rarer one.
PER_RARER = 1.0
#: Standard errors of a discount; those with the best cross-fitted likelihood are taken.
ERRORS = (2.0, 3.0, 4.0, 5.0, 6.0)
REJECT = 0.3
RESULT = "doc_id long, held_out boolean, score double, predicted int"
_U = np.uint64
_START = _U(0x5851F42D4C957F2D)
_HALVES = (0, 1)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _pairs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word's hash, that of the word before it, and the bounds of texts."""
    words = words_of(texts, lower=True, between=PUNCTUATION)
    hashes = word_hash(words)
    before = np.concatenate([[_START], hashes[:-1]]).astype(_U) if len(hashes) else hashes
    starts = words.bounds[:-1][np.diff(words.bounds) > 0]
    before[starts] = _START
    return hashes, before, words.bounds


def _pair_key(before: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(before * _U(0x9E3779B97F4A7C15) + hashes)


def _own(counts: np.ndarray, totals: np.ndarray, errors: float) -> np.ndarray:
    """Of the counts of both classes what each has beyond the other's rate and so many standard errors."""
    rate = totals / np.maximum(totals[::-1], 1)
    expected = counts[:, ::-1] * rate
    return np.maximum(counts - expected - errors * np.sqrt(counts + rate**2 * (counts[:, ::-1] + 1) + 1), 0)


def _may_own(counts: list[Column], totals: np.ndarray) -> Column:
    """False only if neither class has anything of its own (see _own) under the least discount."""
    rate = (totals / np.maximum(totals[::-1], 1)).tolist()

    def own(k: int) -> Column:
        mine, other = counts[k], counts[1 - k]
        return mine - other * rate[k] - ERRORS[0] * F.sqrt(mine + rate[k] ** 2 * (other + 1) + 1) > -1e-6

    return own(0) | own(1)


class Model(NamedTuple):
    """Sorted hashes with what each stands for; columns are ordinary and toxic. Pairs, contexts and words that are not here have nothing of their own."""

    pairs: np.ndarray
    pair_chances: np.ndarray
    contexts: np.ndarray
    context_rest: np.ndarray
    words: np.ndarray
    word_chances: np.ndarray
    rest: np.ndarray

    @classmethod
    def of(cls, pairs, contexts, words, totals, errors: float) -> Model:
        """pairs: (before, word, counts); contexts: (before, sums of counts over all pairs, those not given included), of each context in pairs; words: (word, continuations), of each word in pairs and of those with something of their own; totals: sums of counts and of continuations over all, those not given included."""
        own = _own(pairs[2], totals[0], errors)
        some = own.max(axis=1, initial=0) > 0
        by = np.argsort(contexts[0])
        contexts, size = contexts[0][by], np.maximum(contexts[1][by], 1)
        place = np.searchsorted(contexts, pairs[0])
        kept = np.zeros((len(contexts), 2))
        np.add.at(kept, place, own)
        used = kept.max(axis=1, initial=0) > 0
        key = _pair_key(pairs[0][some], pairs[1][some])
        order = np.argsort(key)
        own_words = _own(words[1], totals[1], errors)
        rest = 1 - own_words.sum(axis=0) / np.maximum(totals[1], 1)
        shared = (words[1] - own_words).sum(axis=1) + 0.5
        chances = own_words / np.maximum(totals[1], 1) + rest * (shared / max(1, totals[1].sum() - own_words.sum()))[:, None]
        by = np.argsort(words[0])
        return cls(key[order], (own / size[place])[some][order], contexts[used], (1 - kept / size)[used], words[0][by], chances[by], rest)

    def differences(self, hashes: np.ndarray, before: np.ndarray) -> np.ndarray:
        """For each word the logarithm of its chance in toxic over that in ordinary documents."""
        known, at = _place(self.words, hashes)
        chance = np.where(known[:, None], self.word_chances[at], self.rest * 1e-9) if len(self.words) else np.ones((len(hashes), 2))
        known, at = _place(self.contexts, before)
        if len(self.contexts):
            chance = np.where(known[:, None], self.context_rest[at], 1.0) * chance
            known, at = _place(self.pairs, _pair_key(before, hashes))
            chance = chance + np.where(known[:, None], self.pair_chances[at], 0.0)
        logs = np.log(np.maximum(chance, 1e-300))
        return logs[:, 1] - logs[:, 0]

    def of_texts(self, texts: pa.Array) -> np.ndarray:
        hashes, before, bounds = _pairs(texts)
        sums = np.concatenate([[0], np.cumsum(self.differences(hashes, before))])
        return (sums[bounds[1:]] - sums[bounds[:-1]]) / np.maximum(1, np.diff(bounds))


def _place(names: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(names):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(names, wanted), len(names) - 1)
    return names[at] == wanted, at


def _count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of words with how often each class and half of the sample has them."""
    for batch in rows:
        cell = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64) * 2 + batch.column(2).to_numpy(zero_copy_only=False)
        for lo, hi in text_slices(batch.column(0)):
            hashes, before, bounds = _pairs(batch.column(0).slice(lo, hi - lo))
            counts = np.diff(bounds)
            text, cells = np.repeat(np.arange(hi - lo), counts), np.repeat(cell[lo:hi], counts)
            order = np.lexsort((text, hashes, before))
            hashes, before, cells, text = hashes[order], before[order], cells[order], text[order]
            once = np.ones(len(hashes), bool)
            once[1:] = (hashes[1:] != hashes[:-1]) | (before[1:] != before[:-1]) | (text[1:] != text[:-1])
            hashes, before, cells = hashes[once], before[once], cells[once]
            first = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (before[1:] != before[:-1])])) if len(hashes) else []
            if len(first):
                counts = [np.add.reduceat((cells == c).astype(np.int64), first) for c in range(4)]
                yield pa.RecordBatch.from_arrays([pa.array(before[first].view(np.int64)), pa.array(hashes[first].view(np.int64)), *map(pa.array, counts)], ["v", "w", "c0", "c1", "c2", "c3"])


def _curve(values: np.ndarray, toxic: np.ndarray, share: float) -> tuple[float, float, float]:
    """Loss, slope and intercept of the logistic curve, by Newton's method, with the classes weighted to the share."""
    weights = np.where(toxic == 1, share / max(1, (toxic == 1).sum()), (1 - share) / max(1, (toxic == 0).sum())) * len(toxic)
    scale = max(values.std(), 1e-9)
    x = np.column_stack([values / scale, np.ones(len(values))])
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weights * (toxic - p)) - 1e-3 * beta
        curve = (x * (weights * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        beta += step
        if abs(step).max() < 1e-9:
            break
    p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
    return float(-(weights * np.log(np.where(toxic == 1, p, 1 - p))).sum()), beta[0] / scale, beta[1]


def _seen(toxic: int, halves: tuple[int, ...]) -> str:
    """The name of the column with the contexts that a class's documents, of a half or of both, have."""
    return f"n{toxic}" if len(halves) > 1 else f"n{toxic}{halves[0]}"


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, per_rarer: float = PER_RARER) -> tuple[Model, float, float] | None:
    """The model, slope and intercept from (doc_id, text) and (doc_id, toxic); rows that are held out teach nothing."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    share = known.agg(F.avg("toxic")).first()[0]
    if not share or share == 1:
        return None
    rarer = known.groupBy("toxic").agg(F.count("*").alias("n")).agg(F.min("n")).first()[0]
    sample = min(sample, math.ceil(rarer * per_rarer))
    chosen = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for c in (0, 1)]
    chosen = chosen[0].union(chosen[1]).withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int"))
    texts = docs.join(F.broadcast(chosen), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), "toxic", "half")  # at most two rows a sampled document
    texts = stored(texts, "labelled")
    cells = ["c0", "c1", "c2", "c3"]
    pairs = texts.mapInArrow(_count, "v long, w long, " + ", ".join(f"{c} long" for c in cells)).groupBy("v", "w").agg(*(F.sum(c).alias(c) for c in cells))
    pairs = stored(pairs, "pairs")
    seen = {_seen(k, (h,)): f"c{2 * k + h} > 0" for k in (0, 1) for h in _HALVES} | {_seen(k, _HALVES): f"c{2 * k} + c{2 * k + 1} > 0" for k in (0, 1)}
    follow = pairs.groupBy("w").agg(*(F.count_if(F.expr(x)).alias(n) for n, x in seen.items()))
    sums = {**pairs.agg(*(F.sum(c).alias(c) for c in cells)).first().asDict(), **follow.agg(*(F.sum(n).alias(n) for n in seen)).first().asDict()}
    parts = ((0,), (1,), _HALVES)
    totals = {p: [np.array([sum(sums[f"c{2 * k + h}"] or 0 for h in p) for k in (0, 1)], np.float64), np.array([sums[_seen(k, p)] or 0 for k in (0, 1)], np.float64)] for p in parts}
    kept = stored(pairs.where(reduce(Column.__or__, (_may_own([sum(F.col(f"c{2 * k + h}") for h in p) for k in (0, 1)], totals[p][0]) for p in parts))), "kept")
    around = pairs.join(kept.select("v").distinct(), "v", "left_semi").groupBy("v").agg(*(F.sum(c).alias(c) for c in cells)).toPandas()
    apart = reduce(Column.__or__, (_may_own([F.col(_seen(k, p)) for k in (0, 1)], totals[p][1]) for p in parts))
    words = follow.where(apart).union(follow.join(kept.select("w").distinct(), "w", "left_semi")).distinct().toPandas()
    kept = kept.toPandas()

    def model(halves: tuple[int, ...], errors: float) -> Model:
        def counts(of):
            return np.column_stack([sum(of[f"c{2 * k + h}"] for h in halves) for k in (0, 1)]).astype(np.float64)

        names = [t[c].to_numpy().view(_U) for t, c in ((kept, "v"), (kept, "w"), (around, "v"), (words, "w"))]
        continuations = np.column_stack([words[_seen(k, halves)] for k in (0, 1)]).astype(np.float64)
        return Model.of((names[0], names[1], counts(kept)), (names[2], counts(around)), (names[3], continuations), totals[halves], errors)

    halves = texts.sparkSession.sparkContext.broadcast([[model((h,), e) for h in _HALVES] for e in ERRORS])

    def cross(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            half = batch.column(2).to_numpy(zero_copy_only=False)
            for lo, hi in text_slices(batch.column(0)):
                part = batch.column(0).slice(lo, hi - lo)
                found = [pa.array(np.where(half[lo:hi] == 0, other.of_texts(part), one.of_texts(part))) for one, other in halves.value]
                yield pa.RecordBatch.from_arrays([*found, batch.column(1).slice(lo, hi - lo)], [*names, "toxic"])

    names = [f"x{k}" for k in range(len(ERRORS))]
    found = texts.mapInArrow(cross, ", ".join(f"{n} double" for n in names) + ", toxic int").toPandas()  # a row a sampled document
    halves.unpersist()
    if found["toxic"].nunique() < 2:
        return None
    curves = [_curve(found[n].to_numpy(), found["toxic"].to_numpy(), share) for n in names]
    best = min(range(len(curves)), key=lambda k: curves[k][0])
    return model(_HALVES, ERRORS[best]), *curves[best][1:]


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, reject: float = REJECT, per_rarer: float = PER_RARER) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of (doc_id, text)."""
    return rated(docs.select("doc_id", "text"), docs, labels, sample, reject, per_rarer).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def rated(rows: DataFrame, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, reject: float = REJECT, per_rarer: float = PER_RARER) -> DataFrame:
    """rows with score and predicted added, by a model of docs and labels; columns of these names are replaced."""
    fitted = fit(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), sample, per_rarer)
    if fitted is None:
        return rows.withColumns({"score": F.lit(0.0), "predicted": F.lit(0)})
    model, slope, intercept = rows.sparkSession.sparkContext.broadcast(fitted[0]), fitted[1], fitted[2]

    @F.arrow_udf("double")
    def chance(column: pa.Array) -> pa.Array:
        column = column.fill_null("")
        found = [np.zeros(0), *(model.value.of_texts(column.slice(lo, hi - lo)) for lo, hi in text_slices(column))]
        return pa.array(1 / (1 + np.exp(-(slope * np.concatenate(found) + intercept))))

    return rows.withColumn("score", chance(F.col("text").cast("string"))).withColumn("predicted", (F.col("score") >= reject).cast("int"))

