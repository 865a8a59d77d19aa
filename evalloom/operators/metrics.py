"""Metrics over prediction rows. Every function takes a frame and the columns of a group, and gives one row a group."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def harmonic(a: Column, b: Column) -> Column:
    return ratio(2 * a * b, a + b)


def f_half(precision: Column, recall: Column) -> Column:
    return ratio(1.25 * precision * recall, 0.25 * precision + recall)


def confusion(rows: DataFrame, positive: str, by: Sequence[str] = (), label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(by, tp, fp, fn, tn)."""
    is_, said = F.col(label) == positive, F.col(prediction) == positive
    return rows.groupBy(*by).agg(*(F.count_if(c).alias(n) for n, c in (("tp", is_ & said), ("fp", ~is_ & said), ("fn", is_ & ~said), ("tn", ~is_ & ~said))))


def binary_scores(rows: DataFrame, positive: str, by: Sequence[str] = (), label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(by, accuracy, precision, recall, f1, fpr)."""
    c = confusion(rows, positive, by, label, prediction)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    c = c.select(*by, ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(fp, fp + tn).alias("fpr"))
    return c.select(*by, "accuracy", "precision", "recall", harmonic(F.col("precision"), F.col("recall")).alias("f1"), "fpr")


def macro_scores(rows: DataFrame, labels: Sequence[str], by: Sequence[str] = (), label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(by, macro_precision, macro_recall, macro_f1) over these labels, those that do not occur included; the last is of the two means."""
    is_, said = F.col(label), F.col(prediction)
    precisions = [ratio(F.count_if((is_ == x) & (said == x)), F.count_if(said == x)) for x in labels]
    recalls = [ratio(F.count_if((is_ == x) & (said == x)), F.count_if(is_ == x)) for x in labels]
    found = rows.groupBy(*by).agg((sum(precisions[1:], precisions[0]) / len(labels)).alias("macro_precision"), (sum(recalls[1:], recalls[0]) / len(labels)).alias("macro_recall"))
    return found.withColumn("macro_f1", harmonic(F.col("macro_precision"), F.col("macro_recall")))


def accuracy_by(rows: DataFrame, by: Sequence[str], label: str = "label", prediction: str = "prediction") -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"), ratio(F.count_if(F.col(label) == F.col(prediction)), F.count("*")).alias("accuracy"))


def row_matches(reference: str, hypothesis: str, most: int = 4, lower: bool = False) -> Column:
    """An array of (n, matches, reference_total, hypothesis_total) of two texts, n-grams of 1 to most words; lengths without n-grams are left out. Nothing is shuffled, and what a task holds is one batch of texts."""

    @F.pandas_udf("array<struct<n: int, matches: long, reference_total: long, hypothesis_total: long>>")
    def matches(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        """Of each length up to most: n-grams that both texts have, repeated ones as often as both have them, and each text's number of them."""
        for references, hypotheses, most in batches:
            found = []
            for a, b, top in zip(references, hypotheses, most, strict=True):
                x, y = (a or "").split(), (b or "").split()
                row = []
                for n in range(1, top + 1):
                    r, h = (Counter(zip(*(w[k:] for k in range(n)), strict=False)) for w in (x, y))
                    if r or h:
                        row.append({"n": n, "matches": sum(min(c, h[g]) for g, c in r.items() if g in h), "reference_total": r.total(), "hypothesis_total": h.total()})
                found.append(row)
            yield pd.Series(found, dtype=object)

    sides = [F.lower(c) if lower else F.col(c) for c in (reference, hypothesis)]
    return matches(*sides, F.lit(most))


def ngram_matches(rows: DataFrame, key: Sequence[str], reference: str, hypothesis: str, most: int = 4, lower: bool = False) -> DataFrame:
    """(key, n, matches, reference_total, hypothesis_total) for n-grams of 1 to most words; rows without n-grams of a length are left out. key names a row."""
    return rows.select(*key, F.inline(row_matches(reference, hypothesis, most, lower)))


def gleu(rows: DataFrame, key: Sequence[str], reference: str, hypothesis: str) -> DataFrame:
    """(key, gleu): matches of all 1- to 4-grams over the larger side's number of them; 0 without words. key names a row."""
    total = lambda c: F.aggregate(F.col("__m")[c], F.lit(0).cast("long"), lambda x, y: x + y)
    found = rows.select(*key, row_matches(reference, hypothesis).alias("__m"))
    return found.select(*key, ratio(total("matches"), F.greatest(total("reference_total"), total("hypothesis_total"))).alias("gleu"))


def geometric_gleu(rows: DataFrame, key: Sequence[str], reference: str, hypothesis: str) -> DataFrame:
    """(key, gleu): exp of a quarter of the sum of logarithms, a length by its own matches, lower-case; 0 if a length has none. key names a row."""
    share = lambda m: m["matches"].cast("double") / F.greatest(m["reference_total"], m["hypothesis_total"]).cast("double")
    found = rows.select(*key, row_matches(reference, hypothesis, lower=True).alias("__m"))
    logs = F.aggregate("__m", F.lit(0.0), lambda x, m: x + F.ln(share(m)))
    some = (F.size("__m") > 0) & F.forall("__m", lambda m: m["matches"] > 0)
    return found.select(*key, F.when(some, F.exp(logs / 4)).otherwise(0.0).alias("gleu"))


def correction_extent(rows: DataFrame, source: str, target: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, mean_jaccard, extent): 1 less the mean similarity of word pairs; 0 without rows."""
    j = T.jaccard(T.bigram_set(F.col(source)), T.bigram_set(F.col(target)))
    return rows.groupBy(*by).agg(F.coalesce(F.avg(j), F.lit(0.0)).alias("mean_jaccard"), F.coalesce(1 - F.avg(j), F.lit(0.0)).alias("extent"))


def pct_memorised(rows: DataFrame, a: str, b: str, by: Sequence[str] = (), above: float = 0.3) -> DataFrame:
    j = T.jaccard(T.bigram_set(F.col(a)), T.bigram_set(F.col(b)))
    return rows.groupBy(*by).agg(F.coalesce(F.avg((j > above).cast("double")), F.lit(0.0)).alias("pct_memorised"))


def edit_scores(rows: DataFrame, predicted: str = "predicted", gold: str = "gold", by: Sequence[str] = ()) -> DataFrame:
    """(by, tp, fp, fn, precision, recall, f05) over sets of edits (start, end, type) of each row."""
    p, g = F.array_distinct(predicted), F.array_distinct(gold)
    found = rows.groupBy(*by).agg(F.coalesce(F.sum(F.size(F.array_intersect(p, g))), F.lit(0)).alias("tp"), F.coalesce(F.sum(F.size(F.array_except(p, g))), F.lit(0)).alias("fp"), F.coalesce(F.sum(F.size(F.array_except(g, p))), F.lit(0)).alias("fn"))
    found = found.select(*by, "tp", "fp", "fn", ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"))
    return found.withColumn("f05", f_half(F.col("precision"), F.col("recall")))


def edit_type_scores(rows: DataFrame, key: Sequence[str], predicted: str = "predicted", gold: str = "gold", by: Sequence[str] = ()) -> DataFrame:
    """(by, tp, fp, fn, precision, recall, f05) over each row's numbers of edits by type."""
    sides = [rows.select(*by, *key, F.explode(F.col(c)["type"]).alias("type"), F.lit(k).alias("side")) for k, c in enumerate((predicted, gold))]
    n = sides[0].union(sides[1]).groupBy(*by, *key, "type").agg(F.count_if(F.col("side") == 0).alias("p"), F.count_if(F.col("side") == 1).alias("g"))
    return _mass(n, "p", "g", by)


def type_distribution_scores(rows: DataFrame, predicted: str = "predicted", gold: str = "gold", by: Sequence[str] = ()) -> DataFrame:
    """(by, tp, fp, fn, precision, recall, f05) over the shares of types that all rows together have."""
    sides = [rows.select(*by, F.explode(F.col(c)["type"]).alias("type"), F.lit(k).alias("side")) for k, c in enumerate((predicted, gold))]
    n = sides[0].union(sides[1]).groupBy(*by, "type").agg(F.count_if(F.col("side") == 0).alias("p"), F.count_if(F.col("side") == 1).alias("g"))
    all_of = Window.partitionBy(*by)  # some tens of types
    n = n.select(*by, *(ratio(F.col(c), F.sum(c).over(all_of)).alias(c) for c in ("p", "g")))
    return _mass(n, "p", "g", by)


def _mass(n: DataFrame, predicted: str, gold: str, by: Sequence[str] = ()) -> DataFrame:
    p, g, zero = F.col(predicted), F.col(gold), F.lit(0)
    sums = n.groupBy(*by).agg(*(F.coalesce(F.sum(x), zero).alias(k) for k, x in (("tp", F.least(p, g)), ("fp", F.greatest(p - g, zero)), ("fn", F.greatest(g - p, zero)))))
    sums = sums.select(*by, "tp", "fp", "fn", ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"))
    return sums.withColumn("f05", f_half(F.col("precision"), F.col("recall")))


def class_share(rows: DataFrame, label: str, positive: str) -> DataFrame:
    """(share) of the labelled rows that are positive; 0 without rows."""
    return rows.where(F.col(label).isNotNull()).agg(F.coalesce(F.avg((F.col(label) == positive).cast("double")), F.lit(0.0)).alias("share"))


def mean_edits(rows: DataFrame, edits: str = "predicted", by: Sequence[str] = ()) -> DataFrame:
    return rows.groupBy(*by).agg(F.coalesce(F.avg(F.size(edits)), F.lit(0.0)).alias("n_edits"))


def acceptability(rows: DataFrame, before: str, after: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, input, corrected, delta): means of two scores that a scorer gave."""
    a, b = F.coalesce(F.avg(before), F.lit(0.0)), F.coalesce(F.avg(after), F.lit(0.0))
    return rows.groupBy(*by).agg(a.alias("input"), b.alias("corrected"), (b - a).alias("delta"))


def tfidf_cosine(rows: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """(key, cosine) of aligned texts: counts times ln((1 + n) / (1 + df)) + 1, both sides in n; words are two or more word characters, lower-case."""

    def words(column: str, side: int) -> DataFrame:
        return rows.select(key, F.lit(side).alias("side"), F.explode(F.regexp_extract_all(F.lower(F.coalesce(column, F.lit(""))), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))).alias("w"))

    counts = words(a, 0).union(words(b, 1)).groupBy(key, "side", "w").agg(F.count("*").alias("n"))
    size = rows.agg((2 * F.count("*")).alias("size"))  # one row
    idf = counts.groupBy("w").agg(F.count("*").alias("df")).crossJoin(F.broadcast(size)).select("w", (F.ln((1 + F.col("size")) / (1 + F.col("df"))) + 1).alias("idf"))
    both = counts.join(idf, "w").groupBy(key, "w").agg(*(F.sum(F.when(F.col("side") == s, F.col("n") * F.col("idf")).otherwise(0.0)).alias(n) for s, n in ((0, "x"), (1, "y"))))
    dots = both.groupBy(key).agg(F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("x") ** 2).alias("xx"), F.sum(F.col("y") ** 2).alias("yy"))
    return rows.select(key).join(dots, key, "left").select(key, ratio(F.col("xy"), F.sqrt("xx") * F.sqrt("yy")).alias("cosine"))
