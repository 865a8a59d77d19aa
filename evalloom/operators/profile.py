"""Profiles of text corpora. Every function takes a frame and gives a frame; `by` names the columns of a slice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vocab import QUANTILES, SIGNAL_RATES, STOPWORDS, bin_label
from ..session import settled


def missing_counts(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, missing): null or blank values, all columns in one pass."""
    counts = rows.agg(*(F.count_if(T.blank(F.col(c).cast("string"))).alias(c) for c in columns))
    return counts.unpivot([], list(columns), "column", "missing")


def numeric_stats(rows: DataFrame, value: Column, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, mean, median, min, max, std): the population's deviation; zeros without rows. The median keeps a group's distinct values, so it is for counts and lengths."""
    v, zero = F.col("__v"), F.lit(0.0)
    found = (F.avg(v), F.median(v), F.min(v).cast("double"), F.max(v).cast("double"), F.stddev_pop(v))
    return rows.select(*by, value.alias("__v")).groupBy(*by).agg(F.count(v).alias("n"), *(F.coalesce(x, zero).alias(n) for x, n in zip(found, ("mean", "median", "min", "max", "std"), strict=True)))


def nonblank(rows: DataFrame, text: str = "text") -> DataFrame:
    return rows.where(~T.blank(F.col(text)))


def text_length_stats(rows: DataFrame, text: str = "text", by: Sequence[str] = ()) -> DataFrame:
    return numeric_stats(nonblank(rows, text), F.length(text), by)


def word_count_stats(rows: DataFrame, text: str = "text", by: Sequence[str] = ()) -> DataFrame:
    return numeric_stats(nonblank(rows, text), F.size(T.tokens(F.col(text))), by)


#: Buckets of hashed n-grams, and of these the fullest ones, whose n-grams give the first bound.
BUCKETS, FULLEST = 1 << 20, 256
#: Of so many rows one is read for that bound, by a hash of the row's key; counts of a part are bounds of those of the whole, too.
BOUND_OF = 8


def _frequent(grams: DataFrame, k: int, order: str, by: Sequence[str] = ()) -> DataFrame:
    """The rows of grams (by, order, ngram, ...) without such n-grams as are surely not among a slice's k most frequent.

    A bucket's rows are as many as those of each of its n-grams at least. The k-th count among the n-grams of the fullest buckets, in some of the rows, is no more than the k-th of all, so n-grams of buckets with fewer rows can't be
    among the first k; all others stay. So only numbers of buckets are shuffled for rare n-grams, not the n-grams themselves. The set of kept buckets is broadcast: BUCKETS of a slice at most.
    """
    hashed = grams.withColumn("__b", F.pmod(F.xxhash64("ngram"), F.lit(BUCKETS)).cast("int"))
    full = settled(hashed.groupBy(*by, "__b").agg(F.count("*").alias("__all")), "buckets")
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("__all"), "__b"))
    fullest = full.withColumn("__k", place).where(F.col("__k") <= FULLEST).select(*by, "__b")

    def of(rows: DataFrame, buckets: DataFrame) -> DataFrame:
        right = buckets.select(*(F.col(c).alias(f"__{c}") for c in by), F.col("__b").alias("__of"))
        same = F.col("__b") == F.col("__of")
        for c in by:
            same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
        return rows.join(F.broadcast(right), same, "left_semi").drop("__b")

    counts = of(hashed.where(F.pmod(F.xxhash64(order), F.lit(BOUND_OF)) == 0), fullest).groupBy(*by, "ngram").agg(F.count("*").alias("n"))
    kth = counts.withColumn("__k", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n")))).where(F.col("__k") == k)
    least = kth.select(*(F.col(c).alias(f"__{c}") for c in by), F.col("n").alias("__least"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    kept = full.join(F.broadcast(least), same, "left").where(F.col("__all") >= F.coalesce("__least", F.lit(1)))  # a row a slice
    return of(hashed, settled(kept.select(*by, "__b"), "kept"))


def top_ngrams(rows: DataFrame, k: int, n: int = 1, text: str = "text", order: str = "doc_id", drop: Sequence[str] = ()) -> DataFrame:
    """(ngram, n): the k most frequent; of equal counts the one seen first in the order of rows.

    Counts and first rows decide but for n-grams of one row; only these, at most k and the n-grams of one row, are looked for again, in their first rows.
    """
    grams = T.tokens(F.col(text), drop) if n == 1 else T.ngrams(T.tokens(F.col(text), drop), n)
    each = rows.select(order, F.explode(grams).alias("ngram"))
    counts = (each if n == 1 else _frequent(each, k, order)).groupBy("ngram").agg(F.count("*").alias("n"), F.min(order).alias("first"))
    if n > 1:
        counts = settled(counts, "counts")
    place = F.struct((-F.col("n")).alias("n"), "first")
    last = counts.orderBy(F.desc("n"), "first").limit(k).agg(F.max(place).alias("last"))  # one row
    found = counts.join(F.broadcast(last), place <= F.col("last")).drop("last")
    again = rows.join(F.broadcast(found.select("first").distinct()), F.col(order).eqNullSafe(F.col("first")), "left_semi").select(order, F.posexplode(grams).alias("at", "gram"))
    placed = found.join(again, (F.col("ngram") == F.col("gram")) & F.col("first").eqNullSafe(F.col(order))).groupBy("ngram", "n", "first").agg(F.min("at").alias("at"))
    return placed.orderBy(F.desc("n"), "first", "at").limit(k).select("ngram", "n")


def top_ngrams_by(rows: DataFrame, k: int, by: Sequence[str], n: int = 1, text: str = "text", order: str = "doc_id", drop: Sequence[str] = ()) -> DataFrame:
    """(by, rank, ngram, n): the k most frequent of each slice; of equal counts the one seen first. Each task passes on at most k of a slice."""
    grams = T.tokens(F.col(text), drop) if n == 1 else T.ngrams(T.tokens(F.col(text), drop), n)
    each = rows.select(*by, order, F.posexplode(grams).alias("at", "ngram"))
    counts = (each if n == 1 else _frequent(each, k, order, by)).groupBy(*by, "ngram").agg(F.count("*").alias("n"), F.min(F.struct(order, "at")).alias("first"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "first"))
    return counts.withColumn("rank", place).where(F.col("rank") <= k).select(*by, "rank", "ngram", "n")


def spaced_length_stats(rows: DataFrame, text: str = "text", by: Sequence[str] = ()) -> DataFrame:
    """(by, n, mean, median, min, max, std) of the numbers of words between spaces; texts without a word count."""
    return numeric_stats(rows.where(F.col(text).isNotNull()), F.size(T.spaced(F.col(text))), by)


def top_edit_types(rows: DataFrame, k: int = 5, edits: str = "edits") -> DataFrame:
    """(type, n): the k most frequent types of edits, noop left out; of equal ones the first name."""
    kinds = rows.select(F.explode(F.col(edits)["type"]).alias("type")).where("type <> 'noop'")
    return kinds.groupBy("type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type").limit(k)


def label_shares(rows: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, label, n, share) of rows with a label."""
    counts = rows.where(F.col(label).isNotNull()).groupBy(*by, label).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def first_examples(rows: DataFrame, k: int, by: Sequence[str], order: str = "doc_id") -> DataFrame:
    """The first k rows of each slice, numbered by rank."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(order))).where(F.col("rank") <= k)


def histogram(rows: DataFrame, value: Column, bins, by: Sequence[str] = ()) -> DataFrame:
    """(by, bin, n, share): every bin of every slice; values below the first bin count in it."""
    valued, v, which = rows.select(*by, value.alias("__v")), F.col("__v"), F.lit(None).cast("string")
    for low, high in reversed(bins):
        which = F.lit(bin_label(low, high)) if high is None else F.when(v <= high, bin_label(low, high)).otherwise(which)
    of = {bin_label(*b): F.count_if(F.col("__bin") == bin_label(*b)) for b in bins}
    binned = valued.where(v.isNotNull()).select(*by, which.alias("__bin"))
    wide = binned.groupBy(*by).agg(F.count("*").alias("__n"), *(c.alias(n) for n, c in of.items()))
    long = wide.unpivot([*by, "__n"], list(of), "bin", "n")
    return long.select(*by, "bin", "n", F.coalesce(F.try_divide(F.col("n").cast("double"), F.col("__n").cast("double")), F.lit(0.0)).alias("share"))


def quantiles(rows: DataFrame, value: Column, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, p10 .. p90) with linear interpolation, ends included."""
    found = rows.select(*by, value.alias("__v")).groupBy(*by).agg(F.count("__v").alias("n"), F.percentile("__v", F.array(*(F.lit(q / 100) for q in QUANTILES))).alias("q"))
    return found.select(*by, "n", *(F.coalesce(F.col("q")[k], F.lit(0.0)).alias(f"p{q}") for k, q in enumerate(QUANTILES)))


def style_rates(rows: DataFrame, text: str = "text", by: Sequence[str] = ()) -> DataFrame:
    """(by, one column a style, punctuation_density): shares of texts, and the mean density of those not empty."""
    rates = (F.coalesce(F.avg(flag.cast("double")), F.lit(0.0)).alias(name) for name, flag in T.style_flags(F.col(text), F.col("__w")).items())
    return rows.select(*by, text, T.tokens(F.col(text)).alias("__w")).groupBy(*by).agg(*rates, F.coalesce(F.avg(T.punctuation_density(F.col(text))), F.lit(0.0)).alias("punctuation_density"))


def signal_rates(rows: DataFrame, text: str = "text", by: Sequence[str] = ("label",)) -> DataFrame:
    """(by, n, one rate a signal)."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *(F.avg(f.cast("double")).alias(SIGNAL_RATES[s]) for s, f in T.signal_flags(F.col(text)).items()))


def vocabulary_stats(rows: DataFrame, text: str = "text", by: Sequence[str] = ()) -> DataFrame:
    """(by, total_tokens, types, type_token_ratio, hapax_fraction, stopword_fraction, avg_word_length)."""
    counts = rows.select(*by, F.explode(T.tokens(F.col(text))).alias("w")).groupBy(*by, "w").agg(F.count("*").alias("n"))
    total, ratio = F.sum("n"), lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    return counts.groupBy(*by).agg(
        F.coalesce(total, F.lit(0)).alias("total_tokens"),
        F.count("*").alias("types"),
        ratio(F.count("*"), total).alias("type_token_ratio"),
        ratio(F.count_if(F.col("n") == 1), F.count("*")).alias("hapax_fraction"),
        ratio(F.sum(F.when(F.col("w").isin(*STOPWORDS), F.col("n")).otherwise(0)), total).alias("stopword_fraction"),
        ratio(F.sum(F.col("n") * F.length("w")), total).alias("avg_word_length"),
    )


def pair_stats(rows: DataFrame, source: str, target: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, bucket, n, mean_similarity): pairs by how much of the source the target keeps."""
    rated = rows.withColumn("similarity", F.round(T.sequence_similarity(F.col(source), F.col(target)), 4))
    return rated.groupBy(*by, T.similarity_bucket(F.col("similarity")).alias("bucket")).agg(F.count("*").alias("n"), F.avg("similarity").alias("mean_similarity"))


def edit_profile(rows: DataFrame, supported: Sequence[str], edits: str = "edits", most: int = 5) -> dict[str, DataFrame]:
    """Of rows with an array of edits (type): shares of supported types, of edits a row (counted to most), and totals. Type noop is no edit."""
    real = rows.where(F.col(edits).isNotNull()).withColumn("__e", F.filter(edits, lambda e: e["type"] != "noop"))
    kinds = real.select(F.explode("__e.type").alias("type"))
    known = kinds.where(F.col("type").isin(*supported))
    per = real.select(F.least(F.size("__e"), F.lit(most)).alias("edits"))
    return {
        "types": label_shares(known, "type"),
        "counts": label_shares(per, "edits"),
        "totals": per.agg(F.coalesce(F.avg("edits"), F.lit(0.0)).alias("mean_edits")).crossJoin(kinds.agg(F.coalesce(F.avg(F.col("type").isin(*supported).cast("double")), F.lit(0.0)).alias("supported_fraction"))),
    }
