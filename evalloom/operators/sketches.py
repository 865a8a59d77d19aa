"""Profiles that can be put together: what is kept of a part of a corpus is a row, and rows of parts (days, sources, sessions) make the row of the whole, without reading a text again.

Counts, sums, least and most are exact. Quantiles of lengths are KLL sketches (of K = 400: a quantile's rank is off by less than RANK_ERROR with 99 % confidence), distinct words a HyperLogLog sketch of 2**12 buckets, frequent words a
sketch of TRACKED of them, exact while a part has fewer distinct ones than three quarters of that. The size of a row doesn't grow with the texts behind it, where an exact quantile keeps a group's distinct values and an exact vocabulary
all its words.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vocab import QUANTILES
from .profile import nonblank

K, BUCKETS, TRACKED = 400, 12, 20_000
RANK_ERROR, DISTINCT_ERROR = 0.01, 0.05
#: The numbers of a text that are kept, each with its sums and its sketch.
NUMBERS = ("words", "chars")


def sketched(rows: DataFrame, by: Sequence[str] = (), text: str = "text") -> DataFrame:
    """(by, texts, then sum, squares, least, most and ranks of words and of chars, tokens, vocabulary, frequent): a row for each part, in one pass over its texts, blank ones left out."""
    read = nonblank(rows, text).select(*by, T.tokens(F.col(text)).alias("__w"), F.length(text).alias("chars"))
    each = read.select(*by, F.size("__w").alias("words"), "chars", F.posexplode_outer("__w").alias("__at", "__word"))
    first = F.coalesce(F.col("__at") == 0, F.lit(True))  # one row of a text stands for it
    each = each.select(*by, "__word", *(F.when(first, F.col(name)).cast("long").alias(name) for name in NUMBERS))  # once, not in each aggregate
    numbers = []
    for name in NUMBERS:
        v = F.col(name)
        numbers += [
            F.sum(v).alias(f"{name}_sum"),
            F.sum(v.cast("double") * v).alias(f"{name}_squares"),
            F.min(v).alias(f"{name}_least"),
            F.max(v).alias(f"{name}_most"),
            F.kll_sketch_agg_bigint(v, K).alias(f"{name}_ranks"),
        ]
    word = F.col("__word")
    return each.groupBy(*by).agg(
        F.count("words").alias("texts"), *numbers, F.count(word).alias("tokens"), F.hll_sketch_agg(word, BUCKETS).alias("vocabulary"), F.expr(f"approx_top_k_accumulate(__word, {TRACKED})").alias("frequent")
    )


def merged(parts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The rows of the parts' wholes; they can be merged again."""
    numbers = []
    for name in NUMBERS:
        numbers += [F.sum(f"{name}_sum").alias(f"{name}_sum"), F.sum(f"{name}_squares").alias(f"{name}_squares"), F.min(f"{name}_least").alias(f"{name}_least"), F.max(f"{name}_most").alias(f"{name}_most"), F.kll_merge_agg_bigint(f"{name}_ranks", K).alias(f"{name}_ranks")]
    return parts.groupBy(*by).agg(
        F.sum("texts").alias("texts"), *numbers, F.sum("tokens").alias("tokens"), F.hll_union_agg("vocabulary").alias("vocabulary"), F.expr(f"approx_top_k_combine(frequent, {TRACKED})").alias("frequent")
    )


def quantile(ranks: Column, share: float) -> Column:
    return F.kll_sketch_get_quantile_bigint(ranks, F.lit(share))


def numbers_of(sketches: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, mean, min, max, std, p10 .. p90) of words or chars; all but the quantiles are exact."""
    n, total = F.col("texts").cast("double"), F.col(f"{name}_sum").cast("double")
    mean = total / n
    spread = F.sqrt(F.greatest(F.col(f"{name}_squares") / n - mean * mean, F.lit(0.0)))
    some = sketches.where("texts > 0")
    return some.select(*by, F.col("texts").alias("n"), mean.alias("mean"), F.col(f"{name}_least").alias("min"), F.col(f"{name}_most").alias("max"), spread.alias("std"), *(quantile(F.col(f"{name}_ranks"), q / 100).alias(f"p{q}") for q in QUANTILES))


def words_of(sketches: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    """(by, tokens, types, top): estimated distinct words, and the k most frequent ones with their counts."""
    top = F.transform(F.expr(f"approx_top_k_estimate(frequent, {int(k)})"), lambda e: F.struct(e["item"].alias("word"), e["count"].alias("n")))
    return sketches.select(*by, "tokens", F.hll_sketch_estimate("vocabulary").alias("types"), top.alias("top"))
