"""Seeded draws. Every draw is a function of a row's id, the name of the draw and the seed, whatever the partitions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def uniform(key: Column, name: str, seed: int) -> Column:
    """A number in (0, 1)."""
    return (digits(key, F.lit(name), F.lit(seed)) + 0.5) * F.lit(2.0**-52)


def digits(*parts: Column) -> Column:
    """A number of 52 bits that depends on the parts' texts alone, by a hash that other engines have, too."""
    text = F.concat_ws("|", *(p.cast("string") for p in parts))
    return F.conv(F.left(F.md5(text.cast("binary")), F.lit(13)), 16, 10).cast("long")


def sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows, all equally likely."""
    return rows.orderBy(digits(F.col(key), F.lit(seed)), key).limit(n)


def sample_by(rows: DataFrame, key: str, by: Sequence[str], n: int, seed: int) -> DataFrame:
    """n rows of each group."""
    order = Window.partitionBy(*by).orderBy(digits(F.col(key), F.lit(seed)), key)
    return rows.withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= n).drop("__k")


def choice(u: Column, weights: Mapping[str, float]) -> Column:
    """The first key whose cumulative weight reaches u of the total; negative weights are 0."""
    clean = {k: max(0.0, w) for k, w in weights.items()}
    if not (total := sum(clean.values())) > 0:
        raise ValueError("no weight is above 0")
    found, before, last = None, 0.0, [k for k, w in clean.items() if w][-1]
    for k, w in clean.items():
        before += w / total
        if w:
            found = F.when(u <= before, k) if found is None else found.when(u <= before, k)
    return found.otherwise(last)


def distinct_choices(key: Column, n: Column, weights: Mapping[str, float], seed: int) -> Column:
    """n keys one after the other without putting back; with putting back if n is more than there are."""
    positive = {k: w for k, w in weights.items() if w > 0}
    keyed = F.array(*(F.struct((F.ln(uniform(key, f"key {k}", seed)) * -1 / F.lit(w)).alias("at"), F.lit(k).alias("k")) for k, w in positive.items()))
    without = F.transform(F.slice(F.sort_array(keyed), 1, F.greatest(n, F.lit(1))), lambda x: x["k"])
    again = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: choice((digits(key, i, F.lit("again"), F.lit(seed)) + 0.5) * F.lit(2.0**-52), positive))
    return F.when(n <= 0, F.array().cast("array<string>")).when(n <= len(positive), without).otherwise(again)


def features(key: Column, rates: Mapping[str, float], seed: int) -> Column:
    """The names drawn at their rates."""
    return F.array_compact(F.array(*(F.when(uniform(key, f"feature {k}", seed) < r, F.lit(k)) for k, r in rates.items())))


def one_of(u: Column, values: Sequence[float]) -> Column:
    """One of these values, all equally likely, such as a row's temperature."""
    return F.element_at(F.array(*map(F.lit, values)), F.floor(u * len(values)).cast("int") + 1)


def whole_number(u: Column, low: Column, high: Column) -> Column:
    return (low + F.floor(u * (high - low + 1))).cast("int")


def balanced_first(rows: DataFrame, label: str, order: str, n: int) -> DataFrame:
    """The first n rows of each label."""
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy(label).orderBy(order))).where(F.col("__k") <= n).drop("__k")
