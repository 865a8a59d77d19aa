"""Syntax of parsed sentences: the parser is the caller's, its heads and labels are columns; depths follow natively.

A text's heads name, for each of its tokens, the place of the token that it depends on (from 0), or its own place or -1 for the root of a sentence.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import metrics, profile

# Labels whose token opens a clause; a verb that is joined on (conj) opens one, too.
CLAUSES = ("ROOT", "ccomp", "advcl", "relcl", "xcomp", "csubj")


def depths(heads: Column) -> Column:
    """The steps from each token to its root, by pointer doubling: every round each token takes over where its pointer points, so that a depth of d takes log2 d rounds. Null for a token whose heads lead round in a cycle or out of the text; null heads have null depths."""

    def doubled(state: Column, _: Column) -> Column:
        at, steps = state["at"], state["steps"]
        there = lambda p, of: F.when(p.isNotNull(), F.get(of, p))
        return F.struct(F.transform(at, lambda p: there(p, at)).alias("at"), F.transform(steps, lambda s, i: s + F.coalesce(F.get(steps, F.get(at, i)), F.lit(0))).alias("steps"))

    def of(h: Column) -> Column:
        own = F.transform(h, lambda p, i: F.when((p == i) | (p == -1), i).when((p >= 0) & (p < F.size(h)), p))
        start = F.struct(own.alias("at"), F.transform(own, lambda p, i: F.when(p == i, F.lit(0)).otherwise(F.lit(1))).alias("steps"))
        rounds = F.sequence(F.lit(1), F.ceil(F.log2(F.size(h) + 1.0)).cast("int") + 1)
        last = F.aggregate(rounds, start, doubled)
        return T.let(F.struct(own.alias("own"), last.alias("last")), lambda x: F.transform(x["last"]["at"], lambda p, i: F.when(F.get(x["own"], p) == p, F.get(x["last"]["steps"], i))))

    return F.when(F.size(heads) > 0, T.let(heads.cast("array<int>"), of)).when(heads.isNotNull(), F.array().cast("array<int>"))


def arc_lengths(heads: Column) -> Column:
    """How far each token is from its head; roots and places out of the text are left out."""
    arcs = F.transform(heads.cast("array<int>"), lambda p, i: F.when((p >= 0) & (p < F.size(heads)) & (p != i), F.abs(p - i)))
    return F.filter(arcs, lambda x: x.isNotNull())


def clauses(labels: Column, kinds: Column) -> Column:
    """Tokens of a text that open a clause."""
    opens = F.zip_with(labels, kinds, lambda d, k: F.coalesce(d.isin(*CLAUSES) | ((d == "conj") & (k == "VERB")), F.lit(False)))
    return F.size(F.filter(opens, lambda x: x))


def sentences(heads: Column) -> Column:
    """Roots of a text."""
    return F.size(F.filter(F.transform(heads.cast("array<int>"), lambda p, i: (p == i) | (p == -1)), lambda x: F.coalesce(x, F.lit(False))))


def measured(rows: DataFrame, heads: str = "heads", labels: str = "labels", kinds: str = "kinds") -> DataFrame:
    """Adds depth (the deepest token's, 0 without any), arcs (their mean length), clauses and sentences of each text."""
    h = F.col(heads)
    arcs = T.let(arc_lengths(h), lambda a: metrics.ratio(F.aggregate(a, F.lit(0), lambda s, x: s + x), F.size(a)))
    return rows.withColumns({"depth": F.coalesce(F.array_max(depths(h)), F.lit(0)), "arcs": arcs, "clauses": clauses(F.col(labels), F.col(kinds)), "sentences": sentences(h)})


def syntax_profile(rows: DataFrame, by: Sequence[str] = (), heads: str = "heads", labels: str = "labels", kinds: str = "kinds") -> dict[str, DataFrame]:
    """Of texts with heads, labels and kinds of their tokens: statistics of depths, clauses and sentences, and shares of the kinds; texts without heads are left out."""
    found = measured(rows.where(F.col(heads).isNotNull()), heads, labels, kinds)
    return {
        "depth": profile.numeric_stats(found, F.col("depth"), by),
        "clauses": profile.numeric_stats(found, F.col("clauses"), by),
        "sentences": profile.numeric_stats(found, F.col("sentences"), by),
        "kinds": profile.label_shares(found.select(*by, F.explode(kinds).alias("kind")), "kind", by),
    }
