"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Every document of a source has the same expected number of copies, its source's target over its source's size. The
whole part is taken as it is. The fractional parts are settled in pairs: a random amount of mass, counted in words, goes
from one document to the other, until one of the two has none or a whole copy; the other goes on to the next pair. Expected
copies stay as they are, and so does the number of words that a pair takes. A group of about GROUP documents, chosen by a hash,
settles all of its documents but one, larger documents first; the rests of groups form groups of their own, level by level, until one document a source is
left, which a last draw rounds. A source's words so miss its target by that one document at most.

Defined results: a null text has size 0; a null source is a source, the last one; a source of size 0 has target 0 and its
documents no copies; documents of size 0 count as one word in the draws and as none in the result. Draws are hashes of
document ids, level and seed, so reruns agree. Repeated rows each have their own copies. An empty table gives an empty one.
Other columns play no part. The list of sources (not of documents) is ordered in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

GROUP = 64
SEPARATORS = r"[\x20\x09-\x0D]+"
#: Fractions closer than this to 0 or 1 are that.
CLOSE = 1e-12


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(F.array_remove(F.split(text, SEPARATORS), "")), F.lit(0)).cast("long")


def targets(sources: DataFrame, most: float = 3.0, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Adds each source's target to (source, source_size): shares by weight of all sizes, none above `most` times its size.

    Sources reach that bound in the order of bound over weight. A source is at its bound if its weight would give it
    more of what those before it leave; the first that isn't fixes the share of a unit of weight for all from there.
    """
    named = Window.orderBy(F.col("source").asc_nulls_last())
    bound = Window.orderBy("bound_by_weight", F.col("source").asc_nulls_last())
    before, rest = bound.rowsBetween(Window.unboundedPreceding, -1), bound.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    return (
        sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(named) - 1, F.lit(len(weights))) + 1).cast("int")))
        .withColumn("bound", F.lit(most) * F.col("source_size"))
        .withColumn("bound_by_weight", F.col("bound") / F.col("weight"))
        .withColumn("unit", (F.sum("source_size").over(everything) - F.coalesce(F.sum("bound").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
        .withColumn("place", F.row_number().over(bound))
        .withColumn("first", F.min(F.when(F.col("bound_by_weight") > F.col("unit"), F.struct("place", "unit"))).over(everything))
        .withColumn("target", F.when(F.col("first").isNull() | (F.col("place") < F.col("first.place")), F.col("bound")).otherwise(F.col("first.unit") * F.col("weight")))
        .select("source", "source_size", "n", F.col("target").cast("double"))
    )


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts alone."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) * F.lit(2.0**-53)


def _settle(group: Column, level: int, seed: int) -> Column:
    """Of an array of (size, doc_id, mark, p): the settled ones as (size, doc_id, mark, one), and the one that is left."""
    ordered = F.sort_array(group, asc=False)

    def entry(x: Column, p: Column) -> Column:
        return F.struct(x["size"].alias("size"), x["doc_id"].alias("doc_id"), x["mark"].alias("mark"), p.alias("p"))

    def clean(p: Column) -> Column:
        return F.when(p < CLOSE, 0.0).when(p > 1 - CLOSE, 1.0).otherwise(p)

    def settled(x: Column, p: Column) -> Column:
        return F.array(F.struct(x["size"].alias("size"), x["doc_id"].alias("doc_id"), x["mark"].alias("mark"), F.round(p).cast("long").alias("one")))

    def pair(state: Column, x: Column) -> Column:
        left = state["left"]
        a, b = left["p"], x["p"]
        size_a, size_b = F.greatest(left["size"], F.lit(1)).cast("double"), F.greatest(x["size"], F.lit(1)).cast("double")
        to_a, to_b = F.least((1 - a) * size_a, b * size_b), F.least(a * size_a, (1 - b) * size_b)
        up = _uniform(left["doc_id"], x["doc_id"], left["mark"], x["mark"], F.lit(level), F.lit(seed)) * (to_a + to_b) < to_b
        moved = F.when(up, to_a).otherwise(-to_b)
        new_a, new_b = clean(a + moved / size_a), clean(b - moved / size_b)
        whole = (a <= 0) | (a >= 1)
        a_first = (new_a <= 0) | (new_a >= 1)
        return (
            F.when(whole, F.struct(F.concat(state["done"], settled(left, a)).alias("done"), entry(x, b).alias("left")))
            .when(a_first, F.struct(F.concat(state["done"], settled(left, new_a)).alias("done"), entry(x, new_b).alias("left")))
            .otherwise(F.struct(F.concat(state["done"], settled(x, new_b)).alias("done"), entry(left, new_a).alias("left")))
        )

    first = F.element_at(ordered, 1)
    none = F.filter(settled(first, first["p"]), lambda _: F.lit(False))
    return F.aggregate(F.slice(ordered, 2, F.greatest(F.size(ordered) - 1, F.lit(0))), F.struct(none.alias("done"), entry(first, first["p"]).alias("left")), pair)


def mix(docs: DataFrame, most: float = 3.0, weights: tuple[int, ...] = (1, 2, 3), seed: int = 7) -> DataFrame:
    """(doc_id, mark, source, size, source_size, target, copies, taken) for each row of (doc_id, text, source); mark is a hash of the text."""
    sizes = stored(docs.select("doc_id", "source", F.xxhash64("text").alias("mark"), word_count(F.col("text")).alias("size")), "sizes")
    sources = stored(targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), most, weights), "sources")
    largest = sources.agg(F.max("n")).first()[0] or 0

    ratio = F.coalesce(F.try_divide("target", F.col("source_size").cast("double")), F.lit(0.0))
    whole = F.floor(ratio + CLOSE)
    of = sources.select(F.col("source").alias("its_source"), "source_size", "target", "n", whole.alias("whole"), F.greatest(ratio - whole, F.lit(0.0)).alias("p"))
    rows = sizes.join(of, F.col("source").eqNullSafe(F.col("its_source"))).drop("its_source")

    fraction = F.col("p") > CLOSE
    keys = ["source", "source_size", "target", "whole", "n"]
    left = rows.where(fraction).select(*keys, F.struct("size", "doc_id", "mark", "p").alias("x"))
    finished, groups = [rows.where(~fraction).select(*keys, "size", "doc_id", "mark", F.lit(0).cast("long").alias("one"))], largest
    for level in range(max(1, math.ceil(math.log(max(largest, 2), GROUP)))):
        groups = GROUP ** (level + 1)
        bucket = F.pmod(F.xxhash64("x.doc_id", "x.mark", F.lit(level), F.lit(seed)), F.ceil(F.col("n") / F.lit(groups)))
        found = left.groupBy(*keys, bucket.alias("bucket")).agg(F.collect_list("x").alias("xs"))
        found = stored(found.select(*keys, _settle(F.col("xs"), level, seed).alias("s")).select(*keys, "s.done", F.col("s.left").alias("x")), f"level{level}")
        finished.append(found.select(*keys, F.inline("done")))
        left = found.select(*keys, "x")
    # One document a source is left, if a level's groups of about GROUP end in a single one.
    last = F.when(_uniform(F.col("x.doc_id"), F.col("x.mark"), F.lit("last"), F.lit(seed)) < F.col("x.p"), 1).otherwise(0).cast("long")
    finished.append(left.select(*keys, "x.size", "x.doc_id", "x.mark", last.alias("one")))
    result = finished[0]
    for part in finished[1:]:
        result = result.unionByName(part)
    copies = (F.col("whole") + F.col("one")).cast("long")
    return result.select("doc_id", "mark", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents themselves, each as often as the mix takes it. Rows with equal doc_id, source and text are one document here, taken as often as its rows together."""
    copies = mix(docs, **options).groupBy("doc_id", "source", "mark").agg(F.sum("copies").alias("copies")).where("copies > 0")
    copies = copies.select(*(F.col(c).alias(f"__{c}") for c in copies.columns))
    same = F.col("doc_id").eqNullSafe(F.col("__doc_id")) & F.col("source").eqNullSafe(F.col("__source")) & (F.xxhash64("text") == F.col("__mark"))
    once = docs.withColumn("__key", F.xxhash64("text")).dropDuplicates(["doc_id", "source", "__key"]).drop("__key")
    return once.join(copies, same).withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select(docs.columns)
