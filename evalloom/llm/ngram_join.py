"""Jaccard join of documents on word n-grams, by prefix filters under several global orders.

A document's set holds its distinct shingles of `width` words as 64-bit hashes. Two sets link if 100 * intersection >= 80 * union. Of n hashes
at most n / 5 can then be missing in the other set, so that under any order of all hashes the first n / 5 + k of each hold k of the other's, too. Three orders are
used, one after the other, each on what the last has left:

1. hashes upwards: a document stays if n / 40 of its first n / 5 + n / 40 hashes are in another document's first ones;
2. hashes downwards, the same;
3. rare first: frequencies of a third of all hashes (those that THIRD divides; the others come after them, upwards) are counted over what is left, and documents that share one of their first n / 5 + 1 hashes meet in that
   hash's bucket. Texts of their own leave no entries here, since all that they begin with is theirs alone; a passage that many documents have is at the end of the order.

In a bucket one member is compared with all others as a star, first in the buckets of each document's rarest hashes, then in all that are left. A pair must pass the bound that parity sketches give (minhash.maybe_linked), share the first n / 5 + 1
hashes in the orders upwards and downwards, too, and is then compared in full. Buckets whose members are not in one component after that are taken up again, with MORE times as many centres a round from outside the bucket's
largest component: no link between components is lost, pairs within a component need not be compared. Equal sets are one class, of which the smallest id takes part.

Defined results: null and empty texts and those without words have empty sets and are linked with nothing; a row with a null id is linked with nothing, its component is null; rows with
equal ids are one document, linked by any of its texts; other columns, whatever their names, play no part; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .minhash import DEALT, MORE, PARITY, PERCENT, SALTS, components, maybe_linked, parities, shingle_sets
from .shared import BASES, dropped, mixed, stored, text_slices

WIDTH = 5
#: A fifth of a set can be missing in one that is linked with it (of PERCENT = 80), and a fortieth of it is looked for besides.
MISSING, LOOKED_FOR, THIRD = 5, 40, 3
#: Numbers in a map of keys, of 64 bits each. Nothing larger than such a map is broadcast, whatever the size of the tables.
MARKS = 1 << 17
#: Buckets of a document's rarest hashes that are taken up first.
RAREST = 2
_U = np.uint64


def marked(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The rows with a column `marked`, false only for rows whose key is surely not among the keys: these set bits of a map, which is broadcast."""
    place = F.pmod(F.xxhash64(*on), F.lit(64 * MARKS))
    number, bit = F.shiftright(place, 6), F.pmod(place, F.lit(64)).cast("int")
    marks = keys.select(number.alias("number"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("bit")).groupBy("number").agg(F.bit_or("bit").alias("marks"))
    rows = rows.withColumn("number", number).join(F.broadcast(marks), "number", "left")
    return rows.withColumn("marked", F.coalesce(F.getbit("marks", bit) == 1, F.lit(False))).drop("number", "marks")


def among(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The rows whose key is among the keys of a stored frame; only rows that are marked go anywhere for it."""
    return marked(rows, keys, on).where("marked").drop("marked").join(keys.select(*on).hint("merge"), on, "left_semi")


def _sets(rows: Iterator[pa.RecordBatch], width: int, whole: bool) -> Iterator[pa.RecordBatch]:
    """(doc_id, n, one, two, first, found, again) of each text's set: its size, two sums, its first hashes upwards without those that another text of the slice begins with, how many these are, and (with the slice's first text) these,
    once each. whole: (doc_id, n, one, two, first, bits) with all hashes and a sketch."""
    for batch in rows:
        texts = batch.column(1)
        for lo, hi in text_slices(texts):
            values, bounds = shingle_sets(texts.slice(lo, hi - lo), width)
            sizes = np.diff(bounds)
            some = np.flatnonzero(sizes)
            sums = np.zeros((2, hi - lo), np.int64)
            if len(some):
                sums[0][some] = np.add.reduceat(mixed(values), bounds[some]).view(np.int64)
                sums[1][some] = np.add.reduceat(mixed(values ^ _U(BASES[0])), bounds[some]).view(np.int64)
            known = [batch.column(0).slice(lo, hi - lo), *map(pa.array, (sizes.astype(np.int64), *sums))]
            text = np.repeat(np.arange(hi - lo), sizes)
            bits = parities(values, bounds).view(np.int64).ravel() if whole else None
            # Signed order, as the JVM has it.
            values = values.view(np.int64)
            values = values[np.lexsort((values, text))]
            if whole:
                sketches = pa.ListArray.from_arrays(np.arange(hi - lo + 1, dtype=np.int32) * (PARITY // 64), bits)
                yield pa.RecordBatch.from_arrays([*known, pa.ListArray.from_arrays(bounds.astype(np.int32), values), sketches], ["doc_id", "n", "one", "two", "first", "bits"])
                continue
            taken = np.arange(len(values)) - bounds[text] < (sizes // MISSING + -(-sizes // LOOKED_FOR))[text]
            values, text = values[taken], text[taken]
            distinct, which, times = np.unique(values, return_inverse=True, return_counts=True)
            shared = times[which] > 1
            alone = np.searchsorted(text[~shared], np.arange(hi - lo + 1)).astype(np.int32)
            found = np.bincount(text[shared], minlength=hi - lo).astype(np.int64)
            again = distinct[times > 1]
            lists = pa.ListArray.from_arrays(alone, values[~shared]), pa.ListArray.from_arrays(np.array([0, *[len(again)] * (hi - lo)], np.int32), again)
            yield pa.RecordBatch.from_arrays([*known, lists[0], pa.array(found), lists[1]], ["doc_id", "n", "one", "two", "first", "found", "again"])


def among_others(entries: DataFrame) -> DataFrame:
    """(row, found): how many entries (row, hash) of each row have a hash that another entry has; entries of row null stand for slices of a table, so that a hash has at most one a slice."""
    of = Window.partitionBy("hash")
    shared = entries.withColumn("df", F.count("*").over(of)).where("df > 1 AND row IS NOT NULL")
    return shared.groupBy("row").agg(F.count("*").alias("found"))


def enough(found: Column, n: Column) -> Column:
    return found >= F.ceil(n / LOOKED_FOR)


def shared_first(rows: DataFrame, first: Column) -> DataFrame:
    """(row) of the rows (row, n) of whose first hashes enough are among another's; the hashes are counted before they are joined, so that a frequent one is no group."""
    entries = rows.select("row", F.explode(first).alias("hash"))
    known = entries.groupBy("hash").agg(F.count("*").alias("df")).where("df > 1").select("hash")
    found = entries.join(known, "hash").groupBy("row").agg(F.count("*").alias("found"))
    return found.join(rows.select("row", "n"), "row").where(enough(F.col("found"), F.col("n"))).select("row")


def rare_first(sets: DataFrame) -> DataFrame:
    """(bucket, parts, rank, row): for each set (row, n, first) those of its first n / 5 + 1 hashes that another has among its own, rare ones first."""
    ranked = lambda x: F.pmod(x, F.lit(THIRD)) == 0
    entries = sets.select("row", F.explode(F.filter("first", ranked)).alias("hash"))
    known = entries.groupBy("hash").agg(F.count("*").alias("df")).where("df > 1")
    shared = entries.join(known, "hash").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("df", "hash"))).alias("shared"))  # one set each
    rows = sets.join(shared, "row", "left").withColumn("shared", F.coalesce(F.col("shared.hash"), F.array().cast("array<bigint>")))
    length, counted = F.floor(F.col("n") / MISSING).cast("int") + 1, F.size(F.filter("first", ranked))
    own = F.greatest(F.lit(0), length - counted + F.size("shared"))
    others = F.slice(F.filter("first", lambda x: ~ranked(x)), F.lit(1), F.greatest(F.lit(0), length - counted))
    found = rows.select("row", F.posexplode(F.concat(F.slice("shared", F.lit(1), own), others)).alias("rank", "bucket"))
    size = found.groupBy("bucket").agg(F.count("*").alias("k")).where("k > 1")
    return found.join(size, "bucket").select("bucket", F.ceil(F.col("k") / DEALT).cast("int").alias("parts"), "rank", "row")


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (x, y) that share first hashes upwards and downwards, and then enough hashes at all, as (a, b) of their documents."""
    one, two = (sets.select(F.col("row").alias(k), F.col("rep").alias(f"rep_{k}"), F.col("n").alias(f"n_{k}"), F.col("first").alias(f"set_{k}")) for k in "xy")

    def both(ends) -> Column:
        return F.arrays_overlap(ends("set_x", F.floor(F.col("n_x") / MISSING).cast("int") + 1), ends("set_y", F.floor(F.col("n_y") / MISSING).cast("int") + 1))

    # A set goes to those that it is compared with; only those go anywhere that have a pair.
    one, two = (marked(rows, pairs, [k]).where("marked").drop("marked") for rows, k in ((one, "x"), (two, "y")))
    rows = two.join(pairs.hint("merge"), "y").join(one, "x")
    rows = rows.where(both(lambda s, n: F.slice(s, F.lit(1), n)) & both(lambda s, n: F.slice(s, -n, n)))
    common = F.size(F.array_intersect("set_x", "set_y"))
    rows = rows.where(100 * common >= PERCENT * (F.col("n_x") + F.col("n_y") - common))
    return rows.select(F.least("rep_x", "rep_y").alias("a"), F.greatest("rep_x", "rep_y").alias("b")).where("a <> b")


def _parts(buckets: DataFrame) -> DataFrame:
    return buckets.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")


def links_in_buckets(entries: DataFrame, sets: DataFrame, links: DataFrame) -> DataFrame | None:
    """(node, component) by the links given and those between the sets (row, rep, n, first, bits) that are in a bucket of the entries (bucket, parts, rank, row) together; None without any.

    Spark takes stored entries by the size of their files for small enough to be broadcast, where they are many times as large as rows, so all joins of theirs are merges."""
    labels = None if links.isEmpty() else components(links)
    light = stored(sets.select("row", "rep", "n", "bits"), "sketches")
    members = stored(entries.select("bucket", "parts", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int").alias("part"), "rank", "row"), "members")
    tested, centres, first = None, 0, True

    def labelled(rows: DataFrame) -> DataFrame:
        """Members with what the comparison reads and their component."""
        rows = rows.join(light.hint("merge"), "row")
        if labels is None:
            return rows.withColumn("component", F.col("rep"))
        return rows.join(labels.withColumnRenamed("node", "rep").hint("merge"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))

    while not members.isEmpty():
        now = labelled(members.where(F.col("rank") < RAREST) if first else members)
        centre = F.struct("rep", "row", "n", "component", "bits")  # the smallest id first: copies often come after what they were made of
        if centres <= 1:
            chosen = now.groupBy("bucket", "parts").agg(F.min(centre).alias("c"))
        else:
            sizes = now.groupBy("bucket", "parts", "component").agg(F.count("*").alias("k"))
            largest = sizes.groupBy("bucket", "parts").agg(F.max(F.struct("k", "component"))["component"].alias("largest"), (F.sum("k") - F.max("k")).alias("others"))
            others = now.join(_parts(largest).hint("merge"), ["bucket", "part"]).where("component <> largest")
            chosen = others.where(F.pmod(F.xxhash64("row"), F.ceil(F.col("others") / centres)) == 0).select("bucket", "parts", centre.alias("c"))
        chosen = stored(chosen, "centres")
        pairs = now.join(_parts(chosen).hint("merge"), ["bucket", "part"]).where("component <> c.component").where(maybe_linked(F.col("n"), F.col("c.n"), F.col("bits"), F.col("c.bits")))
        pairs = pairs.where(100 * F.least("n", "c.n") >= PERCENT * F.greatest("n", "c.n")).select(F.least("row", "c.row").alias("x"), F.greatest("row", "c.row").alias("y")).distinct()
        pairs = stored(pairs.join(tested.hint("merge"), ["x", "y"], "left_anti") if tested is not None else pairs, "pairs")
        tested = pairs if tested is None else tested.union(pairs)
        links = links.union(stored(linked(pairs, sets), "links"))
        if labels is not None:
            dropped(labels)
        labels = components(links)
        # Whoever has been a centre has been compared with all of its bucket.
        left = members if first else members.join(chosen.select("bucket", F.col("c.row").alias("row")).hint("merge"), ["bucket", "row"], "left_anti")
        several = labelled(left).groupBy("bucket", "parts").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("bucket", "parts")
        left = stored(left.join(_parts(several).hint("merge"), ["bucket", "part"]).select("bucket", "parts", "part", "rank", "row"), "members")
        dropped(members, chosen)
        members, centres, first = left, 1 if first else max(1, centres) * MORE, False
    dropped(members)
    return labels


def join(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    schema = "doc_id long, n long, one long, two long, first array<long>"
    sketch = docs.mapInArrow(lambda rows: _sets(rows, width, False), f"{schema}, found long, again array<long>")
    sketch = stored(sketch.withColumn("row", F.monotonically_increasing_id()), "sketch")
    named = sketch.where("doc_id IS NOT NULL AND n > 0")
    same = ["one", "two", "n"]
    classes = named.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.count("*").alias("k")).where("k > 1")
    classes = stored(classes.select(*same, "rep", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")), "classes")
    salted = marked(named.withColumn("salt", F.pmod("doc_id", F.lit(SALTS)).cast("int")), classes, same)
    salted = salted.where("marked").join(classes.hint("merge"), [*same, "salt"], "left").unionByName(salted.where("NOT marked").withColumn("rep", F.lit(None).cast("long")))
    of = salted.select("doc_id", F.coalesce("rep", "doc_id").alias("rep"), "row", "one", "n", "first", "found")
    alone = of.where("rep = doc_id")

    entries = alone.select("row", F.explode("first").alias("hash")).union(sketch.select(F.lit(None).cast("long"), F.explode("again")))
    upwards = among_others(entries).withColumnRenamed("found", "others")
    upwards = alone.join(upwards, "row", "left").where(enough(F.col("found") + F.coalesce("others", F.lit(0)), F.col("n")))
    upwards = stored(upwards.select("rep", "one").distinct(), "upwards")
    # Classes that one id's texts are in are linked by it.
    names = of.select("doc_id", "rep")
    several = names.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("most")).where("a <> most").select("doc_id", "a")
    links = stored(names.withColumnRenamed("rep", "b").join(several, "doc_id").where("a <> b").select("a", "b").distinct(), "links")
    if upwards.isEmpty():
        labels = None if links.isEmpty() else components(links)
    else:
        some = marked(docs, upwards.select(F.col("rep").alias("doc_id")), ["doc_id"]).where("marked")
        again = some.select("doc_id", "text").mapInArrow(lambda rows: _sets(rows, width, True), f"{schema}, bits array<long>")
        again = among(again.withColumnRenamed("doc_id", "rep"), upwards, ["rep", "one"])
        sets = stored(again.select(F.monotonically_increasing_id().alias("row"), "rep", "n", "first", "bits"), "sets")
        length = (F.floor(F.col("n") / MISSING) + F.ceil(F.col("n") / LOOKED_FOR)).cast("int")
        downwards = stored(shared_first(sets, F.slice("first", -length, length)), "downwards")
        left = stored(among(sets, downwards, ["row"]), "sets")
        dropped(sets)
        sets = left
        labels = links_in_buckets(rare_first(sets), sets, links)
    result = names
    if labels is not None:
        result = result.join(labels.withColumnRenamed("node", "rep").hint("merge"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("rep"))
    result = result.groupBy(F.col("doc_id").alias("its_id")).agg(F.min("rep").alias("found"))
    rows = sketch.select("doc_id", F.col("n").alias("n_shingles")).join(result, F.col("doc_id") == F.col("its_id"), "left")
    return rows.select("doc_id", "n_shingles", F.coalesce("found", "doc_id").alias("component_id"))
