"""Places in an order, on as many rows as take several partitions that adaptive execution merges."""

from pyspark.sql import functions as F

from evalloom.operators import generate


def test_places_are_each_number_once(spark):
    n = 2_000_000
    rows = spark.range(n).select(F.xxhash64("id").alias("key"), "id", F.repeat(F.lit("x"), 20).alias("filler"))
    placed = generate.numbered(rows, "key")
    found = placed.agg(F.count("*").alias("rows"), F.count_distinct("n").alias("places"), F.min("n").alias("least"), F.max("n").alias("most")).first()
    assert (found.rows, found.places, found.least, found.most) == (n, n, 1, n)
    steps = placed.where("n <= 1000").orderBy("n").select("key").collect()
    assert steps == sorted(steps)


def test_places_within_groups(spark):
    rows = spark.range(300_000).select((F.col("id") % 7).alias("g"), F.xxhash64("id").alias("key"))
    found = generate.numbered(rows, "key", ["g"]).groupBy("g").agg(F.count("*").alias("c"), F.count_distinct("n").alias("d"), F.max("n").alias("m"))
    assert all(r.c == r.d == r.m for r in found.collect())
