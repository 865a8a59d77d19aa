"""Streams against the same rows as a table, after restarts."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from evalloom.streaming import late
from evalloom.streaming.runs import latest

SCORES = "session string, run int, attempt long, model string, metric string, value double"


def test_runs_out_of_order_and_twice(spark, tmp_path):
    """Three starts of one query, each with new files; some rows come again in later files, older attempts come after newer ones."""
    rng = random.Random(3)
    rows = [(s, r, a, m, "f1", rng.random()) for s in "ab" for r in range(4) for a in range(3) for m in ("x", "y")]
    rows += rng.sample(rows, 12) + [("a", None, 1, "x", "f1", 0.5), ("a", 1, None, "x", "f1", 0.5), ("a", 9, 1, "x", "f1", None)]
    rng.shuffle(rows)
    folder, out, checkpoint = (f"{tmp_path}/{n}" for n in ("in", "out", "checkpoint"))
    third = len(rows) // 3 + 1
    for k in range(3):
        spark.createDataFrame(rows[k * third : (k + 1) * third], SCORES).repartition(2).write.mode("append").json(folder)
        stream = spark.readStream.schema(SCORES).option("maxFilesPerTrigger", 1).json(folder)
        late.kept_up(spark, stream, out, checkpoint).awaitTermination()
    want = {(r.session, r.model): (r.runs, r.mean, r.std) for r in late.batch_runs(spark.createDataFrame(rows, SCORES)).collect()}
    found = {(r.session, r.model): (r.runs, r.mean, r.std) for r in latest(spark, out).collect()}
    assert found.keys() == want.keys() and all(found[k] == pytest.approx(want[k]) for k in want)
    assert max(r.batch for r in spark.read.parquet(out).select("batch").collect()) >= 3


def test_truths_that_come_later(spark, tmp_path):
    """The stream's rows are the table's: matched ones as truths arrive, unmatched ones when the watermark has passed."""
    begin = dt.datetime(2024, 1, 1)
    minutes = lambda n: begin + dt.timedelta(minutes=n)
    said = [(k, "m", "A" if k % 3 else "B", minutes(k)) for k in range(60)]
    known = [(k, "A", minutes(k + (5 if k % 4 else 500))) for k in range(60) if k % 5]
    # What is later moves the watermarks past all of these.
    said_files = [said[:30], said[30:], [(900, "m", "A", minutes(5000))], [(901, "m", "A", minutes(9000))]]
    known_files = [known[:20], known[20:], [(902, "A", minutes(5000))], [(903, "A", minutes(9000))]]
    schemas = "id long, model string, prediction string, said_at timestamp", "id long, label string, known_at timestamp"
    for k in range(4):
        streams = []
        for name, files, schema in zip(("said", "known"), (said_files, known_files), schemas, strict=True):
            spark.createDataFrame(files[k], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
            streams.append(spark.readStream.schema(schema).parquet(f"{tmp_path}/{name}"))
        rows = late.with_truths(*streams)
        rows.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.parquet(f"{tmp_path}/out").where("id < 900")
    tables = [spark.createDataFrame([r for f in files for r in f], schema) for files, schema in zip((said_files, known_files), schemas, strict=True)]
    want = late.with_truths(*tables).where("id < 900")
    assert sorted(map(tuple, found.select("id", "prediction", "label").collect()), key=str) == sorted(map(tuple, want.select("id", "prediction", "label").collect()), key=str)
    row = late.scored(want).first()
    assert (row.n, row.known) == (60, sum(1 for k in range(60) if k % 5 and k % 4)) and 0 < row.accuracy < 1
    assert late.scored(want.limit(0)).collect() == [] and want.where(F.col("label").isNull()).count() == 60 - row.known
