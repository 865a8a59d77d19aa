import json

from pyspark.sql import functions as F

from evalloom.streaming import runs


def put(path, name, *rows):
    path.mkdir(exist_ok=True)
    (path / name).write_text("\n".join(json.dumps(dict(zip(("session", "run", "model", "metric", "value"), r, strict=True))) for r in rows))


def test_means_follow_runs(spark, tmp_path):
    source, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    put(source, "run_1.json", ("s", 1, "m", "f1", 0.2), ("s", 1, "k", "f1", 0.5))
    for _ in range(2):  # the second round finds nothing new
        runs.kept_up(runs.mean_std(runs.arriving(spark, str(source))), out, check).awaitTermination()
    put(source, "run_2.json", ("s", 2, "m", "f1", 0.6))
    runs.kept_up(runs.mean_std(runs.arriving(spark, str(source))), out, check).awaitTermination()
    found = {r.model: (r.runs, round(r.mean, 6), round(r.std, 6)) for r in runs.latest(spark, out).collect()}
    assert found == {"m": (2, 0.4, 0.282843), "k": (1, 0.5, 0.0)}


def test_broken_work_goes_on(spark, tmp_path):
    source = tmp_path / "in"
    put(source, "a.json", ("s", 1, "m", "f1", 0.2), ("s", 2, "m", "f1", None))
    for name in ("b.json", "c.json"):
        runs.resumed(runs.arriving(spark, str(source)), lambda d: d.where("value IS NOT NULL"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
        put(source, name, ("s", 3, "m", "f1", 0.4))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_windows(spark, small):
    events = spark.read.parquet(f"{small}/events.parquet").select("ts", F.col("event_type").alias("model"), "value")
    found = runs.windowed(events)
    assert found.agg(F.sum("n")).first()[0] == events.count()
