"""Every query with SQL against DuckDB on the same tables."""

import math

import duckdb
import pytest

from evalloom import queries, queries_analysis, queries_files, queries_models  # noqa: F401  (they add their queries to the library's)

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def plain(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])

    def value(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else f"{v:.9g}"
        return str(int(v) if isinstance(v, bool) else v)

    return sorted(tuple(value(float(r[k]) if isinstance(r[k], (int, float)) and not isinstance(r[k], bool) else r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, duck, small, name):
    got = queries.QUERIES[name](spark, small)
    want = duck.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert plain(got.columns, got.collect()) == plain(names, want.fetchall())


def test_similarity_without_sql(spark, small):
    from difflib import SequenceMatcher

    rows = {r.pair_id: r for r in queries.turns(spark, small).collect()}
    for r in queries.QUERIES["sequence_similarity"](spark, small).collect():
        x = rows[r.pair_id]
        assert r.similarity == SequenceMatcher(None, x.input or "", x.output or "").ratio()


def test_choices_without_sql(spark, small):
    one, two = (sorted((r.doc_id, tuple(r.signals)) for r in queries.QUERIES["weighted_choices"](spark, small).collect()) for _ in range(2))
    assert one == two and all(1 <= len(s) <= 3 and len({*s}) == len(s) for _, s in one)


def test_buckets_without_sql(spark, small):
    from collections import defaultdict
    from difflib import SequenceMatcher

    want = defaultdict(list)
    for r in queries.turns(spark, small).collect():
        x = round(SequenceMatcher(None, r.input or "", r.output or "").ratio(), 4)
        want["very_similar" if x >= 0.9 else "moderately_changed" if x >= 0.75 else "heavily_changed"].append(x)
    found = {r.bucket: (r.n, r.mean_similarity) for r in queries.QUERIES["pair_buckets"](spark, small).collect()}
    assert found == {b: (len(x), pytest.approx(sum(x) / len(x), abs=1e-6)) for b, x in want.items()}


def test_edit_types_without_sql(spark, small):
    """Counted plainly from the same annotator's edits."""
    from collections import Counter

    from pyspark.sql import functions as F

    from evalloom.operators import edits

    rows = queries.turns(spark, small).withColumn("e", edits.annotator()(F.col("input"), F.col("output"))).collect()
    assert rows and any(r.e for r in rows)
    found = {r.type: r.n for r in queries.QUERIES["edit_types"](spark, small).collect()}
    assert found == Counter(e.type for r in rows for e in r.e or ())
