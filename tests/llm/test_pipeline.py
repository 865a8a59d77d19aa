"""The pipeline: what each stage does to what its predecessor kept."""

import random
import re
from collections import Counter

import corpus_pipeline
import public_tokenizers
import sentencepiece
from evalloom.llm import mixing, toxicity
from evalloom.llm.shared import stored


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, before, kept = docs.columns, docs, {}
    for name, stage in corpus_pipeline.STAGES:
        after = stored(stage(spark, before, small), "stage")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == columns
        kept[name], before = after, after
    ids = {n: Counter(r.doc_id for r in d.select("doc_id").collect()) for n, d in kept.items()}
    assert {*ids["toxicity"]} < {r.doc_id for r in docs.collect()}
    assert {*ids["near-duplicates"]} < {*ids["toxicity"]}
    assert ids["secrets"] == ids["near-duplicates"]
    assert {*ids["mixing"]} <= {*ids["secrets"]}
    assert ids["pieces"] == ids["mixing"]
    plain = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in kept["pieces"].collect():
        assert r.n_tokens == len(r.ids) and r.n_chars == len(r.text or "")
        assert [*r.ids] == plain.encode(r.text or "") and r.same_text == (plain.decode([*r.ids]) == (r.text or ""))
    asked = {r.doc_id: r.predicted for r in toxicity.rated(docs, docs, spark.read.parquet(f"{small}/labels.parquet")).collect()}
    assert {*ids["toxicity"]} == {i for i, predicted in asked.items() if not predicted}
    before = {r.doc_id: r.text for r in kept["near-duplicates"].collect()}
    for r in kept["secrets"].collect():
        assert not re.search("AKIA[A-Z0-9]{12,}|[0-9a-f]{32,}", r.text or "")
        if not re.search("AKIA|[0-9a-f]{32}|[A-Za-z0-9_-]{10}|://", before[r.doc_id] or ""):  # nothing that any rule could find
            assert r.text == before[r.doc_id]
    copies = {r.doc_id: r.copies for r in mixing.mix(kept["secrets"]).collect()}
    assert all(ids["mixing"][i] == n <= 3 for i, n in copies.items())


def test_empty_and_null_documents(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    spark.read.parquet(f"{small}/labels.parquet").write.parquet(f"file://{tmp_path}/labels.parquet")
    docs.where("false").write.parquet(f"file://{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
    odd = spark.createDataFrame([(None,) * len(docs.columns), (-1, *[None] * (len(docs.columns) - 1)), (-2, "", *[None] * (len(docs.columns) - 2))], docs.schema)
    assert docs.columns[:2] == ["doc_id", "text"]
    odd.write.mode("overwrite").parquet(f"file://{tmp_path}/documents.parquet")
    assert all(not r.ids and r.n_tokens == 0 for r in corpus_pipeline.run(spark, f"file://{tmp_path}").collect())


def test_run_is_the_stages(spark, small):
    rows = corpus_pipeline.run(spark, small)
    assert rows.columns == [*spark.read.parquet(f"{small}/documents.parquet").columns, "ids", "n_tokens", "same_text"]
    assert rows.count() > 0


def test_entry_point_has_all_queries():
    import __spark_entry__ as entry

    names = [*entry.queries()]
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert {*entry.oracle_sql()} <= {*names}


def test_near_duplicates_by_five_words(spark):
    """A text with scattered changes is close by pairs of words only, and stays; one with few changes goes."""
    rng = random.Random(4)
    rows = []
    for base in range(12):
        text = [f"b{base}w{i}" for i in range(200)]
        rows += [text, [f"x{base}" + w if i % 20 == 7 else w for i, w in enumerate(text)], [f"y{base}" + w if i in (50, 120) else w for i, w in enumerate(text)]]
        short = [rng.choice(["a", "b", "c"]) for _ in range(rng.randint(1, 9))]
        rows += [short, short + short[:2]]
    rows += ["a b a".split(), "a b a b a".split(), [], "q r s t".split(), "Q r s T".split(), "q r s t u".split()]
    frame = spark.createDataFrame([(i, " ".join(w), 1) for i, w in enumerate(rows)], "doc_id long, text string, n_chars long")

    def kept(width):
        sets = [{tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set() for w in ([x.lower() for x in w] for w in rows)]
        of = [*range(len(rows))]
        for _ in rows:
            for a in range(len(rows)):
                for b in range(a):
                    if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                        of[a] = of[b] = min(of[a], of[b])
        return {i for i, c in enumerate(of) if i == c}

    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, frame, "").collect()} == kept(5) != kept(2)
    assert {1, 6, 11} <= kept(5) and not {2, 7, 12} & kept(5) and not {1, 6, 11} & kept(2)


def test_columns_of_a_documents_own(spark, small):
    """Columns named like those that the stages work with come through as they are; repeated rows of an id stay or go together."""
    from pyspark.sql import functions as F

    names = ["score", "predicted", "kept", "component_id", "found", "copies", "mark", "ids", "decoded", "n_tokens"]
    docs = spark.read.parquet(f"{small}/documents.parquet").select("*", *(F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in names))
    docs = docs.union(docs.where("doc_id % 10 = 0"))
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stored(stage(spark, before, small), "stage")
        rows = after.select("doc_id", *(n for n in names if name != "pieces" or n not in ("ids", "n_tokens"))).collect()
        assert rows and all(r[n] == f"{n}{r.doc_id}" for r in rows for n in r.asDict() if n != "doc_id")
        if name in ("toxicity", "near-duplicates"):
            assert {r.doc_id: r["count"] for r in after.groupBy("doc_id").count().collect()}.items() <= {r.doc_id: r["count"] for r in docs.groupBy("doc_id").count().collect()}.items()
        before = after
    assert after.columns[-3:] == ["ids", "n_tokens", "same_text"] and after.columns.count("ids") == 1
