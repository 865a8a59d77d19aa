import json

import pytest
from pyspark.sql import functions as F

from evalloom.sources import archive, corpora, sessions


def test_m2(spark, tmp_path):
    blocks = [
        "S He go to school .\nA 1 2|||R:VERB|||goes|||REQUIRED|||-NONE-|||0\nA 1 2|||R:VERB|||went|||REQUIRED|||-NONE-|||1",
        "S Fine as it is .\nA -1 -1|||noop|||-NONE-|||REQUIRED|||-NONE-|||0",
        "S a b c d\nA 0 1|||X|||A|||R|||-|||0\nA 2 3|||X|||C|||R|||-|||0\nA bad|||line",
        "S he is is here\nA 1 2|||U|||-NONE-|||R|||-|||0\nA 2 3|||U||||||R|||-|||0",
        "S no article\nA 1 1|||M|||the big|||R|||-|||0",
    ]
    (tmp_path / "x.m2").write_text("\n\n".join(blocks) + "\n")
    rows = [(r.incorrect, r.correct) for r in corpora.local(spark, f"{tmp_path}/x.m2").collect()]
    assert sorted(rows) == sorted([("He go to school .", "He goes to school ."), ("a b c d", "A b C d"), ("he is is here", "he is here"), ("no article", "no the big article")])
    assert [r.correct for r in corpora.m2(spark, f"{tmp_path}/x.m2", 1).collect()] == ["He went to school ."]


def test_delimited(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,label,text\n1,spam,"two\nlines, ""quoted"""\n2,ham,hi\n')
    (tmp_path / "b.tsv").write_text("label\ttext\nham\thi\n")
    rows = corpora.local(spark, f"{tmp_path}/a.csv").orderBy("id").collect()
    assert [r.asDict() for r in rows] == [{"id": "1", "label": "spam", "text": 'two\nlines, "quoted"'}, {"id": "2", "label": "ham", "text": "hi"}]
    assert corpora.local(spark, f"{tmp_path}/b.tsv").first().asDict() == {"label": "ham", "text": "hi"}
    (tmp_path / "c.tsv").write_text("x\ty\n")
    assert corpora.tsv(spark, f"{tmp_path}/c.tsv", ["original", "ground_truth"]).first().asDict() == {"original": "x", "ground_truth": "y"}
    for bad in ("x.txt", "missing.csv"):
        with pytest.raises(ValueError, match=bad):
            corpora.local(spark, f"{tmp_path}/{bad}")


def test_fields_and_labels(spark):
    rows = spark.createDataFrame([(1, "", "a b", "Spam"), (2, "x", "", None), (3, None, None, "ham"), (4, " y ", "z", " spam")], "i int, text string, message string, label string")
    assert {r.i: r.incorrect for r in corpora.ham(rows, ["i"]).collect()} == {2: "x", 4: " y "}
    assert {r.i: (r.text, r.label) for r in corpora.messages(rows, ["i"]).collect()} == {1: ("a b", "SPAM"), 2: ("x", "HAM"), 4: ("y", "SPAM")}
    pairs = spark.createDataFrame([("a", None, "b"), ("", "c", "d"), (None, None, "e")], "input string, incorrect string, target string")
    assert [(r.incorrect, r.correct) for r in corpora.pairs(pairs).collect()] == [("a", "b"), ("c", "d")]
    assert [r.i for r in corpora.first_usable(corpora.messages(rows, ["i"]), "i", 2).collect()] == [1, 2]
    assert corpora.dataset_settings({"dataset": {"name": "n", "split": "test"}, "dataset_split": "train", "dataset_subset": "s"}) == {"source": "huggingface", "name": "n", "split": "test", "subset": "s"}


@pytest.fixture
def root(tmp_path):
    def session(name, meta, results, profile=None):
        at = tmp_path / name
        (at / "generated").mkdir(parents=True)
        (at / "results.json").write_text(json.dumps({"meta": meta, "results": results}))
        if profile:
            (at / "profile.json").write_text(json.dumps(profile))
        for k in (1, 2, 10):
            (at / "generated" / f"run_{k}.json").write_text(json.dumps([{"text": f"t{k}", "label": "SPAM"}]))

    scores = {"org/m1": {"generated": {"f1": {"mean": 0.5, "std": 0.1}, "fpr": {"mean": 0.1, "std": 0}, "errant": {"f0.5": {"mean": 0.3}}}, "real": {"f1": 0.6, "errant": {"f0.5": 0.4}, "note": "x"}, "runs": [{"f1": 0.4, "errant": {"f0.5": 0.3}}, {"f1": 0.6}]}, "m2": {"generated": {"f1": {"mean": 0.7, "std": 0.0}}}}
    session("s/20250101_000000", {"task": "spam", "strategy": "class_conditional", "model": "g", "runs_completed": 1, "created": "2025-01-02"}, scores)
    session("s/20250102_000000", {"task": "spam", "mode": "inverse", "model": "g", "runs_completed": 3, "created": "2025-01-01"}, scores, {"real": {}})
    session("s/20250103_000000", {"task": "spam", "mode": "forward", "seedless": True, "model": "g", "runs_completed": 2, "created": "2025-01-01"}, scores)
    session("comparison", {"task": "spam", "model": "g"}, scores)
    (tmp_path / "s" / "other").mkdir()
    (tmp_path / "s" / "other" / "results.json").write_text('{"x": 1}')
    return str(tmp_path)


def test_sessions(spark, root):
    found = sessions.discover(spark, [root], profiles=True)
    assert sorted((r.dir[-15:], r.strategy, r.profile is not None) for r in found.collect()) == [("20250101_000000", "inverse", False), ("20250102_000000", "inverse", True), ("20250103_000000", "forward+seedless", False)]
    kept, gone = sessions.kept_and_superseded(found)
    assert sorted(r.dir[-15:] for r in kept.collect()) == ["20250102_000000", "20250103_000000"]
    assert [r.dir[-15:] for r in gone.collect()] == ["20250101_000000"]
    assert sessions.latest(found).first().dir.endswith("20250103_000000")
    assert not sessions.same_cell(found)
    tidy = sessions.tidy(sessions.latest(found))
    rows = {(r.eval_model, r.metric): (r.gen_mean, r.gen_std, r.real, r.runs) for r in tidy.collect()}
    assert rows == {("org/m1", "f1"): (0.5, 0.1, 0.6, [0.4, 0.6]), ("org/m1", "errant.f0.5"): (0.3, 0.0, 0.4, [0.3]), ("m2", "f1"): (0.7, 0.0, None, [])}
    assert sessions.run_scores(tidy).count() == 3
    assert sessions.strict(spark, f"{root}/s/20250102_000000").first().meta.runs_completed == 3
    with pytest.raises(ValueError, match="other"):
        sessions.strict(spark, f"{root}/s/other")
    table = archive.comparison(tidy).where("eval_model = 'org/m1'").first()
    assert table["gen.f1"] == "0.500±0.100" and table["real.f1"] == "0.600"
    assert archive.result_lines(tidy).where("line LIKE 'm1 f1%'").first().line == "m1 f1: 0.5000 ± 0.1000 (real 0.6000)"


def test_runs_and_merging(spark, root):
    rows = sessions.run_files(spark, [f"{root}/s/20250101_000000", f"{root}/s/20250102_000000"], "text string, label string")
    assert sorted(r.run for r in rows.collect()) == [1, 1, 2, 2, 10, 10]
    merged = sessions.renumbered(rows, [f"{root}/s/20250102_000000", f"{root}/s/20250101_000000"])
    assert sorted((r.run, r.text) for r in merged.collect()) == [(1, "t1"), (2, "t2"), (3, "t10"), (4, "t1"), (5, "t2"), (6, "t10")]
    assert sessions.differing_rows(rows.select("text"), rows.select("text")) == 0


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1)], "text string, n int")
    path = archive.session_path(str(tmp_path), "spam", "x", "v")
    for _ in range(2):
        archive.archive_run(rows, path, 1)
    assert spark.read.json(f"{path}/generated").select("text", "run").first().asDict() == {"text": "a", "run": 1}
    for k in range(2):
        archive.append_scores(spark.createDataFrame([("m", "f1", k, 0.5)], "model string, metric string, run int, value double"), path)
    assert spark.read.parquet(f"{path}/scores").count() == 2
    archive.save_profile({"a": rows, "b": rows.where("n > 5")}, f"{path}/profile")
    assert json.loads(spark.read.text(f"{path}/profile").first().value) == {"profile_version": 2, "a": [{"text": "a", "n": 1}], "b": []}
    todo = archive.unfinished(spark.range(4), spark.range(2), "id")
    assert sorted(r.id for r in todo.collect()) == [2, 3]
    archive.write_once(rows, f"{path}/once")
    archive.write_once(rows.union(rows), f"{path}/once")
    assert spark.read.parquet(f"{path}/once").select(F.count("*")).first()[0] == 1


def test_m2_with_line_ends_of_either_kind_and_blank_lines_of_spaces(spark, tmp_path):
    block = "S This are one\nA 1 2|||R:VERB|||is|||REQUIRED|||-NONE-|||0\n"
    (tmp_path / "a.m2").write_bytes(f"{block}\n{block}  \n{block}".replace("\n", "\r\n").encode())
    (tmp_path / "b.m2").write_bytes(f"{block}\n{block} \n{block}\n\n".encode())
    for name in ("a.m2", "b.m2"):
        assert [tuple(r) for r in corpora.m2(spark, f"file://{tmp_path}/{name}").collect()] == [("This are one", "This is one")] * 3


def test_sessions_are_merged_only_if_they_are_alike(spark, tmp_path):
    for name, model in (("one", "m"), ("two", "m"), ("three", "other")):
        (tmp_path / name / "generated").mkdir(parents=True)
        (tmp_path / name / "results.json").write_text(json.dumps({"meta": {"task": "spam", "mode": "forward", "model": model}, "results": {}}))
        for k in (1, 2):
            (tmp_path / name / "generated" / f"run_{k}.json").write_text(json.dumps([{"text": f"{name}{k}"}]))
    of = [f"file://{tmp_path}/{n}" for n in ("two", "one", "three")]
    found = sessions.merged(spark, of[:2], "text string")
    assert sorted((r.run, r.text) for r in found.collect()) == [(1, "two1"), (2, "two2"), (3, "one1"), (4, "one2")]
    for folders in ([of[0]], [of[0], of[0]], of):
        with pytest.raises(ValueError):
            sessions.merged(spark, folders, "text string")
