"""More named queries with SQL: fields of responses, files that are written and read back, draws, and whole sessions."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import parse, vocab
from .functions import text as T
from .operators import edits, fidelity, generate, metrics, profile, runs, sampling
from .plans import report, tasks
from .queries import _LABELLED, _SCORES, _spaced, _TURNS, _WS, labelled, query, table, turns
from .queries import scores as daily_scores
from .session import settled, shared_path
from .sources import archive, corpora, sessions

_CLEAN = "coalesce({}, '')"
#: A turn as one line, where a format is one of lines; else whole turns are taken as they are.
_LINE = "trim(regexp_replace(coalesce({}, ''), '[\\r\\n]+', ' ', 'g'))"
_NL = "chr(10)"
# Scores with some thirty days as a run.
_MONTHS = _SCORES.replace("CAST(dayofyear(ts) AS BIGINT)", "CAST(dayofyear(ts) // 31 AS BIGINT)")
# What a client might have answered to a pair of turns, by conversation.
_RESP = f"""{_TURNS}, a AS (SELECT pair_id, conv_id, {_CLEAN.format("input")} AS a, {_CLEAN.format("output")} AS b FROM t),
    al AS (SELECT pair_id, conv_id, {_LINE.format("input")} AS a, {_LINE.format("output")} AS b FROM t),
    q AS (SELECT *, CASE conv_id % 6 WHEN 0 THEN '<think>' || a || '</think>' || {_NL} || 'Error type: spelling' || {_NL} || 'Generated: ' || a || {_NL} || 'Ground truth: ' || b
        WHEN 1 THEN '  Text: ' || a || ' ' || {_NL} || 'generated:' || b WHEN 2 THEN 'I''m sorry, ' || a WHEN 3 THEN '<think> Generated: x' || {_NL} || 'so Generated: ' || b WHEN 4 THEN b
        ELSE a || {_NL} || b END AS raw FROM a),
    x AS (SELECT *, regexp_replace(regexp_replace(raw, '(?is)<think>.*?</think>', '', 'g'), '^{_WS}|{_WS}$', '', 'g') AS x FROM q)"""


def _clean(column: str) -> Column:
    """The whole turn, line ends and all."""
    return F.coalesce(column, F.lit(""))


def plain_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select("pair_id", "conv_id", _clean("input").alias("a"), _clean("output").alias("b"))


def line_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as one line each, for formats of lines."""
    return plain_turns(spark, sf_dir).withColumns({c: F.trim(F.regexp_replace(c, "[\r\n]+", " ")) for c in "ab"})


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_scores(spark, sf_dir).withColumn("run", F.floor(F.col("run") / 31))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, k = F.col("a"), F.col("b"), F.col("conv_id") % 6

    def said(*parts) -> Column:
        return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))

    raw = (
        F.when(k == 0, said("<think>", a, "</think>\nError type: spelling\nGenerated: ", a, "\nGround truth: ", b))
        .when(k == 1, said("  Text: ", a, " \ngenerated:", b))
        .when(k == 2, said("I'm sorry, ", a))
        .when(k == 3, said("<think> Generated: x\nso Generated: ", b))
        .when(k == 4, b)
        .otherwise(said(a, "\n", b))
    )
    return plain_turns(spark, sf_dir).withColumn("raw", raw)


def _field(name: str) -> str:
    anywhere = f"nullif(trim(list_last(regexp_extract_all(x, '(?i){name}:[ \\t]*(.+)', 1))), '')"
    line = rf"(?im)^\s*{name}:\s*(.+?)\s*$"
    return f"CASE WHEN starts_with(lower(x), '<think>') THEN {anywhere} WHEN regexp_matches(x, '{line}') THEN trim(regexp_extract(x, '{line}', 1)) END"


@query(f"WITH {_RESP} SELECT pair_id, x AS answer FROM x")
def responses_without_reasoning(spark, sf_dir):
    return responses(spark, sf_dir).select("pair_id", parse.without_reasoning(F.col("raw")).alias("answer"))


@query(f"WITH {_RESP} SELECT pair_id, starts_with(lower(x), '<think>') AS reasoning, NOT starts_with(lower(x), '<think>') AND regexp_matches(left(x, 400), '{parse.REFUSAL.replace(chr(39), chr(39) * 2)}') AS refusal FROM x")
def response_kinds(spark, sf_dir):
    raw = F.col("raw")
    return responses(spark, sf_dir).select("pair_id", parse.is_reasoning(parse.without_reasoning(raw)).alias("reasoning"), parse.is_refusal(raw).alias("refusal"))


@query(f"WITH {_RESP} SELECT pair_id, {_field('Error[ ]*type')} AS error_type, {_field('Generated')} AS corrupted, {_field('Ground[ ]*truth')} AS gold FROM x")
def response_fields(spark, sf_dir):
    return responses(spark, sf_dir).select("pair_id", parse.generation(F.col("raw")).alias("g")).select("pair_id", "g.*")


@query(f"WITH {_RESP} SELECT pair_id, coalesce({_field('Text')}, CASE WHEN x <> '' AND NOT contains(x, {_NL}) THEN x END) AS said FROM x")
def tagged_responses(spark, sf_dir):
    return responses(spark, sf_dir).select("pair_id", parse.tagged(F.col("raw"), "Text").alias("said"))


@query(f"WITH {_TURNS} SELECT pair_id, NOT (conv_id % 3 = 0 OR conv_id % 5 = 0) AS kept FROM t")
def judged_pairs(spark, sf_dir):
    """Verdicts in any case, one of them missing for some."""
    raw = F.concat(F.when(F.col("conv_id") % 3 == 0, "Redundancy: TRIVIAL\n").when(F.col("conv_id") % 3 == 1, "redundancy: valid\n").otherwise(""), F.when(F.col("conv_id") % 5 == 0, " Correction: incorrect").otherwise("Correction: Correct"))
    return turns(spark, sf_dir).select("pair_id", parse.judge_keeps(raw).alias("kept"))


@query(f"WITH {_RESP} SELECT pair_id, CASE WHEN a <> '' AND b <> '' THEN a || '/' || b END AS lines FROM al")
def numbered_answers(spark, sf_dir):
    raw = F.concat(F.lit("Here you are:\n1. "), F.col("a"), F.lit("\n\n 2) "), F.col("b"), F.lit("\n"))
    rows = line_turns(spark, sf_dir).withColumn("raw", F.when((F.col("a") != "") & (F.col("b") != ""), raw).otherwise("1. only"))
    return rows.select("pair_id", F.array_join(parse.numbered(F.col("raw"), F.lit(2)), "/").alias("lines"))


@query(f"WITH {_RESP} SELECT pair_id, CASE WHEN b <> '' THEN '1=again,3=' || lower(b) ELSE '1=again' END AS labels FROM al")
def answer_labels(spark, sf_dir):
    """Lines of labels: the last of a place counts, places beyond the expected ones don't."""
    raw = F.concat(F.lit("1. First\n1: again\n9) beyond\nprose\n3 - "), F.col("b"))
    found = parse.labels(raw, F.lit(3))
    return line_turns(spark, sf_dir).select("pair_id", F.array_join(F.transform(found, lambda x: F.concat_ws("=", x["place"].cast("string"), x["label"])), ",").alias("labels"))


@query(f"WITH {_RESP}, m AS (SELECT pair_id, unnest(CASE WHEN conv_id % 2 = 0 THEN ['one', 'two', 'two'] ELSE ['two'] END) AS topic, unnest(CASE WHEN conv_id % 2 = 0 THEN ['a', 'b', 'c'] ELSE ['d'] END) AS member FROM a) SELECT pair_id, topic, member FROM m")
def topic_members(spark, sf_dir):
    """Topics of a JSON object in fences or prose, one row a member."""
    raw = F.when(F.col("conv_id") % 2 == 0, 'So:\n```json\n{"one": {"description": "x", "members": ["a"]}, "two": {"members": ["b", "c"]}}\n```').otherwise('{"two": {"members": ["d"]}} done')
    rows = turns(spark, sf_dir).select("pair_id", F.explode(parse.topics(raw)).alias("topic", "t"))
    return rows.select("pair_id", "topic", F.explode("t.members").alias("member"))


@query(f"WITH {_RESP} SELECT pair_id, CASE WHEN conv_id % 3 <> 2 AND a <> '' AND b <> '' THEN a || '/' || b END AS rewrites FROM al")
def indexed_rewrites(spark, sf_dir):
    a, b, k = F.col("a"), F.col("b"), F.col("conv_id") % 3
    raw = F.when(k == 0, F.concat(F.lit("[1] Generated: "), a, F.lit("\n[2] Generated:"), b)).when(k == 1, F.concat(F.lit("- Generated: "), a, F.lit("\n- Generated: "), b)).otherwise("[1] Generated: lone")
    rows = line_turns(spark, sf_dir).withColumn("raw", F.when((a == "") | (b == ""), "Generated: x").otherwise(raw))
    return rows.select("pair_id", F.array_join(parse.indexed_rewrites(F.col("raw"), F.lit(2)), "/").alias("rewrites"))


@query(f"WITH {_RESP} SELECT pair_id, CASE WHEN conv_id % 2 = 0 AND a <> '' AND b <> '' THEN a || '/' || b || '/c/d' END AS pairs, conv_id % 3 <> 0 AS first_kept, conv_id % 5 <> 0 AS second_kept FROM al")
def indexed_pairs(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    raw = F.concat(F.lit("[2] Generated: c\n[1] Generated: x\n[1] Generated: "), a, F.lit("\n[1] Ground truth: "), b, F.when(F.col("conv_id") % 2 == 0, "\n[2] Ground truth: d").otherwise(""))
    verdicts = F.concat(F.when(F.col("conv_id") % 3 == 0, "[1] redundancy: Trivial\n").otherwise("[1] Redundancy: valid\n"), F.when(F.col("conv_id") % 5 == 0, "[2] Correction: incorrect").otherwise(""))
    rows = line_turns(spark, sf_dir).select("pair_id", F.when((a != "") & (b != ""), parse.indexed_pairs(raw, F.lit(2))).alias("p"), parse.indexed_verdicts(verdicts, F.lit(2)).alias("v"))
    return rows.select("pair_id", F.array_join(F.flatten(F.transform("p", lambda x: F.array(x["corrupted"], x["gold"]))), "/").alias("pairs"), F.get("v", F.lit(0)).alias("first_kept"), F.get("v", F.lit(1)).alias("second_kept"))


_FILED = "f AS (SELECT doc_id, translate(coalesce(text, ''), chr(13), ' ') AS text, lang FROM documents)"


def filed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.translate(F.coalesce("text", F.lit("")), "\r", " ").alias("text"), "lang")


def _written(rows: DataFrame, spark: SparkSession, **options) -> str:
    path = shared_path(spark, "files")
    rows.write.options(quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, **options).csv(path)
    return path


@query(f"WITH {_FILED} SELECT doc_id::VARCHAR AS doc_id, md5(text) AS digest, lang FROM f")
def csv_scan(spark, sf_dir):
    """Documents with line ends and quotes, written as csv and scanned."""
    rows = corpora.csv(spark, _written(filed(spark, sf_dir), spark, header=True))
    return rows.select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"), "lang")


@query(f"WITH {_FILED} SELECT doc_id::VARCHAR AS id, md5(text) AS digest FROM f")
def headerless_tsv_scan(spark, sf_dir):
    path = _written(filed(spark, sf_dir), spark, header=False, sep="\t")
    return corpora.tsv(spark, path, ["id", "body", "lang"]).select("id", F.md5(F.coalesce("body", F.lit("")).cast("binary")).alias("digest"))


@query(f"WITH {_RESP}, w AS (SELECT list_filter(string_split(a, ' '), lambda x: x <> '') AS w FROM al) SELECT array_to_string(w, ' ') AS incorrect, array_to_string(list_concat(['Edited'], w[2:]), ' ') || ' end' AS correct FROM w WHERE len(w) > 1")
def m2_scan(spark, sf_dir):
    """Sentences with a replacement, an insertion, another annotator's edit and a line that is no edit, as M2 blocks with line ends of either kind."""
    words = T.spaced(F.col("a"))
    n = F.size(words).cast("string")
    block = F.concat(F.lit("S "), F.array_join(words, " "), F.lit("\nA 0 1|||R:X|||Edited|||REQUIRED|||-NONE-|||0\nA "), n, F.lit(" "), n, F.lit("|||M:X|||end|||REQUIRED|||-NONE-|||0\nA 0 2|||U:X||||||REQUIRED|||-NONE-|||1\nA broken"))
    rows = line_turns(spark, sf_dir).where(F.size(words) > 1)
    folder = shared_path(spark, "m2")
    for k, end in enumerate(("\n", "\r\n")):
        rows.where(F.col("conv_id") % 2 == k).select(F.regexp_replace(block, "\n", end)).write.option("lineSep", end + end).text(f"{folder}/{k}")
    return corpora.m2(spark, f"{folder}/0").unionByName(corpora.m2(spark, f"{folder}/1"))


_ODD = "o AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE source END AS input, lang AS text, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE source END AS correct, CASE doc_id % 4 WHEN 0 THEN 'Spam' WHEN 1 THEN '1' WHEN 2 THEN NULL ELSE ' ham' END AS label, (doc_id % 4)::VARCHAR AS opinion FROM documents)"


def odd_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.when(i % 3 == 0, "").when(i % 3 == 2, F.col("source")).alias("input"), F.col("lang").alias("text"), F.when(i % 5 != 0, F.col("source")).alias("correct"),
                       F.when(i % 4 == 0, "Spam").when(i % 4 == 1, "1").when(i % 4 == 3, " ham").alias("label"), (i % 4).cast("string").alias("opinion"))


@query(f"WITH {_ODD} SELECT doc_id, coalesce(nullif(input, ''), nullif(text, '')) AS incorrect, nullif(correct, '') AS correct FROM o WHERE nullif(correct, '') IS NOT NULL AND coalesce(nullif(input, ''), nullif(text, '')) IS NOT NULL")
def pair_rows(spark, sf_dir):
    return corpora.pairs(odd_fields(spark, sf_dir), ["doc_id"])


@query(f"WITH {_ODD} SELECT doc_id, text AS incorrect FROM o WHERE lower(coalesce(label, '')) NOT IN ('spam', '1') AND nullif(text, '') IS NOT NULL")
def ham_rows(spark, sf_dir):
    return corpora.ham(odd_fields(spark, sf_dir), ["doc_id"])


@query(f"WITH {_ODD} SELECT doc_id, text AS incorrect, CASE opinion WHEN '0' THEN 'NEGATIVE' WHEN '1' THEN 'NEUTRAL' WHEN '2' THEN 'POSITIVE' ELSE opinion END AS sentiment_label FROM o WHERE nullif(text, '') IS NOT NULL")
def opinion_rows(spark, sf_dir):
    return corpora.opinions(odd_fields(spark, sf_dir), ["doc_id"], "opinion")


_KINDS = ("to_negative", "sarcasm_injection", "make_POSITIVE", "intensity_reduction", "paraphrase")


@query("WITH k AS (SELECT doc_id, ['" + "', '".join(_KINDS) + "'][(doc_id % 5 + 1)::INT] AS k FROM documents) SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'NEGATIVE' WHEN 1 THEN 'NEGATIVE' WHEN 2 THEN 'POSITIVE' WHEN 3 THEN 'NEUTRAL' END AS truth, CASE WHEN k = 'paraphrase' THEN 'HAM' ELSE 'SPAM' END AS label FROM k")
def rewritten_labels(spark, sf_dir):
    """What a kind of rewriting makes of a text, for opinions and for messages of older runs."""
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("doc_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", T.sentiment_truth(kind).alias("truth"), tasks.legacy_spam_label(kind).alias("label"))


@query(r"SELECT doc_id, lower(regexp_replace(regexp_replace(source || '/' || lang, '[^0-9a-zA-Z]+', '_', 'g'), '^_+|_+$', '', 'g')) AS slug, lang AS last, 'Put {a} in: ' || lang || '! ' || coalesce(source, '') AS prompt, 'more; ' || lang AS asked FROM documents")
def names_and_prompts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    name = F.concat_ws("/", "source", "lang")
    asked = generate.described(F.array(F.lit("m"), F.col("lang")), {"m": "more"})
    return docs.select("doc_id", T.slug(name).alias("slug"), T.last_segment(name).alias("last"), generate.filled("Put {{a}} in: {b}! {c}", b=F.col("lang"), c=F.col("source")).alias("prompt"), asked.alias("asked"))


def _draw(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 13))::BIGINT"


def _unit(key: str, name: str, seed: int = 1) -> str:
    return f"(({_draw(key, repr(name), str(seed))} + 0.5) / 4503599627370496.0)"


@query(f"SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (ORDER BY {_draw('doc_id', '3')}, doc_id) AS k FROM documents) WHERE k <= 50")
def uniform_sample(spark, sf_dir):
    """A sampling operator: 50 documents, all equally likely."""
    return sampling.sample(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", 50, 3)


@query(f"SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_draw('doc_id', '4')}, doc_id) AS k FROM documents) WHERE k <= 20")
def sample_by_group(spark, sf_dir):
    """A sampling operator: 20 documents of each language."""
    return sampling.sample_by(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", ["lang"], 20, 4)


_U = _unit("doc_id", "kind")
_STYLE_RATES = {"question": 0.25, "digit": 0.5, "slang": 0.0625}


@query(
    f"""SELECT doc_id, CASE WHEN {_U} <= 0.5 THEN 'one' WHEN {_U} <= 0.75 THEN 'two' ELSE 'three' END AS kind,
    array_to_string(list_filter([{", ".join(f"CASE WHEN {_unit('doc_id', f'feature {k}')} < {r} THEN '{k}' END" for k, r in _STYLE_RATES.items())}], lambda x: x IS NOT NULL), ',') AS features,
    (5 + floor({_unit("doc_id", "words")} * 16))::INT AS words FROM documents"""
)
def weighted_draws(spark, sf_dir):
    """A weighted key, independent features and a length for each document."""
    key = F.col("doc_id")
    kind = sampling.choice(sampling.uniform(key, "kind", 1), {"one": 2.0, "none": -1.0, "two": 1.0, "three": 1.0})
    words = sampling.whole_number(sampling.uniform(key, "words", 1), F.lit(5), F.lit(20))
    return table(spark, sf_dir, "documents").select("doc_id", kind.alias("kind"), F.array_join(sampling.features(key, _STYLE_RATES, 1), ",").alias("features"), words.alias("words"))


_WEIGHTS = {"a": 0.4, "b": 0.3, "c": 0.2, "d": 0.1}


@query(
    f"""WITH k AS (SELECT doc_id, unnest([{", ".join(f"'{k}'" for k in _WEIGHTS)}]) AS k, unnest([{", ".join(f"-ln({_unit('doc_id', f'key {k}')}) / {w}" for k, w in _WEIGHTS.items())}]) AS late FROM documents),
    r AS (SELECT doc_id, k, row_number() OVER (PARTITION BY doc_id ORDER BY late) AS place FROM k) SELECT doc_id, string_agg(k, ',' ORDER BY place) AS keys FROM r WHERE place <= 2 GROUP BY doc_id"""
)
def two_distinct_draws(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(sampling.distinct_choices(F.col("doc_id"), F.lit(2), _WEIGHTS, 1), ",").alias("keys"))


@query(f"WITH {_MONTHS} SELECT mode, model, run, count(*) AS n, round(sum(value), 4) AS total FROM e GROUP BY ALL")
def archived_runs(spark, sf_dir):
    """Two runs are archived, one of them twice, and read back: what is there again replaces what was there."""
    path, rows = shared_path(spark, "session"), scores(spark, sf_dir)
    for k, part in ((1, rows.where("mode = 'forward'")), (2, rows.where("mode = 'forward'")), (2, rows.where("mode = 'inverse'"))):
        archive.archive_run(part.withColumnRenamed("run", "day"), path, k)
    back = spark.read.schema("model string, day long, mode string, user_id long, value double, run int").json(f"{path}/generated")
    return back.groupBy("mode", "model", F.col("day").alias("run")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(f"WITH {_MONTHS} SELECT model, run, round(avg(value), 6) AS value FROM e GROUP BY ALL")
def appended_scores(spark, sf_dir):
    """Scores of runs, some of which are tried again: each run counts once."""
    path = shared_path(spark, "session")
    rows = scores(spark, sf_dir).groupBy("model", "run").agg(F.avg("value").alias("value")).withColumn("metric", F.lit("m")).select("model", "metric", F.col("run").cast("int").alias("run"), "value")
    for part in (rows.where("run <= 7"), rows.where("run >= 5")):
        archive.append_scores(part, path)
    return spark.read.parquet(f"{path}/scores").select("model", F.col("run").cast("long").alias("run"), F.round("value", 6).alias("value"))


@query("SELECT doc_id, lang FROM documents")
def written_once(spark, sf_dir):
    """What is there already stays as it is."""
    path, docs = shared_path(spark, "once"), table(spark, sf_dir, "documents").select("doc_id", "lang")
    for rows in (docs, docs.withColumn("lang", F.lit("later"))):
        archive.write_once(rows, path)
    return spark.read.parquet(path)


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unfinished_rows(spark, sf_dir):
    return archive.unfinished(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query(f"WITH {_LABELLED} SELECT label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM l GROUP BY label")
def saved_profile(spark, sf_dir):
    """A profile saved as one JSON document and read again."""
    path = shared_path(spark, "profile")
    archive.save_profile({"labels": profile.label_shares(labelled(spark, sf_dir), "label")}, path)
    found = spark.read.text(path).select(F.from_json("value", "STRUCT<profile_version: INT, labels: ARRAY<STRUCT<label: STRING, n: BIGINT, share: DOUBLE>>>").alias("p")).where("p.profile_version = 2")
    return found.select(F.inline("p.labels")).select("label", "n", F.round("share", 6).alias("share"))


_MEANS = f"{_MONTHS}, v AS (SELECT mode, model, run, round(avg(value), 4) AS value FROM e GROUP BY ALL), g AS (SELECT mode, model, avg(value) AS m, coalesce(stddev_samp(value), 0) AS s, list(value ORDER BY run) AS runs FROM v GROUP BY ALL)"


def session_documents(spark: SparkSession, sf_dir: str) -> str:
    """Two sessions, of either mode, whose results are means of months: a folder of documents as a run leaves them."""
    path = shared_path(spark, "sessions")
    by_run = scores(spark, sf_dir).groupBy("mode", "model", "run").agg(F.round(F.avg("value"), 4).alias("value"))
    found: dict[str, dict] = {}
    for r in by_run.orderBy("mode", "model", "run").collect():  # some hundred means
        found.setdefault(r["mode"], {}).setdefault(r["model"], []).append(r["value"])
    for mode, models in found.items():
        results = {}
        for model, values in models.items():
            m = sum(values) / len(values)
            s = (sum((v - m) ** 2 for v in values) / max(1, len(values) - 1)) ** 0.5
            results[model] = {"generated": {"f1": {"mean": m, "std": s}, "fpr": {"mean": 0.1, "std": 0}, "edits": {"recall": {"mean": 0.5, "std": 0.25}}, "note": "x"}, "real": {"f1": values[0], "edits": {"recall": 0.75}}, "runs": [{"f1": v} for v in values]}
        for k in (1, 2):  # the second session of a mode has fewer runs
            meta = {"task": "spam", "mode": mode, "model": "g", "runs_completed": 3 - k, "created": f"2026-01-0{k}"}
            archive.save_document(spark, f"{path}/{mode}{k}/results.json", json.dumps({"meta": meta, "results": results if k == 1 else {}}))
    archive.save_document(spark, f"{path}/comparison/results.json", "{}")
    archive.save_document(spark, f"{path}/other/results.json", '{"meta": null}')
    return path


def tidy_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, _ = sessions.kept_and_superseded(sessions.discover(spark, [session_documents(spark, sf_dir)]))
    return sessions.tidy(kept)


@query(f"WITH {_MEANS} SELECT mode AS strategy, model AS eval_model, 'f1' AS metric, round(m, 4) AS gen_mean, round(s, 4) AS gen_std, runs[1] AS real, len(runs) AS n FROM g UNION ALL SELECT mode, model, 'edits.recall', 0.5, 0.25, 0.75, 0 FROM g")
def tidy_results(spark, sf_dir):
    """Documents of sessions, found, sifted and flattened: hidden metrics and superseded sessions are not there."""
    return tidy_sessions(spark, sf_dir).select("strategy", "eval_model", "metric", F.round("gen_mean", 4).alias("gen_mean"), F.round("gen_std", 4).alias("gen_std"), "real", F.size("runs").cast("long").alias("n"))


@query(f"WITH {_MEANS} SELECT mode AS strategy, model AS eval_model, unnest(range(1, len(runs) + 1)) AS run, unnest(runs) AS value FROM g")
def session_runs(spark, sf_dir):
    rows = sessions.run_scores(tidy_sessions(spark, sf_dir).where("metric = 'f1'"))
    return rows.select("strategy", "eval_model", F.col("run").cast("long").alias("run"), "value")


@query(f"WITH {_MEANS} SELECT 'spam' AS task, mode AS strategy, 'g' AS gen_model, round((avg(abs(m - runs[1])) + 0.25) / 2, 4) AS mean_abs_gap, round(avg(m - runs[1]), 4) AS mean_headline_gap FROM g GROUP BY mode")
def fidelity_gaps(spark, sf_dir):
    found = runs.fidelity_gap(tidy_sessions(spark, sf_dir), {"spam": "f1"})
    return found.select("task", "strategy", "gen_model", F.round("mean_abs_gap", 4).alias("mean_abs_gap"), F.round("mean_headline_gap", 4).alias("mean_headline_gap"))


@query(f"WITH {_MEANS} SELECT model AS eval_model, round(max(m) FILTER (mode = 'inverse') - max(m) FILTER (mode = 'forward'), 4) AS delta FROM g GROUP BY model HAVING count(*) = 2")
def session_mode_effect(spark, sf_dir):
    return report.summary(tidy_sessions(spark, sf_dir))["mode_effect"].where("metric = 'f1'").select("eval_model", F.round("delta", 4).alias("delta"))


@query(f"WITH {_MEANS} SELECT mode, model, 'f1' AS metric, round(m, 4) AS gen_mean, CASE WHEN max(greatest(m, runs[1])) OVER () <= 1 THEN 'unit' ELSE 'large' END AS scale FROM g")
def chart_bars(spark, sf_dir):
    rows = report.bars(tidy_sessions(spark, sf_dir).where("metric = 'f1'").withColumn("eval_model", F.concat_ws("/", "strategy", "eval_model")))
    parts = F.split("eval_model", "/")
    return rows.select(parts[0].alias("mode"), parts[1].alias("model"), "metric", F.round("gen_mean", 4).alias("gen_mean"), "scale")


@query(f"WITH {_MONTHS} SELECT model, count(*) AS runs, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM e GROUP BY model")
def population_std(spark, sf_dir):
    return runs.mean_std(scores(spark, sf_dir), ["model"], population=True).select("model", "runs", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(f"WITH {_LABELLED} SELECT round(avg((label = 'SPAM')::INT), 9) AS share FROM l")
def class_share(spark, sf_dir):
    return metrics.class_share(labelled(spark, sf_dir), "label", "SPAM").select(F.round("share", 9).alias("share"))


_STRATEGY = "CASE WHEN doc_id % 3 = 0 THEN 'inverse' WHEN doc_id % 3 = 1 THEN 'forward' WHEN doc_id % 2 = 0 THEN 'inverse' ELSE 'forward' END || CASE WHEN doc_id % 5 = 0 THEN '+seedless' ELSE '' END"


@query(f"SELECT doc_id, {_STRATEGY} AS strategy FROM documents")
def strategies(spark, sf_dir):
    i = F.col("doc_id")
    mode = F.when(i % 3 == 0, "inverse").when(i % 3 == 1, "forward").when(i % 4 == 0, "")
    return table(spark, sf_dir, "documents").select("doc_id", runs.strategy(mode, F.when(i % 2 == 0, "class_conditional").otherwise("pairs"), F.when(i % 5 == 0, True)).alias("strategy"))


# Edits by place: what a turn was changed to, and what it ought to have been changed to (some endings are others there). Accented letters count as one for DuckDB's levenshtein if they are one byte.
_IRREGULAR = "MAP {" + ", ".join(f"'{w}': ['{b}', '{f}']" for w, (b, f) in edits.irregular().items()) + "}"
_ONE_BYTE = "translate({}, 'éèêçüäößñáíóúà¿¡', 'ABCDEFGHIJKLMNOP')"
_IN = lambda c, of: f"coalesce({c} IN ({', '.join(repr(w) for w in sorted(of))}), false)"
_MARKS = vocab.PUNCTUATION.replace("'", "''")


def _base(w: str) -> str:
    y = f"regexp_replace({w}, '^(.{{2,}}?)(?:ies|ied|ier|iest|ily)$', '\\1y')"
    return f"coalesce({_IRREGULAR}[{w}][1], list_transform([regexp_replace(CASE WHEN {y} <> {w} THEN {y} ELSE regexp_replace({w}, '^(.{{2,}}?)(?:ing|ed|es|est|er|ly|s|e)$', '\\1') END, '^(.{{2,}}?)e+$', '\\1')], lambda z: CASE WHEN regexp_matches(z, '(bb|dd|gg|ll|mm|nn|pp|rr|ss|tt)$') THEN left(z, length(z) - 1) ELSE z END)[1])"


def _form(w: str) -> str:
    cases = " ".join(f"WHEN regexp_matches({w}, '^.{{2,}}{e}$') THEN '{f}'" for e, f in edits.ENDINGS)
    return f"coalesce({_IRREGULAR}[{w}][2], CASE {cases} ELSE 'base' END)"


def _edits(column: str, side: str) -> str:
    """(pair_id, model, start, end, type) of input and a column by place."""
    words = f"{side}w AS (SELECT pair_id, conv_id % 3 AS model, {_spaced('input')} AS a, {_spaced(column)} AS b FROM u)"
    places = f"{side}p AS (SELECT pair_id, model, least(i, len(a))::INT AS s, least(i + 1, len(a))::INT AS e, lower(a[i + 1]) AS x, lower(b[i + 1]) AS y, lower(a[i]) AS l, i < len(a) AS xs, i < len(b) AS ys FROM {side}w, range(greatest(len(a), len(b))) r(i) WHERE a[i + 1] IS DISTINCT FROM b[i + 1])"
    forms = f"{side}f AS (SELECT *, {_base('x')} AS xb, {_base('y')} AS yb, {_form('x')} AS xf, {_form('y')} AS yf, {_ROOT.format('x')} AS xr, {_ROOT.format('y')} AS yr, coalesce(x, y) AS w FROM {side}p)"
    either = lambda *f: f"(xf IN {f} OR yf IN {f})".replace(",)", ")")
    past = "('past', 'past_s', 'ed')"
    verbs = {w for line in edits.VERBS.split(";") for w in line.split()}
    alone = f"CASE WHEN translate(w, '{_MARKS}', '') = '' THEN 'PUNCT' WHEN {_IN('w', edits.DETERMINERS)} THEN 'DET' WHEN {_IN('w', edits.PREPOSITIONS)} THEN 'PREP' WHEN {_IN('w', edits.PRONOUNS)} THEN 'PRON' WHEN {_IN('w', edits.AUXILIARIES)} THEN 'VERB:TENSE' ELSE 'OTHER' END"
    same = " ".join(f"WHEN {_IN('x', c)} AND {_IN('y', c)} THEN '{n}'" for n, c in (("DET", edits.DETERMINERS), ("PREP", edits.PREPOSITIONS), ("PRON", edits.PRONOUNS)))
    inflected = f"""CASE WHEN {either('er', 'est')} THEN 'ADJ' WHEN {either('ly')} THEN 'MORPH' WHEN {either('plural')} THEN 'NOUN:NUM' WHEN {either('ing', 'part')} THEN 'VERB:FORM' WHEN xf IN {past} AND yf IN {past} THEN CASE WHEN {either('past_s')} THEN 'VERB:SVA' ELSE 'MORPH' END
        WHEN xf IN {past} OR yf IN {past} THEN 'VERB:TENSE' WHEN {_IN('x', edits.AUXILIARIES | verbs)} OR {_IN('l', edits.SUBJECTS)} THEN 'VERB:SVA' ELSE 'NOUN:NUM' END"""
    kind = f"""CASE WHEN NOT xs THEN 'M:' || {alone} WHEN NOT ys THEN 'U:' || {alone} ELSE 'R:' || CASE WHEN x = y THEN 'ORTH' WHEN translate(x, '{_MARKS}', '') = '' AND translate(y, '{_MARKS}', '') = '' THEN 'PUNCT' {same} WHEN xb = yb THEN {inflected} WHEN xr = yr THEN 'MORPH'
        WHEN 3 * levenshtein({_ONE_BYTE.format('x')}, {_ONE_BYTE.format('y')}) <= greatest(length(x), length(y)) THEN 'SPELL' ELSE 'OTHER' END END"""
    return f"{words}, {places}, {forms}, {side} AS (SELECT pair_id, model, list(s || ':' || e || ':' || replace(type, ':', '-')) AS x FROM (SELECT *, {kind} AS type FROM {side}f) GROUP BY ALL)"


_ROOT = f"regexp_replace({{}}, '^(.{{{{3,}}}}?)(?:{edits.DERIVED}|ly|e|y)$', '\\1')"
_E = f"""u AS (SELECT *, replace(replace(output, 'en ', 'ens '), 'e ', 'ed ') AS wanted FROM t), {_edits("output", "p")}, {_edits("wanted", "g")},
    e AS (SELECT u.pair_id, conv_id, conv_id % 3 AS model, coalesce(p.x, []) AS p, coalesce(g.x, []) AS g FROM u LEFT JOIN p ON p.pair_id = u.pair_id LEFT JOIN g ON g.pair_id = u.pair_id)"""


def edited(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    """Edits from a turn to its answer, and to the answer with other endings, word by word; with the columns of keep (input, output). To join these later would broadcast the edits, whose files are much smaller than they are in memory."""
    wanted = F.replace(F.replace("output", F.lit("en "), F.lit("ens ")), F.lit("e "), F.lit("ed "))
    rows = turns(spark, sf_dir).select("pair_id", "conv_id", (F.col("conv_id") % 3).alias("model"), *keep, edits.by_place(F.col("input"), F.col("output")).alias("predicted"), edits.by_place(F.col("input"), wanted).alias("gold"))
    bare = lambda e: F.transform(e, lambda x: F.struct(x["start"], x["end"], x["type"]))
    found = rows.select("pair_id", "conv_id", "model", *keep, bare("predicted").alias("predicted"), bare("gold").alias("gold"))
    return settled(found, "edits")  # the scores read them several times


_PRF = """SELECT model, tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall FROM s"""


@query(f"WITH {_TURNS}, {_E}, s AS (SELECT model, sum(len(list_intersect(list_distinct(p), list_distinct(g))))::BIGINT AS tp, sum(len(list_distinct(p)) - len(list_intersect(list_distinct(p), list_distinct(g))))::BIGINT AS fp, sum(len(list_distinct(g)) - len(list_intersect(list_distinct(p), list_distinct(g))))::BIGINT AS fn FROM e GROUP BY model) {_PRF}")
def edit_scores(spark, sf_dir):
    return _rounded(metrics.edit_scores(edited(spark, sf_dir), by=["model"]))


def _rounded(rows: DataFrame, counts: int | None = None) -> DataFrame:
    n = [F.round(c, counts).alias(c) if counts else F.col(c) for c in ("tp", "fp", "fn")]
    return rows.select("model", *n, F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


_SIDES = "k AS (SELECT model, pair_id, replace(split_part(x, ':', 3), '-', ':') AS type, 0 AS side FROM (SELECT model, pair_id, unnest(p) AS x FROM e) UNION ALL SELECT model, pair_id, replace(split_part(x, ':', 3), '-', ':'), 1 FROM (SELECT model, pair_id, unnest(g) AS x FROM e))"


@query(f"WITH {_TURNS}, {_E}, {_SIDES}, n AS (SELECT model, pair_id, type, count(*) FILTER (side = 0) AS p, count(*) FILTER (side = 1) AS g FROM k GROUP BY ALL), s AS (SELECT model, sum(least(p, g))::BIGINT AS tp, sum(greatest(p - g, 0))::BIGINT AS fp, sum(greatest(g - p, 0))::BIGINT AS fn FROM n GROUP BY model) {_PRF}")
def edit_type_scores(spark, sf_dir):
    return _rounded(metrics.edit_type_scores(edited(spark, sf_dir), ["pair_id"], by=["model"]))


@query(f"WITH {_TURNS}, {_E}, {_SIDES}, c AS (SELECT model, type, count(*) FILTER (side = 0) AS p, count(*) FILTER (side = 1) AS g FROM k GROUP BY ALL), n AS (SELECT model, p / sum(p) OVER (PARTITION BY model) AS p, g / sum(g) OVER (PARTITION BY model) AS g FROM c), s AS (SELECT model, round(sum(least(p, g)), 6) AS tp, round(sum(greatest(p - g, 0)), 6) AS fp, round(sum(greatest(g - p, 0)), 6) AS fn FROM n GROUP BY model) SELECT model, tp, fp, fn, round(tp / (tp + fp), 4) AS precision, round(tp / (tp + fn), 4) AS recall FROM s")
def edit_distribution_scores(spark, sf_dir):
    rows = _rounded(metrics.type_distribution_scores(edited(spark, sf_dir), by=["model"]), 6)
    return rows.select("model", "tp", "fp", "fn", F.round("precision", 4).alias("precision"), F.round("recall", 4).alias("recall"))


@query(f"WITH {_TURNS}, {_E} SELECT model, avg(len(p)) AS n_edits FROM e GROUP BY model")
def edits_a_sentence(spark, sf_dir):
    return metrics.mean_edits(edited(spark, sf_dir), by=["model"])


@query(f"WITH {_TURNS} SELECT conv_id % 3 AS model, round(avg(length(input) % 7), 9) AS input, round(avg(length(output) % 7), 9) AS corrected, round(avg(length(output) % 7) - avg(length(input) % 7), 9) AS delta FROM t GROUP BY ALL")
def acceptability_delta(spark, sf_dir):
    """Means of two columns that a scorer gave; here the texts' lengths stand for its scores."""
    rows = turns(spark, sf_dir).select((F.col("conv_id") % 3).alias("model"), (F.length("input") % 7).alias("x"), (F.length("output") % 7).alias("y"))
    return metrics.acceptability(rows, "x", "y", ["model"]).select("model", *(F.round(c, 9).alias(c) for c in ("input", "corrected", "delta")))


@query(f"WITH {_TURNS}, {_E}, k AS (SELECT replace(split_part(unnest(p), ':', 3), '-', ':') AS type FROM e), c AS (SELECT type, count(*) AS n FROM k GROUP BY type), a AS (SELECT z.type, coalesce(n, 0) AS n FROM (SELECT unnest([{', '.join(repr(x) for x in vocab.EDIT_TYPES)}]) AS type) z LEFT JOIN c USING (type)) SELECT type, round((n + 0.5) / sum(n + 0.5) OVER (), 9) AS p FROM a")
def smoothed_edit_types(spark, sf_dir):
    """Shares of all supported types, smoothed, of which some don't occur."""
    found = fidelity.edit_distribution(edited(spark, sf_dir), vocab.EDIT_TYPES, "predicted")
    return found[0].select("type", F.round("p", 9).alias("p"))


@query(f"WITH {_TURNS}, {_E}, k AS (SELECT model, replace(split_part(unnest(p), ':', 3), '-', ':') AS type FROM e) SELECT model, type, count(*) AS n FROM k GROUP BY ALL")
def edit_kinds(spark, sf_dir):
    """How often each model makes each type of edit."""
    return edited(spark, sf_dir).select("model", F.explode("predicted.type").alias("type")).groupBy("model", "type").agg(F.count("*").alias("n"))


@query("SELECT doc_id, lang AS slice FROM documents UNION ALL SELECT doc_id, source FROM documents")
def concatenated_samples(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.col("lang").alias("slice")).unionByName(docs.select("doc_id", F.col("source").alias("slice")))


@query(f"SELECT '{vocab.bin_label(0, 5)}' AS bin, count(*) FILTER (n_chars <= 5) AS n FROM documents UNION ALL SELECT '{vocab.bin_label(6, None)}', count(*) FILTER (n_chars > 5) FROM documents")
def open_ended_bins(spark, sf_dir):
    return profile.histogram(table(spark, sf_dir, "documents"), F.col("n_chars"), [(0, 5), (6, None)]).select("bin", "n")


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) AS k FROM conversations) WHERE k <= 3")
def first_of_each_role(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("place", F.struct("conv_id", "turn"))
    return profile.first_examples(rows, 3, ["role"], "place").select("conv_id", "turn", "role")


@query(f"WITH {_MONTHS}, r AS (SELECT DISTINCT mode, run FROM e), z AS (SELECT mode, run, row_number() OVER (ORDER BY CASE mode WHEN 'inverse' THEN 0 ELSE 1 END, run)::INT AS k FROM r) SELECT k AS run, count(*) AS n FROM e JOIN z USING (mode, run) GROUP BY k")
def renumbered_runs(spark, sf_dir):
    """Runs of two sessions as runs of one, in the order in which the sessions are named."""
    rows = scores(spark, sf_dir).select(F.concat(F.lit("/s/"), F.col("mode")).alias("dir"), "run", "value")
    return sessions.renumbered(rows, ["/s/inverse", "/s/forward"]).groupBy("run").agg(F.count("*").alias("n"))


@query("SELECT 2 * count(*) AS n FROM documents WHERE doc_id % 10 = 0")
def differing_samples(spark, sf_dir):
    """How many rows only one of two samples has: every tenth text is another one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    other = docs.withColumn("lang", F.when(F.col("doc_id") % 10 == 0, F.lit("other")).otherwise(F.col("lang")))
    return spark.range(1).select(F.lit(sessions.differing_rows(docs, other)).cast("long").alias("n"))
