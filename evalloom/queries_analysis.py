"""Named queries with SQL for what sessions, models and data sets add up to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import text as T
from .functions.vocab import STYLES, WORD_BINS, bin_label
from .operators import generate, models, profile, sampling
from .plans import analysis, tasks
from .queries import _LABELLED, _STYLE, _TOK, _TURNS, _bigrams, _bins, _list, _spaced, labelled, query, table, turns
from .queries_files import _E, _MEANS, _SIDES, _unit, edited, tidy_sessions
from .sources import archive

_MODELS = "m AS (SELECT unnest([1, 2]) AS least)"
_SPAM = f"""{_LABELLED}, {_MODELS}, z AS (SELECT doc_id, doc_id % 3 AS run, label, 'least' || least AS model,
        (phishing_link::INT + money_promise::INT + excessive_caps::INT + urgency::INT + spam_keywords::INT) >= least AS said FROM s, m),
    a AS (SELECT model, run, count(*) FILTER ((label = 'SPAM') = said) / count(*) AS accuracy, coalesce(count(*) FILTER (label = 'SPAM' AND said) / nullif(count(*) FILTER (label = 'SPAM'), 0), 0) AS recall FROM z GROUP BY ALL),
    y AS (SELECT model, count(*) FILTER ((label = 'SPAM') = said) / count(*) AS accuracy, coalesce(count(*) FILTER (label = 'SPAM' AND said) / nullif(count(*) FILTER (label = 'SPAM'), 0), 0) AS recall FROM z WHERE run = 0 GROUP BY ALL),
    v AS (UNPIVOT a ON accuracy, recall INTO NAME metric VALUE value), u AS (UNPIVOT y ON accuracy, recall INTO NAME metric VALUE value),
    g AS (SELECT model, metric, avg(value) AS mean, coalesce(stddev_samp(value), 0) AS std, count(*) AS runs FROM v GROUP BY ALL)"""


def _rescored(spark, sf_dir, stored=None):
    docs = labelled(spark, sf_dir).select("doc_id", "text", "label", (F.col("doc_id") % 3).cast("int").alias("run"))
    predictors = {f"least{n}": models.by_signals(n) for n in (1, 2)}
    return analysis.rescored(tasks.TASKS["spam"], docs, predictors, docs.where("run = 0").drop("run"), stored)


@query(f"WITH {_SPAM} SELECT model, metric, round(mean, 6) AS gen_mean, round(std, 6) AS gen_std, round(value, 6) AS real, runs FROM g JOIN u USING (model, metric)")
def rescored_session(spark, sf_dir):
    """Archived runs scored again by two models, beside the score of a real sample."""
    found, _ = _rescored(spark, sf_dir)
    return found.where("metric IN ('accuracy', 'recall')").select("model", "metric", *(F.round(c, 6).alias(c) for c in ("gen_mean", "gen_std", "real")), F.size("runs").cast("long").alias("runs"))


@query(f"WITH {_SPAM} SELECT model, metric, 0.5 AS old, round(mean, 6) AS new FROM g WHERE metric = 'accuracy' AND abs(0.5 - mean) > 0.005")
def rescored_drift(spark, sf_dir):
    """What scoring again gives that the session did not have."""
    stored = spark.createDataFrame([(f"least{n}", "accuracy", 0.5) for n in (1, 2)], "model string, metric string, value double")
    return _rescored(spark, sf_dir, stored)[1].select("model", "metric", "old", F.round("new", 6).alias("new"))


@query(f"WITH {_SPAM}, r AS (SELECT model, metric, value FROM u WHERE model = 'least2' UNION ALL SELECT 'other', metric, value FROM u WHERE model = 'least2'), k AS (SELECT * FROM g WHERE metric = 'recall') SELECT coalesce(k.model, r.model) AS model, coalesce(k.metric, r.metric) AS metric, round(mean, 6) AS gen_mean, round(value, 6) AS real, coalesce(runs, -1) AS runs FROM k FULL JOIN r ON k.model = r.model AND k.metric = r.metric")
def nested_results(spark, sf_dir):
    """Generated and real scores of all models, of which one has real scores alone."""
    docs = labelled(spark, sf_dir).select("text", "label", (F.col("doc_id") % 3).cast("int").alias("run"))
    task, predictors = tasks.TASKS["spam"], {f"least{n}": models.by_signals(n) for n in (1, 2)}
    generated = analysis.run_scores(task, docs, predictors).where("metric = 'recall'")
    real = task.scores(models.predicted(docs.where("run = 0"), {"least2": predictors["least2"], "other": predictors["least2"]})).where("metric IN ('accuracy', 'recall')")
    found = analysis.nested(generated, real)
    return found.select("model", "metric", F.round("gen_mean", 6).alias("gen_mean"), F.round("real", 6).alias("real"), F.coalesce(F.size("runs"), F.lit(-1)).cast("long").alias("runs"))


def _three(value: str, sign: str = "") -> str:
    """Three places, half up by the decimal value, as Spark's format_string has them."""
    return f"printf('%{sign}.3f', CAST(CAST({value} AS DECIMAL(18, 9)) AS DECIMAL(18, 3))::DOUBLE)"


_CELL = f"{_three('m')} || '±' || {_three('s')}"


@query(
    f"""WITH {_MEANS}, c AS (SELECT mode AS strategy, model AS eval_model, unnest(['gen.f1', 'real.f1', 'gen.edits.recall']) AS "column", unnest([{_CELL}, {_three('runs[1]')}, '0.500±0.250']) AS cell FROM g)
    SELECT 'g' AS gen_model, * FROM c UNION ALL SELECT 'h', NULL, NULL, 'error', 'no key'"""
)
def comparison_cells(spark, sf_dir):
    """The cells of a comparison of generation models, of which one failed; nested real values have none."""
    failed = spark.createDataFrame([("h", "no key")], "gen_model string, error string")
    return archive.comparison_cells(tidy_sessions(spark, sf_dir), failed).drop("task")


@query(
    f"""WITH {_MEANS} SELECT mode AS strategy, model AS eval_model, '| ' || mode || ' | g | ' || model || ' | ' || {_three('m')} || ' ± ' || {_three('s')} || ' | ' || {_three('runs[1]')} || ' | ' || {_three('m - runs[1]', '+')} || ' |' AS line FROM g"""
)
def headline_lines(spark, sf_dir):
    return analysis.headline_lines(tidy_sessions(spark, sf_dir)).select("strategy", "eval_model", "line")


# Pairs of turns as what models made of two data sets: every seventh answer failed, every fifth truth is lacking.
_CORR = f"""SELECT e.pair_id, e.model, CASE WHEN e.pair_id % 2 = 0 THEN 'generated' ELSE 'original' END AS dataset, input, CASE WHEN e.conv_id % 7 = 0 THEN '{analysis.CORRECTION_FAILED}' ELSE output END AS output,
        CASE WHEN e.conv_id % 5 = 0 THEN '' ELSE input END AS truth, p, g FROM e JOIN t USING (pair_id)"""


def _corrected(spark, sf_dir) -> DataFrame:
    k = F.col("conv_id")
    rows = edited(spark, sf_dir, "input", "output")
    return rows.select(
        F.col("pair_id").alias("id"), "model", F.when(F.col("pair_id") % 2 == 0, "generated").otherwise("original").alias("dataset"), "input",
        F.when(k % 7 != 0, F.col("output")).alias("corrected"), F.when(k % 5 == 0, "").otherwise(F.col("input")).alias("truth"),
        (F.length("input") % 7).alias("input_score"), (F.length("output") % 7).alias("corrected_score"), "predicted", "gold",
    )


_LOWER = {c: _spaced(f"lower({c})") for c in ("truth", "output")}
_SHARED = "CASE WHEN r.type IS NULL THEN 0 ELSE least(n / sum(n) OVER (PARTITION BY model, dataset), share) END"


@query(
    f"""WITH {_TURNS}, {_E}, c AS ({_CORR}),
    k AS (SELECT model, dataset, pair_id, truth, split_part(x, ':', 3) AS type, 0 AS side FROM (SELECT *, unnest(p) AS x FROM c) UNION ALL SELECT model, dataset, pair_id, truth, split_part(x, ':', 3), 1 FROM (SELECT *, unnest(g) AS x FROM c)),
    r AS (SELECT type, count(*) / sum(count(*)) OVER () AS share FROM k WHERE side = 1 GROUP BY type),
    n AS (SELECT model, dataset, type, count(*) AS n FROM k WHERE side = 0 GROUP BY ALL), d AS (SELECT model, dataset, {_SHARED} AS x FROM n LEFT JOIN r USING (type)), f AS (SELECT model, dataset, sum(x) AS errant_f05 FROM d GROUP BY ALL),
    q AS (SELECT model, dataset, pair_id, type, count(*) FILTER (side = 0) AS p, count(*) FILTER (side = 1) AS g FROM k WHERE truth <> '' GROUP BY ALL),
    s AS (SELECT model, dataset, sum(least(p, g)) AS tp, sum(greatest(p, g) - g) AS fp, sum(greatest(p, g) - p) AS fn FROM q GROUP BY ALL),
    w AS (SELECT pair_id, 0 AS side, {_LOWER["truth"]} AS w FROM c WHERE truth <> '' UNION ALL SELECT pair_id, 1, {_LOWER["output"]} FROM c WHERE truth <> ''),
    gr AS (SELECT pair_id, side, n, array_to_string(w[i : i + n - 1], ' ') AS gram FROM w, range(1, 5) AS a(n), range(1, len(w) + 1) AS b(i) WHERE i + n - 1 <= len(w)),
    gc AS (SELECT pair_id, n, gram, count(*) FILTER (side = 0) AS r, count(*) FILTER (side = 1) AS h FROM gr GROUP BY ALL), gm AS (SELECT pair_id, n, sum(least(r, h)) AS k, sum(r) AS r, sum(h) AS h FROM gc GROUP BY ALL),
    gs AS (SELECT pair_id, CASE WHEN min(k) > 0 THEN exp(sum(ln(k / greatest(r, h))) / 4) ELSE 0 END AS gleu FROM gm GROUP BY pair_id),
    gl AS (SELECT model, dataset, avg(coalesce(gleu, 0)) AS gleu_gt FROM c LEFT JOIN gs USING (pair_id) WHERE truth <> '' GROUP BY ALL),
    j AS (SELECT *, {_bigrams("input")} AS a, {_bigrams("output")} AS b FROM c), b AS (SELECT model, dataset, 1 - avg(coalesce(len(list_intersect(a, b)) / nullif(len(list_distinct(list_concat(a, b))), 0), 0)) AS correction_extent, avg(len(p)) AS n_edits FROM j GROUP BY ALL)
    SELECT model, dataset, round(errant_f05, 6) AS errant_f05, round(1.25 * tp / (1.25 * tp + fp + 0.25 * fn), 6) AS errant_f05_gt, round(gleu_gt, 6) AS gleu_gt, round(correction_extent, 6) AS correction_extent, round(n_edits, 6) AS n_edits
    FROM b JOIN f USING (model, dataset) JOIN s USING (model, dataset) JOIN gl USING (model, dataset)"""
)
def dataset_summary(spark, sf_dir):
    """How each model corrects each data set, truths that failed left out."""
    rows = _corrected(spark, sf_dir)
    found = analysis.dataset_summary(rows, rows.select(F.col("gold").alias("edits")))
    return found.select("model", "dataset", *(F.round(c, 6).alias(c) for c in ("errant_f05", "errant_f05_gt", "gleu_gt", "correction_extent", "n_edits")))


@query(f"WITH {_TURNS}, a AS (SELECT conv_id % 5 AS variant, avg(length(input) % 7) AS a, avg(length(output) % 7) AS b, avg(length(input) % 5 + 1) AS c FROM t GROUP BY ALL) SELECT variant, round(a, 6) AS cola_a, b < a AS b_below_a, c > b AS c_above_b FROM a")
def leaderboard_flags(spark, sf_dir):
    """Whether generated texts are less acceptable than originals, and corrected ones more than generated; lengths stand for a scorer's values."""
    rows = turns(spark, sf_dir).groupBy((F.col("conv_id") % 5).alias("variant")).agg(F.avg(F.length("input") % 7).alias("cola_a"), F.avg(F.length("output") % 7).alias("cola_b"), F.avg(F.length("input") % 5 + 1).alias("cola_c"))
    return analysis.flagged(rows).select("variant", F.round("cola_a", 6).alias("cola_a"), "b_below_a", "c_above_b")


@query(f"WITH {_LABELLED} SELECT source, round(avg(length(text)) FILTER (label = 'HAM'), 6) AS ham, round(avg(length(text)) FILTER (label = 'SPAM'), 6) AS spam FROM l GROUP BY source")
def heatmap_cells(spark, sf_dir):
    rows = labelled(spark, sf_dir).select("source", "label", F.length("text").alias("n"))
    found = analysis.heatmap(rows, "label", "n", "source", ["HAM", "SPAM"])
    return found.select("source", F.round("HAM", 6).alias("ham"), F.round("SPAM", 6).alias("spam"))


@query(f"SELECT doc_id, [0.1, 0.3, 0.5, 0.7, 0.9][floor({_unit('doc_id', 'temperature')} * 5)::INT + 1]::DOUBLE AS temperature FROM documents")
def row_temperatures(spark, sf_dir):
    """A temperature drawn for each row."""
    u = sampling.uniform(F.col("doc_id"), "temperature", 1)
    return table(spark, sf_dir, "documents").select("doc_id", sampling.one_of(u, [0.1, 0.3, 0.5, 0.7, 0.9]).alias("temperature"))


_SCENARIOS = [("Look at the ring.", "Look the ring.", "preposition"), ("She sings.", "She sing.", "agreement"), ("No fault.", "No faults.", "number")]


@query(
    f"""WITH s AS (SELECT item_id AS id, [{", ".join(f"['{b}', '{a}', '{c}']" for a, b, c in _SCENARIOS)}][floor({_unit("item_id", "scenario")} * 3)::INT + 1] AS s, {_unit("item_id", "noise")} < 0.5 AS swap FROM benchmark)
    SELECT id, CASE WHEN swap THEN replace(replace(s[1], 'the', 'teh'), 'ing', 'ign') ELSE s[1] END AS input, s[2] AS output, s[3] AS error_category FROM s"""
)
def scenario_pairs(spark, sf_dir):
    """A pair for each item of the benchmark, drawn by rule, as no client is asked."""
    return generate.from_scenarios(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id")), "id", _SCENARIOS, 1, 0.5)


@query("SELECT doc_id, 'zero_' || n || '_' || t AS variant, n AS shots, t::DOUBLE AS temperature FROM documents, (SELECT unnest([0, 1, 2]) AS n), (SELECT unnest(['0', '0.5']) AS t)")
def prompt_variants(spark, sf_dir):
    """Each document with each number of examples and each temperature."""
    grid = generate.prompt_grid(spark, {"zero": "Make an error."}, [("a b", "a c"), ("d e", "d")], (0, 1, 2), (0, 0.5))
    shots = F.size(F.split("examples", "Example ")) - 1
    return generate.variants(table(spark, sf_dir, "documents").select("doc_id"), grid).select("doc_id", "variant", shots.cast("int").alias("shots"), "temperature")


def _top_by(n: int, k: int) -> str:
    gram = " || ' ' || ".join(f"tok[i + {j}]" for j in range(n))
    return f"""WITH {_LABELLED}, d AS (SELECT doc_id, label, {_TOK} AS tok FROM l), g AS (SELECT doc_id, label, i, {gram} AS ngram FROM d, range(1, len(tok) + {2 - n}) AS r(i)),
        c AS (SELECT label, ngram, count(*) AS n, min(doc_id * 10000000 + i) AS first FROM g GROUP BY ALL), o AS (SELECT label, ngram, n, row_number() OVER (PARTITION BY label ORDER BY n DESC, first)::INT AS rank FROM c) SELECT label, rank, ngram, n FROM o WHERE rank <= {k}"""


@query(_top_by(1, 20))
def top_words_by_label(spark, sf_dir):
    """A top-k report: the 20 most frequent words of each label."""
    return profile.top_ngrams_by(labelled(spark, sf_dir), 20, ["label"])


@query(_top_by(2, 15))
def top_bigrams_by_label(spark, sf_dir):
    """A top-k report: the 15 most frequent pairs of words of each label."""
    return profile.top_ngrams_by(labelled(spark, sf_dir), 15, ["label"], 2)


@query(f"SELECT lang, count(*) AS n, avg(v) AS mean, median(v) AS median, max(v)::DOUBLE AS max FROM (SELECT lang, len({_spaced('text')}) AS v FROM documents WHERE text IS NOT NULL) GROUP BY lang")
def spaced_lengths(spark, sf_dir):
    return profile.spaced_length_stats(table(spark, sf_dir, "documents"), by=["lang"]).select("lang", "n", "mean", "median", "max")


@query(f"WITH {_TURNS}, {_E}, {_SIDES} SELECT type, count(*) AS n FROM k WHERE side = 0 GROUP BY type ORDER BY n DESC, type LIMIT 2")
def top_edit_types(spark, sf_dir):
    """A top-k report: the two most frequent types of edits."""
    return profile.top_edit_types(edited(spark, sf_dir), 2, "predicted")


_ORDER = [bin_label(*b) for b in WORD_BINS]


@query(
    f"""WITH v AS (SELECT lang, len({_TOK}) AS v FROM documents), b AS (SELECT lang, {_bins(WORD_BINS)} AS bin, count(*) AS n FROM v GROUP BY ALL), m AS (SELECT lang, arg_max(bin, n * 100 - list_position([{_list(_ORDER)}], bin)) AS bin FROM b GROUP BY lang),
    q AS (SELECT lang, quantile_cont(v, 0.5)::DOUBLE AS p50, quantile_cont(v, 0.9)::DOUBLE AS p90 FROM v GROUP BY lang) SELECT lang, 'mostly ' || bin || ' words (p50 ' || round(p50, 1) || ', p90 ' || round(p90, 1) || ')' AS line FROM m JOIN q USING (lang)"""
)
def length_lines(spark, sf_dir):
    docs, words = table(spark, sf_dir, "documents"), F.size(T.tokens(F.col("text")))
    q = profile.quantiles(docs, words, ["lang"]).select("lang", F.round("p50", 1).alias("p50"), F.round("p90", 1).alias("p90"))
    return analysis.busiest_words(profile.histogram(docs, words, WORD_BINS, ["lang"]), q, _ORDER, ["lang"])


_RATE = ", ".join(f"avg({s}::INT) AS {s}" for s in STYLES)
_SAID = ", ".join(f"[{{'r': -{s}, 'k': {k}, 'n': '{s.removesuffix('_rate').replace('_', ' ')}'}}]" for k, s in enumerate(STYLES))


@query(
    f"""WITH d AS (SELECT lang, text, {_TOK} AS tok FROM documents), f AS (SELECT lang, {_STYLE} FROM d), a AS (SELECT lang, {_RATE}, avg(punctuation_density) AS p FROM f GROUP BY lang),
    o AS (SELECT lang, p, list_sort(list_filter(flatten([{_SAID}]), lambda x: x.r < 0))[1:4] AS s FROM a)
    SELECT lang, CASE WHEN len(s) > 0 THEN array_to_string(list_transform(s, lambda x: x.n || printf(' %.0f%%', -100 * x.r)), ', ') ELSE 'none' END || printf('; punct density %.2f', p) AS line FROM o"""
)
def style_lines(spark, sf_dir):
    rates = profile.style_rates(table(spark, sf_dir, "documents"), by=["lang"])
    return rates.select("lang", analysis.style_line({s: F.col(s) for s in STYLES}, F.col("punctuation_density")).alias("line"))


@query(
    f"""WITH w AS (SELECT lang, unnest({_TOK}) AS w FROM documents), c AS (SELECT lang, w, count(*) AS n FROM w GROUP BY ALL)
    SELECT lang, printf('TTR %.3f, hapax %.0f%%, avg word %.1f chars', count(*) / sum(n), 100 * count(*) FILTER (n = 1) / count(*), sum(n * length(w)) / sum(n)) AS line FROM c GROUP BY lang"""
)
def vocabulary_lines(spark, sf_dir):
    stats = profile.vocabulary_stats(table(spark, sf_dir, "documents"), by=["lang"])
    return stats.select("lang", analysis.vocabulary_line(F.col("type_token_ratio"), F.col("hapax_fraction"), F.col("avg_word_length")).alias("line"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '[GENERATION FAILED]' ELSE lang END AS generated, CASE WHEN doc_id % 4 = 0 THEN '' ELSE source END AS fce_ground_truth, '' AS gen_ground_truth FROM documents")
def filled_generations(spark, sf_dir):
    """Generated texts and truths under their older names, with nulls."""
    i = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(i % 3 != 0, F.col("lang")).alias("generated"), F.when(i % 4 != 0, F.col("source")).alias("ground_truth"))
    return analysis.filled(rows)
