"""Named queries over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import parse
from .functions import text as T
from .functions.vocab import CHAR_BINS, FIRST_PERSON, PUNCTUATION, QUANTILES, SECOND_PERSON, SIGNAL_RATES, SIGNALS, SLANG, SPAM_KEYWORDS, STOPWORDS, STYLES, WORD_BINS, bin_label
from .operators import edits, fidelity, generate, metrics, profile, runs, sampling
from .plans import report
from .session import shared_path
from .sources import corpora
from .streaming import runs as streamed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a label, and a rule's prediction: any signal is spam."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    label = F.when(F.col("toxic") == 1, "SPAM").otherwise("HAM")
    return docs.select("doc_id", "text", "lang", "source", label.alias("label"), F.when(F.size(T.signals(F.col("text"))) > 0, "SPAM").otherwise("HAM").alias("prediction"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's turn and the assistant's next one as a pair."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").withColumn("next_role", F.lead("role").over(order)).withColumn("output", F.lead("text").over(order))
    rows = rows.where("role = 'user' AND next_role = 'assistant'")
    return rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("pair_id"), "conv_id", F.col("text").alias("input"), "output")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as scores: a day is a run, a type a model."""
    events = table(spark, sf_dir, "events")
    return events.select(F.col("event_type").alias("model"), F.dayofyear("ts").cast("long").alias("run"), F.when(F.col("user_id") % 2 == 0, "forward").otherwise("inverse").alias("mode"), F.col("user_id").alias("user_id"), "value")


def _list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


_CAPS = r"(^|[^\p{L}\p{N}_])[A-Z]{2,}($|[^\p{L}\p{N}_])"
_WS = T.SPACES
_TOK = "list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9'']+'), lambda w: lower(w))"
_FLAGS = rf"""regexp_matches(text, 'https?://|www\.', 'i') AS phishing_link, regexp_matches(text, '[$€£]') AS money_promise, regexp_matches(text, '{_CAPS}') AS excessive_caps,
    contains(text, '!') AS urgency, list_has_any(regexp_split_to_array(lower(text), '{_WS}'), [{_list(SPAM_KEYWORDS)}]) AS spam_keywords"""
_LABELLED = f"""l AS (SELECT doc_id, text, lang, source, CASE WHEN toxic = 1 THEN 'SPAM' ELSE 'HAM' END AS label FROM documents JOIN labels USING (doc_id)),
    s AS (SELECT *, {_FLAGS} FROM l),
    p AS (SELECT *, CASE WHEN phishing_link OR money_promise OR excessive_caps OR urgency OR spam_keywords THEN 'SPAM' ELSE 'HAM' END AS prediction FROM s)"""
_STYLE = rf"""contains(text, '?') AS question_rate, contains(text, '!') AS exclaim_rate, list_has_any(tok, [{_list(FIRST_PERSON)}]) AS first_person_rate,
    list_has_any(tok, [{_list(SECOND_PERSON)}]) AS second_person_rate, regexp_matches(text, '[A-Za-z]+''[A-Za-z]+') AS contraction_rate, regexp_matches(text, '\p{{Nd}}') AS digit_rate,
    regexp_matches(text, '{_CAPS}') AS uppercase_word_rate, list_has_any(tok, [{_list(SLANG)}]) AS texting_slang_rate,
    (length(text) - length(translate(text, '{PUNCTUATION.replace("'", "''")}', '')))::DOUBLE / nullif(length(text), 0) AS punctuation_density"""
_TURNS = """o AS (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS output FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    t AS (SELECT conv_id * 1000 + turn AS pair_id, conv_id, text AS input, output FROM o WHERE role = 'user' AND next_role = 'assistant')"""
_SCORES = "e AS (SELECT event_type AS model, CAST(dayofyear(ts) AS BIGINT) AS run, CASE WHEN user_id % 2 = 0 THEN 'forward' ELSE 'inverse' END AS mode, user_id, value FROM events)"


def _spaced(column: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({column}, ''), '{_WS}'), lambda w: w <> '')"


def _bigrams(column: str) -> str:
    w = _spaced(f"lower({column})")
    return f"list_distinct(list_transform(range(1, len({w})), lambda i: ({w})[i] || ' ' || ({w})[i + 1]))"


def _stats(value: str, where: str, by: str = "lang") -> str:
    return f"""SELECT {by}, count(*) AS n, avg(v) AS mean, median(v) AS median, min(v)::DOUBLE AS min, max(v)::DOUBLE AS max, round(stddev_pop(v), 6) AS std
        FROM (SELECT *, {value} AS v FROM documents WHERE {where}) GROUP BY {by}"""


def _bins(bins) -> str:
    return "CASE " + " ".join("ELSE '" + bin_label(a, b) + "'" if b is None else f"WHEN v <= {b} THEN '{bin_label(a, b)}'" for a, b in bins) + " END"


_NONBLANK = f"regexp_replace(text, '{_WS}', '', 'g') <> ''"


@query(f"WITH {_LABELLED} SELECT label, count(*) AS n, " + ", ".join(f"avg({s}::INT) AS {r}" for s, r in SIGNAL_RATES.items()) + " FROM s GROUP BY label")
def spam_signal_rates(spark, sf_dir):
    return profile.signal_rates(labelled(spark, sf_dir))


@query(
    f"""WITH c AS (SELECT unnest(['text', 'lang', 'source', 'n_chars']) AS "column", unnest([text, lang, source, n_chars::VARCHAR]) AS v FROM documents)
    SELECT "column", count(*) FILTER (v IS NULL OR regexp_replace(v, '{_WS}', '', 'g') = '') AS missing FROM c GROUP BY "column" """
)
def missing_counts(spark, sf_dir):
    return profile.missing_counts(table(spark, sf_dir, "documents"), ["text", "lang", "source", "n_chars"])


@query(_stats("length(text)", _NONBLANK))
def text_length_stats(spark, sf_dir):
    return profile.text_length_stats(table(spark, sf_dir, "documents"), by=["lang"]).withColumn("std", F.round("std", 6))


@query(_stats(f"len({_TOK})", _NONBLANK))
def word_count_stats(spark, sf_dir):
    return profile.word_count_stats(table(spark, sf_dir, "documents"), by=["lang"]).withColumn("std", F.round("std", 6))


def _top(n: int, k: int, drop: str = "") -> str:
    gram = " || ' ' || ".join(f"tok[i + {j}]" for j in range(n))
    return f"""WITH d AS (SELECT doc_id, {f"list_filter({_TOK}, lambda x: x NOT IN ({drop}))" if drop else _TOK} AS tok FROM documents),
        g AS (SELECT doc_id, i, {gram} AS ngram FROM d, range(1, len(tok) + {2 - n}) AS r(i)),
        c AS (SELECT ngram, count(*) AS n, min(doc_id * 10000000 + i) AS first FROM g GROUP BY ngram)
        SELECT ngram, n FROM c ORDER BY n DESC, first LIMIT {k}"""


@query(_top(1, 20))
def top_words(spark, sf_dir):
    return profile.top_ngrams(table(spark, sf_dir, "documents"), 20)


@query(_top(1, 20, _list(STOPWORDS)))
def top_words_nostop(spark, sf_dir):
    return profile.top_ngrams(table(spark, sf_dir, "documents"), 20, drop=STOPWORDS)


@query(_top(2, 15))
def top_bigrams(spark, sf_dir):
    return profile.top_ngrams(table(spark, sf_dir, "documents"), 15, 2)


@query(_top(3, 15))
def top_trigrams(spark, sf_dir):
    return profile.top_ngrams(table(spark, sf_dir, "documents"), 15, 3)


@query(f"WITH {_LABELLED} SELECT lang, label, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY lang) AS share FROM l GROUP BY lang, label")
def label_distribution(spark, sf_dir):
    return profile.label_shares(labelled(spark, sf_dir), "label", ["lang"])


@query(f"WITH {_LABELLED}, r AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY doc_id)::INT AS rank FROM l) SELECT label, rank, doc_id FROM r WHERE rank <= 3")
def first_examples(spark, sf_dir):
    return profile.first_examples(labelled(spark, sf_dir), 3, ["label"]).select("label", "rank", "doc_id")


def _histogram(value: str, bins) -> str:
    names = ", ".join(f"'{bin_label(*b)}'" for b in bins)
    return f"""WITH x AS (SELECT lang, {value} AS v FROM documents WHERE text IS NOT NULL), y AS (SELECT lang, {_bins(bins)} AS bin, count(*) AS n FROM x GROUP BY ALL),
        k AS (SELECT lang, count(*) AS total, unnest([{names}]) AS bin FROM x GROUP BY lang)
        SELECT k.lang, k.bin, coalesce(y.n, 0) AS n, coalesce(y.n, 0) / total AS share FROM k LEFT JOIN y ON k.bin = y.bin AND k.lang IS NOT DISTINCT FROM y.lang"""


@query(_histogram(f"len({_TOK})", WORD_BINS))
def length_hist_words(spark, sf_dir):
    return profile.histogram(table(spark, sf_dir, "documents").where("text IS NOT NULL"), F.size(T.tokens(F.col("text"))), WORD_BINS, ["lang"])


@query(_histogram("length(text)", CHAR_BINS))
def length_hist_chars(spark, sf_dir):
    return profile.histogram(table(spark, sf_dir, "documents"), F.length("text"), CHAR_BINS, ["lang"])


@query(f"SELECT lang, count(v) AS n, " + ", ".join(f"quantile_cont(v, {q / 100}) AS p{q}" for q in QUANTILES) + f" FROM (SELECT lang, len({_TOK})::DOUBLE AS v FROM documents) GROUP BY lang")
def length_quantiles(spark, sf_dir):
    return profile.quantiles(table(spark, sf_dir, "documents"), F.size(T.tokens(F.col("text"))), ["lang"])


@query(
    f"WITH d AS (SELECT lang, text, {_TOK} AS tok FROM documents), f AS (SELECT lang, {_STYLE} FROM d) SELECT lang, "
    + ", ".join(f"avg({s}::INT) AS {s}" for s in STYLES)
    + ", round(avg(punctuation_density), 9) AS punctuation_density FROM f GROUP BY lang"
)
def style_rates(spark, sf_dir):
    return profile.style_rates(table(spark, sf_dir, "documents"), by=["lang"]).withColumn("punctuation_density", F.round("punctuation_density", 9))


@query(
    f"""WITH w AS (SELECT lang, unnest({_TOK}) AS w FROM documents), c AS (SELECT lang, w, count(*) AS n FROM w GROUP BY ALL)
    SELECT lang, sum(n)::BIGINT AS total_tokens, count(*) AS types, count(*) / sum(n) AS type_token_ratio, count(*) FILTER (n = 1) / count(*) AS hapax_fraction,
    coalesce(sum(n) FILTER (w IN ({_list(STOPWORDS)})), 0) / sum(n) AS stopword_fraction, sum(n * length(w)) / sum(n) AS avg_word_length FROM c GROUP BY lang"""
)
def vocab_stats(spark, sf_dir):
    return profile.vocabulary_stats(table(spark, sf_dir, "documents"), by=["lang"])


_CELLS = "count(*) FILTER (label = 'SPAM' AND prediction = 'SPAM') AS tp, count(*) FILTER (label = 'HAM' AND prediction = 'SPAM') AS fp, count(*) FILTER (label = 'SPAM' AND prediction = 'HAM') AS fn, count(*) FILTER (label = 'HAM' AND prediction = 'HAM') AS tn"


@query(f"WITH {_LABELLED} SELECT lang, {_CELLS} FROM p GROUP BY lang")
def confusion(spark, sf_dir):
    return metrics.confusion(labelled(spark, sf_dir), "SPAM", ["lang"])


@query(
    f"""WITH {_LABELLED}, c AS (SELECT lang, {_CELLS} FROM p GROUP BY lang),
    m AS (SELECT lang, (tp + tn) / (tp + fp + fn + tn) AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(fp / nullif(fp + tn, 0), 0) AS fpr FROM c)
    SELECT lang, accuracy, precision, recall, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1, fpr FROM m"""
)
def precision_recall_f1(spark, sf_dir):
    return metrics.binary_scores(labelled(spark, sf_dir), "SPAM", ["lang"])


@query(
    """WITH p AS (SELECT label % 3 AS label, vec_id % 3 AS prediction FROM embeddings), k AS (SELECT unnest([0, 1, 2, 3]) AS x),
    c AS (SELECT x, coalesce(count(*) FILTER (label = x AND prediction = x) / nullif(count(*) FILTER (prediction = x), 0), 0) AS p, coalesce(count(*) FILTER (label = x AND prediction = x) / nullif(count(*) FILTER (label = x), 0), 0) AS r FROM p, k GROUP BY x),
    m AS (SELECT round(avg(p), 9) AS macro_precision, round(avg(r), 9) AS macro_recall, round(2 * avg(p) * avg(r) / (avg(p) + avg(r)), 9) AS macro_f1 FROM c) SELECT * FROM m"""
)
def macro_prf(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select((F.col("label") % 3).cast("string").alias("label"), (F.col("vec_id") % 3).cast("string").alias("prediction"))
    return metrics.macro_scores(rows, ("0", "1", "2", "3")).select(*(F.round(c, 9).alias(c) for c in ("macro_precision", "macro_recall", "macro_f1")))


@query(f"WITH {_LABELLED} SELECT source, count(*) AS n, avg((label = prediction)::INT) AS accuracy FROM p GROUP BY source")
def accuracy_by_group(spark, sf_dir):
    return metrics.accuracy_by(labelled(spark, sf_dir), ["source"])


_FIRED = "x AS (SELECT *, list_filter([" + ", ".join(f"CASE WHEN {s} THEN '{s}' END" for s in SIGNALS) + "], lambda z: z IS NOT NULL) AS fired FROM s)"


@query(
    f"""WITH {_LABELLED}, {_FIRED}, f AS (SELECT unnest(fired) AS signal FROM x), c AS (SELECT signal, count(*) AS n FROM f GROUP BY signal),
    v AS (SELECT unnest([{_list(SIGNALS)}]) AS signal), k AS (SELECT signal, coalesce(n, 0) AS n FROM v LEFT JOIN c USING (signal)) SELECT signal, n, round((n + 0.5)::DOUBLE / sum(n + 0.5) OVER (), 9) AS p FROM k"""
)
def signal_type_dist_smoothed(spark, sf_dir):
    kinds = labelled(spark, sf_dir).select(F.explode(T.signals(F.col("text"))).alias("signal")).groupBy("signal").agg(F.count("*").alias("n"))
    return fidelity.smoothed(kinds, "signal", SIGNALS).withColumn("p", F.round("p", 9))


@query(f"WITH {_LABELLED}, {_FIRED} SELECT least(len(fired), 5)::INT AS signals, count(*) AS n, count(*) / sum(count(*)) OVER () AS p FROM x GROUP BY 1")
def signal_count_dist(spark, sf_dir):
    return fidelity.signal_counts(labelled(spark, sf_dir).select(T.signals(F.col("text")).alias("s")), "s")


@query(f"WITH {_LABELLED} SELECT lang, count(*) FILTER (label = 'HAM') AS ham, count(*) FILTER (label = 'SPAM') AS spam, avg((label = 'SPAM')::INT) AS spam_fraction FROM l GROUP BY lang")
def class_balance(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    return rows.groupBy("lang").agg(F.count_if(F.col("label") == "HAM").alias("ham"), F.count_if(F.col("label") == "SPAM").alias("spam"), F.avg((F.col("label") == "SPAM").cast("int")).alias("spam_fraction"))


def _jsd(shares: str, by: str) -> str:
    return f"""{shares}, b AS (SELECT coalesce(x.{by}, y.{by}) AS {by}, coalesce(x.p, 0) AS x, coalesce(y.p, 0) AS y FROM real x FULL JOIN generated y ON x.{by} = y.{by} AND x.k = y.k)
    SELECT {by}, CASE WHEN sum(x) = 0 OR sum(y) = 0 THEN 0 ELSE round(sum((CASE WHEN x > 0 THEN x * log2(x / ((x + y) / 2)) ELSE 0 END + CASE WHEN y > 0 THEN y * log2(y / ((x + y) / 2)) ELSE 0 END) / 2), 9) END AS jsd FROM b GROUP BY {by}"""


@query(
    _jsd(
        f"""WITH {_LABELLED}, h AS (SELECT lang, label, len({_TOK}) AS v FROM l), c AS (SELECT lang, label, {_bins(WORD_BINS)} AS k, count(*) AS n FROM h GROUP BY ALL),
        q AS (SELECT lang, label, k, n / sum(n) OVER (PARTITION BY lang, label) AS p FROM c), real AS (SELECT * FROM q WHERE label = 'HAM'), generated AS (SELECT * FROM q WHERE label = 'SPAM')""",
        "lang",
    )
)
def jsd_length_by_lang(spark, sf_dir):
    bins = profile.histogram(labelled(spark, sf_dir), F.size(T.tokens(F.col("text"))), WORD_BINS, ["lang", "label"])
    sides = [bins.where(F.col("label") == x).select("lang", "bin", "share") for x in ("HAM", "SPAM")]
    return fidelity.jensen_shannon(*sides, "bin", ["lang"], "share").withColumn("jsd", F.round("jsd", 9))


@query(
    f"""WITH {_LABELLED}, {_FIRED}, f AS (SELECT label, unnest(fired) AS k FROM x), c AS (SELECT 1 AS one, label, k, count(*) AS n FROM f GROUP BY ALL), q AS (SELECT *, n / sum(n) OVER (PARTITION BY label) AS p FROM c),
    real AS (SELECT * FROM q WHERE label = 'HAM'), generated AS (SELECT * FROM q WHERE label = 'SPAM'), """
    + _jsd("z AS (SELECT 1)", "one").replace("SELECT one, ", "SELECT ").replace("GROUP BY one", "")
)
def jsd_signals(spark, sf_dir):
    counts = labelled(spark, sf_dir).select("label", F.explode(T.signals(F.col("text"))).alias("signal")).groupBy("label", "signal").agg(F.count("*").alias("n"))
    sides = [counts.where(F.col("label") == x).select("signal", "n") for x in ("HAM", "SPAM")]
    return fidelity.jensen_shannon(*sides, "signal", p="n").select(F.round("jsd", 9).alias("jsd"))


@query(
    f"""WITH {_LABELLED}, d AS (SELECT label, text, {_TOK} AS tok FROM l), f AS (SELECT label, {_STYLE} FROM d), a AS (SELECT label, """
    + ", ".join(f"avg({s}::INT) AS {s}" for s in STYLES)
    + """, avg(punctuation_density) AS punctuation_density FROM f GROUP BY label), u AS (UNPIVOT a ON COLUMNS(* EXCLUDE label) INTO NAME metric VALUE v)
    SELECT metric, round(coalesce(sum(v) FILTER (label = 'SPAM'), 0) - coalesce(sum(v) FILTER (label = 'HAM'), 0), 9) AS delta FROM u GROUP BY metric"""
)
def style_deltas(spark, sf_dir):
    rates = profile.style_rates(labelled(spark, sf_dir), by=["label"])
    sides = [rates.where(F.col("label") == x).drop("label") for x in ("HAM", "SPAM")]
    return fidelity.deltas(*sides, [], [*STYLES, "punctuation_density"]).withColumn("delta", F.round("delta", 9))


_PAIRS = f"WITH {_TURNS}, g AS (SELECT pair_id, {_bigrams('input')} AS a, {_bigrams('output')} AS b FROM t), j AS (SELECT pair_id, coalesce(len(list_intersect(a, b)) / nullif(len(list_distinct(list_concat(a, b))), 0), 0) AS jaccard FROM g)"


@query(f"{_PAIRS} SELECT pair_id, jaccard FROM j")
def bigram_jaccard(spark, sf_dir):
    return turns(spark, sf_dir).select("pair_id", T.jaccard(T.bigram_set(F.col("input")), T.bigram_set(F.col("output"))).alias("jaccard"))


@query(f"{_PAIRS} SELECT round(avg(jaccard), 9) AS mean_jaccard, round(1 - avg(jaccard), 9) AS extent FROM j")
def correction_extent(spark, sf_dir):
    return metrics.correction_extent(turns(spark, sf_dir), "input", "output").select(F.round("mean_jaccard", 9).alias("mean_jaccard"), F.round("extent", 9).alias("extent"))


@query(f"{_PAIRS} SELECT avg((jaccard > 0.01)::INT) AS pct_memorised FROM j")
def pct_memorised(spark, sf_dir):
    return metrics.pct_memorised(turns(spark, sf_dir), "input", "output", above=0.01)


def _gleu(lower: bool) -> str:
    words = [_spaced(f"lower({c})" if lower else c) for c in ("input", "output")]
    return f"""WITH {_TURNS}, w AS (SELECT pair_id, 0 AS side, {words[0]} AS w FROM t UNION ALL SELECT pair_id, 1, {words[1]} FROM t),
    g AS (SELECT pair_id, side, n, array_to_string(w[i : i + n - 1], ' ') AS gram FROM w, range(1, 5) AS a(n), range(1, len(w) + 1) AS b(i) WHERE i + n - 1 <= len(w)),
    c AS (SELECT pair_id, n, gram, count(*) FILTER (side = 0) AS r, count(*) FILTER (side = 1) AS h FROM g GROUP BY ALL),
    m AS (SELECT pair_id, n, sum(least(r, h)) AS k, sum(r) AS r, sum(h) AS h FROM c GROUP BY ALL)"""


@query(f"{_gleu(False)}, s AS (SELECT pair_id, sum(k) / greatest(sum(r), sum(h)) AS gleu FROM m GROUP BY pair_id) SELECT pair_id, coalesce(gleu, 0) AS gleu FROM t LEFT JOIN s USING (pair_id)")
def gleu(spark, sf_dir):
    return metrics.gleu(turns(spark, sf_dir), ["pair_id"], "input", "output")


@query(f"{_gleu(True)}, s AS (SELECT pair_id, CASE WHEN min(k) > 0 THEN exp(sum(ln(k / greatest(r, h))) / 4) ELSE 0 END AS gleu FROM m GROUP BY pair_id) SELECT pair_id, round(coalesce(gleu, 0), 9) AS gleu FROM t LEFT JOIN s USING (pair_id)")
def gleu_geometric(spark, sf_dir):
    return metrics.geometric_gleu(turns(spark, sf_dir), ["pair_id"], "input", "output").withColumn("gleu", F.round("gleu", 9))


@query(
    rf"""WITH {_TURNS}, w AS (SELECT pair_id, 0 AS side, unnest(regexp_extract_all(lower(input), '[\p{{L}}\p{{N}}\p{{M}}_]{{2,}}')) AS w FROM t UNION ALL SELECT pair_id, 1, unnest(regexp_extract_all(lower(output), '[\p{{L}}\p{{N}}\p{{M}}_]{{2,}}')) FROM t),
    c AS (SELECT pair_id, side, w, count(*) AS n FROM w GROUP BY ALL), i AS (SELECT w, ln((1 + 2 * (SELECT count(*) FROM t)) / (1 + count(*))) + 1 AS idf FROM c GROUP BY w),
    b AS (SELECT pair_id, w, sum(CASE WHEN side = 0 THEN n * idf ELSE 0 END) AS x, sum(CASE WHEN side = 1 THEN n * idf ELSE 0 END) AS y FROM c JOIN i USING (w) GROUP BY ALL),
    d AS (SELECT pair_id, sum(x * y) AS xy, sum(x * x) AS xx, sum(y * y) AS yy FROM b GROUP BY pair_id) SELECT pair_id, round(coalesce(xy / nullif(sqrt(xx) * sqrt(yy), 0), 0), 9) AS cosine FROM t LEFT JOIN d USING (pair_id)"""
)
def tfidf_cosine(spark, sf_dir):
    return metrics.tfidf_cosine(turns(spark, sf_dir), "pair_id", "input", "output").withColumn("cosine", F.round("cosine", 9))


@query()
def sequence_similarity(spark, sf_dir):
    """No SQL: the longest-block ratio has none. Tested against the standard library."""
    return turns(spark, sf_dir).select("pair_id", T.sequence_similarity(F.col("input"), F.col("output")).alias("similarity"))


@query(f"WITH {_SCORES}, r AS (SELECT model, run, avg(value) AS value FROM e GROUP BY ALL) SELECT model, count(value) AS runs, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS std FROM r GROUP BY model")
def run_mean_std(spark, sf_dir):
    per_run = scores(spark, sf_dir).groupBy("model", "run").agg(F.avg("value").alias("value"))
    return runs.mean_std(per_run, ["model"]).select("model", "runs", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(f"WITH {_SCORES}, m AS (SELECT *, avg(value) OVER (PARTITION BY mode, model) AS g, avg(value) OVER (PARTITION BY mode) AS a FROM e) SELECT mode, round(sum((g - a) ** 2) / sum((value - a) ** 2), 6) AS eta2 FROM m GROUP BY mode")
def eta_squared(spark, sf_dir):
    return runs.eta_squared(scores(spark, sf_dir), ["model"], ["mode"]).withColumn("eta2", F.round("eta2", 6))


@query(
    f"""WITH {_SCORES}, m AS (SELECT model, round(avg(value) FILTER (mode = 'forward'), 6) AS x, round(avg(value) FILTER (mode = 'inverse'), 6) AS y FROM e GROUP BY model),
    p AS (SELECT sign(a.x - b.x) AS dx, sign(a.y - b.y) AS dy FROM m a JOIN m b ON a.model < b.model) SELECT round(sum(dx * dy) / nullif(sqrt(sum(abs(dx))) * sqrt(sum(abs(dy))), 0), 9) AS tau FROM p"""
)
def kendall_tau_b(spark, sf_dir):
    means = scores(spark, sf_dir).groupBy("model").agg(*(F.round(F.avg(F.when(F.col("mode") == m, F.col("value"))), 6).alias(n) for m, n in (("forward", "x"), ("inverse", "y"))))
    return runs.kendall_tau_b(means, "model", "x", "y").select(F.round("tau", 9).alias("tau"))


@query(f"WITH {_SCORES}, s AS (SELECT model, mode, user_id, count(*) AS runs, max(value) AS best FROM e GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY model, mode ORDER BY runs DESC, best DESC, user_id) AS k FROM s) SELECT model, mode, user_id, runs FROM r WHERE k = 1")
def dedup_best(spark, sf_dir):
    sessions = scores(spark, sf_dir).groupBy("model", "mode", "user_id").agg(F.count("*").alias("runs"), F.max("value").alias("best"))
    return runs.best_sessions(sessions, ["model", "mode"], [F.desc("runs"), F.desc("best"), F.asc("user_id")]).where("rank = 1").select("model", "mode", "user_id", "runs")


@query(f"WITH {_SCORES} SELECT model, round(avg(value) FILTER (mode = 'inverse') - avg(value) FILTER (mode = 'forward'), 6) AS delta FROM e GROUP BY model HAVING count(DISTINCT mode) = 2")
def mode_delta(spark, sf_dir):
    means = scores(spark, sf_dir).groupBy("model", "mode").agg(F.avg("value").alias("value"))
    return runs.mode_deltas(means, ["model"], "mode", "forward", "inverse").withColumn("delta", F.round("delta", 6))


@query(f"WITH {_SCORES}, m AS (SELECT mode, model, round(avg(value), 6) AS value FROM e GROUP BY ALL) SELECT mode, model, row_number() OVER (PARTITION BY mode ORDER BY value DESC, model)::INT AS place FROM m")
def rank_order(spark, sf_dir):
    means = scores(spark, sf_dir).groupBy("mode", "model").agg(F.round(F.avg("value"), 6).alias("value"))
    return runs.ordering(means, ["mode"]).select("mode", "model", "place")


@query(f"WITH {_SCORES}, m AS (SELECT mode, model, run, round(avg(value), 6) AS value FROM e GROUP BY ALL) SELECT a.model, a.run, a.value AS old, b.value AS new FROM m a JOIN m b ON a.model = b.model AND a.run = b.run AND a.mode = 'forward' AND b.mode = 'inverse' WHERE abs(a.value - b.value) > 0.005")
def drift(spark, sf_dir):
    means = scores(spark, sf_dir).groupBy("mode", "model", "run").agg(F.round(F.avg("value"), 6).alias("value"))
    return runs.drift(*(means.where(F.col("mode") == m) for m in ("forward", "inverse")), ["model", "run"])


@query(f"WITH {_SCORES}, g AS (SELECT mode, model, avg(value) AS m, stddev_pop(value) AS w FROM e GROUP BY ALL) SELECT mode, round(max(m) - min(m), 6) AS spread, round(avg(w), 6) AS mean_within_std FROM g GROUP BY mode")
def model_impact(spark, sf_dir):
    return runs.model_impact(scores(spark, sf_dir), "model", ["mode"]).select("mode", F.round("spread", 6).alias("spread"), F.round("mean_within_std", 6).alias("mean_within_std"))


@query(
    f"""WITH {_TURNS}, x AS (SELECT pair_id, regexp_replace(input, '^{_WS}|{_WS}$', '', 'g') AS i, regexp_replace(output, '^{_WS}|{_WS}$', '', 'g') AS o, {_spaced('input')} AS w FROM t)
    SELECT pair_id, CASE WHEN i = '' OR o = '' THEN 'parse failed' WHEN i = o THEN 'identical corrupted/gold' WHEN len(w) < 3 THEN 'too short' END AS reason FROM x"""
)
def pair_rejections(spark, sf_dir):
    return turns(spark, sf_dir).select("pair_id", parse.rejection(T.stripped(F.col("input")), T.stripped(F.col("output"))).alias("reason"))


@query()
def weighted_choices(spark, sf_dir):
    """No SQL: draws by hashes. Their shares and determinism are tested."""
    weights = {s: w for s, w in zip(SIGNALS, (0.4, 0.25, 0.2, 0.1, 0.05), strict=True)}
    docs = table(spark, sf_dir, "documents").select("doc_id")
    n = sampling.choice(sampling.uniform(F.col("doc_id"), "n", 1), {"1": 0.5, "2": 0.3, "3": 0.2}).cast("int")
    return docs.select("doc_id", sampling.distinct_choices(F.col("doc_id"), n, weights, 1).alias("signals"))


_MESSAGES = """m AS (SELECT doc_id, regexp_replace(text, '^{ws}|{ws}$', '', 'g') AS text, CASE WHEN toxic = 1 THEN 'SPAM' ELSE 'HAM' END AS label FROM documents JOIN labels USING (doc_id) WHERE {nonblank})""".format(ws=_WS, nonblank=_NONBLANK)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "text", F.col("toxic").alias("label"))
    return corpora.messages(rows, ["doc_id"])


@query(f"WITH {_MESSAGES} SELECT doc_id, md5(text) AS digest, label FROM m")
def usable_messages(spark, sf_dir):
    return messages(spark, sf_dir).select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), "label")


@query(f"WITH {_MESSAGES} SELECT doc_id FROM m WHERE label = 'HAM' ORDER BY doc_id LIMIT 100")
def first_seeds(spark, sf_dir):
    """A top-k report: the first 100 seeds of a run."""
    return corpora.first_usable(messages(spark, sf_dir).where("label = 'HAM'"), "doc_id", 100).select("doc_id")


@query(f"WITH {_MESSAGES}, r AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY doc_id) AS k FROM m) SELECT doc_id, label FROM r WHERE k <= 25")
def balanced_first(spark, sf_dir):
    return sampling.balanced_first(messages(spark, sf_dir), "label", "doc_id", 25).select("doc_id", "label")


@query(f"WITH {_MESSAGES}, s AS (SELECT label, doc_id, row_number() OVER (PARTITION BY label ORDER BY doc_id) AS n, count(*) OVER (PARTITION BY label) AS size FROM m), i AS (SELECT unnest(range(1, 5001)) AS i), c AS (SELECT i, CASE WHEN i % 3 = 0 THEN 'SPAM' ELSE 'HAM' END AS label FROM i) SELECT i, c.label, doc_id FROM c JOIN s ON c.label = s.label AND (c.i - 1) % size + 1 = n")
def cycled_seeds(spark, sf_dir):
    """Seeds of each class in turn for 5000 samples."""
    pool = generate.numbered(messages(spark, sf_dir).select("label", "doc_id"), "doc_id", ["label"])
    wanted = generate.samples(spark, 5000).withColumn("label", F.when(F.col("i") % 3 == 0, "SPAM").otherwise("HAM"))
    return generate.cycled(wanted, pool, ["label"]).select("i", "label", "doc_id")


@query(f"WITH {_LABELLED}, {_FIRED}, k AS (SELECT unnest(CASE WHEN len(fired) = 0 THEN ['unknown'] ELSE fired END) AS kind FROM x) SELECT kind, count(*) AS n FROM k GROUP BY kind")
def technique_tally(spark, sf_dir):
    rows = labelled(spark, sf_dir).select(F.nullif(F.array_join(T.signals(F.col("text")), ", "), F.lit("")).alias("technique"))
    return runs.tally(rows, F.col("technique"), F.lit(None).cast("string"))


@query(f"WITH {_LABELLED}, {_FIRED}, k AS (SELECT unnest(fired) AS kind FROM x), t AS (SELECT kind, count(*) AS n FROM k GROUP BY kind) SELECT kind, n, round(0.25 * (SELECT sum(n) FROM t), 6) AS expected FROM t")
def expected_signals(spark, sf_dir):
    """What a chart of kinds draws: counts beside those at rates of a quarter each."""
    rows = labelled(spark, sf_dir).select(F.explode(T.signals(F.col("text"))).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))
    rates = spark.createDataFrame([(s, 0.25) for s in SIGNALS], "kind string, rate double")
    return report.expected_types(rows, rates).withColumn("expected", F.round("expected", 6))


@query(f"{_gleu(False)}, s AS (SELECT pair_id, sum(k) / greatest(sum(r), sum(h)) AS gleu FROM m GROUP BY pair_id), a AS (SELECT conv_id % 4 AS category, coalesce(gleu, 0) AS gleu FROM t LEFT JOIN s USING (pair_id)), z AS (SELECT category, round(avg(gleu), 9) AS gleu FROM a GROUP BY category) SELECT category, gleu, row_number() OVER (ORDER BY gleu DESC, category)::INT AS place FROM z")
def gleu_leaderboard(spark, sf_dir):
    pairs = turns(spark, sf_dir).withColumn("category", F.col("conv_id") % 4)
    means = metrics.gleu(pairs, ["category", "pair_id"], "input", "output").groupBy("category").agg(F.round(F.avg("gleu"), 9).alias("gleu"))
    return report.leaderboard(means, ["category"], "gleu").select("category", "gleu", "place")


@query(f"WITH {_SCORES} SELECT mode, model, count(*) AS n, count(DISTINCT run) AS runs, round(sum(value), 4) AS total FROM e GROUP BY ALL")
def pooled_runs(spark, sf_dir):
    """Runs of both modes concatenated, and what is effective of them."""
    rows = scores(spark, sf_dir)
    pooled = rows.where("mode = 'forward'").unionByName(rows.where("mode = 'inverse'"))
    return pooled.groupBy("mode", "model").agg(F.count("*").alias("n"), F.count_distinct("run").alias("runs"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT date_trunc('day', ts) AS start, event_type AS model, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def score_windows(spark, sf_dir):
    rows = streamed.windowed(table(spark, sf_dir, "events").withColumnRenamed("event_type", "model"))
    return rows.select("start", "model", "n", F.round("mean", 6).alias("mean"))


@query(f"WITH {_SCORES} SELECT model, mode AS metric, count(value) AS runs, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS std FROM e GROUP BY model, mode")
def streamed_means(spark, sf_dir):
    """The same table as a stream: read in micro-batches, kept up in a table of changes, and read from there."""
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).parquet(f"{sf_dir}/events.parquet")
    rows = events.select(F.lit("s").alias("session"), F.col("event_type").alias("model"), F.when(F.col("user_id") % 2 == 0, "forward").otherwise("inverse").alias("metric"), "value")
    out = shared_path(spark, "streamed")
    streamed.kept_up(streamed.mean_std(rows), f"{out}/results", f"{out}/checkpoint").awaitTermination()
    return streamed.latest(spark, f"{out}/results").select("model", "metric", "runs", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query()
def edit_types(spark, sf_dir):
    """No SQL: edits come from an alignment in Python. Tested on pairs with known edits."""
    rows = turns(spark, sf_dir).select(edits.annotator()(F.col("input"), F.col("output")).alias("edits"))
    return rows.select(F.explode("edits.type").alias("type")).groupBy("type").agg(F.count("*").alias("n"))


@query()
def pair_buckets(spark, sf_dir):
    """No SQL: the longest-block ratio has none."""
    return profile.pair_stats(turns(spark, sf_dir), "input", "output")


@query()
def generated_messages(spark, sf_dir):
    """No SQL: draws by hashes. A sample for each seed, by a client without a model."""
    pool = generate.numbered(messages(spark, sf_dir).select("doc_id", F.col("text").alias("seed")), "doc_id").select("n", "seed")
    n = pool.count()
    return generate.class_conditional(
        spark, generate.Client(generate.offline), n, labels=("SPAM", "HAM"), positive_share=0.5, types=dict.fromkeys(SIGNALS, 0.2), counts={1: 0.7, 2: 0.3},
        descriptions={s: s.replace("_", " ") for s in SIGNALS}, prompts={"inject": "Put in {error_spec}\n{sentence}", "rewrite": "Say again\n{sentence}"}, seeds=pool,
    ).select("i", "label", "technique", "rejected", F.md5(F.col("text").cast("binary")).alias("digest"))
