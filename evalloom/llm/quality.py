"""Quality rules with cross-document line frequency, in DataFrame operations only.

Lines are normalised (A-Z to a-z, white space to single spaces) and hashed; a host's line that more than LIMIT of its
documents have is removed; `cleaned` is the text without such lines. Documents that keep less than half of their words are depleted and rejected. Before that the
base rules reject documents of few words or of many repeated ones.

Defined results: null and empty texts have no words, fail and stay as they are; a null source is a host; repeated rows count as one document of
the host and get equal results; other columns play no part; an empty table gives an empty one. Nothing is capped: a line of any frequency is one row for
each document that has it until it is counted, and counts are partly summed before they are dealt out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored

LIMIT = 20
KEPT_PERCENT = 50
SEPARATORS = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\x0b\f\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _repeated_words(words: Column) -> Column:
    """Words in 3-word windows that the text has twice or more."""

    def count(places: Column) -> Column:
        gaps = F.transform(places, lambda p, i: F.when(i + 1 < F.size(places), F.least(F.get(places, i + 1) - p, F.lit(3))).otherwise(3))
        return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)

    def places(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        again = _let(ordered, lambda o: F.filter(o, lambda x, i: (x["h"] == F.get(o, i + 1)["h"]) | ((i > 0) & (x["h"] == F.get(o, i - 1)["h"]))))
        return F.sort_array(F.transform(again, lambda x: x["i"]))

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    repeated = _let(windows, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), _let(places(w), count)).otherwise(0))
    return F.when(F.size(words) > 3, repeated).otherwise(0)


def base(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, text) for each row; mark is a hash of the text."""
    text = F.coalesce("text", F.lit(""))
    words = F.array_remove(F.split(text, SEPARATORS), "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    counted = docs.select(
        "doc_id",
        F.xxhash64("text").alias("mark"),
        "source",
        "text",
        _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeated_words(w).cast("long").alias("n_repeat_words"))).alias("w"),
        F.length(F.translate(text, _SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    failed = (F.col("w.n_words") < 50) | (100 * F.col("w.n_repeat_words") > 50 * F.col("w.n_words"))
    return counted.select("doc_id", "mark", "source", "w.n_words", "word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words", failed.alias("base_failed"), "text")


def line_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, source, at, line, words): each line with a word, by its place and as the hash of its normalised form."""
    plain = F.translate(F.regexp_replace("text", r"[\x20\x09\x0B-\x0D]+", " "), _UPPER, _UPPER.lower())
    lines = docs.select("doc_id", F.xxhash64("text").alias("mark"), "source", F.posexplode(F.split(plain, "\n")).alias("at", "line")).withColumn("line", F.trim("line")).where("line <> ''")
    return lines.select("doc_id", "mark", "source", "at", F.xxhash64("line").alias("line"), (F.length("line") - F.length(F.translate("line", " ", "")) + 1).cast("long").alias("words")).distinct()


def without_lines(text: Column, places: Column) -> Column:
    """The text without its lines at these places, which count from 0; with all lines if places is null."""

    def joined(lines: Column, bounds: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(bounds) - 2), lambda k: F.slice(lines, F.get(bounds, k) + 2, F.get(bounds, k + 1) - F.get(bounds, k) - 1))
        return F.array_join(F.flatten(runs), "\n")

    def rest(lines: Column) -> Column:
        return _let(F.concat(F.array(F.lit(-1)), F.sort_array(places), F.array(F.size(lines))), lambda bounds: joined(lines, bounds))

    return F.when(places.isNull(), text).otherwise(_let(F.split(text, "\n"), rest))


def quality(docs: DataFrame, limit: int = LIMIT, kept_percent: int = KEPT_PERCENT) -> DataFrame:
    """The columns of base() but text, and removed_words, kept and cleaned, for each row of (doc_id, text, source)."""
    lines = stored(line_rows(docs), "lines")
    frequent = lines.groupBy("source", "line").agg(F.count_distinct(F.coalesce("doc_id", F.lit(-1))).alias("n")).where(F.col("n") > limit)
    frequent = stored(frequent.select(F.col("source").alias("host"), F.col("line").alias("frequent")), "frequent")
    removed = lines.join(frequent, (F.col("line") == F.col("frequent")) & F.col("source").eqNullSafe(F.col("host")), "left_semi")
    removed = removed.groupBy(F.col("doc_id").alias("its_id"), F.col("source").alias("its_source"), F.col("mark").alias("its_mark")).agg(F.sum("words").alias("removed"), F.collect_list("at").alias("places"))
    same = F.col("doc_id").eqNullSafe(F.col("its_id")) & F.col("source").eqNullSafe(F.col("its_source")) & (F.col("mark") == F.col("its_mark"))
    rows = base(docs).join(removed, same, "left").withColumn("removed_words", F.coalesce("removed", F.lit(0).cast("long")))
    depleted = 100 * (F.col("n_words") - F.col("removed_words")) < kept_percent * F.col("n_words")
    rows = rows.withColumn("kept", ~F.col("base_failed") & ~depleted).withColumn("cleaned", without_lines(F.col("text"), F.col("places")))
    return rows.drop("text", "its_id", "its_source", "its_mark", "removed", "places")
