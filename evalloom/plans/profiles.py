"""Whole profiles of corpora: a dict of small frames, one for each block, which archive.save_profile writes as one document."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vocab import CHAR_BINS, EDIT_TYPES, STOPWORDS, WORD_BINS
from ..operators import edits as E
from ..operators import fidelity, profile, topics
from ..session import settled


def rows_profile(rows: DataFrame, texts: Sequence[str] | None = None, order: str = "doc_id", examples: int = 3) -> dict[str, DataFrame]:
    """Counts, missing values, lengths and top words of each text column (all columns if none are named), and first examples."""
    columns = sorted(rows.columns)
    texts = [*texts] if texts else columns
    as_text = rows.select(order, *(F.col(c).cast("string").alias(c) for c in columns if c != order))
    blocks = {"count": rows.agg(F.count("*").alias("n")), "missing": profile.missing_counts(rows, columns), "examples": rows.orderBy(order).limit(examples)}
    for c in texts:
        side = as_text.select(F.col(order).alias("__o"), F.col(c).cast("string").alias("text"))
        blocks[f"{c}.chars"], blocks[f"{c}.words"] = profile.text_length_stats(side), profile.word_count_stats(side)
        blocks[f"{c}.top_words"] = profile.top_ngrams(side, 20, order="__o")
        blocks[f"{c}.top_words_nostop"] = profile.top_ngrams(side, 20, order="__o", drop=STOPWORDS)
    return blocks


def _side(rows: DataFrame, text: str, by: Sequence[str], order: str) -> dict[str, DataFrame]:
    words, chars = F.size(T.tokens(F.col(text))), F.length(text)
    blocks = {
        "word_bins": profile.histogram(rows, words, WORD_BINS, by),
        "char_bins": profile.histogram(rows, chars, CHAR_BINS, by),
        "word_quantiles": profile.quantiles(rows, words, by),
        "char_quantiles": profile.quantiles(rows, chars, by),
        "style": profile.style_rates(rows, text, by),
        "vocabulary": profile.vocabulary_stats(rows, text, by),
    }
    top = (lambda n: profile.top_ngrams_by(rows, 15, by, n, text, order)) if by else (lambda n: profile.top_ngrams(rows, 15, n, text, order))
    blocks |= {f"top_{n}_grams": top(n) for n in (2, 3)}
    return blocks


def classes_profile(rows: DataFrame, label: str = "label", text: str = "text", order: str = "doc_id", examples: int = 3) -> dict[str, DataFrame]:
    """Of rows with a text and a label: shares in per cent, lengths, words and first examples of each label."""
    valid = profile.nonblank(rows, text).where(F.col(label).isNotNull()).withColumn(label, F.col(label).cast("string"))
    shares = profile.label_shares(valid, label).select(label, "n", F.round(100 * F.col("share"), 4).alias("percent"))
    return {"labels": shares, "chars": profile.text_length_stats(valid, text, [label]), "words": profile.word_count_stats(valid, text, [label]), "top_words": profile.top_ngrams_by(valid, 20, [label], 1, text, order), "top_words_nostop": profile.top_ngrams_by(valid, 20, [label], 1, text, order, STOPWORDS), "examples": profile.first_examples(valid, examples, [label], order).select(label, "rank", text)}


def messages_profile(rows: DataFrame, order: str = "doc_id", labels: DataFrame | None = None, consolidated=None) -> dict[str, DataFrame]:
    """Of (order, text, label): classes, signals by label, distributions of signals over spam, and each label's lengths, style and words. labels: (order, text, label) of topics, by a client (topics.labelled) or a model (topics.modelled);
    with them, the topics of all messages and of each class, consolidated or as they are."""
    spam = rows.where("label = 'SPAM'").withColumn("s", T.signals(F.col("text")))
    blocks = {f"classes.{k}": v for k, v in classes_profile(rows, order=order).items()}
    blocks |= {"signals": profile.signal_rates(rows), "signal_counts": fidelity.signal_counts(spam, "s"), "signal_types": profile.label_shares(spam.select(F.explode("s").alias("signal")), "signal")}
    if labels is not None:
        blocks["topics"] = topics.topics(labels, consolidated, order)
        of_class = rows.where("label IS NOT NULL").select(order, F.col("label").alias("class")).join(labels.where("label IS NOT NULL").select(order, "label"), order)
        blocks["class_topics"] = profile.label_shares(of_class, "label", ["class"])
    return blocks | {f"label.{k}": v for k, v in _side(rows, "text", ["label"], order).items()}


def pairs_profile(rows: DataFrame, source: str = "incorrect", target: str = "correct", order: str = "doc_id", annotate=None) -> dict[str, DataFrame]:
    """Of (order, source, target): similarity and its buckets with first examples, edits as an annotator sees them, and lengths, style and words of each side."""
    rated = rows.select(F.col(order), F.col(source), F.col(target), F.round(T.sequence_similarity(F.col(source), F.col(target)), 4).alias("similarity"), (annotate or E.annotator())(F.col(source), F.col(target)).alias("edits"))
    rated = settled(rated.withColumns({"bucket": T.similarity_bucket(F.col("similarity")), "complexity": T.complexity(F.col("similarity"))}), "rated")  # alignments are worked out once
    found = profile.edit_profile(rated, EDIT_TYPES)
    blocks = {
        "similarity": profile.numeric_stats(rated, F.col("similarity")),
        "buckets": profile.label_shares(rated, "bucket"),
        "complexity": profile.label_shares(rated, "complexity"),
        "examples": profile.first_examples(rated, 3, ["complexity"], order).select("complexity", "rank", source, target),
        **{f"edits.{k}": v for k, v in found.items()},
    }
    for side in (source, target):
        blocks |= {f"{side}.{k}": v for k, v in _side(rows, side, [], order).items()}
    return blocks
