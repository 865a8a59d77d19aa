"""Columns over texts: words, n-grams, signals, styles and similarities, all of them built-in expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .vocab import FIRST_PERSON, PUNCTUATION, SECOND_PERSON, SLANG, SPAM_KEYWORDS, STYLES

#: White space as Python's str.split knows it.
SPACES = "[\t-\r\x1c- \x85\xa0  -     　]+"
TOKEN = "[A-Za-z0-9']+"


def blank(value: Column) -> Column:
    """Null, empty or white space only."""
    return value.isNull() | ~F.regexp_like(value, F.lit(f"[^{SPACES[1:-2]}]"))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACES}|{SPACES}$", "")


def first_nonempty(*values: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values))


def tokens(text: Column, drop: Sequence[str] = ()) -> Column:
    """Lower-case runs of ASCII letters, digits and apostrophes; without the words of drop."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), F.lower)
    return F.filter(found, lambda w: ~w.isin(*drop)) if drop else found


def spaced(text: Column) -> Column:
    """The parts between white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def ngrams(words: Column, n: int) -> Column:
    """Runs of n words, joined by spaces; none if there are fewer words."""

    def runs(w: Column) -> Column:
        run = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.concat_ws(" ", *(F.get(w, i + j) for j in range(n))))
        return F.when(F.size(w) >= n, run).otherwise(F.array().cast("array<string>"))

    return let(words, runs)


def bigram_set(text: Column) -> Column:
    return F.array_distinct(ngrams(spaced(F.lower(text)), 2))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double")), F.lit(0.0))


def has_url(text: Column) -> Column:
    return F.regexp_like(text, F.lit(r"(?i)https?://|www\."))


def has_currency(text: Column) -> Column:
    return F.regexp_like(text, F.lit("[$€£]"))


def has_capitals(text: Column) -> Column:
    return F.regexp_like(text, F.lit(r"(?U)\b[A-Z]{2,}\b"))


def has_keyword(text: Column) -> Column:
    return F.arrays_overlap(spaced(F.lower(text)), F.array(*map(F.lit, SPAM_KEYWORDS)))


def signal_flags(text: Column) -> dict[str, Column]:
    return {"phishing_link": has_url(text), "money_promise": has_currency(text), "excessive_caps": has_capitals(text), "urgency": F.contains(text, F.lit("!")), "spam_keywords": has_keyword(text)}


def signals(text: Column) -> Column:
    """The names of the signals of a text."""
    return F.array_compact(F.array(*(F.when(flag, F.lit(name)) for name, flag in signal_flags(text).items())))


def style_flags(text: Column, its_tokens: Column | None = None) -> dict[str, Column]:
    """its_tokens: a column that holds tokens(text) already."""
    found_tokens = tokens(text) if its_tokens is None else its_tokens

    def any_of(words: Sequence[str]) -> Column:
        return F.arrays_overlap(found_tokens, F.array(*map(F.lit, words)))

    found = (
        F.contains(text, F.lit("?")),
        F.contains(text, F.lit("!")),
        any_of(FIRST_PERSON),
        any_of(SECOND_PERSON),
        F.regexp_like(text, F.lit("[A-Za-z]+'[A-Za-z]+")),
        F.regexp_like(text, F.lit(r"(?U)\d")),
        has_capitals(text),
        any_of(SLANG),
    )
    return dict(zip(STYLES, found, strict=True))


def punctuation_density(text: Column) -> Column:
    """The share of ASCII punctuation in a text's characters; null for an empty text."""
    return F.try_divide((F.length(text) - F.length(F.translate(text, PUNCTUATION, ""))).cast("double"), F.length(text).cast("double"))


def slug(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(text, "[^0-9a-zA-Z]+", "_"), "^_+|_+$", ""))


def last_segment(name: Column) -> Column:
    return F.element_at(F.split(name, "/"), -1)


def normalised_spam_label(label: Column) -> Column:
    """spam and 1 are SPAM, everything else is HAM."""
    return F.when(F.lower(stripped(label.cast("string"))).isin("spam", "1"), "SPAM").otherwise("HAM")


def sentiment_label(label: Column) -> Column:
    as_text = label.cast("string")
    return F.when(as_text == "0", "NEGATIVE").when(as_text == "1", "NEUTRAL").when(as_text == "2", "POSITIVE").otherwise(as_text)


def sentiment_truth(error_type: Column) -> Column:
    """The label that a kind of rewriting leads to; null for others."""
    kind = F.lower(error_type)
    return F.when(F.contains(kind, F.lit("negative")) | kind.isin("sarcasm_injection", "negation_insertion"), "NEGATIVE").when(F.contains(kind, F.lit("positive")), "POSITIVE").when(kind == "intensity_reduction", "NEUTRAL")


def similarity_bucket(similarity: Column) -> Column:
    return F.when(similarity >= 0.9, "very_similar").when(similarity >= 0.75, "moderately_changed").otherwise("heavily_changed")


def complexity(similarity: Column) -> Column:
    return F.when(similarity >= 0.9, "low").when(similarity >= 0.75, "medium").otherwise("high")


@F.pandas_udf(DoubleType())
def sequence_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """The ratio of matching characters by the longest common blocks, which no built-in expression gives; 1 for two empty texts."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() if x or y else 1.0 for x, y in zip(a, b, strict=True)], dtype=float)
