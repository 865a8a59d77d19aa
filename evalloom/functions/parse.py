"""Columns that read the fields of a generator's or judge's response."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import spaced, stripped

# Fixed values of the response format.
THINKING = r"(?is)<think>.*?</think>"
REFUSAL = r"(?i)\b(?:I\s+can(?:no|')t|I\s+cannot|I(?:'m| am)\s+(?:not able|unable)|I\s+won'?t|I\s+will\s+not|I(?:'m| am)\s+sorry|I\s+apologi[sz]e|as an AI)\b"


def without_reasoning(raw: Column) -> Column:
    return stripped(F.regexp_replace(F.coalesce(raw, F.lit("")), THINKING, ""))


def is_reasoning(text: Column) -> Column:
    """Reasoning that was opened and not closed."""
    return F.startswith(F.lower(text), F.lit("<think>"))


def is_refusal(raw: Column) -> Column:
    text = without_reasoning(raw)
    return ~is_reasoning(text) & F.regexp_like(F.left(text, F.lit(400)), F.lit(REFUSAL))


def field(text: Column, name: str) -> Column:
    """The value of a line 'name: value'; in open reasoning that of the last 'name:' anywhere. name: a pattern."""
    last = F.element_at(F.regexp_extract_all(text, F.lit(rf"(?i){name}:[ \t]*(.+)"), F.lit(1)), -1)
    anywhere = F.when(F.regexp_like(text, F.lit(rf"(?i){name}:[ \t]*.+")), F.nullif(stripped(last), F.lit("")))
    line = rf"(?im)^\s*{name}:\s*(.+?)\s*$"
    return F.when(is_reasoning(text), anywhere).when(F.regexp_like(text, F.lit(line)), stripped(F.regexp_extract(text, line, 1)))


def tagged(raw: Column, tag: str) -> Column:
    """The field of this name, or else a response of one line."""
    text = without_reasoning(raw)
    return F.coalesce(field(text, tag), F.when((text != "") & ~F.contains(text, F.lit("\n")), text))


def generation(raw: Column) -> Column:
    """Kind of error, faulty sentence and correction."""
    text = without_reasoning(raw)
    return F.struct(field(text, r"Error\s*type").alias("error_type"), field(text, "Generated").alias("corrupted"), field(text, r"Ground\s*truth").alias("gold"))


def judge_keeps(raw: Column) -> Column:
    """False if the first verdict of either kind is against the sample; missing ones are not."""
    first = F.regexp_extract(raw, r"(?im)^\s*Redundancy:\s*(trivial|valid)\b", 1), F.regexp_extract(raw, r"(?im)^\s*Correction:\s*(correct|incorrect)\b", 1)
    return F.coalesce((F.lower(first[0]) != "trivial") & (F.lower(first[1]) != "incorrect"), F.lit(True))


def rejection(corrupted: Column, gold: Column) -> Column:
    """Why a pair is rejected, or null."""
    missing = F.coalesce(corrupted, F.lit("")).eqNullSafe("") | F.coalesce(gold, F.lit("")).eqNullSafe("")
    return F.when(missing, "parse failed").when(stripped(corrupted) == stripped(gold), "identical corrupted/gold").when(F.size(spaced(corrupted)) < 3, "too short")


def numbered(raw: Column, expected: Column) -> Column:
    """The lines of a numbered answer without their numbers, or else all lines; null unless there are as many as expected."""
    lines = F.filter(F.transform(F.split(raw, "\n"), stripped), lambda x: x != "")
    with_number = F.filter(lines, lambda x: F.regexp_like(x, F.lit(r"^\d+[.)]")))
    found = F.when(F.size(with_number) > 0, F.transform(with_number, lambda x: F.regexp_replace(x, r"^\d+[.)]\s*", ""))).otherwise(lines)
    return F.when(F.size(found) == expected, found)


def _indexed(raw: Column, name: str, value: str, flags: str = "") -> Column:
    """A map of the number and the value of lines like '[2] name: value'; of equal numbers the last line counts."""
    pattern = rf"(?m{flags})^[ \t]*\[([0-9]+)\][ \t]*{name}:[ \t]*({value})"
    numbers, values = (F.regexp_extract_all(raw, F.lit(pattern), F.lit(k)) for k in (1, 2))
    entries = F.transform(F.arrays_zip(numbers.alias("n"), values.alias("v")), lambda e: F.struct(e["n"].cast("int").alias("n"), stripped(e["v"]).alias("v")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["n"] == e["n"]))
    return F.map_from_entries(last)


def indexed_rewrites(raw: Column, expected: Column) -> Column:
    """The texts of lines '[k] Generated: text', or else of all that follows 'Generated:' in a line; null unless there are as many as expected."""
    numbered_lines = F.transform(F.regexp_extract_all(raw, F.lit(r"(?m)^[ \t]*\[[0-9]+\][ \t]*Generated:[ \t]*(.+)"), F.lit(1)), stripped)
    anywhere = F.transform(F.regexp_extract_all(raw, F.lit(r"(?m)Generated:(.*)"), F.lit(1)), stripped)
    return F.when(F.size(numbered_lines) == expected, numbered_lines).when(F.size(anywhere) == expected, anywhere)


def indexed_pairs(raw: Column, expected: Column) -> Column:
    """(corrupted, gold) of lines '[k] Generated:' and '[k] Ground truth:', k from 1; null unless all are there."""
    one, two = _indexed(raw, "Generated", ".+"), _indexed(raw, r"Ground\s*truth", ".+")
    found = F.transform(F.sequence(F.lit(1), expected), lambda k: F.struct(F.try_element_at(one, k).alias("corrupted"), F.try_element_at(two, k).alias("gold")))
    return F.when(~F.exists(found, lambda p: p["corrupted"].isNull() | p["gold"].isNull()), found)


def indexed_verdicts(raw: Column, expected: Column) -> Column:
    """Whether each sample is kept, k from 1: false if a line '[k] Redundancy: trivial' or '[k] Correction: incorrect' says so."""
    one, two = (F.transform_values(_indexed(raw, n, v, "i"), lambda _, x: F.lower(x)) for n, v in (("Redundancy", "trivial|valid"), ("Correction", "correct|incorrect")))
    return F.transform(F.sequence(F.lit(1), expected), lambda k: (F.coalesce(F.try_element_at(one, k), F.lit("")) != "trivial") & (F.coalesce(F.try_element_at(two, k), F.lit("")) != "incorrect"))


def labels(raw: Column, expected: Column) -> Column:
    """Places (from 1) with labels of lines like '2. label', lower-case; the last of a place counts."""
    pattern = r"(?m)^\s*(\d+)\s*[:.)-]\s*(.+?)\s*$"
    places, names = (F.regexp_extract_all(raw, F.lit(pattern), F.lit(k)) for k in (1, 2))
    pairs = F.transform(F.arrays_zip(places.alias("p"), names.alias("n")), lambda x: F.struct(F.try_to_number(x["p"], F.lit("999999999")).cast("int").alias("place"), F.lower(x["n"]).alias("label")))
    inside = F.filter(pairs, lambda x: (x["place"] >= 1) & (x["place"] <= expected))
    return F.filter(inside, lambda x, i: ~F.exists(F.slice(inside, i + 2, F.size(inside)), lambda y: y["place"] == x["place"]))


def topics(raw: Column) -> Column:
    """The topics of a JSON object, in fences or prose: a map of description and members."""
    body = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    return F.from_json(body, "MAP<STRING,STRUCT<description STRING,members ARRAY<STRING>>>")
