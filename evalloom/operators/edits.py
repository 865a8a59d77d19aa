"""Edits between two texts, as an annotator sees them: (start, end, type, correction) over words between white space.

Words are aligned at the least cost, by what they have in common: the word itself, its base form, its class, its letters. Runs of the same words in another order are one step. Neighbouring steps are
then one edit, but for words that stand for each other by themselves. Alignment and merging are in Python, an Arrow batch at a time, for pairs that differ only; types are columns over
the words of an edit.

A type says whether words are missing (M), unneeded (U) or replaced (R), and of what kind: from the words' closed classes, their endings and base forms, the word before them and their spelling. Any function from
two columns to such edits can stand in the annotator's place; by_place is one without an alignment.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import lru_cache
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vocab import PUNCTUATION

EDITS = "array<struct<start: int, end: int, type: string, correction: string>>"
SPANS = "array<struct<start: int, end: int, from: int, to: int>>"
# Closed classes of English words.
DETERMINERS = frozenset("a an the this that these those".split())
PREPOSITIONS = frozenset("in on at of for to from by with about into over under after before between".split())
PRONOUNS = frozenset("i you he she it we they me him her us them my your his its our their".split())
SUBJECTS = frozenset("i you he she it we they who which that there".split())
AUXILIARIES = frozenset("am is are was were be been being has have had having do does did will would shall should can could may might must".split())
DEGREES = frozenset("more most".split())
HELPERS = AUXILIARIES | DEGREES | {"to"}
# Verbs with forms of their own: base, third person, past, participle.
VERBS = (
    "be is was been;have has had had;do does did done;go goes went gone;see sees saw seen;take takes took taken;come comes came come;get gets got got;make makes made made;give gives gave given;"
    "know knows knew known;write writes wrote written;eat eats ate eaten;run runs ran run;say says said said;think thinks thought thought;find finds found found;tell tells told told;"
    "become becomes became become;leave leaves left left;feel feels felt felt;bring brings brought brought;begin begins began begun;keep keeps kept kept;hold holds held held;stand stands stood stood;"
    "buy buys bought bought;speak speaks spoke spoken;break breaks broke broken;choose chooses chose chosen"
)
#: Forms of be besides those.
BE = {"am": "base", "are": "base", "were": "past"}
# Nouns with plurals of their own.
PLURALS = "child children;man men;woman women;foot feet;tooth teeth;mouse mice;person people;life lives;wife wives;knife knives"
#: Endings by the form they make, the first that fits; what is left has two letters at least.
ENDINGS = (("ing", "ing"), ("ed", "ed"), ("est", "est"), ("er", "er"), ("ly", "ly"), ("s", "s"))
DERIVED = "iness|ness|ment|ation|ition|tion|ful|less|ity|ous|ive|able|ible|al|ance|ence|ic"

#: Costs of an alignment.
ALONE, CASE, BASES, OPEN, CLASSES, LETTERS = 100, 10, 50, 25, 50, 100
#: Words of the longest run that is put into another order, and cells of a table that are held at once, or else the rows between those that are kept.
RUN, CELLS = 4, 1 << 22


def irregular() -> dict[str, tuple[str, str]]:
    """(base without its ending, form) of words that endings don't tell."""
    found = {w: ("be", form) for w, form in BE.items()}
    for line in VERBS.split(";"):
        base, *forms = line.split()
        for word, form in zip((base, *forms), ("base", "s", "past_s" if base == "be" else "past", "part"), strict=True):
            found.setdefault(word, (_cut(base), form))
    for line in PLURALS.split(";"):
        one, more = line.split()
        found[one], found[more] = (_cut(one), "base"), (_cut(one), "plural")
    return found


# -- types, as columns


def _member(word: Column, of: frozenset[str]) -> Column:
    return F.array_contains(F.split(F.lit(" ".join(sorted(of))), " "), word)  # a constant


def _all(words: Column, of: frozenset[str]) -> Column:
    return F.forall(words, lambda w: _member(w, of))


def _ended(word: Column) -> Column:
    """What is left of a lower-case word without its ending; of two equal letters at its end one."""
    y = F.regexp_replace(word, "^(.{2,}?)(?:ies|ied|ier|iest|ily)$", "$1y")
    cut = F.when(y != word, y).otherwise(F.regexp_replace(word, "^(.{2,}?)(?:ing|ed|es|est|er|ly|s|e)$", "$1"))
    return T.let(F.regexp_replace(cut, "^(.{2,}?)e+$", "$1"), lambda w: F.when(F.regexp_like(w, F.lit("(bb|dd|gg|ll|mm|nn|pp|rr|ss|tt)$")), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w))


def word_form(word: Column) -> Column:
    """(base, form, root) of a lower-case word: root is without endings that make other words."""
    table = F.from_json(F.lit(json.dumps({w: {"base": b, "form": f} for w, (b, f) in irregular().items()})), "MAP<STRING, STRUCT<base: STRING, form: STRING>>")  # a constant
    form = F.lit("base")
    for ending, name in reversed(ENDINGS):
        form = F.when(F.regexp_like(word, F.lit(f"^.{{2,}}{ending}$")), name).otherwise(form)
    known = F.try_element_at(table, word)
    return F.struct(F.coalesce(known["base"], _ended(word)).alias("base"), F.coalesce(known["form"], form).alias("form"), F.regexp_replace(word, f"^(.{{3,}}?)(?:{DERIVED}|ly|e|y)$", "$1").alias("root"))


def word_kind(before: Column, after: Column, left: Column) -> Column:
    """What it is that one lower-case word is replaced by another; left: the word before it."""

    def kind(x: Column) -> Column:
        a, b = x["a"], x["b"]
        either = lambda *forms: a["form"].isin(*forms) | b["form"].isin(*forms)
        past = lambda w: w["form"].isin("past", "past_s", "ed")
        verb = _member(before, AUXILIARIES) | F.coalesce(_member(left, SUBJECTS), F.lit(False)) | _member(before, frozenset(VERBS.replace(";", " ").split()))
        inflected = (
            F.when(either("er", "est"), "ADJ")
            .when(either("ly"), "MORPH")
            .when(either("plural"), "NOUN:NUM")
            .when(either("ing", "part"), "VERB:FORM")
            .when(past(a) & past(b), F.when(either("past_s"), "VERB:SVA").otherwise("MORPH"))
            .when(past(a) | past(b), "VERB:TENSE")
            .when(verb, "VERB:SVA")
            .otherwise("NOUN:NUM")
        )
        close = 3 * F.levenshtein(before, after) <= F.greatest(F.length(before), F.length(after))
        return F.when(a["base"] == b["base"], inflected).when(a["root"] == b["root"], "MORPH").when(close, "SPELL").otherwise("OTHER")

    same = [F.when(_member(before, c) & _member(after, c), n) for n, c in (("DET", DETERMINERS), ("PREP", PREPOSITIONS), ("PRON", PRONOUNS))]
    return F.coalesce(*same, T.let(F.struct(word_form(before).alias("a"), word_form(after).alias("b")), kind))


def alone_kind(words: Column) -> Column:
    """What lower-case words are that are missing or unneeded."""
    found = F.when(F.forall(words, lambda w: F.translate(w, PUNCTUATION, "") == ""), "PUNCT")
    for name, members in (("DET", DETERMINERS), ("PREP", PREPOSITIONS), ("PRON", PRONOUNS), ("VERB:TENSE", AUXILIARIES)):
        found = found.when(_all(words, members), name)
    return found.otherwise("OTHER")


def kind(before: Column, after: Column, left: Column) -> Column:
    """What the words of an edit are; left: the word before them, or null."""

    def of(x: Column) -> Column:
        a, b = x["a"], x["b"]

        def bases(words: Column, without: frozenset[str]) -> Column:
            return F.transform(F.filter(words, lambda w: ~_member(w, without)), lambda w: word_form(w)["base"])

        def but_for(without: frozenset[str]) -> Column:
            return (F.size(bases(a, without)) > 0) & (bases(a, without) == bases(b, without))

        punctuation = F.forall(F.concat(a, b), lambda w: F.translate(w, PUNCTUATION, "") == "")
        classes = [F.when(_all(F.concat(a, b), c), n) for n, c in (("DET", DETERMINERS), ("PREP", PREPOSITIONS), ("PRON", PRONOUNS))]
        several = F.coalesce(*classes, F.when(but_for(DEGREES), "ADJ").when(but_for(frozenset({"to"})), "VERB:FORM").when(but_for(AUXILIARIES), "VERB:TENSE").otherwise("OTHER"))
        return (
            F.when((F.size(a) == 0) | (F.size(b) == 0), alone_kind(F.concat(a, b)))
            .when(F.array_join(a, "") == F.array_join(b, ""), "ORTH")
            .when((F.size(a) > 1) & (F.array_sort(a) == F.array_sort(b)), "WO")
            .when(punctuation, "PUNCT")
            .when((F.size(a) == 1) & (F.size(b) == 1), word_kind(F.get(a, F.lit(0)), F.get(b, F.lit(0)), x["l"]))
            .otherwise(several)
        )

    lower = lambda words: F.transform(words, F.lower)
    return T.let(F.struct(lower(before).alias("a"), lower(after).alias("b"), F.lower(left).alias("l")), of)


def edit(words: Column, others: Column, start: Column, end: Column, at: Column, to: Column) -> Column:
    """(start, end, type, correction): words start to end have become others at to to."""
    before, after = F.slice(words, start + 1, end - start), F.slice(others, at + 1, to - at)
    letter = F.when(start == end, "M").when(at == to, "U").otherwise("R")
    named = F.concat_ws(":", letter, kind(before, after, F.when(start > 0, F.get(words, start - 1))))
    return F.struct(start.alias("start"), end.alias("end"), named.alias("type"), F.array_join(after, " ").alias("correction"))


def by_place(source: Column, target: Column) -> Column:
    """Edits without an alignment: words at one place that differ are replaced, those at the end of the longer text are unneeded or missing. A pair with a null has null edits."""

    def differing(x: Column) -> Column:
        a, b = x["a"], x["b"]
        places = F.filter(F.sequence(F.lit(0), F.greatest(F.size(a), F.size(b)) - 1), lambda i: ~F.get(a, i).eqNullSafe(F.get(b, i)))
        ends = lambda w, i: (F.least(i, F.size(w)), F.least(i + 1, F.size(w)))
        return F.when(F.greatest(F.size(a), F.size(b)) > 0, F.transform(places, lambda i: edit(a, b, *ends(a, i), *ends(b, i)))).otherwise(F.array().cast(EDITS))

    return F.when(source.isNotNull() & target.isNotNull(), T.let(F.struct(T.spaced(source).alias("a"), T.spaced(target).alias("b")), differing))


# -- alignment, in Python


@lru_cache(1)
def _irregular() -> dict[str, tuple[str, str]]:
    return irregular()


def _cut(word: str) -> str:
    """_ended's: the longest ending goes that leaves two letters."""
    for ending in ("ies", "ied", "ier", "iest", "ily"):
        if word.endswith(ending) and len(word) >= len(ending) + 2:
            word = word[: -len(ending)] + "y"
            break
    else:
        fits = [e for e in ("ing", "ed", "es", "est", "er", "ly", "s", "e") if word.endswith(e) and len(word) >= len(e) + 2]
        word = word[: -len(max(fits, key=len))] if fits else word
    while len(word) > 2 and word.endswith("e"):
        word = word[:-1]
    return word[:-1] if len(word) > 1 and word[-1] == word[-2] and word[-1] in "bdglmnprst" else word


@lru_cache(1 << 16)
def base(word: str) -> str:
    """word_form's base."""
    return _irregular()[word][0] if word in _irregular() else _cut(word)


def _class(word: str) -> int:
    for k, members in enumerate((DETERMINERS, PREPOSITIONS, PRONOUNS, AUXILIARIES)):
        if word in members:
            return k + 1
    return 0 if word.strip(PUNCTUATION) else -1


@lru_cache(1 << 18)
def cost(a: str, b: str) -> int:
    """Of putting b for a: 0 for the same word, 200 at most."""
    if a == b:
        return 0
    a, b = a.lower(), b.lower()
    if a == b:
        return CASE
    x, y = _class(a), _class(b)
    classes = (OPEN if x == 0 else 0) if x == y else CLASSES
    n, most = 0, min(len(a), len(b))
    while n < most and a[n] == b[n]:
        n += 1
    m = 0
    while m < most - n and a[-1 - m] == b[-1 - m]:
        m += 1
    return (0 if base(a) == base(b) else BASES) + classes + LETTERS - LETTERS * (n + m) // max(len(a), len(b))


def costs_of(a: list[str], b: list[str]) -> np.ndarray:
    """cost of each word of a and each of b, worked out for distinct words and many at once."""
    ua, ub = ({w: k for k, w in enumerate(dict.fromkeys(words))} for words in (a, b))
    la, lb = [w.lower() for w in ua], [w.lower() for w in ub]
    ids: dict[str, int] = {}
    bases = [np.array([ids.setdefault(base(w), len(ids)) for w in words]) for words in (la, lb)]
    x, y = (np.array([_class(w) for w in words]) for words in (la, lb))
    sizes = [np.array([len(w) for w in words]) for words in (la, lb)]
    width = int(max(sizes[0].max(), sizes[1].max()))
    letters = [[np.array(ws, dtype=f"U{width}").view(np.uint32).reshape(len(ws), width) for ws in (words, [w[::-1] for w in words])] for words in (la, lb)]
    same = bases[0][:, None] == bases[1][None, :]
    found = np.where(same, 0, BASES) + np.where(x[:, None] == y[None, :], np.where(x == 0, OPEN, 0)[:, None], CLASSES)
    at = np.arange(width)
    step = max(1, CELLS // (len(ub) * width))
    for i in range(0, len(ua), step):
        rows = slice(i, i + step)
        most = np.minimum(sizes[0][rows, None], sizes[1][None, :])
        inside = at < most[:, :, None]
        n, m = (np.logical_and.accumulate((letters[0][k][rows, None, :] == letters[1][k][None, :, :]) & inside, axis=2).sum(axis=2) for k in (0, 1))
        shared = n + np.minimum(m, most - n)
        found[rows] += LETTERS - LETTERS * shared // np.maximum(sizes[0][rows, None], sizes[1][None, :])
        found[rows][(shared == most) & (sizes[0][rows, None] == sizes[1][None, :])] = CASE
    for w, i in ua.items():
        if w in ub:
            found[i, ub[w]] = 0
    return found[np.ix_([ua[w] for w in a], [ub[w] for w in b])]


def _reordered(a: list[str], b: list[str]) -> dict[int, list[tuple[int, np.ndarray]]]:
    """For an end of a run in a its lengths, and where in b the runs begin that have its words in another order; equal runs share these places."""
    found: dict[int, list[tuple[int, np.ndarray]]] = {}
    for k in range(2, RUN + 1):
        at: dict[tuple, dict[tuple, list[int]]] = {}
        for j in range(len(b) - k + 1):
            run = tuple(b[j : j + k])
            at.setdefault(tuple(sorted(run)), {}).setdefault(run, []).append(j)
        known: dict[tuple, np.ndarray] = {}
        for i in range(len(a) - k + 1):
            run = tuple(a[i : i + k])
            orders = at.get(tuple(sorted(run)), {})
            if len(orders) > (run in orders):
                if run not in known:
                    known[run] = np.array([j for order, places in orders.items() if order != run for j in places])
                found.setdefault(i + k, []).append((k, known[run]))
    return found


def aligned(a: list[str], b: list[str]) -> tuple[int, list[tuple[str, int, int, int, int]]]:
    """The least cost, and steps (=, R, D, I or T, then the words' bounds in a and b) of that cost: a word left out or put in is ALONE, k words in another order k - 1 times that.

    Of long lists a few rows of the table are kept at a time, and what stands between them is worked out again for the steps.
    """
    runs = _reordered([w.lower() for w in a], [w.lower() for w in b])
    steps = ALONE * np.arange(len(b) + 1)
    height = max(1, CELLS // (len(b) + 1), isqrt(RUN * len(a)))

    def rows(first: int, above: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The table's rows first - RUN + 1 to first + height, of which those up to first are above, and the costs of the words after first."""
        last = min(first + height, len(a))
        costs = costs_of(a[first:last], b) if last > first and b else np.zeros((last - first, len(b)), np.int64)
        table = np.empty((RUN + last - first, len(b) + 1), np.int64)
        table[:RUN] = above
        for at, i in enumerate(range(first + 1, last + 1), RUN):
            row = table[at - 1] + ALONE
            row[1:] = np.minimum(row[1:], table[at - 1, :-1] + costs[at - RUN])
            for k, starts in runs.get(i, ()):
                row[starts + k] = np.minimum(row[starts + k], table[at - k, starts] + ALONE * (k - 1))
            table[at] = np.minimum.accumulate(row - steps) + steps
        return table, costs

    kept = [np.tile(steps, (RUN, 1))]  # of those only the last is the table's
    for first in range(0, max(1, len(a)), height):
        table, costs = rows(first, kept[-1])
        kept.append(table[-RUN:].copy())
    total = int(table[-1, -1])
    found, i, j = [], len(a), len(b)
    while i or j:
        if i <= first and first:
            first -= height
            table, costs = rows(first, kept[first // height])
        at = i - first + RUN - 1
        if i and j and table[at, j] == table[at - 1, j - 1] + costs[i - first - 1, j - 1]:
            found.append(("=" if a[i - 1] == b[j - 1] else "R", i - 1, i, j - 1, j))
        elif run := next((k for k, starts in runs.get(i, ()) if j - k in starts and table[at, j] == table[at - k, j - k] + ALONE * (k - 1)), 0):
            found.append(("T", i - run, i, j - run, j))
        elif i and table[at, j] == table[at - 1, j] + ALONE:
            found.append(("D", i - 1, i, j, j))
        else:
            found.append(("I", i, i, j - 1, j))
        i, j = found[-1][1], found[-1][3]
    return total, found[::-1]


def merged(a: list[str], b: list[str], steps: list[tuple[str, int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Edits of neighbouring steps. By themselves are runs in another order, punctuation, and words of one class, base or case that stand for each other; but what helps a word to another form (has gone, more often, to go) is of its edit."""
    found: list[tuple[int, int, int, int]] = []
    open_edit = False
    for op, i, k, j, m in steps:
        x, y = a[i:k], b[j:m]
        single = op == "T" or all(not w.strip(PUNCTUATION) for w in x + y)
        if op == "R":
            u, v = x[0].lower(), y[0].lower()
            single = single or cost(x[0], y[0]) < ALONE or 0 < _class(u) == _class(v)
        helped = op == "R" and base(x[0].lower()) == base(y[0].lower()) and found and (found[-1][1], found[-1][3]) == (i, j)
        if helped:
            before = a[found[-1][0] : i] + b[found[-1][2] : j]
            helped = all(w.lower() in HELPERS for w in before)
        if op == "=":
            open_edit = False
        elif helped:
            found[-1] = (found[-1][0], k, found[-1][2], m)
            open_edit = False
        elif single or not open_edit:
            found.append((i, k, j, m))
            open_edit = not single
        else:
            found[-1] = (found[-1][0], k, found[-1][2], m)
    return found


def spans(a: list[str], b: list[str]) -> list[tuple[int, int, int, int]]:
    """The edits' bounds in both lists, by the same alignment whatever their lengths."""
    return merged(a, b, aligned(a, b)[1])


def annotator(align: Callable | None = None) -> Callable[[Column, Column], Column]:
    """A column function of source and target, by the alignment above, or by a function of two texts that gives whole edits. A pair with a null, or one that align fails on, has null edits."""

    @F.pandas_udf(SPANS)
    def spans_of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for source, target in batches:
            yield pd.Series([None if x is None or y is None else [dict(zip(("start", "end", "from", "to"), s, strict=True)) for s in spans(x.split(), y.split())] for x, y in zip(source, target, strict=True)], dtype=object)

    @F.pandas_udf(EDITS)
    def given(source: pd.Series, target: pd.Series) -> pd.Series:
        found = []
        for a, b in zip(source, target, strict=True):
            try:
                found.append([dict(zip(("start", "end", "type", "correction"), e, strict=True)) for e in align(a, b)] if a is not None and b is not None else None)
            except Exception:  # the pair is skipped, as the contract of profiles says
                found.append(None)
        return pd.Series(found, dtype=object)

    def by_cost(source: Column, target: Column) -> Column:
        differ = source != target
        found = spans_of(F.when(differ, source), F.when(differ, target))  # equal texts don't reach Python
        words = F.struct(T.spaced(source).alias("a"), T.spaced(target).alias("b"), found.alias("s"))
        typed = T.let(words, lambda x: F.transform(x["s"], lambda s: edit(x["a"], x["b"], s["start"], s["end"], s["from"], s["to"])))
        return F.when(source == target, F.array().cast(EDITS)).when(differ, typed)

    return given if align else by_cost
