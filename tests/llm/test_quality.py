"""Quality rules against a plain version."""

import re
from collections import Counter

from evalloom.llm import quality

SCHEMA = "doc_id long, text string, source string, mark string, n_words string, line int"


def plain(rows, limit):
    def lines(text):
        return [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]

    def norm(line):
        return " ".join(re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in line)))

    has = Counter(k for i, t, s in {*rows} for k in {(s, norm(x)) for x in lines(t)})
    found = {}
    for i, text, source in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        often = Counter(windows)
        n_repeat = len({k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(3)})
        gone = sum(len(norm(x).split(" ")) for x in lines(text) if has[source, norm(x)] > limit)
        failed = len(words) < 50 or 100 * n_repeat > 50 * len(words)
        found[i] = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines(text)) - len({*lines(text)}), n_repeat, failed, not failed and 100 * (len(words) - gone) >= 50 * len(words))
    return found


def test_rules(spark):
    body = "\n".join(f"line {i} of a text with words number {i * 7}" for i in range(8))
    menu = "Home | About | Contact us and all the other things that a menu has today"
    rows = [(i, f"{menu}\n" * 6 + f"own words of {i} " * 12, "a") for i in range(5)]
    rows += [(10, body, "a"), (11, f"{menu}\n{body} x", "a"), (12, menu.upper() + "\n" + body, "b"), (13, None, None), (14, "", "a"), (15, "word " * 60, "c"), (16, f"{body}\n{body}", None)]
    rows += [(20 + i, f"{menu}\r\n" + " ".join(f"d{i}w{j}" for j in range(60)), None) for i in range(4)]
    frame = spark.createDataFrame([(*r, "m", "n", 0) for r in rows], SCHEMA)
    found = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in quality.quality(frame, limit=3).collect()}
    assert found == plain(rows, 3)
    assert {r[-1] for r in found.values()} == {True, False}


def test_repeated_rows_and_empty_table(spark):
    frame = spark.createDataFrame([(1, "a b", "s", "", "", 0)] * 3 + [(None, "a b", "s", "", "", 0)], SCHEMA)
    assert quality.quality(frame, limit=1).count() == 4
    assert quality.quality(spark.createDataFrame([], SCHEMA)).count() == 0


def test_texts_without_frequent_lines(spark):
    """Frequent lines go wherever and however often they stand; all others stay as they are."""
    menu = "Home | About  us"
    rows = [(i, f"{menu}\n\n  Own line {i}\n{menu.upper()} \nlast {i}\n\n", "a") for i in range(4)]
    rows += [(10, menu, "a"), (11, f"{menu}\n{menu}\n", "a"), (12, f"{menu}\nx", "b"), (13, None, "a"), (14, "", "a"), (15, f"one\n{menu}\r\n\ttwo", "a"), (16, f"x\n{menu}", None), (0, rows[0][1], "a")]
    frame = spark.createDataFrame([(*r, "m", "n", 0) for r in rows], SCHEMA)
    found = quality.quality(frame, limit=3)
    want = {i: f"\n  Own line {i}\nlast {i}\n\n" for i in range(4)} | {10: "", 11: "", 12: f"{menu}\nx", 13: None, 14: "", 15: "one\n\ttwo", 16: f"x\n{menu}"}
    assert sorted((r.doc_id, r.cleaned or "", r.cleaned is None) for r in found.collect()) == sorted((i, want[i] or "", want[i] is None) for i, _, _ in rows)
    assert {r.doc_id: r.cleaned for r in quality.quality(frame, limit=30).collect()} == {i: t for i, t, _ in rows}
