"""Secret scans against the regular expressions themselves."""

import random
import re

import pytest

from evalloom.llm import secrets

SCHEMA = "doc_id long, text string, secrets int, kind string"
PATTERNS = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""".replace("(password", "((?i:password").replace("api_?key)", "api_?key))"), re.A), 2, 8),
    "access": (re.compile("AKIA[A-Z0-9]+"), 0, 16),
    "hex": (re.compile("[0-9a-f]+"), 0, 32),
    "key": (re.compile("-----BEGIN [A-Z ]*PRIVATE KEY-----"), 0, 1),
    "forge": (re.compile("gh[pousr]_[A-Za-z0-9]+"), 0, 40),
    "chat": (re.compile("xox[abprs]-[A-Za-z0-9-]+"), 0, 15),
    "payment": (re.compile("[sr]k_live_[A-Za-z0-9]+"), 0, 28),
    "webtoken": (re.compile(r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"), 0, 1),
}


def plain(text):
    found = []
    for place, (kind, (pattern, group, least)) in enumerate(PATTERNS.items()):
        for m in pattern.finditer(text or ""):
            if len(m[{2: m.re.groups}.get(group, 0)]) >= least:
                found.append((m.start(), place, kind, m.end()))
    return [(kind, a, b) for a, _, kind, b in sorted(found)]


def texts(n=300, seed=2):
    rng = random.Random(seed)
    parts = ["password", "PassWd", "secret", "toKEN", "api_key", "APIKEY", "=", ":", " ", "  ", '"', "'", "\n", "é", "日", "AKIA", "AKIAAKIA", "ABCDEFGH1234", "deadbeef" * 4, "0123456789abcdef", "x", "Zz9+/_.=-", "-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN ", "PRIVATE KEY-----", "short", "longer_value_1", "🙂", "ghp_", "gho_" + "a1" * 18, "xoxb-", "xoxp-12-", "sk_live_", "rk_live_abcdefghij", "eyJ", "eyJhb.", "eyJ-_x.eyJzd.", "."]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 60))) for _ in range(n)]


def test_random_texts_against_regexes(spark):
    rows = [*enumerate(texts())]
    found = secrets.scan(spark.createDataFrame([(i, t, 0, "k") for i, t in rows], SCHEMA)).collect()
    assert sum(len(r.secrets) for r in found) > 100
    for r in found:
        assert [(s.kind, s.start, s.end) for s in r.secrets] == plain(rows[r.doc_id][1]), rows[r.doc_id][1]


def test_documents_against_regexes(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for r in secrets.scan(docs).collect():
        assert [(s.kind, s.start, s.end) for s in r.secrets] == plain(r.text)


def test_edges(spark):
    rows = [(1, None, 0, ""), (2, "", 0, ""), (3, "token=" + "a" * 100_000, 0, ""), (4, "f" * 31, 0, ""), (4, "f" * 31, 0, ""), (5, "f" * 32, 0, "")]
    found = secrets.scan(spark.createDataFrame(rows, SCHEMA))
    assert found.columns == ["doc_id", "text", "kind", "secrets"]
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.secrets] for r in found.collect()}
    assert got == {1: [], 2: [], 3: [("assign", 0, 100_006), ("hex", 6, 100_006)], 4: [], 5: [("hex", 0, 32)]}
    assert secrets.scan(spark.createDataFrame([], SCHEMA)).count() == 0


def test_redaction(spark):
    from pyspark.sql import functions as F

    rows = [(1, "é password=abcdefgh1 and " + "0a" * 16 + ".", 0, ""), (2, "nothing", 0, "")]
    found = secrets.scan(spark.createDataFrame(rows, SCHEMA)).select("doc_id", secrets.redacted(F.col("text"), F.col("secrets")).alias("t")).collect()
    assert {r.doc_id: r.t for r in found} == {1: "é [assign] and [hex].", 2: "nothing"}


def test_the_automaton_stays_small():
    one = secrets.automaton(secrets.RULES)
    assert len(secrets.RULES) == 8 and len(one.outputs) < 10_000 and one.width < 60
    print(len(one.outputs), "states,", one.width, "classes")


def test_rules_that_the_automaton_cannot_say():
    with pytest.raises(ValueError):
        secrets.Automaton((secrets.Rule("x", r"a\d"),))
