"""The queries of this package, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, anchors, anisotropic, lattice, manifest, minhash, mixing, ngram_join, pieces, quality, secrets, toxicity, warc
from .shared import documents

PIECES = "piece_bpe_32k.model"
BYTES = "byte_bpe_50k.json"


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anisotropic.nearest(documents(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir).select("doc_id", "text"), width=2)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pieces.encode(documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path(PIECES), decoded="decoded")
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.quality(documents(spark, sf_dir))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.archive_and_read(documents(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.score(documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path(PIECES))


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = [r.kind for r in secrets.BASE]

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def number(kind: str) -> Column:
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")

    found = secrets.scan(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select(
        "doc_id",
        *(number(k).alias(f"n_{k}") for k in base),
        F.sha2(joined(F.filter("secrets", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"),
    )


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = anchors.remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir).select("doc_id", "text"), documents(spark, sf_dir, "labels").select("doc_id", "toxic")
    return toxicity.score(docs, labels)


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(documents(spark, sf_dir).select("doc_id", "text"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = alignment.align(documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path(BYTES), public_tokenizers.path(PIECES))
    sha = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", sha.alias("groups_sha256"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    rows = manifest.manifest(docs, tampered)
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", "verified")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_nearest": op1_nearest,
    "op2_minhash": op2_minhash,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_quality_rules": op4_quality_rules,
    "op5_warc": op5_warc,
    "op6_lattice": op6_lattice,
    "op7_secret_scans": op7_secret_scans,
    "op8_mixing": op8_mixing,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_toxicity": op10_toxicity,
    "op11_ngram_join": op11_ngram_join,
    "op12_alignment": op12_alignment,
    "op13_manifest": op13_manifest,
}

#: What stands before (<) or after (>) a node in its run of three.
_SIDE = "coalesce(string_agg(o.d, '' ORDER BY o.i) FILTER (o.i {} x.i), '')"
#: CRC-32 of an id's decimal digits, bit by bit.
_CRC = """xor(4294967295, list_reduce([4294967295] || flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: list_transform(range(8), lambda k: CAST((ascii(c) >> k) & 1 AS BIGINT)))),
            lambda c, b: xor(c >> 1, 3988292384 * xor(c & 1, b))))"""


def _leaf(text: str) -> str:
    """The SHA-256 of a row's values with this one as its text."""
    columns = ["doc_id", "source", "lang", "n_chars", text]
    return "sha256(" + " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in columns) + ")"


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLE_SQL: dict[str, str] = {
    "op2_minhash": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] AS g FROM w, range(1, len(w)) AS r(i) UNION ALL SELECT doc_id, w[1] FROM w WHERE len(w) = 1),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= {minhash.PERCENT} * (x.n + y.n - k)),
        edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a),
        c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
        SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
        FROM c LEFT JOIN n USING (doc_id)""",
    "op4_quality_rules": rf"""
        WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
        tri AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM d, range(1, len(w) - 1) AS r(i)),
        again AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM tri),
        repeated AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, range(0, 3) AS r(k) WHERE n > 1 GROUP BY doc_id),
        line AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS raw FROM d),
        filled AS (SELECT *, trim(regexp_replace(translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09\x0B-\x0D]+', ' ', 'g'), ' ') AS norm FROM line),
        lines AS (SELECT *, len(string_split(norm, ' ')) AS words FROM filled WHERE norm <> ''),
        dup AS (SELECT doc_id, count(*) - count(DISTINCT raw) AS n FROM lines GROUP BY doc_id),
        frequent AS (SELECT source, norm FROM lines GROUP BY source, norm HAVING count(DISTINCT doc_id) > {quality.LIMIT}),
        removed AS (SELECT l.doc_id, sum(words) AS n FROM lines l JOIN frequent f ON l.norm = f.norm AND l.source IS NOT DISTINCT FROM f.source GROUP BY l.doc_id),
        b AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
                CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
                CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
                CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(repeated.n, 0) AS BIGINT) AS n_repeat_words,
                CAST(coalesce(removed.n, 0) AS BIGINT) AS gone
              FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN repeated USING (doc_id) LEFT JOIN removed USING (doc_id))
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
            n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
            NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * (n_words - gone) >= {quality.KEPT_PERCENT} * n_words AS kept
        FROM b""",
    "op5_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
        digits AS (SELECT page_id, html, list_transform([1, 11, 21, 31], lambda k: CAST('0x' || h[k : k + 9] AS BIGINT)) AS parts FROM p),
        d AS (SELECT page_id, html, list_aggregate(flatten(list_transform(parts, lambda v: list_transform([35, 30, 25, 20, 15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> s) & 31 AS BIGINT) + 1, 1)))), 'string_agg', '') AS digest FROM digits),
        k AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS kept FROM d)
        SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, digest AS payload_digest,
            CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> kept THEN kept END AS refers_to
        FROM k""",
    "op9_substring_dedup": rf"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        win AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS g FROM d, range(1, len(w) - 48) AS r(i)),
        own AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS first FROM win),
        gone AS (SELECT DISTINCT doc_id, i + k AS p FROM own, range(0, 50) AS r(k) WHERE first < doc_id),
        places AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
            sha256(CASE WHEN ps IS NULL THEN array_to_string(w, ' ') ELSE coalesce(array_to_string(list_filter(w, lambda x, i: NOT list_contains(ps, i)), ' '), '') END) AS kept_sha256
        FROM d LEFT JOIN places USING (doc_id)""",
    "op11_ngram_join": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + {ngram_join.WIDTH - 1}], ' ') AS g FROM w, range(1, len(w) - {ngram_join.WIDTH - 2}) AS r(i)
              UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND {ngram_join.WIDTH - 1}),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= {minhash.PERCENT} * (x.n + y.n - k)),
        edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a),
        c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
        SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id FROM c LEFT JOIN n USING (doc_id)""",
    "op13_manifest": rf"""
        WITH RECURSIVE leaves AS (SELECT doc_id, source, {_leaf("text")} AS d,
                {_leaf("replace(text, chr(10), '')")} AS now, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS m FROM documents),
        t AS (SELECT source, 0 AS lvl, i, m, d FROM leaves
              UNION ALL SELECT source, lvl + 1, i // 3, (m + 2) // 3, sha256(string_agg(d, '' ORDER BY i)) FROM t WHERE m > 1 GROUP BY source, lvl, i // 3, m),
        subroot AS (SELECT source, lvl AS h, d AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS j FROM t WHERE m = 1),
        u AS (SELECT 0 AS lvl, j AS i, (SELECT count(*) FROM subroot) AS m, subroot AS d FROM subroot
              UNION ALL SELECT lvl + 1, i // 3, (m + 2) // 3, sha256(string_agg(d, '' ORDER BY i)) FROM u WHERE m > 1 GROUP BY lvl, i // 3, m),
        steps AS (SELECT x.source, x.lvl, x.i, {_SIDE.format("<")} AS l, {_SIDE.format(">")} AS r FROM t x LEFT JOIN t o ON o.source IS NOT DISTINCT FROM x.source AND o.lvl = x.lvl AND o.i // 3 = x.i // 3 AND o.i <> x.i WHERE x.m > 1 GROUP BY x.source, x.lvl, x.i),
        above AS (SELECT x.lvl, x.i, {_SIDE.format("<")} AS l, {_SIDE.format(">")} AS r FROM u x LEFT JOIN u o ON o.lvl = x.lvl AND o.i // 3 = x.i // 3 AND o.i <> x.i WHERE x.m > 1 GROUP BY x.lvl, x.i),
        f AS (SELECT doc_id, source, i, 0 AS lvl, CASE WHEN crc % 2 = 0 AND now IS NOT NULL THEN now ELSE d END AS d, '' AS proof FROM (SELECT *, {_CRC} AS crc FROM leaves)
              UNION ALL SELECT f.doc_id, f.source, f.i // 3, f.lvl + 1, sha256(s.l || f.d || s.r), f.proof || s.l || s.r FROM f JOIN steps s ON s.source IS NOT DISTINCT FROM f.source AND s.lvl = f.lvl AND s.i = f.i),
        g AS (SELECT f.doc_id, f.source, j AS i, 0 AS lvl, f.d, f.proof FROM f JOIN subroot b ON b.source IS NOT DISTINCT FROM f.source AND b.h = f.lvl
              UNION ALL SELECT g.doc_id, g.source, g.i // 3, g.lvl + 1, sha256(a.l || g.d || a.r), g.proof || a.l || a.r FROM g JOIN above a ON a.lvl = g.lvl AND a.i = g.i)
        SELECT g.doc_id, v.d AS leaf, b.subroot, u.d AS root, sha256(g.proof) AS proof_sha256, g.d AS folded_root, g.d = u.d AS verified
        FROM g JOIN u ON u.m = 1 AND u.lvl = g.lvl JOIN subroot b ON b.source IS NOT DISTINCT FROM g.source JOIN leaves v ON v.doc_id = g.doc_id""",
}
