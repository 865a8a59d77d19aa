"""Alignments against the two libraries on whole texts and overlaps by comparison of ranges."""

import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evalloom.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def letters():
    """Bytes by letter of the byte-level vocabulary, from the published rule."""
    seen = list(range(ord("!"), ord("~") + 1)) + list(range(ord("¡"), ord("¬") + 1)) + list(range(ord("®"), ord("ÿ") + 1))
    found, n = {chr(b): b for b in seen}, 0
    for b in range(256):
        if b not in seen:
            found[chr(256 + n)], n = b, n + 1
    return found


def spans(tokens):
    at, found = 0, []
    for i, data in tokens:
        found.append((i, at, at + len(data)))
        at += len(data)
    return found


def plain(rows, libraries):
    a, b = libraries
    of = letters()
    texts, counts = [], Counter()
    for _, text in rows:
        links, groups = None, ""
        if text:
            x = [(i, bytes(of[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
            y = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
            if b"".join(d for _, d in x) == b"".join(d for _, d in y) == (" " + text).encode():
                x, y = spans(x), spans(y)
                links = [(i, j) for i, s, e in x for j, t, f in y if s < f and t < e]
                cuts = sorted({e for _, _, e in x} & {f for _, _, f in y})
                parts = [[[str(i) for i, s, e in side if p <= s and e <= q] for side in (x, y)] for p, q in zip([0, *cuts], cuts)]
                groups = ";".join("|".join(",".join(side) for side in part) for part in parts)
                counts.update(links)
                texts.append((len(x), len(y), len(cuts), links, groups))
        if links is None:
            texts.append((0, 0, 0, [], ""))
    most = Counter()
    for (_, j), n in counts.items():
        most[j] = max(most[j], n)
    return sorted((str(d), n, m, g, len(li), sum(counts[p] == most[p[1]] for p in li), sum(counts[p] for p in li), said) for (d, _), (n, m, g, li, said) in zip(rows, texts, strict=True))


def found(frame):
    return sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in frame.collect())


def corpus():
    rng = random.Random(4)
    pieces = ["the", "Straße", "don't", "naïve", "  ", "   x", "\n", "\n\n ", "\t", "x\r\n", "12345", "3.14", "€", "😀", "日本語テキスト", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", "a.b,c", "http://x.y/z?q=1", " ", "é", "ﬁ", "İ", " ", "\x1f", "ſ", "A" * 70, "'s", "' s", "--", "¿qué?", "​", "﻿"]
    texts = ["".join(rng.choice(pieces) + rng.choice(["", " ", " ", " "]) for _ in range(rng.choice([1, 3, 30]))) for _ in range(250)]
    return [*enumerate(texts + ["", " ", "  ", " a", "a ", "a▁b", "▁", "x\0y", None, None, "the the", "the the"]), (3, "again"), (None, "no id"), (None, None)]


@pytest.mark.parametrize("known", [alignment.KNOWN, 5])
def test_plain_overlaps(spark, libraries, known):
    """Both ways of bringing the numbers to the texts."""
    rows = corpus()
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).select("*", *(F.lit(1).alias(c) for c in ("pair", "n", "links", "row", "groups")))
    want = plain(rows, libraries)
    assert sum(w[1] > 0 for w in want) > 200 and sum(w[1] == 0 for w in want) >= 6
    assert found(alignment.align(frame, A, B, known)) == want


def test_whole_documents(spark, libraries, small):
    """Long texts of the tables, tokens and groups against the libraries (overlaps by ranges would take too long)."""
    a, b = libraries
    docs = spark.read.parquet(f"{small}/documents.parquet")
    of = {r.doc_id: r for r in alignment.align(docs, A, B).collect()}
    for d in docs.collect():
        x, y = a.encode(" " + d.text, add_special_tokens=False).ids, b.encode(d.text)
        r = of[d.doc_id]
        parts = [p.split("|") for p in r.groups.split(";")]
        assert [int(i) for p in parts for i in p[0].split(",")] == x and [int(i) for p in parts for i in p[1].split(",")] == y
        assert (r.n_a, r.n_b, r.n_groups) == (len(x), len(y), len(parts)) and r.n_links >= max(r.n_a, r.n_b)


def test_a_long_text_without_spaces_and_an_empty_table(spark, libraries):
    text = "日本語abc" * 20_000
    row = alignment.align(spark.createDataFrame([(1, text)], "doc_id long, text string"), A, B).first()
    assert (row.n_a, row.n_b) == (len(libraries[0].encode(" " + text, add_special_tokens=False).ids), len(libraries[1].encode(text)))
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string"), A, B).collect() == []


def test_memory_of_stretches_is_bounded(monkeypatch):
    monkeypatch.setattr(alignment, "REMEMBERED", 50)
    memory = alignment.Memory(alignment.Aligner(A, B))
    for k in range(40):
        memory.ids({f"w{k}x{j}" for j in range(10)} | {"y" * 100 + str(k)})
    assert len(memory.recent) <= 60 and len(memory.older) <= 60 and not any(len(s) > alignment.SHORT for s in memory.recent)


def test_stretches_together_are_as_each_by_itself():
    """Encoded as one text, or alone; one that is not given back leaves the others as they are."""
    words = [w for _, t in corpus()[:100] if t for w in alignment._CUT.split(t)] + ["a▁b", "plain"]
    aligner = alignment.Aligner(A, B)
    together = aligner.encode(words)
    assert together[words.index("a▁b")] is None and together == [aligner.encode([w])[0] for w in words]


def test_task_sums_add_up(spark, monkeypatch):
    """Pairs that a task passes on in parts are still counted whole."""
    rows = [(k, " ".join(f"word{j} und" for j in range(k % 50))) for k in range(200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    ids = alignment.encoded(frame, A, B)
    whole = {r.pair: (r.n, r.best) for r in alignment.pair_counts(ids, A, B).collect()}
    monkeypatch.setattr(alignment, "HELD", 40)
    monkeypatch.setattr(alignment, "TOKENS", 100)
    assert {r.pair: (r.n, r.best) for r in alignment.pair_counts(ids, A, B).collect()} == whole
