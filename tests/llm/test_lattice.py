"""Lattice scores against all segmentations."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from evalloom.llm import lattice

SCHEMA = "doc_id long, text string, g int, r string, words string"


@pytest.fixture(scope="module")
def model_file():
    return public_tokenizers.path("piece_bpe_32k.model")


def ways(word, piece_logs, byte_logs):
    """The log of the sum over all segmentations, one by one."""
    if not word:
        return [0.0]
    found = []
    for k in range(1, len(word) + 1):
        if word[:k] in piece_logs:
            found += [piece_logs[word[:k]] + x for x in ways(word[k:], piece_logs, byte_logs)]
        elif k == 1:
            own = sum(byte_logs[b] for b in word[0].encode())
            found += [own + x for x in ways(word[1:], piece_logs, byte_logs)]
    return found


def test_forward_is_the_sum_over_all_segmentations(model_file):
    import sentencepiece

    vocab = lattice.vocabulary(model_file)
    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    rng = np.random.default_rng(1)
    chances = vocab.start * rng.uniform(0.5, 1.5, len(vocab.start))
    logs = lattice._logs(chances / chances.sum())
    piece_logs = {p: logs[i] for i in range(model.get_piece_size()) if np.isfinite(logs[i]) and not model.is_byte(i) and not model.is_control(i) and not model.is_unknown(i) for p in [model.id_to_piece(i)]}
    byte_logs = {b: logs[vocab.bytes[b]] for b in range(256)}
    words = ["the", "a", "testing", "x", "straße", "日本", "🙂a", "don't", "aaaaaa"]
    found = lattice.log_probabilities(words, logs, vocab)
    for word, value in zip(words, found, strict=True):
        each = np.array(ways("▁" + word, piece_logs, byte_logs))
        assert value == pytest.approx(each.max() + math.log(np.exp(each - each.max()).sum()), abs=1e-9)


def test_expected_counts_are_slopes(model_file):
    """How often a piece is used is the slope of the log probability in its log weight."""
    vocab = lattice.vocabulary(model_file)
    logs = lattice._logs(vocab.start)
    graph = lattice.Lattice(["testing"], vocab)
    used = graph.expected(logs, np.array([1.0]))
    piece = int(np.argmax(used))
    up, down = logs.copy(), logs.copy()
    up[piece] += 1e-5
    down[piece] -= 1e-5
    assert used[piece] == pytest.approx((graph.forward(up)[1][0] - graph.forward(down)[1][0]) / 2e-5, abs=1e-5)


def plain_base(rows):
    def tokens(text):
        return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) + [None]

    def out(i):
        return i is not None and zlib.crc32(str(i).encode()) % 7 == 2

    counts = Counter(w for i, t in rows if not out(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    return {i: (out(i), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t))) for i, t in rows}


def test_base_score_and_edges(spark, model_file):
    texts = ["The cat sat on the mat", "the dog", None, "", " \t\n", "Ünïcode wörds É é", "a b c", "x " * 500, "the dog"]
    rows = [*enumerate(texts * 4)]
    found = lattice.score(spark.createDataFrame([(i, t, 0, "", "") for i, t in rows], SCHEMA), model_file).collect()
    want = plain_base(rows)
    assert len(found) == len(rows)
    for r in found:
        w = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert r.base_score == pytest.approx(w[4], abs=1e-9)
        assert r.score < 0
    assert len({r.score for r in found if not (texts[r.doc_id % len(texts)] or "").split()}) == 1


def test_empty_table_and_held_out_only(spark, model_file):
    assert lattice.score(spark.createDataFrame([], SCHEMA), model_file).count() == 0
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = lattice.score(spark.createDataFrame([(only, "a b", 0, "", "")], SCHEMA), model_file).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (True, 3, 0, 0)


def test_learning_makes_held_out_documents_likelier(spark, middle, model_file):
    """Against the vocabulary's own scores, by which the rounds begin."""
    from evalloom.llm.queries import op6_lattice

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{middle}/documents.parquet").select("doc_id", "text").collect()}
    rows = [r for r in op6_lattice(spark, middle).where("held_out").collect() if r.n_tokens > 20]
    vocab = lattice.vocabulary(model_file)
    logs = lattice._logs(vocab.start)
    better = 0
    for r in rows[:40]:
        words = [w.decode() for w in lattice._words(texts[r.doc_id])]
        start = (lattice.log_probabilities(words, logs, vocab).sum() + logs[vocab.end]) / math.log(10)
        better += r.score > start
    assert better > 0.95 * len(rows[:40])


def test_long_words_are_worked_out_as_short_ones_are(model_file):
    vocab = lattice.vocabulary(model_file)
    logs = lattice._logs(vocab.start)
    for word in ["testing", "straßenbahnhaltestelle", "日本語", "a" * 40, "x🙂y" * 9]:
        graph, one = lattice.Lattice([word], vocab), lattice.LongWord(word, vocab)
        assert one.forward(logs)[-1] == pytest.approx(graph.forward(logs)[1][0], abs=1e-9)
        assert one.expected(logs, 3) == pytest.approx(graph.expected(logs, np.array([3.0])), abs=1e-9)


def splits(word, vocab):
    """All segmentations of a word, each as the numbers of its pieces."""
    if not word:
        return [()]
    found = []
    for k in range(1, len(word) + 1):
        if word[:k] in vocab.pieces:
            found += [(vocab.pieces[word[:k]], *x) for x in splits(word[k:], vocab)]
        elif k == 1:
            found += [(*vocab.bytes[[*word[0].encode()]].tolist(), *x) for x in splits(word[1:], vocab)]
    return found


def test_scores_equal_a_plain_version(spark, model_file):
    texts = ["the cat sat", "a dog sat on it", None, "it is 日", "The end", "cats run", "run dog run", "x", "one cat", "so it is", "on the mat", "a 🙂 b"]
    vocab, rows = lattice.vocabulary(model_file), [*enumerate(texts)]
    words = {i: [w.decode() for w in lattice._words(t)] for i, t in rows}
    ways_of = {w: splits("▁" + w, vocab) for ws in words.values() for w in ws}
    trained = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    chances = vocab.start
    for _ in range(lattice.ROUNDS):
        used = lattice.PRIOR * vocab.start
        for i in trained:
            for w in words[i]:
                each = [math.prod(chances[p] for p in way) for way in ways_of[w]]
                for way, x in zip(ways_of[w], each, strict=True):
                    for p in way:
                        used[p] += x / sum(each)
            used[vocab.end] += 1
        chances = used / used.sum()
    want = {i: sum(math.log10(sum(math.prod(chances[p] for p in way) for way in ways_of[w])) for w in words[i]) + math.log10(chances[vocab.end]) for i, _ in rows}
    found = {r.doc_id: r.score for r in lattice.score(spark.createDataFrame([(i, t, 0, "", "") for i, t in rows], SCHEMA), model_file).collect()}
    assert found == pytest.approx(want, abs=1e-9)


def test_one_very_long_text_and_a_repeated_row(spark, model_file):
    rows = [(1, "ab" * 30_000, 0, "", ""), *[(None, "", 0, "", "")] * 50]
    found = lattice.score(spark.createDataFrame(rows, SCHEMA), model_file)
    assert found.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    found = found.collect()
    assert len(found) == 51 and all(math.isfinite(r.score) for r in found)
