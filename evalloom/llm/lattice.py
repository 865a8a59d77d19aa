"""Language-model scores from a subword lattice.

The pieces of an existing vocabulary and the scores it gives them are the start: a piece of rank r weighs 1 / (r + 2). Rounds of
expectation-maximisation over all words of the training documents turn these weights into probabilities. A text is its
words, each with a space in front, and one end. All segmentations of a word count: the forward recursion adds up their
probabilities in log space, and the text's probability is the product over its words and the end. No piece crosses a space,
so each distinct word is worked out once in a group of documents.

Beside this stands the base score, from smoothed counts of whole words. Counts meet the documents without a
broadcast: documents are dealt to groups of about GROUP_BYTES, row by row, a group sends its distinct words with its counts to tasks by range of
hash, and these send back the counts of the whole corpus, in the same order. So a frequent word is one entry a group.

Defined results: null and empty texts are an end alone; a row with a null id trains; characters without a piece are
their bytes; repeated rows count each; other columns play no part; an empty table gives an empty one.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored

SPACE = "▁"
GROUP_BYTES = 5 << 20
ROUNDS = 2
#: Pieces that the vocabulary's own scores count as, against those of the training words.
PRIOR = 1000.0
BLOCK = 4096
#: Words of more characters are worked out one by one, in time in proportion to their length.
LONG = 512
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_NONE = 0x110000


class Vocabulary:
    """The pieces of a model file as a table of all their prefixes, by hash; the last number is the end."""

    def __init__(self, model_file: str):
        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = model.get_piece_size()
        self.size, self.end = n + 1, n
        self.bytes = np.zeros(256, np.int64)
        ranks, pieces = np.full(n + 1, float(n)), {}
        for i in range(n):
            if model.is_byte(i):
                self.bytes[int(model.id_to_piece(i)[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                piece = model.id_to_piece(i)
                if SPACE not in piece[1:]:
                    pieces[piece] = i
                    ranks[i] = min(-model.get_score(i), n)
        used = np.array([*pieces.values(), *self.bytes, self.end])
        self.start = np.zeros(n + 1)
        self.start[used] = 1 / (ranks[used] + 2)
        self.start /= self.start.sum()
        self.used = np.unique(used)
        table = {piece[:k]: -1 for piece in pieces for k in range(1, len(piece) + 1)} | pieces
        keys = np.array([self._hash(p) for p in table], _U)
        self.pieces, self.longest = pieces, max(map(len, pieces), default=1)
        order = np.argsort(keys)
        self.keys, self.numbers = keys[order], np.array([*table.values()])[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two prefixes share a hash")

    @staticmethod
    def _hash(piece: str) -> int:
        found = 0
        for c in piece:
            found = (found * int(_BASE) + ord(c) + 1) % (1 << 64)
        return found

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return self.keys[place] == hashes, self.numbers[place]


class LongWord:
    """One long word, place by place: what Lattice does for many short ones at once."""

    def __init__(self, word: str, vocab: Vocabulary):
        self.word, self.vocab = SPACE + word, vocab

    def _arcs(self, end: int, logs: list[float]):
        """(start, weight, pieces) of all that end at a place."""
        word, pieces = self.word, self.vocab.pieces
        for start in range(end - 1, max(-1, end - 1 - self.vocab.longest), -1):
            number = pieces.get(word[start:end])
            if number is not None:
                yield start, logs[number], (number,)
            elif start == end - 1:  # a character without a piece is its bytes
                parts = tuple(self.vocab.bytes[[*word[start].encode("utf-8", "surrogatepass")]].tolist())
                yield start, sum(logs[b] for b in parts), parts

    def forward(self, logs: np.ndarray) -> array:
        alpha, logs = array("d", [0.0]), logs.tolist()
        for end in range(1, len(self.word) + 1):
            alpha.append(_log_sum([alpha[start] + weight for start, weight, _ in self._arcs(end, logs)]))
        return alpha

    def expected(self, logs: np.ndarray, count: int) -> np.ndarray:
        alpha, used, listed = self.forward(logs), np.zeros(self.vocab.size), logs.tolist()
        beta = array("d", [-math.inf]) * len(alpha)
        beta[-1] = 0.0
        for end in range(len(self.word), 0, -1):  # all arcs from here on are in beta[end] by now
            if beta[end] == -math.inf:
                continue
            for start, weight, parts in self._arcs(end, listed):
                after = weight + beta[end]
                beta[start] = _log_sum([beta[start], after])
                share = math.exp(alpha[start] + after - alpha[-1]) * count
                for b in parts:
                    used[b] += share
        return used


def _log_sum(values: list[float]) -> float:
    most = max(values, default=-math.inf)
    return most if most == -math.inf else most + math.log(sum(math.exp(v - most) for v in values))


@lru_cache(1)
def vocabulary(model_file: str) -> Vocabulary:
    return Vocabulary(model_file)


class Lattice:
    """Arcs of some words: for each start and length, the words and the piece's number (or minus one minus the character)."""

    def __init__(self, words: list[str], vocab: Vocabulary):
        self.vocab, self.lengths = vocab, np.array([len(w) + 1 for w in words])
        width = int(self.lengths.max(initial=1))
        points = np.full((len(words), width), _NONE, np.uint32)
        flat = np.frombuffer((SPACE + SPACE.join(words)).encode("utf-32-le", "surrogatepass"), np.uint32)
        points[np.arange(width) < self.lengths[:, None]] = flat
        self.width, self.arcs = width, []
        for i in range(width):
            rows = np.flatnonzero(self.lengths > i)
            hashes = np.zeros(len(rows), _U)
            with np.errstate(over="ignore"):
                for k in range(i, width):
                    hashes = hashes * _BASE + points[rows, k].astype(_U) + _U(1)
                    found, numbers = vocab.look_up(hashes)
                    whole = found & (numbers >= 0)
                    if k == i:  # a character without a piece is its bytes
                        self._add(i, k, rows[~whole], -1 - points[rows[~whole], k].astype(np.int64))
                    self._add(i, k, rows[whole], numbers[whole])
                    rows, hashes = rows[found], hashes[found]
                    if not len(rows):
                        break

    def _add(self, i: int, k: int, rows: np.ndarray, numbers: np.ndarray) -> None:
        if len(rows):
            self.arcs.append((i, k + 1, rows, numbers))

    def _weights(self, logs: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        if numbers[0] >= 0:
            return logs[numbers]
        points, place = np.unique(-1 - numbers, return_inverse=True)
        return np.array([logs[self.vocab.bytes[list(chr(p).encode("utf-8", "surrogatepass"))]].sum() for p in points])[place]

    def forward(self, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log sums over all ways to each place, and those of whole words."""
        alpha = np.full((len(self.lengths), self.width + 1), -np.inf)
        alpha[:, 0] = 0
        for i, k, rows, numbers in self.arcs:
            alpha[rows, k] = np.logaddexp(alpha[rows, k], alpha[rows, i] + self._weights(logs, numbers))
        return alpha, alpha[np.arange(len(self.lengths)), self.lengths]

    def expected(self, logs: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """How often each piece is used, over all segmentations by their probability."""
        alpha, total = self.forward(logs)
        beta = np.full_like(alpha, -np.inf)
        beta[np.arange(len(self.lengths)), self.lengths] = 0
        used = np.zeros(self.vocab.size)
        for i, k, rows, numbers in reversed(self.arcs):
            after = self._weights(logs, numbers) + beta[rows, k]
            beta[rows, i] = np.logaddexp(beta[rows, i], after)
            share = np.exp(alpha[rows, i] + after - total[rows]) * counts[rows]
            if numbers[0] >= 0:
                used += np.bincount(numbers, share, self.vocab.size)
            else:
                for point in np.unique(numbers):
                    for b in chr(-1 - point).encode("utf-8", "surrogatepass"):
                        used[self.vocab.bytes[b]] += share[numbers == point].sum()
        return used


def _blocks(words: list[str]):
    """Words of about the same length together, short ones in larger blocks; long ones are left out."""
    lengths = np.array([len(w) for w in words], np.int64)
    order = np.argsort(lengths, kind="stable")
    order = order[: np.searchsorted(lengths[order], LONG, "right")]
    at = 0
    while at < len(order):
        n = max(1, BLOCK * 8 // max(8, len(words[order[min(at + BLOCK, len(order)) - 1]])))
        yield order[at : at + n]
        at += n


def _long(words: list[str]) -> list[int]:
    return [k for k, w in enumerate(words) if len(w) > LONG]


def log_probabilities(words: list[str], logs: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """The natural logarithm of each word's probability over all segmentations."""
    found = np.zeros(len(words))
    for block in _blocks(words):
        found[block] = Lattice([words[k] for k in block], vocab).forward(logs)[1]
    for k in _long(words):
        found[k] = LongWord(words[k], vocab).forward(logs)[-1]
    return found


def expected_pieces(words: list[str], counts: np.ndarray, logs: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """How often each piece is used in words that come so many times."""
    used = np.zeros(vocab.size)
    for block in _blocks(words):
        used += Lattice([words[k] for k in block], vocab).expected(logs, counts[block])
    for k in _long(words):
        used += LongWord(words[k], vocab).expected(logs, int(counts[k]))
    return used


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def _press(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def _open(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _counts(texts, trains, ranges: int) -> list[list[tuple[bytes, int]]]:
    """The distinct words of a group by range of hash, in order, with how often training documents have them."""
    all_words, trained = set(), Counter()
    for text, train in zip(texts, trains, strict=True):
        words = _words(text.as_py())
        all_words.update(words)
        if train:
            trained.update(words)
    parts: list[list[tuple[bytes, int]]] = [[] for _ in range(ranges)]
    for word in sorted(all_words):
        parts[zlib.crc32(word) % ranges].append((word, trained[word]))
    return parts


def score(docs: DataFrame, model_file: str) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of (doc_id, text), in logarithms to base 10."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    trains = ~F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    known = docs.agg(F.sum(F.octet_length("text")).alias("bytes"), F.sum(trains.cast("long")).alias("ends")).first()
    volume, ends = known["bytes"] or 0, known["ends"] or 0
    groups = max(1, math.ceil(volume / GROUP_BYTES))
    ranges = max(1, groups // 2)
    # Rows are dealt out one by one, whatever they hold; the table makes that final.
    grouped = stored(docs.withColumn("g", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("int")), "groups")

    def count(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        parts = _counts(table.column("text"), [not held_out(d) for d in table.column("doc_id").to_pylist()], ranges)
        rows = [(r, key[0].as_py(), _press(b"\n".join(w for w, _ in p)), _press(np.array([c for _, c in p], np.int64).tobytes())) for r, p in enumerate(parts) if p]
        return _table(rows, [("r", pa.int32()), ("g", pa.int32()), ("words", pa.binary()), ("counts", pa.binary())])

    def total(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """Each group's words with the counts of all, and (g null) the training words of this range."""
        sums: Counter = Counter()
        for words, counts in zip(table.column("words"), table.column("counts"), strict=True):
            for word, c in zip(_open(words.as_py()).split(b"\n"), np.frombuffer(_open(counts.as_py()), np.int64).tolist(), strict=True):
                sums[word] += c
        rows = []
        for g, words in zip(table.column("g").to_pylist(), table.column("words"), strict=True):
            rows.append((g, key[0].as_py(), None, _press(np.array([sums[w] for w in _open(words.as_py()).split(b"\n")], np.int64).tobytes()), 0, 0))
        trained = sorted(w for w, c in sums.items() if c)
        counts = np.array([sums[w] for w in trained], np.int64)
        for at in range(0, len(trained), 50_000):
            part = counts[at : at + 50_000]
            rows.append((None, key[0].as_py(), _press(b"\n".join(trained[at : at + 50_000])), _press(part.tobytes()), int(part.sum()), len(part)))
        return _table(rows, [("g", pa.int32()), ("r", pa.int32()), ("words", pa.binary()), ("counts", pa.binary()), ("n", pa.int64()), ("v", pa.int64())])

    sent = grouped.groupBy("g").applyInArrow(count, "r int, g int, words binary, counts binary")
    totals = stored(sent.groupBy("r").applyInArrow(total, "g int, r int, words binary, counts binary, n long, v long"), "totals")
    sums = totals.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    n, v = (sums["n"] or 0) + ends, (sums["v"] or 0) + (ends > 0)

    vocab = vocabulary(model_file)
    chances = vocab.start
    for _ in range(ROUNDS):
        logs = _logs(chances)

        def expect(batches, logs=logs):
            vocab = vocabulary(model_file)
            used = np.zeros(vocab.size)
            for batch in batches:
                for words, counts in zip(batch.column(0), batch.column(1), strict=True):
                    words, counts = _open(words.as_py()).decode().split("\n"), np.frombuffer(_open(counts.as_py()), np.int64)
                    used += expected_pieces(words, counts, logs, vocab)
            some = np.flatnonzero(used)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(used[some])], ["piece", "used"])

        parts = totals.where("g IS NULL").select("words", "counts").mapInArrow(expect, "piece long, used double")
        used = PRIOR * vocab.start
        for piece, times in parts.groupBy("piece").agg(F.sum("used").alias("used")).collect():  # at most one row a piece
            used[piece] += times
        used[vocab.end] += ends
        chances = used / used.sum()
    logs = _logs(chances)

    def rate(key: tuple[pa.Scalar, ...], table: pa.Table, met: pa.Table) -> pa.Table:
        vocab = vocabulary(model_file)
        of = dict(zip(met.column("r").to_pylist(), met.column("counts"), strict=True))
        place, counts = {}, [np.zeros(0, np.int64)]
        for r, part in enumerate(_counts(table.column("text"), [False] * len(table), ranges)):
            if part:
                counts.append(np.frombuffer(_open(of[r].as_py()), np.int64))
                place.update(zip((w for w, _ in part), range(len(place), len(place) + len(part)), strict=True))
        counts = np.concatenate(counts)
        likely = log_probabilities([w.decode() for w in place], logs, vocab) / math.log(10)
        plain = np.log10((counts + 1) / (n + v + 1))
        rows = []
        for doc_id, text in zip(table.column("doc_id").to_pylist(), table.column("text"), strict=True):
            at = np.array([place[w] for w in _words(text.as_py())], np.int64)
            rows.append((doc_id, held_out(doc_id), len(at) + 1, int((counts[at] > 0).sum()) + (ends > 0), n, float(plain[at].sum() + math.log10((ends + 1) / (n + v + 1))), float(likely[at].sum() + logs[vocab.end] / math.log(10))))
        return _table(rows, [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    met = totals.where("g IS NOT NULL").select("g", "r", "counts")
    return grouped.groupBy("g").cogroup(met.groupBy("g")).applyInArrow(rate, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _logs(chances: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log(chances)


def _table(rows: list[tuple], fields: list) -> pa.Table:
    schema = pa.schema(fields)
    return pa.table([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True) if rows else [[]] * len(fields), schema, strict=True)], schema=schema)
