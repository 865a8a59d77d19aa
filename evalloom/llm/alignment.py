"""Alignment of two tokenizations of one text by byte owners.

Tokenizer A (byte-level BPE) encodes a space and the text, tokenizer B (pieces with byte fallback) the text, to which it adds the space itself. Each text is encoded once, and the ids are stored. Repeating each token's
index over its bytes gives every byte an owner in A and one in B. Each run of equal pairs of owners is a link, a pair of tokens whose bytes overlap; places where both owners change at once cut the text into groups.

For encoding a text is cut before single spaces that stand between two plain characters: neither tokenizer has a token across such a place, so that each stretch is encoded by itself, many of them as one text, and
short ones are remembered in a task.

The corpus-wide number of links of each pair of ids comes from the stored ids (each task sums its own pairs); then these are gone through again, with the numbers broadcast if they are at most KNOWN pairs, and else joined.

Defined results: null and empty texts, and texts that either tokenizer does not give back byte by byte, have no tokens, zeros and an empty column of groups, and no part in the
numbers; repeated rows count as often as they occur, and so do rows of equal or null ids; other columns, whatever their names, play no part; an empty table gives an empty one.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .shared import new_path, stored, text_slices

#: Characters of the longest stretch that a task remembers, and how many it remembers before it forgets those not used of late.
SHORT, REMEMBERED = 48, 150_000
#: Pairs of ids up to which their numbers are broadcast (17 bytes each), and those that a task holds before it sums them.
KNOWN, HELD = 1 << 22, 1 << 19
#: Bytes of text that a task splits at once, characters of the stretches that are encoded as one text, and tokens that are aligned at once.
SLICE, JOINED, TOKENS = 1 << 20, 4096, 1 << 18
#: Texts whose ids are in one file: a task that reads a few files has their ids in few Arrow batches, of which each is held whole.
FILE_ROWS = 2048
_CUT = re.compile("(?<=[!-~À-ɏ]) (?=[!-~À-ɏ])")
_PLAIN = frozenset(map(chr, [*range(ord("!"), ord("~") + 1), *range(ord("À"), ord("ɏ") + 1)]))
_SPACE = "▁"


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it can be seen, else the next one from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Aligner:
    """Two tokenizers and the bytes of their tokens."""

    def __init__(self, a_file: str, b_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        letters = _byte_letters()
        named = [self.a.id_to_token(i) for i in range(self.a.get_vocab_size())]
        self.a_bytes = [bytes(map(letters.get, t)) if all(c in letters for c in t) else t.encode() for t in named]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes((int(p[3:5], 16),)) if self.b.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.cuts = not any(_SPACE in p.lstrip(_SPACE) for p in pieces)  # else a piece could go on across a space
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        # A token's text with what follows it: another of its side, the other side, another group, nothing.
        n_a, n_b = len(named), len(pieces)
        self.said = [*(f"{i}," for i in range(n_a)), *(f"{i}|" for i in range(n_a)), *(f"{i}," for i in range(n_b)), *(f"{i};" for i in range(n_b))]

    def stretches(self, text: str) -> list[str]:
        return _CUT.split(text) if self.cuts else [text]

    def encode(self, stretches: list[str]) -> list[tuple[bytes, bytes] | None]:
        """A's and B's ids of each stretch as bytes, None if one of them doesn't give it back. Stretches that begin and end with plain characters are encoded as one text with spaces between them; where that isn't given back,
        each by itself."""
        chunks, room = [], 0
        for k, s in enumerate(stretches):
            plain = self.cuts and s and s[0] in _PLAIN and s[-1] in _PLAIN
            if plain and room > len(s):
                chunks[-1].append(k)
            else:
                chunks.append([k])
                room = JOINED if plain else 0
            room -= len(s) + 1
        result: list[tuple[bytes, bytes] | None] = [None] * len(stretches)
        while chunks:
            texts = [" ".join([stretches[k] for k in c]) for c in chunks]
            a_ids = [e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
            again = []
            for c, t, *ids in zip(chunks, texts, a_ids, self.b.encode(texts, num_threads=1), strict=True):
                data = b" " + t.encode()
                if all(b"".join(map(of.__getitem__, i)) == data for of, i in zip((self.a_bytes, self.b_bytes), ids, strict=True)):
                    # Bytes at which stretches end, and the tokens up to there.
                    ends = np.cumsum([1 + (len(stretches[k]) if t.isascii() else len(stretches[k].encode())) for k in c])
                    arrays = [np.array(i, np.int32) for i in ids]
                    bounds = [np.searchsorted(np.cumsum(size[i]), ends, "right").tolist() for size, i in zip((self.a_size, self.b_size), arrays, strict=True)]
                    a, b = (i.tobytes() for i in arrays)
                    for k, (p, q), (u, v) in zip(c, pairwise([0, *bounds[0]]), pairwise([0, *bounds[1]]), strict=True):
                        result[k] = a[4 * p : 4 * q], b[4 * u : 4 * v]
                elif len(c) > 1:
                    again += [[k] for k in c]
            chunks = again
        return result

    def align(self, a: np.ndarray, b: np.ndarray) -> Aligned:
        """Of one or more texts' ids, of which every text is whole."""
        a_owner, b_owner = np.repeat(np.arange(len(a), dtype=np.int32), self.a_size[a]), np.repeat(np.arange(len(b), dtype=np.int32), self.b_size[b])
        a_new, b_new = np.diff(a_owner, prepend=-1) > 0, np.diff(b_owner, prepend=-1) > 0
        both = a_new & b_new
        link, cut = np.flatnonzero(a_new | b_new), np.flatnonzero(both)
        return Aligned(a_owner[link], b_owner[link], link, cut, np.flatnonzero(a_new), np.flatnonzero(b_new), both)

    def groups(self, a: np.ndarray, b: np.ndarray, of: Aligned) -> list[str]:
        """The groups' ids as text, token by token in the order of the text: in a group A's tokens come before B's, so that a token comes after those of earlier groups and, of B, those of A in its own."""
        of_byte = np.cumsum(of.both, dtype=np.int32) - 1
        a_group, b_group = of_byte[of.a_start], of_byte[of.b_start]
        a_until, b_until = (np.searchsorted(g, np.arange(len(of.cut) + 1)) for g in (a_group, b_group))
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + b_until[a_group]] = a + len(self.a_bytes) * np.diff(a_group, append=-1).astype(bool)
        order[np.arange(len(b)) + a_until[b_group + 1]] = b + 2 * len(self.a_bytes) + len(self.b_bytes) * np.diff(b_group, append=-1).astype(bool)
        return list(map(self.said.__getitem__, order.tolist()))


class Aligned(NamedTuple):
    """The links' tokens of A and of B, the bytes at which links, groups, A's and B's tokens begin, and of each byte whether a group begins there."""

    a_link: np.ndarray
    b_link: np.ndarray
    link: np.ndarray
    cut: np.ndarray
    a_start: np.ndarray
    b_start: np.ndarray
    both: np.ndarray


class Memory:
    """What a task remembers of short stretches."""

    def __init__(self, aligner: Aligner) -> None:
        self.aligner = aligner
        self.recent: dict[str, tuple[bytes, bytes] | None] = {}
        self.older: dict[str, tuple[bytes, bytes] | None] = {}

    def ids(self, stretches: set[str]) -> dict[str, tuple[bytes, bytes] | None]:
        found, new, recent, older = {}, [], self.recent, self.older
        for s in stretches:
            if s in recent:
                found[s] = recent[s]
            elif s in older:
                found[s] = recent[s] = older[s]
            else:
                new.append(s)
        for s, x in zip(new, self.aligner.encode(new), strict=True):
            found[s] = x
            if len(s) <= SHORT:
                recent[s] = x
        if len(recent) > REMEMBERED:
            self.older, self.recent = recent, {}
        return found


@lru_cache(1)
def _aligner(a_file: str, b_file: str) -> Aligner:
    return Aligner(a_file, b_file)


def _lists(parts: list[bytes]) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.append(0, np.cumsum([len(p) // 4 for p in parts])).astype(np.int32), np.frombuffer(b"".join(parts), np.int32))


def encoded(docs: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """(doc_id, row, a, b): the ids of each text, stored; row is a number of its own. Texts without tokens have empty lists."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(a_file, b_file)
        memory = Memory(aligner)
        for batch in rows:
            for lo, hi in text_slices(batch.column(2), SLICE):
                split = [aligner.stretches(t) if t else [] for t in batch.column(2).slice(lo, hi - lo).to_pylist()]
                known = memory.ids({s for parts in split for s in parts})
                a, b = [], []
                for parts in split:
                    ids = [known[s] for s in parts]
                    one, two = zip(*ids, strict=True) if ids and None not in ids else ((), ())
                    a.append(b"".join(one))
                    b.append(b"".join(two))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(lo, hi - lo) for k in (0, 1)), _lists(a), _lists(b)], ["doc_id", "row", "a", "b"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col("text").cast("string").alias("text"))
    found = found.mapInArrow(batches, "doc_id long, row long, a array<int>, b array<int>")
    path = new_path(docs.sparkSession, "ids")
    found.write.option("compression", "zstd").option("maxRecordsPerFile", FILE_ROWS).parquet(path)
    return docs.sparkSession.read.schema(found.schema).parquet(path)


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Some rows at a time, of TOKENS tokens about: their bounds, all ids of A and of B, and the bounds of each row's ids in these."""
    sides = []
    for name in "ab":
        column = batch.column(batch.schema.get_field_index(name))
        sides.append((column.offsets.to_numpy().astype(np.int64), column.values.to_numpy()))
    (a_at, a), (b_at, b) = sides
    lo = 0
    while lo < len(batch):
        hi = min(len(batch), max(lo + 1, int(np.searchsorted(a_at, a_at[lo] + TOKENS, "right")) - 1))
        yield lo, hi, a[a_at[lo] : a_at[hi]], b[b_at[lo] : b_at[hi]], a_at[lo : hi + 1] - a_at[lo], b_at[lo : hi + 1] - b_at[lo]
        lo = hi


def _summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    pairs, which = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
    return pairs, np.bincount(which, np.concatenate([n for _, n in held]), len(pairs)).astype(np.int64)


def pair_counts(ids: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """(pair, n, best): the number of links that each pair of ids (A's * 2**32 + B's) has in all encoded texts, and whether no other pair of its id of B has more."""

    def counted(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, held, size = _aligner(a_file, b_file), [], 0

        def batches(pairs: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(pairs), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[at : at + (1 << 16)]) for x in (pairs, n)], ["pair", "n"])

        for batch in rows:
            for _, _, a, b, _, _ in _texts(batch):
                of = aligner.align(a, b)
                held.append(np.unique(a[of.a_link].astype(np.int64) << 32 | b[of.b_link], return_counts=True))
                size += len(held[-1][0])
                if size > HELD:
                    held = [_summed(held)]
                    size = len(held[0][0])
                    if 2 * size > HELD:
                        yield from batches(*held.pop())
                        size = 0
        if held:
            yield from batches(*_summed(held))

    counts = stored(ids.select("a", "b").mapInArrow(counted, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    of = F.col("pair").bitwiseAND((1 << 32) - 1)
    most = counts.groupBy(of.alias("b")).agg(F.max("n").alias("most"))  # a row for each id of B
    return stored(counts.join(most, of == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "best")


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def align(docs: DataFrame, a_file: str, b_file: str, known: int = KNOWN) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) for each row of (doc_id, text); the files' paths must hold on all machines."""
    ids = encoded(docs, a_file, b_file)
    counts = pair_counts(ids, a_file, b_file)
    small = counts.count() <= known
    table = None
    if small:
        found = counts.orderBy("pair").toArrow()
        table = docs.sparkSession.sparkContext.broadcast(tuple(found.column(c).to_numpy() for c in ("pair", "n", "best")))

    def rows_of(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(a_file, b_file)
        pairs, n, best = table.value if small else (None, None, None)
        for batch in rows:
            for lo, hi, a, b, a_at, b_at in _texts(batch):
                of = aligner.align(a, b)
                starts = np.append(0, np.cumsum(aligner.a_size[a]))[a_at]  # bytes at which the rows begin and end
                links, groups = np.searchsorted(of.link, starts), np.searchsorted(of.cut, starts)
                linked = a[of.a_link].astype(np.int64) << 32 | b[of.b_link]
                at = np.searchsorted(pairs, linked) if small else np.zeros(0, np.int64)
                sums = [np.diff(np.append(0, np.cumsum(x[at], dtype=np.int64))[links]) if small else np.zeros(hi - lo, np.int64) for x in (best, n)]
                said = aligner.groups(a, b, of)
                texts = ["".join(said[p:q])[:-1] for p, q in pairwise((a_at + b_at).tolist())]
                lists = pa.ListArray.from_arrays((np.zeros_like(links) if small else links).astype(np.int32), np.zeros(0, np.int64) if small else linked)
                numbers = (np.diff(a_at), np.diff(b_at), np.diff(groups), np.diff(links), *sums)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(lo, hi - lo) for k in (0, 1)), *map(pa.array, numbers), pa.array(texts, pa.string()), lists], ["doc_id", "row", *COLUMNS, "groups", "links"])

    rows = ids.mapInArrow(rows_of, f"doc_id long, row long, {', '.join(f'{c} long' for c in COLUMNS)}, groups string, links array<long>")
    if small:
        return rows.drop("row", "links")
    rows = stored(rows, "aligned")
    sums = rows.select("row", F.explode("links").alias("pair")).groupBy("row", "pair").agg(F.count("*").alias("times")).join(counts, "pair")
    sums = sums.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    whole = rows.drop("links", "n_best", "count_sum").join(sums, "row", "left")
    return whole.select("doc_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in COLUMNS), "groups")
