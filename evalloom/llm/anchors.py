"""Exact substring dedup of word windows by fixed-block anchors.

Any window of WINDOW words holds a whole block of BLOCK words that starts at a multiple of BLOCK in its document. All such
blocks are the index; every document probes it with the block that starts at each of its words. Where a block of one
document turns up in another, the hit is extended: the windows around it are hashed (96 bits) and those that a
document with a smaller id also has are removed, together the maximal exact repeats.

Documents are dealt to groups by a hash of the id, about GROUP_BYTES of text each. A group sends its blocks and probes as sorted
short hashes to tasks by range of hash, each once however often the group has it, so that a common passage costs a task
one entry a group. Short hashes only nominate: of the probes about one in a thousand hits by chance.

Defined results: null and empty texts have no words; a row with a null id removes nothing and loses nothing; rows with equal
ids remove nothing from each other; a document repeats itself freely; other columns play no part; an empty table gives
an empty one. A text is handled whole, in memory.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import BASES, runs_hash, span_hash, text_slices, word_hash, words_of

WINDOW, BLOCK = 50, 25
GROUP_BYTES = 6 << 20
RANGE_WORDS = 4 << 20
_U = np.uint64
_SECOND = 0xA0761D6478BD642F
RESULT = "doc_id long, n_words long, n_removed long, repeats array<struct<first: int, last: int>>, kept string"


def pack(values: np.ndarray) -> bytes:
    """Sorted 64-bit numbers as differences, byte by byte: the upper bytes are zeros that compress away."""
    steps = np.diff(values, prepend=_U(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack(data: bytes) -> np.ndarray:
    steps = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.cumsum(np.ascontiguousarray(steps.reshape(8, -1).T).view(_U).ravel(), dtype=_U)


class Group:
    """The hashed words of a group's documents; rows without id are left out."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        self.ids = table.column("doc_id").to_numpy(zero_copy_only=False) if not table.column("doc_id").null_count else None
        if self.ids is None:
            table = table.filter(table.column("doc_id").is_valid()).combine_chunks()
            self.ids = table.column("doc_id").to_numpy()
        self.ids = self.ids.astype(np.int64)
        column = table.column("text").combine_chunks() if table.num_rows else pa.array([], pa.string())
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) and column.num_chunks else column
        self.texts = column
        hashes, counts = [np.zeros(0, _U)], [np.zeros(0, np.int64)]
        for lo, hi in text_slices(column):
            words = words_of(column.slice(lo, hi - lo))
            hashes.append(word_hash(words))
            counts.append(np.diff(words.bounds))
        self.hashes, self.counts = np.concatenate(hashes), np.concatenate(counts)
        self.bounds = np.concatenate([[0], np.cumsum(self.counts)])
        self.doc = np.repeat(np.arange(len(self.ids)), self.counts)

    def runs(self, n: int, base: int = BASES[1]) -> tuple[np.ndarray, np.ndarray]:
        """Places at which n words of one document start, and the hashes of these."""
        found = runs_hash(self.hashes, n, base)
        at = np.flatnonzero(self.doc[: len(found)] == self.doc[n - 1 :]) if len(found) else np.zeros(0, np.int64)
        return at, found[at]

    def around(self, blocks: np.ndarray) -> np.ndarray:
        """Places at which a window starts that holds one of the blocks."""
        first = np.maximum(blocks - (WINDOW - BLOCK), self.bounds[self.doc[blocks]])
        last = np.minimum(blocks, self.bounds[self.doc[blocks] + 1] - WINDOW)
        some = last >= first
        edge = np.zeros(len(self.hashes) + 1, np.int64)
        np.add.at(edge, first[some], 1)
        np.add.at(edge, last[some] + 1, -1)
        return np.flatnonzero(np.cumsum(edge)[:-1])

    def shared_blocks(self, at: np.ndarray, short: np.ndarray, hits: np.ndarray) -> np.ndarray:
        """Of the blocks at these places those whose short hash is a hit, or that two documents of the group have, one of them in the index."""
        _, inverse = np.unique(short, return_inverse=True)
        low, high = np.full(inverse.max(initial=-1) + 1, len(self.ids)), np.full(inverse.max(initial=-1) + 1, -1)
        np.minimum.at(low, inverse, self.doc[at])
        np.maximum.at(high, inverse, self.doc[at])
        indexed = np.zeros(len(low), bool)
        indexed[inverse[(at - self.bounds[self.doc[at]]) % BLOCK == 0]] = True
        chosen = ((low != high) & indexed)[inverse]
        if len(hits):
            chosen |= hits[np.minimum(np.searchsorted(hits, short), len(hits) - 1)] == short
        return at[chosen]

    def windows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ends = at + WINDOW
        return span_hash(self.hashes, at, ends, BASES[0]), span_hash(self.hashes, at, ends, _SECOND) >> _U(32)


def _ranges(values: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The ranges (of n) that sorted numbers of so many bits fall into, and where each begins in values."""
    part = ((values >> _U(max(0, bits - 32))) * _U(n) >> _U(min(32, bits))).astype(np.int64)
    return np.unique(part, return_index=True)


def _empty(*names: str) -> dict:
    return {n: [] for n in names}


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, repeats, kept) for each row of (doc_id, text): repeats are spans of word places, last exclusive; kept is the other words, joined by spaces."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    volume = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_groups, n_ranges = max(1, math.ceil(volume / GROUP_BYTES)), max(1, math.ceil(volume / 6 / RANGE_WORDS))
    bits = min(63, max(32, math.ceil(math.log2(max(2, volume / 6 * 40)))))
    shift = _U(64 - bits)
    grouped = docs.where("doc_id IS NOT NULL").withColumn("g", F.pmod(F.xxhash64("doc_id"), F.lit(n_groups)).cast("int"))

    def probes(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        group = Group(table)
        at, found = group.runs(BLOCK)
        aligned = (at - group.bounds[group.doc[at]]) % BLOCK == 0
        rows = _empty("r", "g", "blocks", "probes")
        index, probe = np.unique(found[aligned] >> shift), np.unique(found >> shift)
        for part, lo, hi in _parts(probe, n_ranges, bits):
            a, b = np.searchsorted(index, [probe[lo], probe[hi - 1]]) + [0, 1]
            rows["r"].append(part)
            rows["g"].append(key[0].as_py())
            rows["blocks"].append(pack(index[a : min(b, len(index))][index[a : min(b, len(index))] <= probe[hi - 1]]))
            rows["probes"].append(pack(probe[lo:hi]))
        return pa.table(rows, pa.schema([("r", pa.int32()), ("g", pa.int32()), ("blocks", pa.binary()), ("probes", pa.binary())]))

    def meet(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """For each group the probes that some block has and another group probes, too."""
        index = np.unique(np.concatenate([unpack(x.as_py()) for x in table.column("blocks")]))
        groups, found = table.column("g").to_pylist(), []
        for x in table.column("probes"):
            values = unpack(x.as_py())
            found.append(values[index[np.minimum(np.searchsorted(index, values), len(index) - 1)] == values] if len(index) else values[:0])
        values, counts = np.unique(np.concatenate(found), return_counts=True)
        common = values[counts > 1]
        hits = [np.intersect1d(x, common, assume_unique=True) for x in found]
        kept = [k for k, x in enumerate(hits) if len(x)]
        return pa.table({"g": pa.array([groups[k] for k in kept], pa.int32()), "hits": pa.array([pack(hits[k]) for k in kept], pa.binary())})

    def extend(key: tuple[pa.Scalar, ...], table: pa.Table, met: pa.Table) -> pa.Table:
        """The windows around hits, each with the least id that the group has it for."""
        group = Group(table)
        hits = np.unique(np.concatenate([np.zeros(0, _U), *(unpack(x.as_py()) for x in met.column("hits"))]))
        at, found = group.runs(BLOCK)
        starts = group.around(at[(hits[np.minimum(np.searchsorted(hits, found >> shift), len(hits) - 1)] == found >> shift)]) if len(hits) else at[:0]
        rows = _empty("r", "g", "one", "two", "owner")
        one, two, owner = _least(*group.windows(starts), group.ids[group.doc[starts]])
        for part, lo, hi in _parts(one, n_ranges, 64):
            rows["r"].append(part)
            rows["g"].append(key[0].as_py())
            rows["one"].append(pack(one[lo:hi]))
            rows["two"].append(two[lo:hi].astype(np.uint32).tobytes())
            rows["owner"].append(_ids(owner[lo:hi]))
        return pa.table(rows, pa.schema([("r", pa.int32()), ("g", pa.int32()), ("one", pa.binary()), ("two", pa.binary()), ("owner", pa.binary())]))

    def smallest(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """For each group those of its windows that another group has for a smaller id."""
        groups = table.column("g").to_pylist()
        blobs = [(unpack(a.as_py()), np.frombuffer(b.as_py(), np.uint32).astype(_U), _from_ids(c.as_py())) for a, b, c in zip(table.column("one"), table.column("two"), table.column("owner"), strict=True)]
        one, two, owner = _least(*(np.concatenate(x) for x in zip(*blobs, strict=True)))
        rows = _empty("g", "one", "two", "owner")
        for g, (a, b, c) in zip(groups, blobs, strict=True):
            least = owner[_find(one, two, a, b)]
            some = least < c
            if some.any():
                for name, value in zip(rows, (g, pack(a[some]), b[some].astype(np.uint32).tobytes(), _ids(least[some])), strict=True):
                    rows[name].append(value)
        return pa.table(rows, pa.schema([("g", pa.int32()), ("one", pa.binary()), ("two", pa.binary()), ("owner", pa.binary())]))

    def remove(key: tuple[pa.Scalar, ...], table: pa.Table, met: pa.Table) -> pa.Table:
        group = Group(table)
        blobs = [(unpack(a.as_py()), np.frombuffer(b.as_py(), np.uint32).astype(_U), _from_ids(c.as_py())) for a, b, c in zip(met.column("one"), met.column("two"), met.column("owner"), strict=True)]
        at, found = group.runs(BLOCK)
        starts = group.around(group.shared_blocks(at, found >> shift, np.zeros(0, _U)))
        places = np.zeros(len(group.hashes), bool)
        one, two = group.windows(starts)
        mine = group.ids[group.doc[starts]]
        if len(starts):
            a, b, least = _least(one, two, mine)
            places[starts[least[_find(a, b, one, two)] < mine]] = True
        if blobs:
            a, b, least = _least(*(np.concatenate(x) for x in zip(*blobs, strict=True)))
            at, one = group.runs(WINDOW, BASES[0])
            some = np.flatnonzero(a[np.minimum(np.searchsorted(a, one), len(a) - 1)] == one)
            at = at[some]
            one, two = group.windows(at)
            place = _find(a, b, one, two)
            places[at[(a[place] == one) & (b[place] == two) & (least[place] < group.ids[group.doc[at]])]] = True
        edge = np.zeros(len(places) + WINDOW + 1, np.int64)
        starts = np.flatnonzero(places)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + WINDOW, -1)
        gone = np.cumsum(edge)[: len(places)] > 0
        return _rows(group, gone)

    met = grouped.groupBy("g").applyInArrow(probes, "r int, g int, blocks binary, probes binary").groupBy("r").applyInArrow(meet, "g int, hits binary")
    around = grouped.groupBy("g").cogroup(met.groupBy("g")).applyInArrow(extend, "r int, g int, one binary, two binary, owner binary")
    owners = around.groupBy("r").applyInArrow(smallest, "g int, one binary, two binary, owner binary")
    named = grouped.groupBy("g").cogroup(owners.groupBy("g")).applyInArrow(remove, RESULT)
    return named.unionByName(docs.where("doc_id IS NULL").mapInArrow(_untouched, RESULT))


def _parts(values: np.ndarray, n: int, bits: int):
    if len(values):
        parts, begin = _ranges(values, n, bits)
        yield from zip(parts.tolist(), begin.tolist(), [*begin[1:].tolist(), len(values)], strict=True)


def _least(one: np.ndarray, two: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct windows in order, each with its least owner."""
    order = np.lexsort((owner, two, one))
    one, two, owner = one[order], two[order], owner[order]
    first = np.ones(len(one), bool)
    first[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    return one[first], two[first], owner[first]


def _find(one: np.ndarray, two: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The places of the windows (a, b) among distinct ones in order; some place where there is none."""
    place = np.minimum(np.searchsorted(one, a), len(one) - 1)
    while True:  # equal first hashes with unequal second ones are rare
        later = (two[place] < b) & (one[place] == a) & (np.append(one[1:], ~one[-1])[place] == a)
        if not later.any():
            return place
        place = place + later


def _ids(values: np.ndarray) -> bytes:
    """Ids as places among the distinct ones."""
    names, place = np.unique(values, return_inverse=True)
    kind = np.uint16 if len(names) <= 1 << 16 else np.uint32
    return zstandard.ZstdCompressor(level=1).compress(np.array([len(names), kind().itemsize], np.int64).tobytes() + names.tobytes() + place.astype(kind).tobytes())


def _from_ids(data: bytes) -> np.ndarray:
    data = zstandard.ZstdDecompressor().decompress(data)
    n, width = np.frombuffer(data, np.int64, 2)
    return np.frombuffer(data, np.int64, n, 16)[np.frombuffer(data, np.uint16 if width == 2 else np.uint32, offset=16 + 8 * n)]


def _rows(group: Group, gone: np.ndarray) -> pa.Table:
    removed, repeats, kept = [], [], []
    for d, text in enumerate(group.texts):
        mask = gone[group.bounds[d] : group.bounds[d + 1]]
        words = (text.as_py() or "").encode().split()
        removed.append(int(mask.sum()))
        edges = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0)).tolist() if removed[-1] else []
        repeats.append([{"first": a, "last": b} for a, b in zip(edges[::2], edges[1::2], strict=True)])
        kept.append(b" ".join(words if not removed[-1] else [w for w, out in zip(words, mask.tolist(), strict=True) if not out]).decode())
    return pa.table({"doc_id": pa.array(group.ids, pa.int64()), "n_words": pa.array(group.counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()),
                     "repeats": pa.array(repeats, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))), "kept": pa.array(kept, pa.string())})


def _untouched(rows):
    for batch in rows:
        words = [(x or "").encode().split() for x in batch.column(1).to_pylist()]
        n = len(batch)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(n, pa.int64()), pa.array([*map(len, words)], pa.int64()), pa.array([0] * n, pa.int64()), pa.array([[]] * n, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))), pa.array([b" ".join(w).decode() for w in words], pa.string())],
            ["doc_id", "n_words", "n_removed", "repeats", "kept"],
        )
