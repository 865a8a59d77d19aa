"""What the corpus operators have in common: slices of Arrow text, hashed words, and tables kept in the shared folder."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import dropped, shared_folder
from ..session import settled as stored
from ..session import shared_path as new_path

__all__ = ["dropped", "new_path", "shared_folder", "stored"]

#: Bytes of text that a task hashes at once.
SLICE_BYTES = 1 << 20
#: Any odd numbers serve; two of each give 128 bits.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

_U = np.uint64
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: Marks what stands between words when punctuation does, too.
PUNCTUATION = _SEPARATOR.copy()
PUNCTUATION[[c for c in range(128) if not chr(c).isalnum()]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


class Words(NamedTuple):
    """Words of some texts. bounds[d]:bounds[d + 1] are those of text d; start and end are byte offsets into data."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray


def text_slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges that hold at most so many bytes, or one text."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + most, "right")) - 1)
        yield lo, min(hi, len(column))
        lo = hi


def words_of(column: pa.Array, lower: bool = False, between: np.ndarray = _SEPARATOR) -> Words:
    """Maximal runs of bytes other than 0x20 and 0x09-0x0D (or those marked in between); a null text has none. lower: A-Z become a-z."""
    column = column.cast(pa.string()) if not pa.types.is_string(column.type) else column
    if not len(column) or not column.buffers()[2]:
        return Words(np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(column) + 1, np.int64))
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    inside = ~between[data]
    first = np.ones(len(data), bool)
    first[1:] = ~inside[:-1]
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    last = np.ones(len(data), bool)
    last[:-1] = ~inside[1:]
    last[offsets[1:][offsets[1:] > 0] - 1] = True
    start, end = np.flatnonzero(inside & first), np.flatnonzero(inside & last) + 1
    return Words(_LOWER[data] if lower else data, start, end, np.searchsorted(start, offsets))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**k and base**-k modulo 2**64 for k < n at least."""
    if base not in _powers or len(_powers[base][0]) < n:
        size = 1 << max(10, (n - 1).bit_length())
        with np.errstate(over="ignore"):
            both = [np.full(size, x, _U) for x in (base, pow(base, -1, 1 << 64))]
            for x in both:
                x[0] = 1
                np.cumprod(x, out=x)
        _powers[base] = both[0], both[1]
    return _powers[base]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers under which close numbers become far ones."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def span_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = BASES[0]) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each pair; it depends on the values alone, not on where they stand."""
    up, down = powers(base, len(values) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(values) + 1, _U)
        np.cumsum((values.astype(_U) + _U(1)) * up[: len(values)], out=sums[1:])
        return mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(_U) * _U(0xD6E8FEB86659FD93))


def word_hash(words: Words, base: int = BASES[0]) -> np.ndarray:
    return span_hash(words.data, words.start, words.end, base)


def runs_hash(hashes: np.ndarray, n: int, base: int = BASES[1]) -> np.ndarray:
    """The hash of each n successive values, by the place of the first; runs across texts are for the caller to leave out."""
    at = np.arange(max(0, len(hashes) - n + 1))
    return span_hash(hashes, at, at + n, base)


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
