"""SentencePiece encoding and decoding by a table of last pieces.

The merges of a BPE model give every prefix of a text one last piece. An automaton over all pieces finds those that
end at a place, and the one that the merges leave there is the one that is compatible with the last piece of the
prefix before it. The ids follow by walking back from the end. The table takes time in proportion to the text,
whatever its shape; equal stretches between white space are encoded once in a worker.

Defined results: null and empty texts have no ids and decode to the empty string; other columns pass unchanged, and
columns named like an output are replaced; repeated rows give equal results; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import text_slices

SPACE = "▁"
#: Stretches and pairs that a worker remembers before it starts anew.
REMEMBERED = 120_000
SLICE = 2 << 20
_BYTES = re.compile("[\udc80-\udcff]")


class Remembered(dict):
    """A bounded memory of a function's results: at most twice REMEMBERED, of which those not used for long go first."""

    def __init__(self, function, most: int = REMEMBERED):
        super().__init__()
        self.function, self.most, self.older = function, most, {}

    def __missing__(self, key):
        value = self.older.pop(key, None)
        if value is None:
            value = self.function(key)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class PieceTable:
    """The pieces of a BPE model file with byte fallback, and encoding and decoding with them."""

    def __init__(self, model_file: str):
        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(len(self.pieces))]
        self.bytes = {i: int(p[3:5], 16) for i, p in enumerate(self.pieces) if model.is_byte(i)}
        self.byte_ids = {b: i for i, b in self.bytes.items()}
        self.ids = {p: i for i, p in enumerate(self.pieces) if not special[i] and i not in self.bytes}
        # Pieces of one character are where merging starts; they have no merge to undo.
        self.order = {p: -1 if len(p) == 1 else round(-model.get_score(i)) for p, i in self.ids.items()}
        # Pieces of one score are merged leftmost first, whichever they are. Only runs of spaces may be so, after all else.
        scores = Counter(self.order[p] for p in self.order if len(p) > 1)
        self.runs = {p for p in self.order if len(p) > 1 and scores[self.order[p]] > 1}
        if any(p.strip(SPACE) for p in self.runs) or self.runs and min(map(self.order.get, self.runs)) < max(scores):
            raise ValueError(f"{model_file}: pieces other than runs of spaces share a score")
        self.order = {p: o for p, o in self.order.items() if p not in self.runs}
        self.parts: dict[str, tuple[str, str]] = {}
        for piece in sorted((p for p in self.order if len(p) > 1), key=self.order.get):
            for k in range(1, len(piece)):
                left, right = piece[:k], piece[k:]
                if self._made(left, piece) and self._made(right, piece) and self._apart(left, right, self.order[piece]):
                    self.parts[piece] = left, right
                    break
        self.automaton = ahocorasick.Automaton()
        for piece in self.parts:
            self.automaton.add_word(piece, (len(piece), piece))
        self.automaton.make_automaton()
        inner = {c for p in self.ids for c in p[1:] if p.strip(SPACE)}
        self.stretch = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n|[^{SPACE}\n]+" if SPACE not in inner and not any("\n" in p for p in self.ids) else r"(?s).+")
        self.compatible = Remembered(lambda pair: self._apart(*pair))
        self.encoded = Remembered(self._encode)
        self.blobs = _Blobs(self.ids, self.byte_ids)
        # A byte from 0x80 stands as the half character that Python decodes it to, until the text is whole.
        self.texts = [bytes((self.bytes[i],)).decode("ascii", "surrogateescape") if i in self.bytes else (" \u2047 " if model.is_unknown(i) else "") if special[i] else p.replace(SPACE, " ") for i, p in enumerate(self.pieces)]

    def _made(self, part: str, whole: str) -> bool:
        return len(part) == 1 or part in self.parts and self.order[part] < self.order[whole]

    def _apart(self, left: str, right: str, limit: float = float("inf")) -> bool:
        """True if merging left + right ends with these two: while the merges are undone, latest first, none across the border comes before the one undone last."""
        order, parts = self.order, self.parts
        while True:
            across = order.get(left + right)
            if across is not None and across < limit:
                return False
            a, b = order.get(left, -1), order.get(right, -1)
            if a < 0 and b < 0:
                return True
            if a > b:  # of equal merges the left one comes first
                left, limit = parts[left][1], a
            else:
                right, limit = parts[right][0], b + 1

    def _run(self, n: int) -> list[str]:
        """A run of n spaces, of which neighbours are merged leftmost first."""
        done: list[str] = []
        for _ in range(n):
            done.append(SPACE)
            while len(done) > 1 and done[-2] + done[-1] in self.runs:
                done[-2:] = [done[-2] + done[-1]]
        return done

    def _encode(self, stretch: str) -> bytes:
        spaces = len(stretch) - len(stretch.lstrip(SPACE)) if self.runs else 0
        found = self._last_pieces(stretch[max(0, spaces - 1) :])
        if spaces > 1:
            found = self._run(spaces) + found[1:] if found[0] == SPACE else self._run(spaces - 1) + found
        return b"".join(map(self.blobs.__getitem__, found))

    def _last_pieces(self, stretch: str) -> list[str]:
        last, compatible, done = ["", *stretch], self.compatible, -1
        for end, (n, piece) in self.automaton.iter(stretch):  # by end, of equal ends the longest first
            if end != done and (end + 1 == n or compatible[last[end + 1 - n], piece]):
                last[end + 1], done = piece, end
        found, at = [], len(stretch)
        while at:
            found.append(piece := last[at])
            at -= len(piece)
        found.reverse()
        return found

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        return np.frombuffer(b"".join(map(self.encoded.__getitem__, self.stretch.findall(SPACE + text.replace(" ", SPACE)))), np.int32)

    def decode(self, ids: list[int]) -> str:
        text = "".join(map(self.texts.__getitem__, ids))
        if _BYTES.search(text):
            text = text.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
        return text[1:] if ids and self.pieces[ids[0]].startswith(SPACE) else text


class _Blobs(dict):
    """Ids by piece, as bytes of 32-bit numbers; a character without a piece has those of its bytes."""

    def __init__(self, ids: dict[str, int], byte_ids: dict[int, int]):
        super().__init__((p, np.int32(i).tobytes()) for p, i in ids.items())
        self.byte_ids = byte_ids

    def __missing__(self, char: str) -> bytes:
        return np.array([self.byte_ids[b] for b in char.encode()], np.int32).tobytes()


@lru_cache(1)
def _table(model_file: str) -> PieceTable:
    return PieceTable(model_file)


def _path(model_file: str) -> str:
    return SparkFiles.get(model_file.removeprefix("sparkfiles:")) if model_file.startswith("sparkfiles:") else model_file


def _with_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    kept = [i for i, n in enumerate(batch.schema.names) if n != name]
    return pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), values], [*(batch.schema.names[i] for i in kept), name])


def _schema(schema: T.StructType, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*(f for f in schema.fields if f.name != name), T.StructField(name, kind)])


def _encoded(table: PieceTable, texts: pa.Array) -> pa.ListArray:
    found = [table.encode(t) for t in texts.to_pylist()]
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, found)], dtype=np.int32), np.concatenate(found))


def _decoded(table: PieceTable, ids: pa.ListArray) -> pa.Array:
    values = ids.values.to_numpy(zero_copy_only=False)
    return pa.array([table.decode(values[a:b].tolist()) for a, b in pairwise(ids.offsets.to_pylist())], pa.string())


def encode(docs: DataFrame, model_file: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """Adds the ids of each whole text, and in the same pass, if decoded names a column, the text that these stand for. model_file: a path that all machines have, or sparkfiles:NAME after addFile."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(_path(model_file))
        for batch in rows:
            column = batch.column(batch.schema.get_field_index(text))
            for lo, hi in text_slices(column, SLICE):
                found = _encoded(table, column.slice(lo, hi - lo))
                part = _with_column(batch.slice(lo, hi - lo), ids, found)
                yield _with_column(part, decoded, _decoded(table, found)) if decoded else part

    docs = docs.withColumn(text, F.col(text).cast("string"))
    schema = _schema(docs.schema, ids, T.ArrayType(T.IntegerType()))
    return docs.mapInArrow(batches, _schema(schema, decoded, T.StringType()) if decoded else schema)


def decode(frame: DataFrame, model_file: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds the text that a row's ids stand for; a null list decodes to the empty string."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(_path(model_file))
        for batch in rows:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                yield _with_column(part, decoded, _decoded(table, part.column(part.schema.get_field_index(ids))))

    frame = frame.withColumn(ids, F.coalesce(F.col(ids).cast("array<int>"), F.array().cast("array<int>")))
    return frame.mapInArrow(batches, _schema(frame.schema, decoded, T.StringType()))
