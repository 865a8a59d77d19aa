"""Secret scans: the rules' regexes become one deterministic automaton that reads each byte of a text once.

A rule is a prefix and a greedy run of characters. The threads of all rules, in the order in which a leftmost greedy
search prefers them, are the states of a subset construction; equal states are merged and the rest become one array
of transitions over classes of bytes. A state says which rules' matches ended just before its byte and whether their
runs were long enough. Where each of these few began, an automaton of the reversed rule finds by reading back from
its end as far as the rule's match before it.

Defined results: null and empty texts have no spans; spans count code points, end exclusive, and are sorted by start,
then in the order of the rules; a rule's spans don't overlap, those of two rules may; other columns pass unchanged, and a
column named like the output is replaced; repeated rows give equal results; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from re import _constants as C
from re import _parser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import text_slices

SLICE = 4 << 20


class Rule(NamedTuple):
    """prefix, then one or more of the characters of run (none if empty); matches whose run is shorter than least are dropped, and so are matches shorter than shortest.

    least is a part of the automaton, with a state a character; shortest is looked at when a match has ended.
    """

    kind: str
    prefix: str
    run: str = ""
    least: int = 1
    any_case: bool = False
    shortest: int = 0


BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9+/_.=-]", 8, True),
    Rule("access", "AKIA", "[A-Z0-9]", shortest=16),
    Rule("hex", "", "[0-9a-f]", 32),
)
WORD, NAME = "[A-Za-z0-9]", "[A-Za-z0-9_-]"
RULES = (
    *BASE,
    Rule("key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge", "gh[pousr]_", WORD, shortest=40),
    Rule("chat", "xox[abprs]-", "[A-Za-z0-9-]", shortest=15),
    Rule("payment", "[sr]k_live_", WORD, shortest=28),
    Rule("webtoken", rf"eyJ{NAME}+\.eyJ{NAME}+\.", NAME),
)
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


class Program:
    """Threads of one rule: step[i] is (bytes, next), split[i] the nexts in order of preference, end[i] whether the run is long enough."""

    def __init__(self, rule: Rule, backwards: bool = False):
        self.step: dict[int, tuple[frozenset, int]] = {}
        self.split: dict[int, tuple[int, ...]] = {}
        self.end: dict[int, bool] = {}
        self.n, self.any_case, self.backwards = 0, rule.any_case, backwards
        prefix = [*_parser.parse(rule.prefix)]
        run = _parser.parse(rule.run)[0] if rule.run else None
        if backwards:
            start = self._sequence(prefix, self._end(True))
            if run:
                again = self._new()
                self.split[again] = self._item(run, again), start
                start = self._item(run, again)
        elif run:
            following = self._new()
            self.split[following] = self._item(run, following), self._end(True)
            for k in range(rule.least - 1, 0, -1):
                at = self._new()
                self.split[at] = self._item(run, following), self._end(False)
                following = at
            start = self._sequence(prefix, self._item(run, following))
        else:
            start = self._sequence(prefix, self._end(True))
        self.start = start

    def _new(self) -> int:
        self.n += 1
        return self.n

    def _end(self, enough: bool) -> int:
        self.end[at := self._new()] = enough
        return at

    def _sequence(self, items, then: int) -> int:
        for item in items if self.backwards else reversed([*items]):
            then = self._item(item, then)
        return then

    def _bytes(self, item) -> frozenset | None:
        op, value = item
        if op is C.LITERAL:
            found = {value}
        elif op is C.IN:
            found = {b for kind, v in value if kind in (C.LITERAL, C.RANGE) for b in (range(v[0], v[1] + 1) if kind is C.RANGE else (v,))}
            if any(kind not in (C.LITERAL, C.RANGE) for kind, _ in value):
                raise ValueError(f"{value}: only characters and ranges")
        else:
            return None
        if max(found) > 127:
            raise ValueError("rules are made of ASCII characters")
        return frozenset(found | {ord(x) for b in found for x in (chr(b).lower(), chr(b).upper())} if self.any_case else found)

    def _item(self, item, then: int) -> int:
        op, value = item
        if (found := self._bytes(item)) is not None:
            self.step[at := self._new()] = found, then
            return at
        if op is C.SUBPATTERN:
            return self._sequence(value[3], then)
        if op is C.BRANCH:
            at = self._new()
            self.split[at] = tuple(self._sequence(x, then) for x in value[1])
            return at
        if op is C.MAX_REPEAT:
            least, most, sub = value
            if most is C.MAXREPEAT:
                at = self._new()
                self.split[at] = self._sequence(sub, at), then
                then = at
            else:
                last = then
                for _ in range(most - least):
                    at = self._new()
                    self.split[at] = self._sequence(sub, then), last
                    then = at
            for _ in range(least):
                then = self._sequence(sub, then)
            return then
        raise ValueError(f"{op}: not a part of rules")

    def follow(self, starts) -> tuple[tuple[int, ...], bool | None]:
        """The threads that read a byte next, in order, as far as the first that is at an end, and whether that run is long enough."""
        order, seen, stack = [], set(), [*reversed([*starts])]
        while stack:
            if (at := stack.pop()) in seen:
                continue
            seen.add(at)
            if at in self.end:
                return tuple(order), self.end[at]
            if at in self.step:
                order.append(at)
            else:
                stack += reversed(self.split[at])
        return tuple(order), None


def _next(program: Program, state, byte: int | None):
    """The state after a byte (None: the end of the text), and how a match ended before it: True if long enough, None if none did."""
    threads, pending = state
    read = [program.step[t][1] for t in threads if byte in program.step[t][0]]
    if pending is None:
        after, hit = program.follow(read)
        return ((after, hit) if hit is not None else program.follow([*read, program.start])), None
    if read:
        after, hit = program.follow(read)
        if hit is None:
            raise ValueError("a rule would have to go back to the end of a shorter match")
        return (after, hit), None
    return _next(program, program.follow([program.start]), byte)[0], pending


class Automaton:
    """All rules in one table: table[state + class of the byte] is the next state; those from `ended` on say what has ended."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        programs = [Program(r) for r in rules]
        self.back = [Backwards(r) for r in rules]
        sets = [s for p in programs for s, _ in p.step.values()]
        of = {b: tuple(b in s for s in sets) for b in range(256)}
        kinds = {x: i for i, x in enumerate(dict.fromkeys(of.values()))}
        sample = {kinds[of[b]]: b for b in range(256)} | {len(kinds): None}
        self.classes, self.close = bytes(kinds[of[b]] for b in range(256)), bytes([len(kinds)])
        width = len(sample)
        step = lru_cache(None)(lambda i, state, c: _next(programs[i], state, sample[c]))
        first = tuple(p.follow([p.start]) for p in programs), ()
        number, todo, rows = {first: 0}, [first], []
        for states, _ in todo:
            row = []
            for c in range(width):
                found = [step(i, s, c) for i, s in enumerate(states)]
                # A run without a prefix can't begin in an earlier match, so short ones needn't be known.
                new = tuple(s for s, _ in found), tuple((i, full) for i, (_, full) in enumerate(found) if full or full is False and rules[i].prefix)
                if new not in number:
                    number[new] = len(number)
                    todo.append(new)
                row.append(number[new])
            rows.append(row)
        outputs = [x for _, x in todo]
        table, part = np.array(rows), np.array([[*dict.fromkeys(outputs)].index(x) for x in outputs])
        while True:  # states with equal outputs and equal successors are one
            _, finer = np.unique(np.column_stack([part, part[table]]), axis=0, return_inverse=True)
            finer = finer.ravel()
            if finer.max() == part.max():
                break
            part = finer
        chosen = np.unique(part, return_index=True)[1]
        order = sorted(range(len(chosen)), key=lambda k: bool(outputs[chosen[k]]))
        place = np.empty(len(chosen), int)
        place[order] = np.arange(len(chosen))
        self.table = (place[part[table[chosen[order]]]] * width).ravel().tolist()
        self.outputs = [outputs[chosen[k]] for k in order]
        self.ended, self.width, self.first = sum(not x for x in self.outputs) * width, width, int(place[part[0]]) * width

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, end, number of the rule) of all matches, in bytes."""
        table, ended, state, events = self.table, self.ended, self.first, []
        for i, c in enumerate(data.translate(self.classes) + self.close):
            state = table[state + c]
            if state >= ended:
                events.append((i, state))
        found, before = [], [0] * len(self.rules)
        for end, state in events:
            for rule, full in self.outputs[state // self.width]:
                if full:
                    start = self.back[rule].start(data, before[rule], end)
                    if end - start >= self.rules[rule].shortest:
                        found.append((start, end, rule))
                before[rule] = end
        return sorted(found, key=lambda x: (x[0], x[2]))


class Backwards:
    """Finds where a match that ends at a place begins."""

    def __init__(self, rule: Rule):
        self.program = Program(rule, backwards=True)
        self.first = self._closed([self.program.start])
        self.known: dict = {}

    def _closed(self, starts) -> tuple[frozenset, bool]:
        threads, end, seen, stack = set(), False, set(), [*starts]
        while stack:
            if (at := stack.pop()) in seen:
                continue
            seen.add(at)
            if at in self.program.end:
                end = True
            elif at in self.program.step:
                threads.add(at)
            else:
                stack += self.program.split[at]
        return frozenset(threads), end

    def start(self, data: bytes, least: int, end: int) -> int:
        state, found = self.first, end
        for at in range(end - 1, least - 1, -1):
            key = state, data[at]
            if key not in self.known:
                self.known[key] = self._closed(self.program.step[t][1] for t in state[0] if data[at] in self.program.step[t][0])
            state = self.known[key]
            if state[1]:
                found = at
            if not state[0]:
                break
        return found


@lru_cache(4)
def automaton(rules: tuple[Rule, ...]) -> Automaton:
    return Automaton(rules)


def in_code_points(data: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    places, count, last = {}, 0, 0
    for at in sorted({x for s in spans for x in s[:2]}):
        count, last = count + len(data[last:at].decode("utf-8", "replace")), at
        places[at] = count
    return [(places[a], places[b], k) for a, b, k in spans]


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", spans: str = "secrets") -> DataFrame:
    """Adds the spans of all rules in each whole text."""

    ready = docs.sparkSession.sparkContext.broadcast(automaton(rules))  # as large as the rules make it, whatever the data

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = ready.value
        for batch in rows:
            column = batch.column(batch.schema.get_field_index(text))
            for lo, hi in text_slices(column, SLICE):
                found = []
                for value in column.slice(lo, hi - lo).cast(pa.binary()):
                    data = value.as_py() or b""
                    found.append([{"kind": rules[k].kind, "start": a, "end": b} for a, b, k in in_code_points(data, one.spans(data))])
                part = batch.slice(lo, hi - lo)
                names = [n for n in part.schema.names if n != spans]
                kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(n)) for n in names), pa.array(found, kind)], [*names, spans])

    docs = docs.withColumn(text, F.col(text).cast("string"))
    return docs.mapInArrow(batches, T.StructType([*(f for f in docs.schema.fields if f.name != spans), T.StructField(spans, SPANS)]))


def redacted(text, spans):
    """A column: the text with each span replaced by its kind in brackets; of overlapping spans the first is named."""
    start = F.struct(F.lit(1).cast("long").alias("at"), F.lit("").alias("done"))

    def put(done, span):
        first = span["start"] + 1 >= done["at"]
        return F.struct(
            F.greatest(done["at"], span["end"] + 1).alias("at"),
            F.when(first, F.concat(done["done"], F.substring(text, done["at"].cast("int"), (span["start"] + 1 - done["at"]).cast("int")), F.lit("["), span["kind"], F.lit("]"))).otherwise(done["done"]).alias("done"),
        )

    def rest(done):
        return F.concat(done["done"], F.substring(text, done["at"].cast("int"), F.length(text)))

    return F.when(F.size(spans) > 0, F.aggregate(spans, start, put, rest)).otherwise(text)
