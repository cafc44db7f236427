"""Secrets in texts: known patterns, and formats learned from them as probabilistic automata."""

from __future__ import annotations

import math
import pickle
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderweave.llm.words import LOWER, flat, pieces
from orderweave.session import configure, pin, sql

KINDS = ("assign", "access", "hex")
LEAST = {"assign": 12, "access": 18, "hex": 16}
#: A candidate for the learned formats: so many characters of the credential alphabet, a digit among them.
CANDIDATE = 12
#: Distinct strings of each class (a kind, or other candidates) that the automata are learned from: smallest hash first.
TRAINING_STRINGS = 1000
#: Confidence of the state-merging test; smaller merges more.
ALPHA = 0.05
#: A candidate is a span if a credential automaton beats the one of other strings by so much log10 per character.
MARGIN = 0.35

# fixed values: the assignment pattern and the alphabets
_ASSIGN = re.compile(rb"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_MARK = "[SECRET]"


def _table(characters: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(characters)] = True
    return table


_UPPER, _DIGIT = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
_IS_HEX = _table(_DIGIT + b"abcdef")
_IS_DIGIT = _table(_DIGIT)
_IS_CANDIDATE = _table(_UPPER + _UPPER.lower() + _DIGIT + b"+/_.=-")
#: Symbols of the automata: classes of characters, and how many characters each has.
_CLASSES = [_DIGIT, b"abcdef", b"ghijklmnopqrstuvwxyz", b"ABCDEF", b"GHIJKLMNOPQRSTUVWXYZ", b"+/=", b"_-", b"."]
_CLASS_OF = {c: i for i, cs in enumerate(_CLASSES) for c in cs}
_CODES = np.array([_CLASS_OF.get(c, -1) for c in range(256)], np.int8)
_END = len(_CLASSES)


def _runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of ``mask`` inside rows: starts and ends."""
    n = len(mask)
    opens, closes = mask.copy(), mask.copy()
    if n:
        opens[1:] &= ~mask[:-1]
        closes[:-1] &= ~mask[1:]
        inner = offsets[(offsets > 0) & (offsets < n)]
        opens[inner] = mask[inner]
        closes[inner - 1] = mask[inner - 1]
    return np.flatnonzero(opens), np.flatnonzero(closes) + 1


def _places(raw: bytes, needle: bytes) -> list[int]:
    found, at = [], raw.find(needle)
    while at >= 0:
        found.append(at)
        at = raw.find(needle, at + 1)
    return found


def _scan(column: pa.Array) -> list[tuple[bytes, list, list]]:
    """Per row: its bytes, base spans (start, kind, end, label start), other candidates (start, end); in bytes."""
    data, offsets = flat(column)
    raw, lower = data.tobytes(), LOWER[data].tobytes()
    rows = [(raw[a:b], [], []) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]

    def row_of(places):
        return np.searchsorted(offsets, places, "right") - 1

    hits = {r for k in _KEYWORDS for r in row_of(_places(lower, k)).tolist()} if len(raw) else set()
    for r in sorted(hits):
        for m in _ASSIGN.finditer(rows[r][0]):
            if m.end(2) - m.start(2) >= LEAST["assign"]:
                rows[r][1].append((m.start(), "assign", m.end(), m.start(2)))
    for r in sorted({*row_of(_places(raw, b"AKIA")).tolist()}) if len(raw) else ():
        for m in _ACCESS.finditer(rows[r][0]):
            if m.end() - m.start() >= LEAST["access"]:
                rows[r][1].append((m.start(), "access", m.end(), m.start()))
    starts, ends = _runs(_IS_HEX[data], offsets)
    long = ends - starts >= LEAST["hex"]
    starts, ends = starts[long], ends[long]
    for s, e, r in zip(starts.tolist(), ends.tolist(), row_of(starts).tolist()):
        o = int(offsets[r])
        rows[r][1].append((s - o, "hex", e - o, s - o))
    starts, ends = _runs(_IS_CANDIDATE[data], offsets)
    long = ends - starts >= CANDIDATE
    starts, ends = starts[long], ends[long]
    digits = np.concatenate(([0], np.cumsum(_IS_DIGIT[data], dtype=np.int32)))
    some = digits[ends] > digits[starts]
    starts, ends = starts[some], ends[some]
    taken: dict[int, tuple[list[int], list[int]]] = {}  # the base spans of a row as separate stretches
    for s, e, r in zip(starts.tolist(), ends.tolist(), row_of(starts).tolist()):
        o = int(offsets[r])
        if r not in taken:
            taken[r] = _stretches([(b[0], b[2]) for b in rows[r][1]])
        opens, closes = taken[r]
        before = bisect_left(opens, e - o) - 1
        if before < 0 or closes[before] <= s - o:
            rows[r][2].append((s - o, e - o))
    for _, base, _ in rows:
        base.sort(key=lambda b: (b[0], KINDS.index(b[1])))
    return rows


#: Characters of a string that automata are fitted on, and beyond which a string is scored by itself.
LONG = 512
#: Cells of a block of strings that are scored together.
_CELLS = 1 << 20


def _stretches(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Where the union of spans opens and closes, ascending."""
    opens: list[int] = []
    closes: list[int] = []
    for s, e in sorted(spans):
        if closes and s <= closes[-1]:
            closes[-1] = max(closes[-1], e)
        else:
            opens.append(s)
            closes.append(e)
    return opens, closes


class Automaton:
    """A probabilistic automaton over character classes, learned by merging compatible states of a prefix tree (ALERGIA).

    Two states are merged if the shares of each symbol, and of ending, agree by Hoeffding's bound in them and in all
    states reached from both."""

    def __init__(self, strings: list[bytes]):
        self.next: list[dict[int, int]] = [{}]
        self.count: list[dict[int, int]] = [{}]
        for s in strings:
            at = 0
            for symbol in [_CLASS_OF[c] for c in s] + [_END]:
                self.count[at][symbol] = self.count[at].get(symbol, 0) + 1
                if symbol != _END:
                    if symbol not in self.next[at]:
                        self.next[at][symbol] = len(self.next)
                        self.next.append({})
                        self.count.append({})
                    at = self.next[at][symbol]
        self._merge_all()
        self._settle()

    def _compatible(self, a: int, b: int) -> bool:
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            x, y = self.count[a], self.count[b]
            n, m = sum(x.values()), sum(y.values())
            if not n or not m:
                continue
            bound = math.sqrt(0.5 * math.log(2 / ALPHA)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if any(abs(x.get(s, 0) / n - y.get(s, 0) / m) > bound for s in x.keys() | y.keys()):
                return False
            stack += [(t, self.next[b][s]) for s, t in self.next[a].items() if s in self.next[b] and t != self.next[b][s]]
        return True

    def _fold(self, into: int, tree: int) -> None:
        """Add the tree of states below ``tree`` to the automaton at ``into``."""
        stack = [(into, tree)]
        while stack:
            a, b = stack.pop()
            for s, n in self.count[b].items():
                self.count[a][s] = self.count[a].get(s, 0) + n
            for s, t in self.next[b].items():
                if s in self.next[a]:
                    stack.append((self.next[a][s], t))
                else:
                    self.next[a][s] = t

    def _merge_all(self) -> None:
        red = [0]
        seen = {0}
        while True:
            blue = [(a, s, t) for a in red for s, t in sorted(self.next[a].items()) if t not in seen]
            if not blue:
                return
            a, s, t = max(blue, key=lambda x: (sum(self.count[x[2]].values()), -x[0], -x[1]))
            for r in red:
                if self._compatible(r, t):
                    self.next[a][s] = r
                    self._fold(r, t)
                    break
            else:
                red.append(t)
                seen.add(t)

    def _settle(self) -> None:
        """Smoothed log10 probabilities of each state reached from the first."""
        order, number = [0], {0: 0}
        for a in order:
            for t in self.next[a].values():
                if t not in number:
                    number[t] = len(order)
                    order.append(t)
        width = _END + 1
        share = np.array([1 / len(c) for c in _CLASSES] + [1.0])
        self.log, self.to = np.zeros((len(order), width)), np.zeros((len(order), width), np.int64)
        for a in order:
            counts = np.array([self.count[a].get(s, 0) for s in range(width)]) + 0.5
            self.log[number[a]] = np.log10(counts / counts.sum() * share)
            self.to[number[a]] = [number[self.next[a][s]] if s in self.next[a] else 0 for s in range(width)]
        del self.next, self.count

    def score(self, strings: list[bytes]) -> np.ndarray:
        """log10 probability of each string: those of like length a step at a time together, in blocks of bounded size, and
        very long ones by themselves."""
        total = np.zeros(len(strings))
        sizes = np.array([len(s) for s in strings], np.int64)
        order = np.argsort(sizes, kind="stable")
        short = int(np.searchsorted(sizes[order], LONG, "right"))
        at = 0
        while at < short:
            to = at + 1
            while to < short and (to + 1 - at) * (sizes[order[to]] + 1) <= _CELLS:
                to += 1
            some = order[at:to]
            codes = np.full((len(some), int(sizes[some[-1]]) + 1), -1, np.int8)
            for i, j in enumerate(some):
                codes[i, : sizes[j]] = _CODES[np.frombuffer(strings[j], np.uint8)]
                codes[i, sizes[j]] = _END
            total[some] = self._steps(codes)
            at = to
        for j in order[short:].tolist():
            log, to_, state, sum_ = self.log.tolist(), self.to.tolist(), 0, 0.0
            for c in _CODES[np.frombuffer(strings[j], np.uint8)].tolist():
                sum_ += log[state][c]
                state = to_[state][c]
            total[j] = sum_ + log[state][_END]
        return total

    def _steps(self, codes: np.ndarray) -> np.ndarray:
        state, total = np.zeros(len(codes), np.int64), np.zeros(len(codes))
        for column in codes.T:
            on = column >= 0
            total[on] += self.log[state[on], column[on]]
            state[on] = self.to[state[on], column[on]]
        return total


class Formats:
    """The automata of each kind of credential and of other strings."""

    def __init__(self, strings: dict[str, list[bytes]]):
        self.kinds = {k: Automaton(v) for k, v in strings.items() if v and k in KINDS}
        self.other = Automaton(strings["other"]) if strings.get("other") else None

    def margin(self, strings: list[bytes]) -> np.ndarray:
        """log10 likelihood per character of the best credential format over that of other strings."""
        if not self.kinds or not strings:
            return np.full(len(strings), -np.inf)
        best = np.max([a.score(strings) for a in self.kinds.values()], axis=0)
        uniform = np.array([-(len(s) + 1) * math.log10(69) for s in strings])
        other = self.other.score(strings) if self.other else uniform
        return (best - np.maximum(other, uniform)) / np.array([len(s) + 1 for s in strings])


_FOUND = "doc_id long, base array<struct<kind: string, start: long, end: long>>, "
_FOUND += "labels array<struct<kind: string, value: string>>, other array<struct<start: long, end: long, value: string>>"


def _code_points(text: bytes, places: list[int]) -> dict[int, int]:
    if text.isascii():
        return {p: p for p in places}
    opens = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80  # bytes that begin a code point
    at, before, done = {}, 0, 0
    for p in sorted(set(places)):
        before, done = before + int(np.count_nonzero(opens[done:p])), p
        at[p] = before
    return at


def _found(batches):
    for batch in batches:
        for part in pieces(batch, "text"):
            base, labels, other = [], [], []
            for text, spans, rest in _scan(part.column("text")):
                at = _code_points(text, [p for s in spans for p in (s[0], s[2])] + [p for s in rest for p in s]) if spans or rest else {}
                base.append([{"kind": k, "start": at[s], "end": at[e]} for s, k, e, _ in spans])
                labels.append([{"kind": k, "value": text[v:e].decode()} for _, k, e, v in spans])
                other.append([{"start": at[s], "end": at[e], "value": text[s:e].decode()} for s, e in rest])
            span = [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(base, pa.list_(pa.struct(span))),
                    pa.array(labels, pa.list_(pa.struct([("kind", pa.string()), ("value", pa.string())]))),
                    pa.array(other, pa.list_(pa.struct([*span[1:], ("value", pa.string())]))),
                ],
                ["doc_id", "base", "labels", "other"],
            )


def found(docs: DataFrame) -> DataFrame:
    """One pass over the texts: base spans, the strings that they label, and other candidates."""
    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(_found, _FOUND)


def learn(rows: DataFrame) -> Formats:
    """Automata from the distinct strings of ``found`` rows, cut to LONG characters: of each class the TRAINING_STRINGS with
    the smallest hash."""
    strings = sql(
        """select distinct kind, value from (
             select l.kind, left(l.value, {n}) as value from (select explode(labels) as l from {r})
             union all select 'other', left(o.value, {n}) from (select explode(other) as o from {r}))""".replace("{n}", str(LONG)),
        r=rows,
    )
    strings = pin(strings, "labelled")
    got: dict[str, list[bytes]] = {}
    for kind in (*KINDS, "other"):
        few = strings.where(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(TRAINING_STRINGS)
        got[kind] = [r["value"].encode() for r in few.collect()]
    return Formats(got)


def _extra(formats: Formats, values: list[bytes]) -> np.ndarray:
    return formats.margin(values) >= MARGIN if values else np.zeros(0, bool)


def secrets(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): ``base`` and ``spans``, arrays of (kind, start, end) in code points, end exclusive.

    Base spans are the matches of the three known patterns. ``spans`` adds those of kind ``learned``: candidates
    outside of base spans (12 or more credential characters, a digit among them) whose format is that of the labelled
    credentials. Null and empty texts have none. Both are ordered by start, then kind. Strings of any length are scored
    whole; automata are fitted on the first LONG characters of a string."""
    configure(docs.sparkSession)
    rows = pin(found(docs), "found")
    formats = docs.sparkSession.sparkContext.broadcast(pickle.dumps(learn(rows)))

    def score(batches):
        automata = pickle.loads(formats.value)
        for batch in batches:
            base, other = batch.column("base").to_pylist(), batch.column("other").to_pylist()
            good = iter(_extra(automata, [o["value"].encode() for row in other for o in row]).tolist())
            spans = []
            for known, row in zip(base, other):
                more = [{"kind": "learned", "start": o["start"], "end": o["end"]} for o in row if next(good)]
                spans.append(sorted([*known, *more], key=lambda s: s["start"]) if more else known)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("base"), pa.array(spans, batch.column("base").type)], ["doc_id", "base", "spans"]
            )

    span = "array<struct<kind: string, start: long, end: long>>"
    return rows.select("doc_id", "base", "other").mapInArrow(score, f"doc_id long, base {span}, spans {span}")


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with all its columns, every secret span of ``text`` replaced by a mark; null texts stay null."""
    configure(docs.sparkSession)
    formats = docs.sparkSession.sparkContext.broadcast(pickle.dumps(learn(pin(found(docs).where("size(base) + size(other) > 0"), "found"))))
    at = docs.columns.index("text")

    def run(batches):
        automata = pickle.loads(formats.value)
        for batch in batches:
            for part in pieces(batch, "text"):
                scanned = _scan(part.column("text"))
                good = iter(_extra(automata, [t[s:e] for t, _, rest in scanned for s, e in rest]).tolist())
                texts = part.column("text").to_pylist()
                for i, (raw, base, rest) in enumerate(scanned):
                    spans = sorted([(b[0], b[2]) for b in base] + [r for r in rest if next(good)])
                    if spans:
                        out, done = [], 0
                        for s, e in spans:
                            if s >= done:
                                out += [raw[done:s], _MARK.encode()]
                            done = max(done, e)
                        texts[i] = b"".join([*out, raw[done:]]).decode()
                columns = list(part.columns)
                columns[at] = pa.array(texts, part.column("text").type)
                yield pa.RecordBatch.from_arrays(columns, part.schema.names)

    return docs.mapInArrow(run, docs.schema)
