"""Packing of tokenised documents into training sequences, with bounded memory and next to no padding."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from orderweave.llm.bpe import SLICE_BYTES, default_path, encoder
from orderweave.llm.words import pieces
from orderweave.session import configure, pin, sql

WINDOW = 4096
#: Open windows of a partition.
OPEN = 64
#: Partitions whose last, part-filled windows are merged in one step.
MERGED = 64
END = 2
#: Memory of a worker for words it has encoded in a task: a million of them, as nothing else here needs much.
KEPT_BYTES = 320 << 20

_PIECE = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
_LEFT = pa.list_(pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())]))
_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
_SCHEMA += "part long, left array<struct<doc_id: long, start: long, doc_tokens: long, ids: binary>>"


class Packer:
    """Best-fit packing with at most OPEN windows. A piece is (doc_id, start, doc_tokens, packed ids)."""

    def __init__(self, first_id: int):
        self.next_id = first_id
        self.open: list[tuple[int, int, list]] = []  # (room left, when opened, pieces), least room first
        self.opened = 0
        self.rows: list[tuple] = []

    def _emit(self, window: list) -> None:
        offset = 0
        for doc_id, start, total, ids in window:
            n = len(ids) // 4
            self.rows.append((doc_id, start, n, zlib.crc32(ids), total, self.next_id, offset))
            offset += n
        self.next_id += 1

    def add(self, doc_id, start: int, total: int, ids: bytes) -> None:
        while len(ids) >= 4 * WINDOW:
            self._emit([(doc_id, start, total, ids[: 4 * WINDOW])])
            start, ids = start + WINDOW, ids[4 * WINDOW :]
        n = len(ids) // 4
        if not n:
            return
        at = bisect_left(self.open, n, key=lambda w: w[0])
        if at == len(self.open) and len(self.open) >= OPEN:
            # nothing fits: the fullest window is topped up with the head of the piece and goes
            room, _, window = self.open.pop(0)
            self._emit([*window, (doc_id, start, total, ids[: 4 * room])])
            self.add(doc_id, start + room, total, ids[4 * room :])
            return
        room, when, window = self.open.pop(at) if at < len(self.open) else (WINDOW, self._new(), [])
        window.append((doc_id, start, total, ids))
        if room == n:
            self._emit(window)
        else:
            insort(self.open, (room - n, when, window), key=lambda w: w[:2])

    def _new(self) -> int:
        self.opened += 1
        return self.opened

    def close(self) -> list:
        """Chain what the open windows hold into full ones; returns the pieces of the last, part-filled one."""
        rest, room = [], WINDOW
        for _, _, window in self.open:
            for doc_id, start, total, ids in window:
                while ids:
                    head = ids[: 4 * room]
                    rest.append((doc_id, start, total, head))
                    start, ids, room = start + len(head) // 4, ids[len(head) :], room - len(head) // 4
                    if not room:
                        self._emit(rest)
                        rest, room = [], WINDOW
        self.open = []
        return rest

    def close_even(self, rest: list) -> None:
        """Emit the last window's pieces as sequences of a power of two each, largest first: no padding."""
        left = sum(len(ids) for *_, ids in rest) // 4
        while left:
            size = room = 1 << (left.bit_length() - 1)
            window = []
            while room:
                doc_id, start, total, ids = rest.pop(0)
                head, tail = ids[: 4 * room], ids[4 * room :]
                window.append((doc_id, start, total, head))
                room -= len(head) // 4
                if tail:
                    rest.insert(0, (doc_id, start + len(head) // 4, total, tail))
            self._emit(window)
            left -= size

    def batch(self, part: int, rest: list | None = None) -> pa.RecordBatch:
        """The rows made since the last call, then a row that holds ``rest``."""
        columns = [list(c) for c in zip(*self.rows)] or [[] for _ in _PIECE]
        self.rows = []
        arrays = [pa.array(c + [None] * bool(rest), t) for c, (_, t) in zip(columns, _PIECE)]
        n = len(arrays[0])
        held = [None] * (n - 1) + [[dict(zip(("doc_id", "start", "doc_tokens", "ids"), p)) for p in rest]] if rest else [None] * n
        return pa.RecordBatch.from_arrays([*arrays, pa.array([part] * n, pa.int64()), pa.array(held, _LEFT)], [*[c for c, _ in _PIECE], "part", "left"])


def packed(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Cut ``docs`` (doc_id, text; other columns are not read) into pieces laid out in sequences of up to 4096 tokens.

    A document is the ids of its whole text followed by one end id; a null or empty text is the end id alone. A
    sequence is full, or has a power of two of tokens (only the very last few), so none needs padding. One row per piece:
    doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. Rows with equal or null doc_id are packed each
    for itself.

    Each input partition keeps OPEN windows: a piece goes where it leaves least room, else the fullest window is topped
    up and emitted. What is left at its end is chained, and the last part-filled window of each partition is
    merged with others, MERGED at a time, until one is left. Nothing depends on the order in which tasks run."""
    spark = configure(docs.sparkSession)
    path = path or default_path()

    def first(batches):
        part = TaskContext.get().partitionId()
        packer = Packer(part << 32)
        coder = encoder(path, KEPT_BYTES)
        end = END.to_bytes(4, "little")
        for batch in batches:
            for slice_ in pieces(batch, "text", SLICE_BYTES):
                for doc_id, ids in zip(slice_.column("doc_id").to_pylist(), coder.encode(slice_.column("text").to_pylist())):
                    packer.add(doc_id, 0, len(ids) // 4 + 1, ids + end)
                yield packer.batch(part)
        # the worker lives on, beside those of other steps
        coder.forget()
        yield packer.batch(part, packer.close())

    def merge(level: int, last: bool):
        def run(table: pa.Table) -> pa.Table:
            rows = sorted(table.select(["part", "left"]).to_pylist(), key=lambda r: r["part"])
            part = rows[0]["part"] // MERGED
            packer = Packer((level << 56) + (part << 32))
            packer.open = [(0, 0, [tuple(p[c] for c in ("doc_id", "start", "doc_tokens", "ids")) for p in r["left"]]) for r in rows]
            rest = packer.close()
            if last:
                packer.close_even(rest)
            return pa.Table.from_batches([packer.batch(part, rest)])

        return run

    rows = docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(first, _SCHEMA)
    rows = done = pin(rows, "packed")
    parts, level = (rows.where("left is not null").selectExpr("max(part) + 1 as n").first()["n"] or 0), 1
    while parts:
        last = parts <= MERGED
        left = rows.where("left is not null").select("part", "left")
        rows = pin(left.groupBy((left["part"] / MERGED).cast("long").alias("g")).applyInArrow(merge(level, last), _SCHEMA), "packed")
        done = done.unionByName(rows)
        parts, level = 0 if last else -(-parts // MERGED), level + 1
    return sql("select doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset from {d} where left is null", d=done)
