"""Packing of token ids into sequences: bounded-space online best fit.

Each task reads documents one by one and keeps a fixed number of open windows. What is left of a
document after its full windows goes to the open window with the least sufficient room. If none has
room and no window may be opened, the fullest one takes as much as it can hold and is emitted, full;
the rest of the document is placed anew. So only the windows that are open at the end of a task are
not full. They are merged: first those of a task, then what remains of a task with what remains of up
to ``FAN_IN`` others, in rounds, until one window is left, whose content is cut at powers of two. No
sequence is padded.

A task holds its open windows, and a merging task one window from each of ``FAN_IN`` others.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sinks.shared import stored
from .columns import col
from .tokens import encoder
from .units import slices

#: Tokens in a sequence.
LENGTH = 4096
#: Open windows of a task.
WINDOWS = 64
#: Tasks whose leftovers one task merges.
FAN_IN = 256

#: A piece while its window is open: document id, start, tokens of its document, ids.
Piece = tuple[object, int, int, bytes]


class OpenWindows:
    """The open windows of one task. ``emit`` gets the pieces of each window that is complete."""

    def __init__(self, emit: Callable[[list[Piece]], None], length: int = LENGTH, limit: int = WINDOWS) -> None:
        self.emit, self.length, self.limit = emit, length, limit
        self.free: list[int] = []  # ascending; pieces[i] are in the window with free[i]
        self.pieces: list[list[Piece]] = []

    def add(self, doc_id, ids: bytes, start: int = 0, total: int | None = None) -> None:
        total = len(ids) // 4 if total is None else total
        at, left, length = 0, len(ids) // 4, self.length

        def cut(n: int) -> Piece:
            return doc_id, start + at, total, ids[4 * at:4 * (at + n)]

        while left:
            if left >= length:
                n = length
                self.emit([cut(n)])
            elif (k := bisect.bisect_left(self.free, left)) < len(self.free):
                n = left
                self._put(k, cut(n), n)
            elif len(self.free) < self.limit:
                n = left
                self._insert(length - n, [cut(n)])
            else:
                n = self.free[0]
                self._put(0, cut(n), n)
            at, left = at + n, left - n

    def _put(self, k: int, piece: Piece, n: int) -> None:
        room, held = self.free.pop(k) - n, self.pieces.pop(k)
        held.append(piece)
        if room:
            self._insert(room, held)
        else:
            self.emit(held)

    def _insert(self, room: int, held: list[Piece]) -> None:
        k = bisect.bisect_left(self.free, room)
        self.free.insert(k, room)
        self.pieces.insert(k, held)

    def merge(self) -> list[Piece]:
        """Fills windows with what the open ones hold; the pieces of the only one that isn't full."""
        rest = [p for held in self.pieces for p in held]
        self.free, self.pieces = [], []
        return filled(rest, self.length, self.emit)


def filled(pieces: list[Piece], length: int, emit: Callable[[list[Piece]], None]) -> list[Piece]:
    """Emits full windows of the pieces in order and returns the pieces of the rest."""
    held, room = [], length
    for doc_id, start, total, ids in pieces:
        while ids:
            n = min(room, len(ids) // 4)
            held.append((doc_id, start, total, ids[:4 * n]))
            start, ids, room = start + n, ids[4 * n:], room - n
            if not room:
                emit(held)
                held, room = [], length
    return held


def powers_of_two(pieces: list[Piece], emit: Callable[[list[Piece]], None]) -> None:
    """Emits the pieces as sequences whose lengths are the powers of two that their sum consists of."""
    left = sum(len(p[3]) // 4 for p in pieces)
    while left:
        first = 1 << (left.bit_length() - 1)
        done: list[list[Piece]] = []
        rest = filled(pieces, first, done.append)
        emit(done[0])
        pieces, left = [p for held in done[1:] for p in held] + rest, left - first


class _Rows:
    """Pieces as rows: complete sequences, and open ones with their ids."""

    def __init__(self, first_id: int) -> None:
        self.next_id, self.rows = first_id, []

    def emit(self, pieces: list[Piece], is_open: bool = False) -> None:
        import zlib

        offset = 0
        for doc_id, start, total, ids in pieces:
            n = len(ids) // 4
            self.rows.append((doc_id, start, n, zlib.crc32(ids), total, self.next_id, offset, ids if is_open else None))
            offset += n
        self.next_id += 1

    def batch(self, id_type):
        import pyarrow as pa

        columns = list(zip(*self.rows)) if self.rows else [()] * 8
        self.rows = []
        kinds = [id_type, *[pa.int64()] * 6, pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], list(COLUMNS))


COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "open_ids")


def _schema(id_type: str) -> str:
    return f"doc_id {id_type}, " + ", ".join(f"{c} bigint" for c in COLUMNS[1:7]) + ", open_ids binary"


def _sequence_ids(level: int, task: int) -> int:
    """The first of the sequence ids of a task: 2**30 tasks a round, 2**28 sequences a task."""
    return level << 58 | task << 28


def _pack(tokenizer: str, end_id: int, length: int, windows: int):
    def run(batches: Iterator) -> Iterator:
        import struct

        from pyspark import TaskContext

        encode, end = encoder(tokenizer, blank_with_word=False), struct.pack("<I", end_id)
        rows = _Rows(_sequence_ids(0, TaskContext.get().partitionId()))
        space, kind = OpenWindows(rows.emit, length, windows), None
        for batch in batches:
            doc_ids, texts = batch.column(0), batch.column(1).to_pylist()
            kind = doc_ids.type
            for a, b in slices(texts):
                for doc_id, ids in zip(doc_ids[a:b].to_pylist(), encode(texts[a:b])):
                    space.add(doc_id, ids + end)
                yield rows.batch(kind)
        if kind is not None:
            if rest := space.merge():
                rows.emit(rest, is_open=True)
            yield rows.batch(kind)

    return run


def _merge(level: int, length: int, last: bool):
    def run(key, table):
        rows = _Rows(_sequence_ids(level, key[0].as_py()))
        table = table.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        pieces = list(zip(*(table[c].to_pylist() for c in ("doc_id", "start", "doc_tokens", "open_ids"))))
        rest = filled(pieces, length, rows.emit)
        if last:
            powers_of_two(rest, rows.emit)
        elif rest:
            rows.emit(rest, is_open=True)
        import pyarrow as pa

        return pa.Table.from_batches([rows.batch(table.schema.field("doc_id").type)])

    return run


def pack(df: DataFrame, tokenizer: str, *, text: str = "text", id_column: str = "doc_id", end_id: int = 2,
         length: int = LENGTH, windows: int = WINDOWS, fan_in: int = FAN_IN) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and the end id; a NULL text counts as empty and gives the end id alone. Each
    id is in one piece. A NULL or repeated id is kept: every input row is a document of its own. An
    empty table gives an empty result. ``length`` is a power of two. The result is stored.
    """
    if length < 1 or length & (length - 1):
        raise ValueError("the length of a sequence must be a power of two")
    rows = df.select(col(id_column).alias("id"), F.coalesce(col(text), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    packed = stored(rows.mapInArrow(_pack(tokenizer, end_id, length, windows), _schema(kind)))
    done = packed.filter("open_ids IS NULL")
    rest, level = packed.filter("open_ids IS NOT NULL"), 1
    task = F.shiftright("sequence_id", 28).bitwiseAND(F.lit((1 << 30) - 1))
    tasks = rest.agg(F.max(task)).first()[0]
    last = tasks is None
    while not last:
        tasks //= fan_in
        last = tasks == 0
        merged = stored(rest.groupBy(F.floor(task / fan_in).alias("group")).applyInArrow(
            _merge(level, length, last), _schema(kind)))
        done = done.unionByName(merged.filter("open_ids IS NULL"))
        rest, level = merged.filter("open_ids IS NOT NULL"), level + 1
    return done.select(F.col("doc_id").alias(id_column), *COLUMNS[1:7])
