"""Sum-of-squares online packing of tokenised documents into windows.

A document becomes its token ids and an end id.  Each input partition is a stream, packed in one pass: full
windows are cut off a long document's front, and what is left, or a shorter document as a whole, goes
online into a window of the fill level that makes the sum of the squared counts of partially filled windows least, a
new window being level 0.  The counts stand in an array by level; with n the counts and s the length, taking a window from
level h to h + s changes the sum by 2 (n[h+s] - n[h]) + 2, a new window by 2 n[s] + 1, and filling one up by 1 - 2 n[h]; the
array gives the least of these at once (ties: the fullest).

Documents are whole while they are placed.  At a stream's end, and whenever ``most_open`` windows are partially
filled, these are laid end to end and cut at the window's size, so they leave one short window; its tokens are cut into windows
of powers of two, which take no padding.  So no sequence is padded, and at most one document a window laid out is cut
then.  The state of a task is the array and the ids of at most ``most_open`` windows; nothing is shuffled.  The result is
written to the shared folder: a task that runs again after its executor is lost gives its sequences once.

Defined results: null and empty texts are one end id; repeated rows are packed each by itself; an empty table gives
no pieces; very long texts are cut into full windows; kept columns travel in a struct, so names can't clash.  Which
documents share a sequence depends on the partitions of the input; a document's ids don't.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quarry.llm.common import col, map_batches, written
from quarry.llm.packing import encoder, tokenizer_path
from quarry.session import spread

FIELDS = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Levels:
    """Windows of ``size`` tokens by fill level.  A piece is (row, start, length, document's tokens, ids)."""

    def __init__(self, size: int, most_open: int, first_id: int = 0):
        self.size, self.most_open, self.next_id = size, most_open, first_id
        self.count = np.zeros(size + 1, np.int64)  # 0 and size stay 0: neither is partially filled
        self.windows: list[list[list[tuple]]] = [[] for _ in range(size)]
        self.n_open = 0
        self.out: list[tuple] = []  # pieces with their sequence and offset

    def level(self, s: int) -> int:
        """The level that a piece of ``s`` tokens, fewer than a window, goes to."""
        own = self.count[1:self.size - s + 1]
        change = 2 * (self.count[s + 1:] - own) + 2
        change[-1] -= 1  # filled up: it counts no more
        change[own == 0] = np.iinfo(np.int64).max
        best = len(change) - 1 - int(change[::-1].argmin())
        return best + 1 if change[best] <= 2 * self.count[s] + 1 else 0

    def place(self, piece: tuple) -> None:
        s = piece[2]
        h = self.level(s)
        window = []
        if h:
            window = self.windows[h].pop()
            self.count[h] -= 1
            self.n_open -= 1
        window.append(piece)
        if h + s == self.size:
            self.close(window)
            return
        self.windows[h + s].append(window)
        self.count[h + s] += 1
        self.n_open += 1
        if self.n_open >= self.most_open:
            self.lay_out()

    def close(self, window: list[tuple]) -> None:
        at = 0
        for piece in window:
            self.out.append((*piece, self.next_id, at))
            at += piece[2]
        self.next_id += 1

    def add(self, row, ids: bytes) -> None:
        total = len(ids) // 4
        full = total // self.size * self.size
        for at in range(0, full, self.size):
            self.close([(row, at, self.size, total, ids[4 * at:4 * (at + self.size)])])
        if full < total:
            self.place((row, full, total - full, total, ids[4 * full:]))

    def lay_out(self) -> None:
        """Lays the partially filled windows end to end: full windows, then ones of powers of two."""
        pieces = [p for h in reversed(range(self.size)) for w in self.windows[h] for p in w]
        self.windows = [[] for _ in range(self.size)]
        self.count[:] = 0
        self.n_open = 0
        left = sum(p[2] for p in pieces)
        window, room = [], self._room(left)
        for row, start, length, total, ids in pieces:
            at = 0
            while at < length:
                n = min(room, length - at)
                window.append((row, start + at, n, total, ids[4 * at:4 * (at + n)]))
                at, room, left = at + n, room - n, left - n
                if not room:
                    self.close(window)
                    window, room = [], self._room(left)

    def _room(self, left: int) -> int:
        return self.size if left >= self.size else 1 << max(0, left.bit_length() - 1)


def pack(docs: DataFrame, keep: list[str] | None = None, path: str | None = None, size: int = 2048, most_open: int = 2048,
         end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """``row``, start, length, ids_crc32, doc_tokens, sequence_id, offset (and the ids, if asked for) of every piece.  ``size``
    is a power of two."""
    if size < 2 or size & (size - 1):
        raise ValueError("the window's size is a power of two")
    keep, path = docs.columns if keep is None else keep, path or tokenizer_path()
    nested = docs.select(F.struct(*[col(docs, c).alias(c) for c in keep]).alias("row"), col(docs, "text").alias("text"))
    schema = T.StructType([nested.schema["row"], *T._parse_datatype_string(FIELDS + ", ids array<int>" * with_ids).fields])
    arrow = to_arrow_schema(schema)

    def run(batches):
        ids_of, end = encoder(path).many, struct.pack("<I", end_id)
        levels = Levels(size, most_open, TaskContext.get().partitionId() << 40)

        def done() -> pa.RecordBatch:
            found, levels.out = levels.out, []
            fields = [[p[0] for p in found], [p[1] for p in found], [p[2] for p in found], [zlib.crc32(p[4]) for p in found],
                      *[[p[i] for p in found] for i in (3, 5, 6)], [np.frombuffer(p[4], "<u4").tolist() for p in found] if with_ids else []]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(fields, arrow)], schema=arrow)

        for batch in batches:
            for row, ids in zip(batch.column(0).to_pylist(), ids_of(batch.column(1).to_pylist())):
                levels.add(row, ids + end)
            yield done()
        levels.lay_out()
        yield done()

    return written(map_batches(spread(nested), run, schema), "levels")


def report(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The contract's digest per piece."""
    return pack(docs, ["doc_id"], path).select(F.col("row.doc_id").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens",
                                               "sequence_id", "offset")
