"""CSV files by byte ranges (S2, S4, S5): no line is shuffled.

Whether a byte stands inside a quoted field follows from the number of quotes before it in the file.  A first pass counts the quotes
of each range, in tasks; their running sum over a file's ranges, a small table, gives each range its start state.  A second
pass cuts each range into records at the line ends outside quotes: a range owns the records that begin in it and reads its last one
beyond its end.  Packed files are one range each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.sources.dumpindex import PACKED

RANGE_BYTES = 32 << 20
BLOCK = 1 << 20
QUOTE, NEWLINE = 34, 10


def _open(path: str):
    from quarry.sources.files import arrow_fs
    fs, p = arrow_fs(path)
    if path.endswith(PACKED):
        with fs.open_input_stream(p) as stream:  # unpacked by its name
            return pa.BufferReader(stream.read())
    return fs.open_input_file(p)


def count_quotes(file, start: int, end: int) -> int:
    file.seek(start)
    n = 0
    while start < end and (block := file.read(min(BLOCK, end - start))):
        n += block.count(b'"')
        start += len(block)
    return n


def record_ends(data: bytes, inside: int) -> tuple[np.ndarray, int]:
    """Places of the line ends outside quotes, and the state after the data; ``inside`` is 1 where it begins inside quotes."""
    raw = np.frombuffer(data, np.uint8)
    odd = np.cumsum(raw == QUOTE, dtype=np.uint8) & 1  # wraps, which leaves its last bit right
    odd ^= inside
    return np.flatnonzero((raw == NEWLINE) & (odd == 0)), int(odd[-1]) if len(odd) else inside


def records(file, start: int, end: int, inside: int) -> Iterator[bytes]:
    """The records that begin in [start, end), without their line ends; a file's first one is its header and left out."""
    file.seek(max(start - 1, 0))
    data = file.read(end - max(start - 1, 0))  # with the byte before, which may end a record
    if start and data[:1] == b'"':
        inside ^= 1  # the state before that byte
    ends, state = record_ends(data, inside)
    base = max(start - 1, 0)
    begins = [int(e) + 1 for e in ends if base + int(e) + 1 < end]
    if start == 0:
        begins.insert(0, 0)
    if not begins:
        return
    last = begins[-1]
    tail = data[last:]
    if not len(ends) or ends[-1] < last:  # its end is not in the range
        parts, more = [tail], b""
        while (more := file.read(BLOCK)):
            ends, state = record_ends(more, state)
            if len(ends):
                parts.append(more[:int(ends[0])])
                break
            parts.append(more)
        tail = b"".join(parts)
    else:
        tail = tail[:int(ends[np.searchsorted(ends, last)]) - last]
    for i, (a, b) in enumerate(zip(begins, begins[1:])):
        if start or i:
            yield data[a:b - 1]
    if start or len(begins) > 1:
        yield tail


def csv_records(spark: SparkSession, paths: list[str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The records of CSV files as lines (``_line``), quotes and line ends inside fields kept, headers and blank lines left out."""
    files = spark.read.format("binaryFile").load(paths).select(F.col("path").alias("file"), F.col("length").alias("size"))
    packed = F.lit(False)
    for ending in PACKED:
        packed = packed | F.col("file").endswith(ending)
    step = F.when(packed, F.greatest("size", F.lit(1))).otherwise(F.lit(range_bytes))
    ranges = files.select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, step.cast("long"))).alias("start"),
                          packed.alias("packed"), "size")
    ranges = ranges.select("file", "start", F.when(F.col("packed"), F.lit(1 << 62)).otherwise(F.least(F.col("start") + range_bytes, "size")).alias("end"))
    tasks = 4 * spark.sparkContext.defaultParallelism

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for name, start, end in zip(*[c.to_pylist() for c in batch.columns]):
                with _open(name) as file:
                    found.append(count_quotes(file, start, end) if start or end < 1 << 62 else 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], names=["file", "start", "end", "quotes"])

    counted = ranges.repartition(tasks).mapInArrow(count, "file string, start long, end long, quotes long")
    before = F.sum("quotes").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    dealt = counted.select("file", "start", "end", F.coalesce(before % 2, F.lit(0)).cast("int").alias("inside")).repartition(tasks, "file", "start")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start, end, inside in zip(*[c.to_pylist() for c in batch.columns]):
                with _open(name) as file:
                    end = min(end, file.size()) if hasattr(file, "size") else end
                    held, size = [], 0
                    for r in records(file, start, end, inside):
                        r = r[:-1] if r.endswith(b"\r") else r
                        if r:
                            held.append(r.decode("utf-8", "replace"))
                            size += len(r)
                        if size > 1 << 23:
                            yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["_line"])
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["_line"])
    return dealt.mapInArrow(cut, "_line string")
