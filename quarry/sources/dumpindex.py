"""Bulk exports by byte ranges (B1, S7): an index of their markers, and the records read by it.

A file is cut into ranges of ``range_bytes``; each is searched for ``Document N of M`` markers that begin in it, reading on
where one runs over the range's end.  What leaves the tasks is a row per marker (its place, the next one's, N and M), no text.
Records are then read by their byte ranges in tasks, grouped by where they lie.  Only plain UTF-8 files have ranges.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.text import PY_WS_SET

RANGE_BYTES = 64 << 20
LOOK_AHEAD = 1 << 16
PACKED = (".gz", ".bz2", ".xz", ".zst", ".lz4", ".snappy")

_WS = b"(?:" + b"|".join(re.escape(c.encode()) for c in PY_WS_SET) + b")"
MARKER = re.compile(b"(?i:Document)" + _WS + rb"+(\d+)" + _WS + b"+(?i:of)" + _WS + rb"+(\d+)")
#: the beginning of a marker, up to wherever it breaks off
BEGUN = re.compile(b"(?i:Document)(?:" + _WS + rb"+(?:\d+(?:" + _WS + b"+(?i:o(?:f(?:" + _WS + rb"+\d*)?)?)?)?)?)?")
DOCUMENT = re.compile(b"(?i:Document)")


def find_markers(file, start: int, end: int) -> list[tuple[int, str, str]]:
    """(place, N, M) of the markers that begin in [start, end) of an open file."""
    file.seek(start)
    data = file.read(end - start + LOOK_AHEAD)
    size = end - start
    while True:
        last = max((m.start() for m in DOCUMENT.finditer(data, max(0, size - LOOK_AHEAD), size + 7) if m.start() < size), default=None)
        # three bytes may be the beginning of a character
        if last is None or BEGUN.match(data, last).end() < len(data) - 3 or not (more := file.read(LOOK_AHEAD)):
            break
        data += more  # a marker that is still open where the data ends
    return [(start + m.start(), m.group(1).decode(), m.group(2).decode()) for m in MARKER.finditer(data) if m.start() < size]


def _open(path: str):
    from quarry.sources.files import arrow_fs
    fs, p = arrow_fs(path)
    return fs.open_input_file(p)


def marker_index(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> tuple[DataFrame, list[str]]:
    """keys, file, place, end, n, width (digits of the file's first M) of every record under ``path``, and the keys: the partition
    columns of a partitioned folder, else ``source`` (the file name)."""
    files = spark.read.format("binaryFile").load(path)
    keys = [c for c in files.columns if c not in ("path", "modificationTime", "length", "content")]
    files = files.select(*keys, F.col("path").alias("_file"), F.col("length").alias("_size"))
    if not keys:
        keys, files = ["source"], files.withColumn("source", F.regexp_extract("_file", "([^/]*)$", 1))
    ranges = files.select("_file", "_size", F.explode(F.sequence(F.lit(0), F.col("_size") - 1, F.lit(range_bytes))).alias("_start"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, size, start in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                if name.endswith(PACKED):
                    raise ValueError(f"a packed export has no byte ranges: {name}")
                with _open(name) as file:
                    found = find_markers(file, start, min(size, start + range_bytes))
                at = [p for p, _, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(at), pa.string()), pa.array([start] * len(at), pa.int64()), pa.array(at, pa.int64()),
                     pa.array([*at[1:], None][:len(at)], pa.int64()), pa.array([n for _, n, _ in found], pa.string()),
                     pa.array([m for _, _, m in found], pa.string())], names=["_file", "_start", "_place", "_next", "_n", "_m"])

    schema = "_file string, _start long, _place long, _next long, _n string, _m string"
    tasks = 4 * spark.sparkContext.defaultParallelism
    from quarry.session import shared_dir
    store = shared_dir(spark, "markers")
    ranges.repartition(tasks).mapInArrow(scan, schema).write.parquet(store)
    markers = spark.read.schema(schema).parquet(store)
    # a row per range that has markers: its first one ends the record before, in whatever range that began
    firsts = markers.groupBy("_file", "_start").agg(F.min(F.struct("_place", "_m")).alias("_f"))
    order = Window.partitionBy("_file").orderBy("_start")
    firsts = firsts.select("_file", "_start", F.lead("_f._place").over(order).alias("_after"),
                           F.first("_f._m").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_total"))
    width = F.length(F.col("_total").cast("decimal(38,0)").cast("string"))
    placed = markers.join(firsts, ["_file", "_start"]).join(files, "_file")
    return placed.select(*keys, "_file", "_place", F.coalesce("_next", "_after", "_size").alias("_end"),
                         F.col("_n").cast("decimal(38,0)").alias("_n"), width.alias("_w")), keys


def read_records(index: DataFrame, keep: list[str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The kept columns and ``text`` (line ends as in text mode, stripped) of the records of an index."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StringType, StructField, StructType
    near = index.repartition(4 * index.sparkSession.sparkContext.defaultParallelism, "_file", F.floor(F.col("_place") / range_bytes))
    near = near.select(F.struct(*keep).alias("row"), "_file", "_place", "_end").sortWithinPartitions("_file", "_place")
    schema = StructType([near.schema["row"], StructField("text", StringType())])
    arrow = to_arrow_schema(schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = opened = None
        try:
            for batch in batches:
                rows, texts, size = 0, [], 0
                for name, place, end in zip(*[batch.column(i).to_pylist() for i in range(1, 4)]):
                    if name != opened:
                        if file:
                            file.close()
                        file, opened = _open(name), name
                    file.seek(place)
                    text = file.read(end - place).decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n").strip(PY_WS_SET)
                    texts.append(text)
                    size += len(text)
                    if size > 1 << 24:  # a batch of long records goes out in parts
                        yield pa.RecordBatch.from_arrays([batch.column(0).slice(rows, len(texts)).cast(arrow.field(0).type), pa.array(texts, pa.string())], schema=arrow)
                        rows, texts, size = rows + len(texts), [], 0
                if texts:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(rows, len(texts)).cast(arrow.field(0).type), pa.array(texts, pa.string())], schema=arrow)
        finally:
            if file:
                file.close()
    return near.mapInArrow(read, schema).select("row.*", "text")
