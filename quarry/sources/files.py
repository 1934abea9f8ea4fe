"""File listing, shard schema probing and the readers.

Listing uses the ``binaryFile`` source with only path/length selected, so
file contents are never read (the source prunes ``content``).  Schema probing
reads one Parquet footer (or one CSV header record) per shard inside Spark
tasks, so millions of shards are probed in parallel and only the small
catalogue (one row per shard) exists - never one DataFrame per file.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CATALOG_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("format", T.StringType()),
    T.StructField("columns", T.ArrayType(T.StringType())),
    T.StructField("error", T.StringType()),
])


def list_files(spark: SparkSession, root: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """C1/W6 listing: (path, folder, name, length) of files under ``root``; content not read.

    Zero-byte files produce no input split in Spark's file sources and are not listed.
    """
    df = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
          .option("recursiveFileLookup", str(recursive).lower()).load(root)
          .select("path", "length"))
    return df.select("path",
                     F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder"),
                     F.regexp_extract("path", r"([^/]*)$", 1).alias("name"),
                     "length")


def arrow_fs(path: str):
    """pyarrow file system + path for a Hadoop-style URI (s3a:// and s3n:// read as s3://)."""
    import pyarrow.fs as pafs
    for scheme in ("s3a://", "s3n://"):
        if path.startswith(scheme):
            path = "s3://" + path[len(scheme):]
    return pafs.FileSystem.from_uri(path)


def csv_header(stream) -> list[str]:
    """The first record of a CSV byte stream, however long; quoted names may hold newlines."""
    import csv
    import io
    csv.field_size_limit(2 ** 31 - 1)
    return next(csv.reader(io.TextIOWrapper(stream, "utf-8-sig", "replace", newline="")), [])


def _probe(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import pyarrow as pa
    import pyarrow.parquet as pq
    for pdf in it:
        out = []
        for path in pdf["path"]:
            fmt = "csv" if path.lower().endswith(".csv") else "parquet"
            try:
                fs, p = arrow_fs(path)
                if fmt == "parquet":
                    with fs.open_input_file(p) as fh:
                        cols = list(pq.read_schema(fh).names)
                else:
                    with fs.open_input_stream(p, compression=None) as fh:
                        cols = csv_header(fh)
                out.append((path, fmt, cols, None))
            except pa.ArrowInvalid as e:  # the bytes are no Parquet file: skipped by the classifier
                if "Unrecognized filesystem" in str(e) or "scheme" in str(e):
                    raise
                out.append((path, fmt, [], f"{type(e).__name__}: {e}"[:200]))
        yield pd.DataFrame(out, columns=["path", "format", "columns", "error"])


def shard_catalog(spark: SparkSession, root: str, patterns=("*.parquet", "*.csv")) -> DataFrame:
    """One row per shard with its column names, read from footers in tasks.

    Only a file that is no Parquet gets an ``error`` and no columns; a failing
    read (credentials, network, an unknown scheme) fails the job, so that no shard
    goes missing unseen.
    """
    frames = [list_files(spark, root, g).select("path") for g in patterns]
    files = frames[0]
    for f in frames[1:]:
        files = files.unionByName(f)
    return files.mapInPandas(_probe, CATALOG_SCHEMA)


def scan_union(spark: SparkSession, paths: list[str], fmt: str = "parquet") -> DataFrame | None:
    """S3: one reader over the paths/globs that match something; None when none does."""
    found = [p for p in paths if path_exists(spark, p)]
    if not found:
        return None
    return read_csv_strings(spark, found) if fmt == "csv" else spark.read.parquet(*found)


def path_exists(spark: SparkSession, glob: str) -> bool:
    """Whether a Hadoop path or glob matches any file."""
    path = spark._jvm.org.apache.hadoop.fs.Path(glob)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


def read_csv_strings(spark: SparkSession, paths, schema: T.StructType | str | None = None,
                     keep_empty: bool = True) -> DataFrame:
    """CSV with header; RFC-4180 quoting (doubled quotes, embedded newlines).

    Without a schema every column is a string (no inference pass over the
    data); callers cast in the normalisers.  With ``keep_empty`` a quoted
    empty field ``""`` reads as '' and only an unquoted empty field as NULL
    (the writer in :mod:`quarry.sources.sinks` writes them that way);
    otherwise both read as NULL, as pandas does.
    """
    r = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"')
    if keep_empty:
        r = r.option("nullValue", "\u0000")
    if schema is not None:
        r = r.schema(schema)
    return r.csv(paths)


def read_csv_split(spark: SparkSession, paths, schema: T.StructType | str | None = None,
                   keep_empty: bool = True, range_bytes: int | None = None) -> DataFrame:
    """S2/S4/S5 for CSV files of any size: the same rows as :func:`read_csv_strings`, read in byte ranges.

    Records are cut out where they lie (see :mod:`quarry.sources.csvranges`) and parsed in the JVM; no line is
    shuffled.  The first record of every file is its header.  The planner takes the rows for as small as the list of
    byte ranges, so joins with them merge, where they would send all rows through the driver.
    """
    from quarry.sources.csvranges import RANGE_BYTES, csv_records
    paths = [paths] if isinstance(paths, str) else list(paths)
    if schema is None:
        first = spark.read.format("binaryFile").load(paths).select("path").orderBy("path").first()[0]
        fs, p = arrow_fs(first)
        with fs.open_input_stream(p, compression=None) as fh:
            schema = T.StructType([T.StructField(c, T.StringType()) for c in csv_header(fh)])
    elif isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    records = csv_records(spark, paths, range_bytes or RANGE_BYTES)
    options = {"escape": '"', "multiLine": "true", "mode": "FAILFAST", "maxCharsPerColumn": "-1"} | ({"nullValue": "\u0000"} if keep_empty else {})
    strings = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    parsed = records.select(F.from_csv("_line", _ddl(strings), options).alias("r"))
    return parsed.select(*[F.col("r")[f.name].cast(f.dataType).alias(f.name) for f in schema]).hint("merge")


def _ddl(schema: T.StructType) -> str:
    return ", ".join("`" + f.name.replace("`", "``") + "` " + f.dataType.simpleString() for f in schema)


def read_whole_texts(spark: SparkSession, folder: str, glob: str = "*.txt") -> DataFrame:
    """One row per file under ``folder`` (filename, text) - the file name is the key.

    Read as bytes and decoded as UTF-8 (strict, like ``open().read()``), so
    the text is exact but for line ends, which become ``\\n`` as in text mode; the
    ``wholetext`` text source drops a final newline.
    """
    return (spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
            .select(F.col("_metadata.file_name").alias("filename"), universal_newlines(F.decode("content", "UTF-8")).alias("text")))


def universal_newlines(c) -> Column:
    return F.regexp_replace(c, "\\r\\n?", "\n")


def read_dump_records(spark: SparkSession, path: str, record_sep: str) -> DataFrame:
    """S7 (splittable): read a bulk export with its record separator as line separator.

    Large exports are split across tasks at the separator; each record is a
    row (source file, record text).
    """
    return (spark.read.option("lineSep", record_sep).text(path)
            .select(F.col("_metadata.file_name").alias("source"), F.col("value").alias("record")))


FEED_ARTICLE = T.StructType([
    T.StructField("source", T.StructType([T.StructField("id", T.StringType()),
                                          T.StructField("name", T.StringType())])),
    T.StructField("author", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("urlToImage", T.StringType()),
    T.StructField("publishedAt", T.StringType()),
    T.StructField("content", T.StringType()),
])
FEED_PAGE = T.StructType([
    T.StructField("status", T.StringType()),
    T.StructField("totalResults", T.LongType()),
    T.StructField("articles", T.ArrayType(FEED_ARTICLE)),
])


def read_feed_pages(spark: SparkSession, path: str) -> DataFrame:
    """Saved feed responses (one JSON object per file) with an explicit schema."""
    return spark.read.schema(FEED_PAGE).option("multiLine", "true").json(path)


def inline_frame(spark: SparkSession, columns: dict, schema: str | None = None) -> DataFrame:
    """Pandas-style inline frame; scalar entries are broadcast to every row."""
    n = max((len(v) for v in columns.values() if isinstance(v, (list, tuple))), default=1)
    data = {k: (list(v) if isinstance(v, (list, tuple)) else [v] * n) for k, v in columns.items()}
    rows = list(zip(*data.values()))
    return spark.createDataFrame(rows, schema or list(data.keys()))
