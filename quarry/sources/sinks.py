"""Sinks (K1-K6).  Every writer is a plain DataFrameWriter call."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> str:
    """K1: Parquet product; ``partition_by`` enables partition pruning on re-read."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, nulls_as_blank: bool = True,
              mode: str = "overwrite") -> str:
    """K2/K3: CSV with header, fixed column order, RFC-4180 quoting.

    Quotes are doubled (``escape='"'``) so other tools read the file back;
    empty strings are written as ``""`` and NULLs as blanks.
    """
    if columns:
        df = df.select(*columns)
    (df.write.mode(mode).option("header", "true").option("escape", '"')
     .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false")
     .option("emptyValue", '""').option("nullValue", "" if nulls_as_blank else "null").csv(path))
    return path


def write_text_blocks(df: DataFrame, col: str, path: str, mode: str = "overwrite") -> str:
    """K4: one text per block, blocks separated by a blank line."""
    df.select(F.col(col).alias("value")).write.mode(mode).option("lineSep", "\n\n").text(path)
    return path


def write_keyed_table(df: DataFrame, path: str, key: str = "filename", order: str | None = None,
                      mode: str = "overwrite") -> str:
    """K5 re-aimed: the article files become one Parquet table keyed by file name.

    With ``order``, a key that repeats keeps its row of the largest ``order`` (a later
    file overwrites an earlier one), by an aggregate with map-side combine; without, a
    repeated key is an error of the caller's and both rows stay.
    """
    if order is not None:
        row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
        df = df.groupBy(F.col(key).alias("_k")).agg(F.max_by(row, F.col(order)).alias("_r")).select("_r.*")
    df.write.mode(mode).parquet(path)
    return path


def write_observed(df: DataFrame, writer, path: str, *args, profile: list[str] | None = None, **kwargs) -> dict[str, int]:
    """K6 with A6/A7: ``writer(df, path, ...)``, and what was seen of the rows on their way: ``rows``, and for each ``profile``
    column its NULLs.

    The input runs once; nothing is counted before or after.  A result without rows leaves no output: a new path is
    removed again, and an output that stands there stays, as the rows are then written beside it and only take its place if
    there are any.
    """
    spark = df.sparkSession
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    stands = fs.exists(target)
    place = f"{path.rstrip('/')}-new-{uuid.uuid4().hex[:8]}" if stands else path
    seen = Observation()
    missing = [F.count(F.when(F.col(f"`{c}`").isNull(), 1)).alias(f"missing_{c}") for c in profile or []]
    writer(df.observe(seen, F.count(F.lit(1)).alias("rows"), *missing), place, *args, **kwargs)
    found = dict(seen.get)
    written = jvm.org.apache.hadoop.fs.Path(place)
    if not found["rows"]:
        fs.delete(written, True)
    elif stands:
        fs.delete(target, True)
        fs.rename(written, target)
    return found


def write_if_any(df: DataFrame, writer, path: str, *args, **kwargs) -> bool:
    """K6: write only when the result has rows; returns whether it wrote.  The input runs once (see :func:`write_observed`)."""
    return write_observed(df, writer, path, *args, **kwargs)["rows"] > 0
