"""News-feed responses to rows (S9 + F11)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEED_COLUMNS = ("source", "author", "title", "description", "content", "url", "publishedAt")


def flatten_feed(pages: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row per article of each response page; missing text fields become ''.

    ``source`` is the nested ``source.name`` (missing source -> '').  The
    explode is row-local, so pages are processed where they were read.
    """
    keep = keep or []
    a = pages.select(*keep, F.explode("articles").alias("a"))
    return a.select(*keep, *[F.coalesce(F.col("a.source.name") if c == "source" else F.col(f"a.{c}"), F.lit(""))
                             .alias(c) for c in FEED_COLUMNS])
