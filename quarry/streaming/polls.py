"""W5 as a stream: a feed that is polled again and again for its last days, each article kept once.

Polls overlap, as each asks for the articles of the last ``days`` days.  Saved feed pages are read as a stream; an article's
time is its event time, and ``days`` the watermark's delay.  An article that comes again is dropped as long as any
poll can return it; its key leaves the state when the watermark, ``days`` behind the newest article seen, has passed its
time by as much, so the state holds the keys of about two windows, dealt by key over the tasks, however long the feed is followed.
The sink and the state are committed per batch against the checkpoint: a query that is stopped and started again goes on
where it was.

An article without a readable time counts from when its poll was saved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.feeds import flatten_feed
from quarry.sources.files import FEED_PAGE
from quarry.streaming.mentions import run_available_now


def read_polls(spark: SparkSession, folder: str, max_files: int = 64) -> DataFrame:
    """The saved polls under ``folder`` (one JSON object a line) as a stream, in the order they were saved."""
    return (spark.readStream.schema(FEED_PAGE).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files).json(folder)
            .withColumn("_saved", F.col("_metadata.file_modification_time")))


def new_articles(pages: DataFrame, days: int = 7, key: str = "url") -> DataFrame:
    """The articles of a stream of feed pages, each the first time that it comes."""
    articles = flatten_feed(pages, keep=["_saved"])
    at = F.coalesce(F.try_to_timestamp("publishedAt"), F.col("_saved"))
    return (articles.withColumn("_at", at).withWatermark("_at", f"{days} days").dropDuplicatesWithinWatermark([key]).drop("_at", "_saved"))


def follow_feed(spark: SparkSession, folder: str, sink: str, checkpoint: str, days: int = 7, max_files: int = 64) -> DataFrame:
    """Adds what is new in the polls saved since the last call to ``sink``; the sink's articles."""
    run_available_now(new_articles(read_polls(spark, folder, max_files), days), sink, checkpoint)
    return spark.read.parquet(sink)
