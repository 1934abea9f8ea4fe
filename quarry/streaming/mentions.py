"""Row-wise operators over a ``readStream`` source.

The mention, density, dump and page operators contain no action and no
global sort, so the same functions accept a streaming DataFrame.  A file
source with ``availableNow`` processes everything present, in micro-batches
bounded by ``maxFilesPerTrigger``, and the file sink commits each batch
atomically against the checkpoint in the shared folder: a lost executor
only re-runs its task, a restarted query resumes from the last commit.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from quarry.operators.mentions import sentence_mentions
from quarry.session import shared_dir
from quarry.sources.files import path_exists

DOCUMENTS_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def read_stream(spark: SparkSession, folder: str, glob: str, schema: str, max_files: int = 1) -> DataFrame:
    """Streaming Parquet source over what matches ``glob`` in ``folder``: files, or folders of files (a table of many)."""
    # a pattern, even of one name, may be a file; a plain path of a stream must be a folder
    name = glob if re.search(r"[*?\[{]", glob) else f"{{{glob}}}"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(f"{folder.rstrip('/')}/{name}")


def run_available_now(stream: DataFrame, sink: str, checkpoint: str, fmt: str = "parquet") -> str:
    """Drain everything available into ``sink`` (exactly-once file sink) and stop."""
    q = (stream.writeStream.format(fmt).option("path", sink).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return sink


def stream_sentence_mentions(spark: SparkSession, folder: str, transform=None) -> DataFrame:
    """Sentence mentions of the documents in ``folder``, computed as a streaming query.

    ``transform`` prepares each micro-batch's rows (e.g. derives the text);
    the result is the sink re-read as a batch DataFrame, without rows when no document has a mention.
    """
    if not path_exists(spark, f"{folder.rstrip('/')}/documents.parquet"):
        raise FileNotFoundError(f"no documents.parquet in {folder}")
    docs = read_stream(spark, folder, "documents.parquet", DOCUMENTS_SCHEMA)
    if transform is not None:
        docs = transform(docs)
    docs = docs.select(docs["doc_id"].alias("source"), "text")
    out = sentence_mentions(docs, "text", "source")
    base = shared_dir(spark, "stream_mentions")
    sink = run_available_now(out, base + "/sink", base + "/checkpoint")
    return spark.read.schema(out.schema).parquet(sink)
