"""quarry: corpus analytics as plain Spark DataFrame operators.

Sub-packages
------------
functions  Column -> Column helpers (tokens, sentences, strip, zero-fill, HTML text)
sources    readers and writers (parquet shards, CSV, dumps, feeds, web archives)
operators  DataFrame -> DataFrame operators (corpus counts, mentions, dumps, pages, profiles)
plans      derived input views and the query catalogue used by ``__spark_entry__``
streaming  the row-wise operators run over a ``readStream`` source
"""

from quarry.session import get_session, shared_dir

__all__ = ["get_session", "shared_dir"]
