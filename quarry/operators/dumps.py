"""Bulk newspaper exports: split into articles and parse their fields.

Each dump is one row (``blob``); every operator here is row-local (array
functions + ``posexplode``), so dumps are processed in parallel, one task
per partition of dumps, and the operators also run on streaming frames.
For very large single exports, read them record by record with
:func:`quarry.sources.files.read_dump_records` (splittable) instead of whole.

Regex notes: ``(?d)`` (UNIX_LINES) makes ``^``/``$``/``.`` treat only ``\\n``
as a line end, as Python does; ``(?U)`` gives Python's Unicode ``\\s``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import PY_WS, article_filename, first_match, line_value, strip_ws

# ---- fixed values ----
MARKER = rf"Document{PY_WS}+\d+{PY_WS}+of{PY_WS}+\d+"
TITLE_PATTERN = r"(?U)^(.*?)[^\S\n]*:[^\S\n]*\[Op-Ed\]"
URL_PATTERN = r"(?U)^(https?://\S+)"
# labels that end a full text only with ``strict_end``, and the rule line that does
STRICT_END_LABELS = ["URL", "Title"]
RULE_LINE = "_{10,}"
LITERAL_DELIMITER = "Document "
END_LABELS = ["Subject", "Business indexing term", "Location", "Company / organization"]
# field name -> (label, value must be non-blank); title and url have their own patterns
FIELD_LABELS = {
    "author": ("Author", False),
    "publication_info": ("Publication info", False),
    "abstract": ("Abstract", False),
    "links": ("Links", True),
    "publication_date": ("Publication date", False),
    "publication_title": ("Publication title", False),
    "section": ("Section", False),
    "issn": ("ISSN", False),
    "doc_type": ("Document type", False),
    "proquest_id": ("ProQuest document ID", False),
}
MARKER_CI = f"(?i:{MARKER})"
DOCUMENT_CI = "(?i:Document)"
ARTICLE_COLUMNS = ["doc_marker", "title", "author", "publication_info", "url", "abstract", "links",
                   "publication_date", "publication_title", "section", "issn", "doc_type", "proquest_id",
                   "full_text"]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def split_marked(dumps: DataFrame, blob_col: str = "blob", keys: list[str] | None = None) -> DataFrame:
    """B1: split on ``Document N of M`` anywhere (case-insensitive); each piece keeps its marker.

    Text before the first marker is dropped.  The key is ``article_<N>.txt``
    zero-filled to the digit count of the first marker's M.  When a number
    repeats inside one dump the last piece wins (as an overwritten file
    would); that dedup sorts the row's pieces by name, so it is O(n log n) and
    needs no shuffle.  A dump without any marker raises an error.
    """
    keys = keys if keys is not None else [c for c in dumps.columns if c != blob_col]
    blob = _c(blob_col)
    pieces = F.when(blob.rlike(MARKER_CI), F.split(blob, f"(?={MARKER_CI})")).otherwise(
        F.raise_error(F.lit("no 'Document N of M' marker found in dump")).cast("array<string>"))
    total = F.regexp_extract(blob, rf"{DOCUMENT_CI}{PY_WS}+\d+{PY_WS}+of{PY_WS}+(\d+)", 1).cast("decimal(38,0)").cast("string")
    width = F.length(total)
    d = dumps.select(*keys, pieces.alias("_p"), width.alias("_w"))
    # drop a preamble: only the first piece can lack a leading marker
    d = d.withColumn("_p", F.filter("_p", lambda p: p.rlike(f"^{MARKER_CI}")))
    # last piece wins per file name: sort (filename, position descending) inside the row and
    # keep the first entry of each name - O(n log n) per dump, no shuffle
    entry = F.transform("_p", lambda p, i: F.struct(
        article_filename(F.regexp_extract(p, rf"^{DOCUMENT_CI}{PY_WS}+(\d+)", 1).cast("decimal(38,0)"), F.col("_w"))
        .alias("filename"), (-i).alias("neg_pos"), strip_ws(p).alias("text")))
    d = d.withColumn("_e", F.array_sort(entry))
    last = F.filter("_e", lambda x, i: F.when(i == 0, F.lit(True))            # element_at is 1-based:
                    .otherwise(F.element_at("_e", i)["filename"] != x["filename"]))  # i = the previous entry
    return d.select(*keys, F.explode(last).alias("_a")).select(*keys, "_a.filename", "_a.text")


def split_header_lines(dumps: DataFrame, blob_col: str = "blob", keys: list[str] | None = None) -> DataFrame:
    """B2: split on lines that are exactly a marker (case-sensitive).

    Output: keys, record_pos, doc_marker (the header), body (text up to the
    next header line, header line excluded).
    """
    keys = keys if keys is not None else [c for c in dumps.columns if c != blob_col]
    blob = _c(blob_col)
    line = rf"(?md)^{MARKER}{PY_WS}*$"
    markers = F.regexp_extract_all(blob, F.lit(rf"(?md)^({MARKER}){PY_WS}*$"), 1)
    bodies = F.split(blob, line)
    body_list = F.slice(bodies, 2, F.greatest(F.size(bodies) - 1, F.lit(1)))
    recs = F.arrays_zip(markers.alias("doc_marker"), body_list.alias("body"))
    return (dumps.select(*keys, F.posexplode(recs).alias("record_pos", "_r"))
            .select(*keys, "record_pos", "_r.doc_marker", "_r.body"))


def split_literal(dumps: DataFrame, blob_col: str = "blob", keys: list[str] | None = None,
                  delimiter: str = LITERAL_DELIMITER, width: int = 3) -> DataFrame:
    """Split on a literal delimiter, drop text before the first, number 1..n.

    Over-splits when the delimiter occurs inside an article (e.g. "Document type:").
    """
    keys = keys if keys is not None else [c for c in dumps.columns if c != blob_col]
    parts = F.split(_c(blob_col), "\\Q" + delimiter + "\\E")
    chunks = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1)))
    d = dumps.select(*keys, F.posexplode(chunks).alias("_i", "_c"))
    return d.select(*keys, article_filename(F.col("_i") + 1, width).alias("filename"),
                    F.concat(F.lit(delimiter), strip_ws("_c")).alias("text"))


def article_fields(records: DataFrame, body_col: str = "body") -> DataFrame:
    """The twelve labelled fields (first matching line each, stripped, else '')."""
    body = _c(body_col)
    cols = {"title": first_match(body, TITLE_PATTERN), "url": first_match(body, URL_PATTERN)}
    for name, (label, nonblank) in FIELD_LABELS.items():
        cols[name] = line_value(body, label, nonblank)
    order = ["title", "author", "publication_info", "url", "abstract", "links", "publication_date",
             "publication_title", "section", "issn", "doc_type", "proquest_id"]
    return records.withColumns({k: cols[k] for k in order})


def _full_text_block(body: Column, start_label: str, end_labels, rule_line: str | None = None) -> Column:
    """Text after the first ``start_label`` at a line start, cut before the first
    later line that starts with an end label (or is a rule line); NULL when there is no start line."""
    q = "\\Q" + start_label + "\\E"
    after = F.regexp_extract(body, "(?sm)^" + q + "(.*)", 1)
    ends = "|".join(e.replace("/", "\\/") for e in end_labels)
    rule = rf"|\n{rule_line}(?=\n|\z)" if rule_line else ""
    block = F.split(after, rf"\n(?:{ends}):{rule}", 2).getItem(0)
    return F.when(body.rlike("(?m)^" + q), block)


def with_full_text(df: DataFrame, body_col: str = "body", out: str = "full_text",
                   start_label: str = "Full text:", end_labels=END_LABELS, strict_end: bool = False) -> DataFrame:
    """The full-text block of each record.

    From the first line starting with ``Full text:`` (label removed from that
    line, line stripped) up to, not including, the first later line starting
    with an end label; lines joined with newlines, stripped.  No start line ->
    ''; no end line -> runs to the end of the body.  The block is staged as
    its own column so the regex runs once per row.  ``strict_end`` also ends it at the labels in
    ``STRICT_END_LABELS`` and at a line of underscores, for records without a regular end label.
    """
    labels = [*end_labels, *STRICT_END_LABELS] if strict_end else end_labels
    staged = df.withColumn("__b", _full_text_block(_c(body_col), start_label, labels, RULE_LINE if strict_end else None))
    b = F.col("__b")
    nl = F.instr(b, "\n")
    first = F.substring_index(b, "\n", 1)
    rest = F.when(nl > 0, F.substr(b, nl + F.lit(1)))
    first_clean = strip_ws(F.replace(first, F.lit(start_label), F.lit("")))
    text = F.when(b.isNull(), F.lit("")).otherwise(strip_ws(F.concat_ws("\n", first_clean, rest)))
    return staged.withColumn(out, text).drop("__b")


def parse_articles(records: DataFrame, body_col: str = "body", strict_end: bool = False) -> DataFrame:
    """B4 + B5: labelled fields and the full text of each record."""
    return with_full_text(article_fields(records, body_col), body_col, strict_end=strict_end)


def with_publication_day(articles: DataFrame, col: str = "publication_date", out: str = "publication_day") -> DataFrame:
    """A typed date beside the ``publication_date`` string ("Dec 10, 2022"); NULL where it is no such date."""
    return articles.withColumn(out, F.try_to_timestamp(F.col(col), F.lit("MMM d, yyyy")).cast("date"))


def dump_to_articles(dumps: DataFrame, blob_col: str = "blob", keys: list[str] | None = None) -> DataFrame:
    """B2 + B4 + B5: a bulk export to one article record per marker line, in the
    record layout (doc_marker, the twelve fields, full_text)."""
    keys = keys if keys is not None else [c for c in dumps.columns if c != blob_col]
    recs = split_header_lines(dumps, blob_col, keys)
    return parse_articles(recs, "body").select(*keys, "record_pos", *ARTICLE_COLUMNS)


def split_marked_lines(spark, path: str, range_bytes: int | None = None) -> DataFrame:
    """B1 for exports far larger than one row: the same split, by an index of the markers.

    The files are searched by byte ranges for markers, which may wrap over line ends and range ends; what comes of
    that is a row per marker, without text.  Of records that repeat a number in a file the last one is chosen among these rows, and
    the chosen records are read by their places, each text once and in no shuffle.  Output: keys, filename, text - keys are the
    partition columns of a partitioned folder, else ``source`` (the file name) - with the same key width and last-marker-wins rule as
    :func:`split_marked`; a file without any marker yields no rows.
    """
    from quarry.sources.dumpindex import RANGE_BYTES, marker_index, read_records
    size = range_bytes or RANGE_BYTES
    index, keys = marker_index(spark, path, size)
    last = index.groupBy(*keys, "_file", "_n").agg(F.max(F.struct("_place", "_end", "_w")).alias("_r"))
    chosen = last.select(*keys, "_file", "_r._place", "_r._end", article_filename(F.col("_n"), F.col("_r._w")).alias("filename"))
    return read_records(chosen, [*keys, "filename"], size)
