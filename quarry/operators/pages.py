"""Web pages to rows: headline, article paragraphs, quote blocks, article text (H1-H4).

Input is any DataFrame with an HTML string column (``pages.html``, or the
output of :func:`quarry.sources.archive.read_warc_html`).  Every operator is
row-local: regex/array expressions plus ``posexplode``; the page is cleaned
once (comments, script and style removed) as its own projection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import html as H


def _cleaned(pages: DataFrame, html_col: str, keep: list[str]) -> DataFrame:
    return pages.select(*keep, H.clean(html_col).alias("_doc"))


def _keep(pages, html_col, keep):
    return keep if keep is not None else [c for c in pages.columns if c != html_col]


def headline(pages: DataFrame, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """H1: text of the first ``<h1>`` (text nodes stripped, joined without separator); NULL if none."""
    keep = _keep(pages, html_col, keep)
    # the element and its text nodes are staged as columns of their own, so each regex runs once
    d = _cleaned(pages, html_col, keep).withColumn("_h1", H.first_element("_doc", "h1"))
    return d.select(*keep, F.when(F.col("_h1").isNotNull(), H.get_text("_h1")).alias("headline"))


def article_paragraphs(pages: DataFrame, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """H2: paragraphs of the first ``<article>`` (empty ones kept), with their position.

    Pages without an article give no rows.  Sorting by paragraph text (W3)
    is left to the caller's sink.
    """
    keep = _keep(pages, html_col, keep)
    d = _cleaned(pages, html_col, keep).withColumn("_art", H.first_element("_doc", "article"))
    # a page without an article has NULL paragraphs, so the generator emits nothing for it
    # (no row filter: a filter would be pushed below the spread and run the regex chain twice)
    return (d.select(*keep, F.posexplode(H.paragraphs("_art")).alias("para_pos", "_p"))
            .select(*keep, "para_pos", H.get_text("_p").alias("paragraph")))


def blocks(pages: DataFrame, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """H3: every ``<blockquote>`` first, then every ``<p>`` outside block quotes (whole page).

    Columns: keep..., kind ('blockquote' | 'p'), pos (document order within kind), text.
    A quote within a quote has a row of its own, and its text is also part of the outer one's.  A quote
    ends at its own end tag or with the element around it (:data:`quarry.functions.html.CONTAINERS`), whichever comes
    first, and with the page if neither does.  Both kinds are built as one array per page and exploded once.
    """
    keep = _keep(pages, html_col, keep)
    d = _cleaned(pages, html_col, keep)
    d = d.select(*keep, H.tag_parts("_doc", ["blockquote", *H.CONTAINERS]).alias("_parts"))
    d = d.select(*keep, "_parts", H.moves("_parts", ["blockquote"]).alias("_moves"))
    d = d.select("*", H.depths("_moves").alias("_depth"))
    d = d.select("*", H.spans("_moves", "_depth").alias("_spans"))
    d = d.select("*", F.when(F.size("_spans") > 0, H.depths(H.moves("_parts", H.CONTAINERS))).alias("_around"))

    def bounded(s):  # up to the first part where the element around the quote is closed
        last = F.coalesce(s["last"], F.size("_parts"))
        left = F.filter(F.sequence(s["first"], last - 1), lambda j: F.get("_around", j) < F.get("_around", s["first"]))
        return F.struct(s["first"].alias("first"), F.coalesce(F.get(left, F.lit(0)), last).alias("last"), s["last"].alias("tag"),
                        (s["last"].isNull() | (F.size(left) > 0)).alias("loose"))
    d = d.select("*", F.transform("_spans", bounded).alias("_quotes"))
    # a part is inside if a quote that ends at its own tag is open there, or if it lies in one of the others
    d = d.select("*", F.filter("_quotes", lambda s: s["loose"]).alias("_loose"))
    own = F.transform("_moves", lambda v, i: F.when(F.exists("_loose", lambda s: (s["first"] == i) | s["tag"].eqNullSafe(i)), 0).otherwise(v))
    d = d.select("*", F.when(F.size("_loose") > 0, H.depths(own)).otherwise(F.col("_depth")).alias("_own"))
    inside = F.transform("_own", lambda n, i: (n > 0) | F.exists("_loose", lambda s: (s["first"] <= i) & (i < s["last"])))
    d = d.select(*keep, "_parts", "_quotes", inside.alias("_inside"))
    rest = F.array_join(F.zip_with("_parts", "_inside", lambda p, q: F.when(q, "<blockquote>").otherwise(p)), "")
    quotes = F.transform("_quotes", lambda s, i: F.struct(
        F.lit("blockquote").alias("kind"), i.alias("pos"),
        H.get_text(F.array_join(F.slice("_parts", s["first"] + 1, s["last"] - s["first"]), "")).alias("text")))
    paras = F.transform(H.paragraphs(rest), lambda p, i: F.struct(
        F.lit("p").alias("kind"), i.alias("pos"), H.get_text(p).alias("text")))
    return (d.select(*keep, F.explode(F.concat(quotes, paras)).alias("_b"))
            .select(*keep, "_b.kind", "_b.pos", "_b.text"))


def article_text(pages: DataFrame, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """H4: text of the first ``<article>``, text nodes joined by a space; pages without one dropped."""
    keep = _keep(pages, html_col, keep)
    d = _cleaned(pages, html_col, keep).withColumn("_art", H.first_element("_doc", "article"))
    # drop pages without an article through a generator (see article_paragraphs)
    return d.select(*keep, F.explode(F.array_compact(F.array(H.get_text("_art", " ")))).alias("text"))
