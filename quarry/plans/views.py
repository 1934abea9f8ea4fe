"""Derived input views over the shipped test tables.

The shipped tables hold no corpus shards, titles-with-names, dump markers or
labelled article blocks; these views derive such inputs from them so that
every operator runs over data whose size grows with the tables.  Each view
is also written as DuckDB SQL in :mod:`quarry.plans.oracle` (same rules).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.text import WORD_PATTERN, article_filename

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

# tables whose rows carry long texts: spread over the task slots before row-local text work
TEXT_TABLES = {"documents", "pages", "conversations"}

# ---- fixed values of the derived views ----
DUMP_SIZE = 100                 # doc_id range per bulk export held in one row (bounds the row)
EXPORT_SIZE = 1000              # doc_id range per bulk export written as a file (dump_split_lines)
FEED_PAGE_SIZE = 100            # articles per feed page
POLLS = 5                       # polls of the feed (feed_repoll)


class Views:
    """Lazy readers for the shipped tables plus the derived views."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str, spread: bool = True) -> DataFrame:
        """A shipped table; text tables are spread over the task slots unless the
        caller shuffles them right away anyway (``spread=False``)."""
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if spread and name in TEXT_TABLES:
            from quarry.session import spread
            df = spread(df)
        return df

    # -------------------------------------------------- corpus star, raw shard layout
    def token_shard(self) -> DataFrame:
        """Token shard with non-canonical names (TextID, word_id, ID int)."""
        return self.table("lineitem").select(F.col("l_orderkey").alias("TextID"),
                                             F.col("l_partkey").alias("word_id"),
                                             F.col("l_linenumber").alias("ID"))

    def word_shard(self) -> DataFrame:
        """Lexicon shard: WordID, Token, Lemma, PoS (mixed case on purpose).

        Every part is a row; small parts (p_size up to 5) get a negated id, so that some tokens
        have no lexicon row and some lexicon rows no token.
        """
        return self.table("part").select(
            F.when(F.col("p_size") > 5, F.col("p_partkey")).otherwise(-F.col("p_partkey")).alias("WordID"),
            F.concat(F.col("p_brand"), F.lit(" "), F.col("p_name")).alias("Token"),
            F.col("p_name").alias("Lemma"), F.col("p_type").alias("PoS"))

    def text_shard(self) -> DataFrame:
        """Text metadata shard: doc_id, Date_Year, Decade, Section.

        Every order is a row; orders of status 'P' get a negated id, so that some tokens have no
        metadata and some metadata no token.
        """
        y = F.year("o_orderdate")
        return self.table("orders").select(
            F.when(F.col("o_orderstatus") != F.lit("P"), F.col("o_orderkey")).otherwise(-F.col("o_orderkey")).alias("doc_id"),
            y.alias("Date_Year"), (y - y % 10).alias("Decade"), F.col("o_orderpriority").alias("Section"))

    # -------------------------------------------------- canonical corpus star
    def corpus(self):
        from quarry.operators.catalog import normalise_texts, normalise_tokens, normalise_words
        return (normalise_tokens(self.token_shard()), normalise_words(self.word_shard()),
                normalise_texts(self.text_shard()))

    def tok(self) -> DataFrame:
        """Tagged tokens from documents (textID, word), no wordID."""
        return self.table("documents").select(
            F.col("doc_id").alias("textID"),
            F.explode(F.regexp_extract_all("text", F.lit(WORD_PATTERN), 0)).alias("word"))

    # -------------------------------------------------- mentions
    def aug(self) -> DataFrame:
        """Documents with title-and-name sentences injected (every row kept)."""
        return augment(self.table("documents"))

    def feed_pages(self, minutes: Column | None = None) -> DataFrame:
        """Feed pages shaped like a news API response: {page, totalResults, articles[]}.

        Articles are grouped into pages of at most FEED_PAGE_SIZE by doc_id, so
        a page is a bounded group.  ``minutes`` (default: the doc_id) after the year's start an article is published.
        """
        after = F.col("doc_id") if minutes is None else minutes
        a = augment(self.table("documents", spread=False))   # grouped into pages right away
        art = F.struct(
            F.when(F.col("doc_id") % 11 == 0, F.lit(None))
             .otherwise(F.struct(F.col("source").alias("name"))).alias("source"),
            F.when(F.col("doc_id") % 7 == 0, F.lit(None)).otherwise(F.col("source")).alias("author"),
            F.concat(F.lit("Mr Bob Ray on "), F.col("lang")).alias("title"),
            F.when(F.col("doc_id") % 3 == 0, F.lit(None)).otherwise(F.lit("A talk with Ms Jo Park"))
             .alias("description"),
            F.col("text").alias("content"),
            F.concat(F.lit("https://example.org/d/"), F.col("doc_id")).alias("url"),
            # timestamp_ntz arithmetic: independent of the session time zone
            F.date_format(F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00"))
                          + F.make_dt_interval(mins=after.cast("int")),
                          "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("publishedAt"),
        )
        page = F.floor(F.col("doc_id") / FEED_PAGE_SIZE)
        return (a.select(page.alias("page"), art.alias("a"))
                .groupBy("page").agg(F.collect_list("a").alias("articles"))
                .withColumn("totalResults", F.lit(None).cast("int")))

    def feed_polls(self) -> list[DataFrame]:
        """The feed's pages as POLLS polls of the last days return them: poll p holds slices p - 1 and p of the pages, whose
        articles were published over three days each, so every article is in two polls."""
        three_days = 4320
        pages = self.feed_pages(F.floor(F.col("doc_id") / FEED_PAGE_SIZE) % (POLLS - 1) * three_days + F.col("doc_id") * 7 % three_days)
        piece = F.col("page") % (POLLS - 1)
        return [pages.where((piece == p - 1) | (piece == p)) for p in range(POLLS)]

    def aug_pages(self) -> DataFrame:
        """Pages with block quotes, nested and unclosed ones too, and paragraphs naming experts injected into every third article."""
        return augment_pages(self.table("pages").select("page_id", "html"))

    # -------------------------------------------------- bulk dumps
    def dump(self, size: int = DUMP_SIZE, crlf: bool = False) -> DataFrame:
        """One bulk export per (source, chunk of ``size`` doc_ids) of the document texts.

        Each export numbers its documents ``Document rn of cnt``, some with a no-break space
        in the marker, some with the marker wrapped over two lines; ``crlf`` gives some records
        the line ends of other systems.  Dumps are bounded: a chunk holds at most ``size`` documents.
        """
        d = self.table("documents", spread=False)            # grouped into dumps right away
        return bundle(d.select("source", "doc_id", "text"), size, crlf)

    def rec_dump(self) -> DataFrame:
        """Bulk exports (as :meth:`dump`) whose records are the labelled article blocks of :meth:`rec`."""
        d = self.table("documents", spread=False)
        return bundle(d.select("source", "doc_id", rec_body(d).alias("text")))

    def rec(self) -> DataFrame:
        """One labelled article block per document."""
        d = self.table("documents")
        return d.select("doc_id", rec_body(d).alias("body"))

    # -------------------------------------------------- keyed joins
    def meas_t(self) -> DataFrame:
        """Template: id + metadata (documents)."""
        return self.table("documents").select(F.col("doc_id").alias("id"), "lang", "n_chars")

    def meas_m(self) -> DataFrame:
        """Measures keyed by article file name (labels), width 3."""
        return self.table("labels").select(article_filename(F.col("doc_id"), 3).alias("filename"),
                                           "quality", "toxic")


def augment(d: DataFrame) -> DataFrame:
    """Inject title-and-name sentences into documents by ``doc_id % 4`` (row-local)."""
    m = F.col("doc_id") % 4
    text = (F.when(m == 0, F.concat("text", F.lit(" Dr Ann Lee said it may work. Mr Bob Ray would not!")))
            .when(m == 1, F.concat(F.lit("Professor Ida Moss must agree. "), "text"))
            .when(m == 2, F.concat("text", F.lit(" We asked Mr. Cole and Ms Jo Park.")))
            .otherwise(F.col("text")))
    return d.select("doc_id", "lang", "source", text.alias("text"))


PAGE_INSERT = ("<blockquote><p>Dr Ann Lee said it <b>may</b> work.</p> Prof Bo Ek agreed.</blockquote>"
               "<p>We asked Mr Bob Ray, who would not &amp; could not say.</p>"
               "<p>Caf&eacute; &bull; it&#146;s &#9999999; &#38;lt; &amp;lt;</p><article-teaser>more</article-teaser>"
               # quotes within quotes, one that is never closed, one closed across another element, one with its end tag alone
               "<blockquote>Dr Ann Lee: <BLOCKQUOTE class='in'><p>Ms Jo Park must go</p><blockquote>so</blockquote></BLOCKQUOTE > said Prof Bo Ek</blockquote>"
               "<div><blockquote>Mr Al Fox may<p>stay</div><p>We met Dr Eve Day.</p>"
               "<blockquote>a<section>Mr Bob Ray</blockquote>left</section></blockquote><p>Mrs Di Orr</p></article>")


def augment_pages(pages: DataFrame) -> DataFrame:
    """Inject PAGE_INSERT before ``</article>`` when ``page_id % 3 = 0`` (row-local)."""
    html = F.when(F.col("page_id") % 3 == 0, F.replace("html", F.lit("</article>"), F.lit(PAGE_INSERT))) \
        .otherwise(F.col("html"))
    return pages.select("page_id", html.alias("html"))


def rec_body(d: DataFrame):
    """The labelled article block of a document row (column expression)."""
    nl2 = F.lit("\n\n")
    return F.concat(
        F.lit("Piece "), F.col("doc_id"), F.lit(": [Op-Ed]: [Op-Ed]"), nl2,
        F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("Author: "), F.col("source"), nl2)).otherwise(F.lit("")),
        F.lit("https://example.org/d/"), F.col("doc_id"), nl2, F.lit("Abstract: None available."), nl2,
        F.lit("Full text: "), F.col("text"), nl2,
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Subject: "), F.col("lang"), nl2)).otherwise(F.lit("")),
        F.lit("URL: https://example.org/u/"), F.col("doc_id"), nl2,
        F.lit("Publication date: Jan 2, 2022"), nl2, F.lit("Section: "), F.col("lang"))


def marker(rn, cnt):
    """The marker of record ``rn``: a no-break space in every fifth, a line end in every other fifth."""
    return F.concat(F.lit("Document"), F.when(rn % 5 == 1, F.lit("\u00a0")).otherwise(F.lit(" ")), rn,
                    F.when(rn % 5 == 2, F.lit("\n")).otherwise(F.lit(" ")), F.lit("of "), cnt)


def bundle(d: DataFrame, size: int = DUMP_SIZE, crlf: bool = False) -> DataFrame:
    """(source, doc_id, text) rows -> one export per (source, doc_id div size), records in doc_id order."""
    d = d.withColumn("chunk", F.floor(F.col("doc_id") / size))
    w = Window.partitionBy("source", "chunk")
    d = d.withColumns({"rn": F.row_number().over(w.orderBy("doc_id")), "cnt": F.count(F.lit(1)).over(w)})
    piece = F.concat(marker(F.col("rn"), F.col("cnt")), F.lit("\n\n"), F.col("text"), F.lit("\n"))
    if crlf:
        piece = F.when(F.col("rn") % 5 == 3, F.replace(piece, F.lit("\n"), F.lit("\r\n"))).otherwise(piece)
    return (d.groupBy("source", "chunk")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", piece.alias("p")))),
                                          lambda s: s["p"]), "").alias("blob")))
