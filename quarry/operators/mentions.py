"""Expert-mention extraction (D1-D4, D6) as row-wise DataFrame transforms.

Every operator here is a projection / generator over rows: no action, no
global sort and no shuffle, so each also runs on a ``readStream`` frame and
scales with the number of input partitions.  Output order is carried by
position columns (``sentence_pos``, ``mention_pos``), never by row order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import (MENTION_PATTERN, MODALS, PY_WS, SENTENCE_SPLIT, TITLES, count_in, lower_words,
                                   mentions, ratio, strip_ws)
from quarry.operators.scoring import LexiconScorer

# sentence split that does not cut after a dotted title ("Mr. Cole")
PROTECTED_SPLIT = r"(?<=[.!?])(?<!\b(?:" + "|".join(TITLES) + r")\.)" + PY_WS + "+"


def modal_density(df: DataFrame, text_col: str = "text", terms=MODALS, out: str = "persuasion_score",
                  places: int = 3, tokens_col: str | None = None) -> DataFrame:
    """Share of lower-cased word tokens in ``terms`` (0.0 without tokens), rounded.

    The token array is its own projection, so the text is tokenised once;
    ``tokens_col`` reuses an existing one.
    """
    t = tokens_col or "_toks"
    toks = df if tokens_col else df.withColumn(t, lower_words(F.coalesce(F.col(text_col), F.lit(""))))
    dens = F.round(ratio(count_in(t, terms), F.size(t)), places)
    out_df = toks.withColumn(out, dens)
    return out_df if tokens_col else out_df.drop(t)


def extract_mentions(df: DataFrame, text_col: str = "text", keep: list[str] | None = None,
                     pattern: str = MENTION_PATTERN, quote_col: str | None = None) -> DataFrame:
    """One row per title-and-name match (repeats kept) with its position."""
    keep = keep if keep is not None else [c for c in df.columns if c != text_col]
    extra = [F.col(text_col).alias(quote_col)] if quote_col else []
    return df.select(*keep, *extra, F.posexplode(mentions(F.coalesce(F.col(text_col), F.lit("")), pattern))
                     .alias("mention_pos", "expert"))


def sentence_mentions(df: DataFrame, text_col: str = "text", id_col: str = "source",
                      protect_titles: bool = False, pattern: str = MENTION_PATTERN) -> DataFrame:
    """D3: split into sentences, keep sentences with a match, one row per (sentence, match).

    Columns: id, sentence_pos, mention_pos, expert, quote (stripped sentence).
    A NULL text yields no rows.  By default the split cuts after "Mr." like
    the reference, so dotted titles never match; ``protect_titles`` keeps
    such sentences whole.
    """
    split = PROTECTED_SPLIT if protect_titles else SENTENCE_SPLIT
    s = df.select(F.col(id_col), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), split))
                  .alias("sentence_pos", "sentence"))
    m = s.select(id_col, "sentence_pos", "sentence", mentions("sentence", pattern).alias("_m"))
    # strip once per sentence, before the mentions multiply the rows
    m = m.filter(F.size("_m") > 0).withColumn("quote", strip_ws("sentence"))
    return m.select(id_col, "sentence_pos", F.posexplode("_m").alias("mention_pos", "expert"), "quote")


FEED_FIELDS = ("title", "description", "content")


def field_mentions(articles: DataFrame, fields=FEED_FIELDS, carry=("source", "author", "url", "publishedAt"),
                   pattern: str = MENTION_PATTERN, scored: bool = False, scorer=None,
                   names=("emotion", "emotion_score", "persuasion")) -> DataFrame:
    """Mentions in several text fields of each article, carrying article attributes.

    The fields are unpivoted (one row per (article, field)),
    fields without a match are dropped, and - with ``scored`` - emotion and
    modal density are computed once per field text *before* the mentions are
    exploded.  Output: carry..., field, mention_pos, expert, text (stripped
    field text)[, emotion, emotion_score, persuasion].
    """
    pairs = [F.struct(F.lit(f).alias("field"), F.coalesce(articles[f"`{f}`"], F.lit("")).alias("ftext")) for f in fields]
    long = articles.select(*carry, F.inline(F.array(*pairs)))
    long = long.withColumn("_m", mentions("ftext", pattern)).filter(F.size("_m") > 0)
    extra = []
    if scored:
        long = score_text(long, "ftext", scorer, *names)
        extra = list(names)
    long = long.withColumn("text", strip_ws("ftext"))      # once per field, before the explode
    return long.select(*carry, "field", F.posexplode("_m").alias("mention_pos", "expert"), "text", *extra)


def score_text(df: DataFrame, text_col: str, scorer=None, label_col: str = "emotion_label",
               score_col: str = "emotion_score", persuasion_col: str = "persuasion_score",
               terms=MODALS) -> DataFrame:
    """D5 + D1 on one text column; the lexicon scorer and the density share one tokenisation."""
    scorer = scorer or LexiconScorer()
    if isinstance(scorer, LexiconScorer):
        toks = df.withColumn("_toks", lower_words(F.coalesce(F.col(text_col), F.lit(""))))
        out = scorer.score(toks, text_col, label_col, score_col, tokens_col="_toks")
        return modal_density(out, text_col, terms, persuasion_col, tokens_col="_toks").drop("_toks")
    out = scorer.score(df, text_col, label_col, score_col)
    return modal_density(out, text_col, terms, persuasion_col)


def expert_analysis(df: DataFrame, text_col: str = "text", id_col: str = "source", scorer=None,
                    protect_titles: bool = False) -> DataFrame:
    """Sentence mentions + emotion + modal density in the reference's column order.

    The emotion and density are computed on the unstripped sentence like
    the reference; stripping only changes the quote column.  Both are
    row-local here (lexicon scorer) so no distinct/join-back is needed.
    """
    split = PROTECTED_SPLIT if protect_titles else SENTENCE_SPLIT
    s = df.select(F.col(id_col), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), split))
                  .alias("sentence_pos", "sentence"))
    s = s.withColumn("_m", mentions("sentence")).filter(F.size("_m") > 0)
    s = score_text(s, "sentence", scorer).withColumn("quote", strip_ws("sentence"))
    return s.select(id_col, "sentence_pos", F.posexplode("_m").alias("mention_pos", "expert"),
                    "quote", "emotion_label", "emotion_score", "persuasion_score")


def page_expert_analysis(blocks: DataFrame, scorer=None) -> DataFrame:
    """Page variant of D6 over H3 blocks: expert, quote (block text), emotion, density."""
    b = blocks.withColumn("_m", mentions("text")).filter(F.size("_m") > 0)
    b = score_text(b, "text", scorer)
    keep = [c for c in blocks.columns if c != "text"]
    return b.select(*keep, F.posexplode("_m").alias("mention_pos", "expert"), F.col("text").alias("quote"),
                    "emotion_label", "emotion_score", "persuasion_score")
