"""Token / lexicon / text-metadata joins and the frequency products.

Plan shape for the count products (A1-A4, W1)
---------------------------------------------
The row-level product is ``tokens LEFT JOIN words ON wordID LEFT JOIN texts
ON textID``.  Every product is ``count(*)`` grouped by a few columns of it,
so the operator never materialises the joined rows:

1. tokens are joined with the text metadata on textID (the only join whose
   both sides grow with the corpus; sort-merge under AQE, which also splits a
   skewed textID) and immediately reduced to ``(text keys, wordID) -> n``
   with a partial (map-side) aggregate.  A hot word or a hot year collapses
   in the map-side combine, so no task receives a hot key's raw rows.
2. only then the lexicon is joined on wordID - to at most
   ``|text-key groups| x |distinct words|`` rows instead of one row per token
   - and the final counts are ``sum(n)``.

Both joins merge by key: neither table is broadcast (see :func:`unsent`).

Left-join semantics are preserved: unmatched tokens keep NULL word/lemma/pos
or NULL year, and duplicate lexicon keys multiply the counts exactly as they
multiply rows in the row-level join.  ``(textID, wordID)`` are counted
before the metadata join, which pays off when texts repeat words (natural
language) and not when pairs are unique; with ``salt`` or without metadata
only for ``preaggregate=True``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WORD_COLS = ("word", "lemma", "pos")
TEXT_COLS = ("year", "decade", "genre")


MOST_HOT = 4_000        # hot keys of a column at most; the sketch below misses none with more than rows / MOST_HOT rows


def hot_keys(df: DataFrame, columns: list[str], hot_rows: int = 1_000_000) -> dict[str, list]:
    """The values of each column that more than ``hot_rows`` rows (and more than one in MOST_HOT) hold, by one pass over ``df``.

    A frequent-items sketch per column, merged map-side, so nothing is shuffled by key and at most MOST_HOT values a column come
    back.  A table of no more than ``hot_rows`` rows has none, which its count tells.  Runs a job.
    """
    n = df.count()
    if n <= hot_rows:
        return {c: [] for c in columns}
    least = max(hot_rows, n // MOST_HOT)
    found = df.agg(*[F.expr(f"approx_top_k(`{c}`, {MOST_HOT}, {16 * MOST_HOT})").alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return {c: [x["item"] for x in found[f"c{i}"] or [] if x["item"] is not None and x["count"] > least] for i, c in enumerate(columns)}


def split_hot_keys(big: DataFrame, small: DataFrame, key: str | list[str], hot: list, parts: int = 32) -> DataFrame:
    """``big LEFT JOIN small USING (key)`` with the rows of the ``hot`` values of the (first) key dealt to ``parts`` tasks.

    Rows of a hot value get a hash of the row as salt, and the value's rows in ``small`` are repeated once per
    salt; every other row joins as usual.  Results equal the plain left join, which it is without hot values.
    """
    keys = [key] if isinstance(key, str) else key
    if not hot:
        return big.join(small, keys, "left")
    is_hot = F.col(keys[0]).isin(hot)
    salt = F.when(is_hot, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in big.columns]), F.lit(parts)).cast("int")).otherwise(F.lit(0))
    salts = F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0))))
    return big.withColumn("_salt", salt).join(small.withColumn("_salt", salts), [*keys, "_salt"], "left").drop("_salt")


def salted_left_join(big: DataFrame, small: DataFrame, key: str, salt: int = 0,
                     salt_cols: list[str] | None = None) -> DataFrame:
    """``big LEFT JOIN small USING (key)`` that survives a hot key without AQE.

    With ``salt > 1`` each big row gets a deterministic salt in [0, salt)
    (a hash of ``salt_cols``, so a retried task computes the same salt) and
    each small row is replicated once per salt value; the join runs on
    (key, salt).  A key holding a third of ``big`` is spread over ``salt``
    tasks.  Results equal the plain left join.  ``salt <= 1``: plain join
    (Catalyst/AQE choose its kind, unless ``small`` has a hint, and split skew themselves).
    """
    if salt <= 1:
        return big.join(small, key, "left")
    cols = salt_cols or big.columns
    b = big.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in cols]), F.lit(salt)).cast("int"))
    s = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    return b.join(s, [key, "_salt"], "left").drop("_salt")


def unsent(small: DataFrame) -> DataFrame:
    """``small`` as a join's side that is merged by key, whatever size the planner takes it for.

    Lexicon and metadata grow with the corpus, and the planner knows them by the bytes of their compressed files, or of the
    byte ranges that a CSV file is read by: a few megabytes stand for millions of rows, which a broadcast holds on the driver.
    """
    return small.hint("merge")


def texts_for_join(texts: DataFrame) -> DataFrame:
    """textID, year, decade, genre with aligned types (textID stays long for the join), never broadcast."""
    cols = set(texts.columns)
    sel = [F.col("textID").cast("bigint").alias("textID")]
    for c, t in (("year", "int"), ("decade", "int"), ("genre", "string")):
        if c in cols:
            sel.append(F.col(c).cast(t).alias(c))
    return unsent(texts.select(sel))


def join_corpus(tokens: DataFrame, words: DataFrame, texts: DataFrame | None = None,
                hot_rows: int = 1_000_000) -> DataFrame:
    """J1 + J2: the row-level product, textID rendered as string like the reference.

    The join runs on the long key (string equality of two long renderings is
    long equality) and the key is cast to string at the end.  wordIDs and
    textIDs that :func:`hot_keys` finds among the tokens, both in one pass, are split.
    """
    if "wordID" not in words.columns:
        return join_tagged(words, texts)
    hot = hot_keys(tokens, ["wordID"] + ["textID"] * (texts is not None), hot_rows)
    out = split_hot_keys(tokens, unsent(words), "wordID", hot["wordID"])
    if texts is not None:
        out = split_hot_keys(out, texts_for_join(texts), "textID", hot["textID"])
    return out.withColumn("textID", F.col("textID").cast("string"))


def write_bucketed(df: DataFrame, path: str, name: str, key: str = "textID", buckets: int = 16) -> DataFrame:
    """K1: ``df`` as a table of Parquet files under ``path``, in ``buckets`` buckets of ``key``, each sorted by it; read back.

    Tables of one number of buckets join on the key, and group by it, without an exchange: the shuffle is paid once, when
    the table is written, and every later join reads it for free.  A bucket should hold about a gigabyte.  Rows are
    dealt by the key before the write, so a bucket is one file.
    """
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).mode("overwrite").saveAsTable(name)
    return df.sparkSession.table(name)


def tokens_per_text(tokens: DataFrame, texts: DataFrame) -> DataFrame:
    """J2 over co-partitioned tables: textID, year, genre and number of tokens of every text with tokens.

    Both sides merge bucket by bucket; the tokens' counts need no exchange either, as they are grouped by the buckets'
    key.  (Tables without buckets give the same rows by a shuffle.)
    """
    counts = tokens.groupBy("textID").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(texts.hint("merge"), "textID", "left").select("textID", "year", "genre", "n")


def join_tagged(tagged: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Per-token rows keyed by textID (no lexicon) joined with the metadata."""
    cols = set(tagged.columns)
    base = tagged.select(
        F.col("textID").cast("bigint").alias("textID"),
        *[(F.col(c).cast("string") if c in cols else F.lit(None).cast("string")).alias(c) for c in WORD_COLS])
    if texts is not None:
        base = base.join(texts_for_join(texts), "textID", "left")
    return base.withColumn("textID", F.col("textID").cast("string"))


def count_by(tokens: DataFrame, words: DataFrame, texts: DataFrame | None, keys: list[str],
             preaggregate: bool = False, count_col: str = "n", salt: int = 0,
             matched_texts: bool = False) -> DataFrame:
    """``count(*)`` of the row-level join grouped by ``keys`` (see module doc).

    ``matched_texts`` keeps only tokens that have a metadata row (an inner join), as a slice
    over a filtered metadata table needs.

    ``salt`` spreads a hot textID in the metadata join (the lexicon join runs
    after the reduction, where hot words are already collapsed).
    """
    wkeys = [k for k in keys if k in WORD_COLS]
    tkeys = [k for k in keys if k in TEXT_COLS]
    other = [k for k in keys if k not in WORD_COLS and k not in TEXT_COLS]
    if other:
        raise ValueError(f"unknown corpus keys {other}")
    if texts is None and tkeys:
        raise ValueError(f"keys {tkeys} need text metadata")
    if "wordID" not in words.columns:           # tagged layout: no lexicon join
        rows = join_tagged(words, texts if tkeys else None)
        return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(count_col))

    salted = salt > 1 and bool(tkeys)
    # the salt hashes whole token rows (occurrence id included), so repeats of one pair spread too
    row_hash = [F.xxhash64(*[F.col(c) for c in tokens.columns]).alias("_h")] if salted and not preaggregate else []
    tok = tokens.select("textID", "wordID", *row_hash)
    # the metadata is merged by key, so the tokens travel by textID: they are counted before
    if preaggregate or tkeys and not salted:
        tok = tok.groupBy("textID", "wordID").agg(F.count(F.lit(1)).alias("_n"))
    else:
        tok = tok.withColumn("_n", F.lit(1).cast("bigint"))
    if tkeys:
        meta = texts_for_join(texts).select("textID", *tkeys)
        if salted and not matched_texts:
            tok = salted_left_join(tok, meta, "textID", salt, salt_cols=["_h"] if row_hash else ["textID", "wordID"])
        else:
            tok = meta.join(tok, "textID", "inner" if matched_texts else "right")
    reduced = tok.groupBy(*tkeys, "wordID").agg(F.sum("_n").alias("_n"))
    if wkeys:
        lex = words.select("wordID", *wkeys)
        reduced = unsent(lex).join(reduced, "wordID", "right")
    return reduced.groupBy(*keys).agg(F.sum("_n").cast("bigint").alias(count_col))


def top_k_per_group(df: DataFrame, group: str, order_col: str, k: int, tie: str,
                    rank_col: str = "rank") -> DataFrame:
    """First ``k`` rows per ``group`` by ``order_col`` desc, ties by ``tie`` asc nulls first.

    ``row_number() <= k`` is planned as a partial ``WindowGroupLimit`` before
    the shuffle, so each group's exchange carries at most k rows per input
    partition - a hot group never lands whole in one task.
    """
    w = Window.partitionBy(group).orderBy(F.col(order_col).desc(), F.col(tie).asc_nulls_first())
    return (df.withColumn(rank_col, F.row_number().over(w))
            .filter(F.col(rank_col) <= k))


def top_lemmas(tokens, words, texts, k: int = 50, preaggregate: bool = False, matched_texts: bool = False) -> DataFrame:
    """A3 + W1: the top ``k`` lemmas per year (year, lemma, n, rank)."""
    counts = count_by(tokens, words, texts, ["year", "lemma"], preaggregate=preaggregate, matched_texts=matched_texts)
    return top_k_per_group(counts, "year", "n", k, "lemma")


def lemma_trend(tokens, words, texts, lemma: str, n_rows: int = 20) -> DataFrame:
    """A4 + W2: count of one lemma per year, ascending year, first ``n_rows``.

    The lexicon is filtered to the lemma before its one join, so only that
    lemma's wordIDs travel and only their tokens reach the metadata join; the
    filter reaches the lexicon scan.  A wordID with several rows of the lemma
    counts once per row, as in the row-level product.
    """
    lex = words.filter(F.col("lemma") == F.lit(lemma))
    rows = lex.select("textID") if "wordID" not in words.columns else \
        tokens.select("textID", "wordID").join(lex.select("wordID"), "wordID").select("textID")
    dated = rows.join(texts_for_join(texts).select("textID", "year"), "textID", "left")
    return (dated.groupBy("year").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.col("year").asc_nulls_first()).limit(n_rows))


PRODUCTS = {"by_year_word": ["year", "word"], "by_year_lemma_pos": ["year", "lemma", "pos"],
            "top_lemmas_per_year": ["year", "lemma"]}


def corpus_products(tokens, words, texts, k: int = 50, trend_lemma: str | None = None,
                    materialize_dir: str | None = None, n_rows: int = 20) -> dict:
    """the products whose columns exist in the joined schema, by name.

    A product is planned only when all its columns are present (plan-time
    set test on column names), like the reference's guarded sinks.  The
    (year, lemma, pos) cube is computed once; the per-year lemma counts, the
    top-k and the trend are roll-ups of it (``materialize_dir`` writes the
    cube once so that the derived products do not re-run the joins).
    """
    names = set(WORD_COLS if "wordID" in words.columns else [c for c in WORD_COLS if c in words.columns])
    if texts is not None:
        names |= {c for c in TEXT_COLS if c in texts.columns}
    out = {}
    if {"year", "word"} <= names:
        out["by_year_word"] = count_by(tokens, words, texts, ["year", "word"])
    if {"year", "lemma"} <= names:
        cube_keys = ["year", "lemma", "pos"] if "pos" in names else ["year", "lemma"]
        cube = count_by(tokens, words, texts, cube_keys)
        if materialize_dir:
            cube.write.mode("overwrite").parquet(materialize_dir)
            cube = cube.sparkSession.read.parquet(materialize_dir)
        if "pos" in cube_keys:
            out["by_year_lemma_pos"] = cube
        by_lemma = cube.groupBy("year", "lemma").agg(F.sum("n").cast("bigint").alias("n"))
        out["top_lemmas_per_year"] = top_k_per_group(by_lemma, "year", "n", k, "lemma")
        if trend_lemma is not None:
            out["lemma_trend"] = (by_lemma.filter(F.col("lemma") == F.lit(trend_lemma)).select("year", "n")
                                  .orderBy(F.col("year").asc_nulls_first()).limit(n_rows))
    return out
