"""Corpus joins and counts on small synthetic frames."""

from collections import Counter

from pyspark.sql import functions as F

from quarry.operators import corpus as C
from quarry.operators.catalog import normalise_texts, normalise_tokens, normalise_words
from quarry.plans.views import Views

from conftest import SF_SMALL


def frames(spark):
    tokens = spark.createDataFrame([(1, 10, 1), (1, 10, 2), (1, 11, 3), (2, 12, 1), (3, 10, 1), (None, 10, 1),
                                    (2, None, 2)], "textID long, wordID long, occID long")
    words = spark.createDataFrame([(10, "Cats", "cat", "N"), (11, "ran", "run", "V"), (11, "ran", "ran", "V"),
                                   (13, "x", "x", "N")], "wordID long, word string, lemma string, pos string")
    texts = spark.createDataFrame([(1, 1900, 1900, "news"), (2, 1901, 1900, "fic")],
                                  "textID long, year int, decade int, genre string")
    return tokens, words, texts


def brute(tokens, words, texts, keys):
    """Row-level left joins in plain Python, then count."""
    w = {}
    for r in words.collect():
        w.setdefault(r["wordID"], []).append(r)
    t = {r["textID"]: r for r in texts.collect()}
    out = Counter()
    for tok in tokens.collect():
        for wr in w.get(tok["wordID"], [None]) if tok["wordID"] is not None else [None]:
            tr = t.get(tok["textID"]) if tok["textID"] is not None else None
            row = {"word": wr and wr["word"], "lemma": wr and wr["lemma"], "pos": wr and wr["pos"],
                   "year": tr and tr["year"], "decade": tr and tr["decade"], "genre": tr and tr["genre"]}
            out[tuple(row[k] for k in keys)] += 1
    return out


def test_counts_equal_row_level_join(spark):
    tokens, words, texts = frames(spark)
    for keys in (["year", "word"], ["year", "lemma", "pos"], ["year", "lemma"], ["genre", "lemma"]):
        for pre in (False, True):
            got = {tuple(r[k] for k in keys): r["n"] for r in C.count_by(tokens, words, texts, keys, pre).collect()}
            assert got == dict(brute(tokens, words, texts, keys)), (keys, pre)


def test_sum_of_counts_is_joined_rows(spark):
    tokens, words, texts = frames(spark)
    joined = C.join_corpus(tokens, words, texts)
    total = C.count_by(tokens, words, texts, ["year", "word"]).agg(F.sum("n")).first()[0]
    assert total == joined.count() == 8          # wordID 11 appears twice in the lexicon
    assert dict(joined.dtypes)["textID"] == "string"


def test_top_k_ties_and_plan(spark):
    counts = spark.createDataFrame([(1, "b", 2), (1, "a", 2), (1, "c", 1), (None, "z", 5)],
                                   "year int, lemma string, n long")
    top = C.top_k_per_group(counts, "year", "n", 2, "lemma")
    assert sorted((r.year, r.lemma, r.rank) for r in top.collect() if r.year) == [(1, "a", 1), (1, "b", 2)]
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_lemma_trend(spark):
    tokens, words, texts = frames(spark)
    got = [(r.year, r.n) for r in C.lemma_trend(tokens, words, texts, "cat").collect()]
    assert got == [(None, 2), (1900, 2)]


def test_tagged_layout(spark):
    tagged = spark.createDataFrame([(1, "a"), (1, "b"), (9, "a")], "TextID long, Token string")
    _, _, texts = frames(spark)
    from quarry.operators.catalog import normalise_lexicon, normalise_tagged
    assert normalise_lexicon(tagged).columns == ["textID", "word"]       # by the shard's own columns
    assert normalise_lexicon(tagged.withColumn("Word_ID", tagged.TextID)).columns == ["wordID", "word"]
    rows = C.count_by(None, normalise_tagged(tagged), texts, ["year", "word"]).collect()
    assert sorted((r.year or 0, r.word, r.n) for r in rows) == [(0, "a", 1), (1900, "a", 1), (1900, "b", 1)]


def test_normalisers_case_insensitive(spark):
    raw = spark.createDataFrame([(1, 2, 3)], "Text_ID int, WORDID int, Id int")
    assert normalise_tokens(raw).dtypes == [("textID", "bigint"), ("wordID", "bigint"), ("occID", "bigint")]
    texts = spark.createDataFrame([("7", "1999", "news")], "DocID string, date_year string, Section string")
    r = normalise_texts(texts).first()
    assert (r.textID, r.year, r.decade, r.genre) == (7, 1999, None, "news")


def test_null_groups_kept_in_counts_dropped_in_profiles(spark):           # T10
    from quarry.operators import profile as P
    df = spark.createDataFrame([(None, 1.0), (None, 2.0), ("a", 3.0)], "k string, v double")
    assert {r.k for r in df.groupBy("k").count().collect()} == {None, "a"}
    assert {r.k for r in P.mean_by(df, "k", "v").collect()} == {"a"}
    assert {r.k for r in P.value_counts(df, "k").collect()} == {"a"}


def test_strict_casts_and_cast_before_union(spark):                       # T9, T22
    import pytest
    from quarry.operators.catalog import union_relaxed
    bad = spark.createDataFrame([("x1", "2")], "textid string, wordid string")
    with pytest.raises(Exception):
        normalise_tokens(bad).collect()
    a = spark.createDataFrame([(1,)], "v int")
    b = spark.createDataFrame([("word",)], "v string")
    u = union_relaxed([a, b])
    assert u.dtypes == [("v", "string")] and sorted(r.v for r in u.collect()) == ["1", "word"]
    assert normalise_tokens(bad, lenient=True).first().textID is None     # try_cast on request


def test_normalisers_emit_canonical_schemas(spark):
    from quarry.operators.catalog import TEXTS_SCHEMA, TOKENS_SCHEMA, WORDS_SCHEMA
    raw_t = spark.createDataFrame([(1, 2, 3)], "DocID int, Word_ID int, ID int")
    raw_w = spark.createDataFrame([(1, "a", "b", "c")], "wordid long, Form string, LEMMA string, upos string")
    raw_x = spark.createDataFrame([("1", "1999", "1990", "g")], "text_id string, Year string, decade string, genre string")
    assert normalise_tokens(raw_t).schema.simpleString() == TOKENS_SCHEMA.simpleString()
    assert normalise_words(raw_w).schema.simpleString() == WORDS_SCHEMA.simpleString()
    assert normalise_texts(raw_x).schema.simpleString() == TEXTS_SCHEMA.simpleString()


def test_salted_joins_equal_plain(spark):
    tokens, words, texts = frames(spark)
    hot = tokens.unionByName(spark.createDataFrame([(1, 10, i) for i in range(200)], tokens.schema))
    plain = sorted(map(tuple, C.join_corpus(hot, words, texts).collect()), key=str)
    split = sorted(map(tuple, C.join_corpus(hot, words, texts, hot_rows=20).collect()), key=str)
    assert plain == split
    assert C.hot_keys(hot, ["textID", "wordID"], 20) == {"textID": [1], "wordID": [10]}
    assert C.hot_keys(hot, ["textID", "wordID"]) == {"textID": [], "wordID": []}
    a = {tuple(r) for r in C.count_by(hot, words, texts, ["year", "lemma"]).collect()}
    b = {tuple(r) for r in C.count_by(hot, words, texts, ["year", "lemma"], salt=5).collect()}
    assert a == b


def test_hot_keys_and_scans_of_the_row_level_join(spark):
    """a third of the rows under one key: it is found and salted; without hot keys the plan is that of the plain joins"""
    tokens, words, texts = Views(spark, SF_SMALL).corpus()
    many = tokens.unionByName(tokens.withColumn("wordID", F.lit(7).cast("long")).limit(3_000))
    assert C.hot_keys(many, ["wordID", "textID"], 1_000)["wordID"] == [7]
    assert sorted(map(str, C.join_corpus(many, words, texts, 1_000).collect())) == sorted(map(str, C.join_corpus(many, words, texts).collect()))
    p = C.join_corpus(tokens, words, texts)._jdf.queryExecution().optimizedPlan().toString()
    assert p.count("Join LeftOuter") == 2 and p.count("Relation") == 3


def test_bucketed_tables_join_without_an_exchange(spark, tmp_dir):
    tokens, _, texts = Views(spark, SF_SMALL).corpus()
    a = C.write_bucketed(tokens, f"{tmp_dir}/a", "bucketed_a", buckets=4)
    b = C.write_bucketed(C.texts_for_join(texts), f"{tmp_dir}/b", "bucketed_b", buckets=4)
    out = C.tokens_per_text(a, b)
    rows = sorted(map(str, out.collect()))
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert rows == sorted(map(str, C.tokens_per_text(tokens, C.texts_for_join(texts)).collect()))


def test_products_from_one_cube(spark, tmp_dir):
    tokens, words, texts = frames(spark)
    prods = C.corpus_products(tokens, words, texts, k=2, trend_lemma="cat", materialize_dir=f"{tmp_dir}/cube")
    direct_top = {tuple(r) for r in C.top_lemmas(tokens, words, texts, k=2).collect()}
    assert {tuple(r) for r in prods["top_lemmas_per_year"].collect()} == direct_top
    direct_trend = [tuple(r) for r in C.lemma_trend(tokens, words, texts, "cat").collect()]
    assert [tuple(r) for r in prods["lemma_trend"].collect()] == direct_trend


def test_lexicon_and_metadata_are_not_broadcast(spark, tmp_dir):
    """files of a few kilobytes hold many equal rows; a CSV file is known by its list of byte ranges"""
    from quarry.sources.files import read_csv_split
    tokens = spark.createDataFrame([(i % 5 or None, i % 3 or None, i) for i in range(60)], "textID long, wordID long, occID long")
    spark.range(1, 2000).selectExpr("id AS wordID", "'w' AS word", "'l' AS lemma", "'p' AS pos").write.parquet(f"{tmp_dir}/words")
    spark.range(1, 2000).selectExpr("id AS textID", "1990 + id % 2 AS year").write.option("header", "true").csv(f"{tmp_dir}/texts")
    words, texts = spark.read.parquet(f"{tmp_dir}/words"), read_csv_split(spark, f"{tmp_dir}/texts", "textID long, year int")
    want = Counter((None if i % 5 == 0 else 1990 + i % 5 % 2, "w" if i % 3 else None) for i in range(60))
    counts = C.count_by(tokens, words, texts, ["year", "word"])
    assert {(r.year, r.word): r.n for r in counts.collect()} == want
    rows = C.join_corpus(tokens, words, texts)
    assert Counter((r.year, r.word) for r in rows.collect()) == want
    dated = tokens.join(texts, "textID").groupBy("year").count()
    assert {r["year"]: r["count"] for r in dated.collect()} == {1990: 24, 1991: 24}
    tagged = C.count_by(None, words.selectExpr("wordID AS textID", "word"), texts, ["year", "word"])
    assert {(r.year, r.n) for r in tagged.collect()} == {(1990, 999), (1991, 1000)}
    for df in (counts, rows, dated, tagged):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
