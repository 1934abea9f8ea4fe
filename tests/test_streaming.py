"""The row-wise operators on a readStream source give the batch result."""

from quarry.operators.mentions import sentence_mentions
from quarry.plans.views import Views, augment
from quarry.streaming.mentions import stream_sentence_mentions

from conftest import SF_SMALL


def test_stream_equals_batch(spark):
    streamed = stream_sentence_mentions(spark, SF_SMALL, transform=augment)
    aug = Views(spark, SF_SMALL).aug()
    batch = sentence_mentions(aug.select(aug["doc_id"].alias("source"), "text"), "text", "source")
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.collect()))
    assert streamed.count() > 0


def test_stream_of_a_table_in_many_files(spark, tmp_dir):
    """a table may be a folder of files, also without any mention; one that is not there is an error"""
    import pytest
    rows = [(i, f"We met Dr Ann Lee {i}. So it was.", "en", "s", 9) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    df.repartition(3).write.parquet(f"{tmp_dir}/many/documents.parquet")
    df.where("doc_id < 5").selectExpr("doc_id", "'nobody' AS text", "lang", "source", "n_chars").write.parquet(f"{tmp_dir}/none/documents.parquet")
    got = stream_sentence_mentions(spark, f"{tmp_dir}/many")
    batch = sentence_mentions(df.selectExpr("doc_id AS source", "text"), "text", "source")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect())) and got.count() == 20 and got.columns == batch.columns
    none = stream_sentence_mentions(spark, f"{tmp_dir}/none")
    assert none.count() == 0 and none.columns == batch.columns
    with pytest.raises(FileNotFoundError):
        stream_sentence_mentions(spark, f"{tmp_dir}/gone")


def test_article_parsing_on_a_stream(spark):
    from pyspark.sql import functions as F

    from quarry.operators.dumps import parse_articles
    from quarry.plans.views import rec_body
    from quarry.session import shared_dir
    from quarry.streaming.mentions import DOCUMENTS_SCHEMA, read_stream, run_available_now

    def parse(d):
        return parse_articles(d.select("doc_id", rec_body(d).alias("body")), "body").drop("body")

    stream = parse(read_stream(spark, SF_SMALL, "documents.parquet", DOCUMENTS_SCHEMA))
    base = shared_dir(spark, "stream-articles")
    out = spark.read.parquet(run_available_now(stream, base + "/sink", base + "/ckpt"))
    batch = parse(spark.read.parquet(f"{SF_SMALL}/documents.parquet"))
    cols = sorted(batch.columns)
    assert sorted(map(tuple, out.select(cols).collect())) == sorted(map(tuple, batch.select(cols).collect()))
    assert out.filter(F.col("full_text") != "").count() == out.count() > 0


def test_polls_keep_each_article_once_over_restarts(spark):
    """polls are saved and followed in three sittings; articles that come again, in later polls too, are dropped"""
    from quarry.operators.feeds import flatten_feed
    from quarry.session import shared_dir
    from quarry.streaming.polls import follow_feed
    polls = Views(spark, SF_SMALL).feed_polls()
    base = shared_dir(spark, "polls")
    seen = []
    for sitting in (polls[:2], polls[2:3], polls[3:]):
        for p in sitting:
            p.write.mode("append").json(base + "/polls")
        seen.append(follow_feed(spark, base + "/polls", base + "/sink", base + "/ckpt", max_files=2).count())
    out = spark.read.parquet(base + "/sink").collect()
    every = [r for p in polls for r in flatten_feed(p).collect()]
    assert len(every) == 2 * len(out) and len({r.url for r in out}) == len(out) and seen == sorted(seen)
    assert {tuple(r) for r in out} == {tuple(r) for r in every}
    again = follow_feed(spark, base + "/polls", base + "/sink", base + "/ckpt")
    assert again.count() == len(out)  # nothing new


def test_articles_without_a_time_are_kept(spark, tmp_dir):
    from quarry.streaming.polls import follow_feed
    page = '{"articles": [{"title": "a", "url": "u1", "publishedAt": "soon"}, {"title": "b", "url": "u2"}, {"title": "b", "url": "u2"}]}\n'
    with open(f"{tmp_dir}/p.json", "w") as f:
        f.write(page)
    got = follow_feed(spark, tmp_dir, tmp_dir + "-sink", tmp_dir + "-ckpt").collect()
    assert sorted((r.url, r.publishedAt) for r in got) == [("u1", "soon"), ("u2", "")]
