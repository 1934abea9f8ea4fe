"""Physical-plan properties of the catalogue queries (run on the smallest scale factor)."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from quarry.plans.catalogue import QUERIES

from conftest import SF_SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


# probes run in tasks; round trips write before they read and are checked through their operators
NOT_HERE = ("shard_catalog", "shard_roles", "shard_labels", "product_roundtrip", "csv_roundtrip", "stream_mentions", "news_csv_mentions",
            "corpus_discovery", "corpus_discovery_tagged", "feed_json", "text_blocks", "article_sink", "whole_texts", "record_separators", "glob_union", "archive_articles",
            "model_scores", "dump_split_lines", "describe_scores", "corpus_bucketed", "classifier_scores", "feed_repoll")
NO_PYTHON = [k for k in QUERIES if k not in NOT_HERE]


@pytest.mark.parametrize("name", sorted(NO_PYTHON))
def test_default_queries_stay_in_the_jvm(spark, name):
    p = plan(E.queries()[name](spark, SF_SMALL))
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_top_lemmas_plan(spark):
    df = E.queries()["top_lemmas"](spark, SF_SMALL)
    p = plan(df)
    assert "WindowGroupLimit" in p
    # the lexicon joins the reduced (year, wordID) counts, not the raw tokens
    o = optimized(df)
    assert o.index("Aggregate") < o.rindex("Join")


def test_filters_reach_the_scan(spark):
    df = E.queries()["recent_selection"](spark, SF_SMALL)
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)" in p or "EqualTo(lang,en)" in p


def test_column_pruning(spark):
    df = E.queries()["top_lemmas"](spark, SF_SMALL)
    p = plan(df)
    assert "l_extendedprice" not in p and "p_retailprice" not in p


def test_spread_is_a_noop_for_split_inputs(spark):
    from quarry.session import spread
    many = spark.range(0, 1000, numPartitions=spark.sparkContext.defaultParallelism + 2)
    assert spread(many) is many
    one = spark.range(0, 1000, numPartitions=1)
    assert spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_counts_aggregate_before_the_shuffle(spark):
    from quarry.operators import corpus as C
    from quarry.plans.views import Views
    tokens, words, texts = Views(spark, SF_SMALL).corpus()
    p = plan(C.count_by(tokens, words, texts, ["year", "lemma"]))
    # a partial aggregate runs below the first hash exchange
    first_exchange = p.rindex("Exchange hashpartitioning")
    assert "HashAggregate" in p[first_exchange:]


def test_spread_leaves_dealt_rows_alone(spark):
    from quarry.session import spread
    df = spark.range(0, 100, numPartitions=1)
    for dealt in (df.groupBy("id").count(), df.join(df.withColumnRenamed("id", "k"), df.id == F.col("k")), df.repartition(2, "id"), df.limit(3)):
        assert spread(dealt) is dealt          # asking for their partitions would run them


def test_session_settings(spark):
    from quarry.session import get_session
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert get_session("local[2]", 3) is spark
        assert spark.conf.get("spark.sql.session.timeZone") == "Asia/Tokyo"     # an active session keeps its own
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_shared_folder_is_required_off_local_masters(spark, monkeypatch):
    from quarry import session

    class Cluster:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Fake:
        sparkContext = Cluster()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default
    with pytest.raises(RuntimeError):
        session.shared_dir(Fake())
