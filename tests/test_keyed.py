"""Validated keyed joins."""

import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from quarry.operators import keyed as K


def test_filename_from_max_id_width(spark):
    meta = spark.createDataFrame([(7, "a"), (1000, "b")], "id long, x string")
    got = sorted(r.filename for r in K.with_filename(meta).collect())
    assert got == ["article_0007.txt", "article_1000.txt"]
    fixed = sorted(r.filename for r in K.with_filename(meta, width=3).collect())
    assert fixed == ["article_007.txt", "article_1000.txt"]              # zfill never truncates
    with pytest.raises(KeyError):
        K.with_filename(spark.createDataFrame([(1,)], "x long"))
    keep = spark.createDataFrame([("given.txt",)], "filename string")
    assert K.with_filename(keep).first().filename == "given.txt"


def test_one_to_one_validation(spark):
    """shared columns are an error at once, keys that repeat or are NULL when the result is read"""
    t = spark.createDataFrame([(1, "a"), (2, "b")], "id long, lang string")
    m = spark.createDataFrame([("article_001.txt", 1)], "filename string, q int")
    m_dup = spark.createDataFrame([("article_001.txt", 1), ("article_001.txt", 2)], "filename string, q int")
    with pytest.raises(SparkRuntimeException, match="right side is not unique.*article_001.txt"):
        K.template_measures(t, m_dup).collect()
    t_dup = spark.createDataFrame([(1, "a"), (1, "b")], "id long, lang string")
    with pytest.raises(SparkRuntimeException, match="left side is not unique"):
        K.template_measures(t_dup, m).count()
    shared = spark.createDataFrame([("article_001.txt", "x")], "filename string, lang string")
    with pytest.raises(K.ValidationError):
        K.template_measures(t, shared)
    nulls = spark.createDataFrame([(None, 1)], "filename string, q int")
    with pytest.raises(SparkRuntimeException, match="NULL join keys"):
        K.template_measures(t, nulls).collect()
    other = spark.createDataFrame([("article_099.txt", 1)] * 2, "filename string, q int")  # a key of no template row
    with pytest.raises(SparkRuntimeException, match="not unique"):
        K.template_measures(t, other).collect()
    assert K.validated_left_join(t_dup.withColumnRenamed("id", "filename"), m_dup.withColumn("filename", F.lit(1).cast("long")), "filename", False).count() == 4


def test_validation_costs_one_shuffle_a_side_and_no_job(spark):
    tracker, group = spark.sparkContext.statusTracker(), "validated"
    t = spark.range(1000).select(F.col("id"), F.lit("x").alias("lang"))
    m = spark.range(900).select(K.article_filename("id", 3).alias("filename"), F.lit(1).alias("q"))
    spark.sparkContext.setJobGroup(group, "")
    try:
        out = K.validated_left_join(t.select(K.article_filename("id", 3).alias("filename"), "lang"), m, "filename")
        assert list(tracker.getJobIdsForGroup(group)) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    plan = out.hint("merge")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and out.count() == 1000


def test_template_measures_fill_and_order(spark):
    t = spark.createDataFrame([(1, "a", None), (2, "b", 5)], "id long, lang string, n long")
    m = spark.createDataFrame([(" article_1.txt ", 3, "hi")], "filename string, q int, note string")
    out = K.template_measures(t, m, width=None, strip_keys=True, fill=True)
    assert out.columns == ["id", "lang", "n", "filename", "q", "note"]
    rows = sorted(tuple(r) for r in out.collect())
    assert rows == [(1, "a", 0, "article_1.txt", 3, "hi"), (2, "b", 5, "article_2.txt", 0, None)]


def test_measures_with_id_and_combine(spark):
    m = spark.createDataFrame([("article_012_v3.txt", 1.5, None)], "filename string, a double, b string")
    out = K.measures_with_id(m)
    assert out.columns == ["id", "filename", "a", "b"] and out.first().id == 12 and out.first().b is None
    meta = spark.createDataFrame([(1, "article_1.txt"), (2, "article_2.txt")], "id long, filename string")
    texts = spark.createDataFrame([("article_1.txt", "  body \n")], "filename string, text string")
    got = sorted((r.id, r.text) for r in K.combine_text(meta, texts).collect())
    assert got == [(1, "body"), (2, "")]
