"""Ledger checks for the text helpers (Python semantics reproduced in Spark)."""

import pytest
from pyspark.sql import functions as F
from pyspark.errors import NumberFormatException

from quarry.functions import text as X
from quarry.operators.keyed import first_int


def one(spark, col, value, schema="s string"):
    return spark.createDataFrame([(value,)], schema).select(col.alias("r")).first()["r"]


@pytest.mark.parametrize("s, want", [                                 # T1
    ("Grüße aus Köln, señor_1 — ça va?", ["Grüße", "aus", "Köln", "señor_1", "ça", "va"]),
    ("naïve café 12ab", ["naïve", "café", "12ab"]), ("東京 タワー x_y", ["東京", "タワー", "x_y"]), ("a b\tc", ["a", "b", "c"])])
def test_words_are_unicode(spark, s, want):
    assert one(spark, X.words(F.col("s")), s) == want


@pytest.mark.parametrize("s, want", [                                 # T2
    ("One. Two!  Three? four", ["One.", "Two!", "Three?", "four"]), ("Mr. Cole said. Next.", ["Mr.", "Cole said.", "Next."]),
    ("end. ", ["end.", ""]), ("x.\x1cy", ["x.", "y"])])
def test_sentences_end_at_any_white_space(spark, s, want):
    assert one(spark, X.sentences(F.col("s")), s) == want


@pytest.mark.parametrize("s", ["  a b \n", " x ", "\x1cy\x1f", "", "\t"])
def test_strip_matches_python(spark, s):                              # T3
    assert one(spark, X.strip_ws(F.col("s")), s) == s.strip()


def test_zfill_never_truncates(spark):                                # T4
    df = spark.createDataFrame([(7,), (1000,)], "n int")
    got = [r[0] for r in df.select(X.zfill(F.col("n"), 3)).collect()]
    assert got == ["007", "1000"] == [str(7).zfill(3), str(1000).zfill(3)]


def test_line_value_does_not_jump_lines(spark):                       # T5
    body = "Author:\nNext line\nLinks:   \nLinks: http://x\n"
    assert one(spark, X.line_value(F.col("s"), "Author"), body) == ""
    assert one(spark, X.line_value(F.col("s"), "Links", nonblank=True), body) == "http://x"


def test_density_rounds_half_up(spark):                               # T6 (documented deviation)
    text = " ".join(["may"] + ["x"] * 15)                              # 1/16 = 0.0625
    assert one(spark, X.term_density(F.col("s")), text) == 0.063


def test_mentions_rows(spark):
    s = "Dr Ann Lee met Prof. Bo Ek, Professor Ida Moss and Mrs Kim. DrX Yz. Mr Ray."
    assert one(spark, X.mentions(F.col("s")), s) == ["Dr Ann Lee", "Prof. Bo Ek", "Professor Ida Moss", "Mrs Kim", "Mr Ray"]


def test_first_int_raises_without_digits(spark):                      # X8 / T22
    df = spark.createDataFrame([("article_012_v2.txt",)], "s string")
    assert df.select(first_int("s")).first()[0] == 12
    with pytest.raises(Exception):
        spark.createDataFrame([("none.txt",)], "s string").select(first_int("s")).collect()
