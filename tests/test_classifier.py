"""The learned text classifier: scores against a plain computation, held-out labels, odd rows."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarry.operators.classifier import TextClassifier
from quarry.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.1"


def plain(model, text):
    """probabilities of one text, feature by feature"""
    words = re.findall(r"\w+", (text or "").lower())
    n = Counter(zlib.crc32(x.encode()) % len(model.weights) for x in [*words, *map(" ".join, zip(words, words[1:]))])
    norm = math.sqrt(sum(c * c for c in n.values())) or 1
    z = [model.bias[k] + sum(c / norm * model.weights[i][k] for i, c in n.items()) for k in range(len(model.labels))]
    e = [math.exp(x - max(z)) for x in z]
    return [x / sum(e) for x in e]


def test_scores_by_plain_computation(spark):
    rows = [(i, t, y) for i, (t, y) in enumerate([("good day sun", "a"), ("bad night rain", "b"), ("sun good", "a"), ("rain and bad", "b"),
                                                  ("Été chaud", "c"), (None, "c"), ("good rain", None)] * 3)]
    df = spark.createDataFrame(rows, "i long, text string, y string")
    model = TextClassifier.fit(df, "text", "y", buckets=64)
    assert model.labels == ["a", "b", "c"]
    texts = ["sun", "bad rain", "été", "", None, "unseen words", "good " * 500]
    got = model.predict(pd.Series(texts))
    for t, label, score in zip(texts, got.label, got.score):
        p = plain(model, t)
        assert label == model.labels[int(np.argmax(p))] and abs(score - max(p)) < 1e-9
    assert [got.label[i] for i in range(3)] == ["a", "b", "c"] and got.label[3] == got.label[4]
    for dedupe in (True, False):
        out = model.scorer(spark, dedupe).score(df, "text").collect()
        assert len(out) == len(rows) and all(abs(r.emotion_score - max(plain(model, r.text))) < 1e-9 for r in out)
    again = TextClassifier.fit(df.repartition(7), "text", "y", buckets=64)
    assert np.allclose(again.weights, model.weights)


def test_only_rows_near_the_sample_travel(spark):
    """of many texts a label, little more than the sample is gathered by label; copies count once; small labels are whole"""
    from quarry.operators.classifier import near_rows
    df = spark.range(12_000).selectExpr("if(id % 3000 = 0, 'c', if(id % 2 = 0, 'a', 'b')) AS label", "concat('text ', id div 2 * 2) AS text")
    near, labels = near_rows(df.unionAll(df).withColumn("t", F.xxhash64("text")), 50, 9)
    assert labels == ["a", "b", "c"]
    kept, every = ({k: sorted(d.t) for k, d in x.distinct().toPandas().groupby("label")} for x in (near, df.withColumn("t", F.xxhash64("text"))))
    for k in labels:
        assert kept[k][:50] == every[k][:50] and len(kept[k]) <= 60, k
    assert len(kept["c"]) == 4 and near.count() <= 2 * 124


def test_learns_from_every_labelled_row(spark):
    """more texts a label than any sample held: every word of theirs weighs something"""
    df = spark.range(5_200).selectExpr("if(id % 2 = 0, 'a', 'b') AS y", "concat('w', id) AS text")
    model = TextClassifier.fit(df, "text", "y", rounds=2)
    seen = {zlib.crc32(f"w{i}".encode()) % (1 << 16) for i in range(5_200)}
    mixed = seen - set(np.flatnonzero(model.weights.any(axis=1)).tolist())  # words of both labels that fall into one bucket
    assert len(seen) > 4_900 and len(mixed) < 200
    right = model.predict(pd.Series([f"w{i}" for i in range(5_200)])).label.tolist()
    assert sum(x == "ab"[i % 2] for i, x in enumerate(right)) > 5_000


def descended(rows, buckets, rounds, penalty=1e-5):
    """weights and biases of the descent on dense rows (text, label); copies count once"""
    rows = sorted(set(rows), key=str)
    names = sorted({y for _, y in rows})
    x, truth = np.zeros((len(rows), buckets + 1)), np.array([[float(y == k) for k in names] for _, y in rows])
    for row, (text, _) in zip(x, rows):
        words = re.findall(r"\w+", (text or "").lower())
        for w in [*words, *map(" ".join, zip(words, words[1:]))]:
            row[zlib.crc32(w.encode()) % buckets] += 1
        row /= np.sqrt((row * row).sum()) or 1
        row[-1] = 1
    w = old = np.zeros((buckets + 1, len(names)))
    shrink, t = np.append(np.full(buckets, penalty), 0)[:, None], 1.0
    for _ in range(rounds):
        e = np.exp(x @ w)
        new = w - x.T @ ((e / e.sum(axis=1, keepdims=True) - truth) * (truth / truth.sum(axis=0)).sum(axis=1, keepdims=True) / len(names)) - shrink * w
        after = (1 + math.sqrt(1 + 4 * t * t)) / 2
        w, old, t = new + (t - 1) / after * (new - old), new, after
    return old[:-1], old[-1]


@pytest.mark.parametrize("driver, sums, block", [(1 << 20, 1 << 20, 1 << 17), (-1, 1 << 20, 40), (-1, 0, 3)])
def test_the_descent_is_the_same_wherever_it_runs(spark, monkeypatch, driver, sums, block):
    """by the driver, by tasks whose sums the driver adds up, and by tasks that add them up; held against dense rows"""
    from quarry.operators import classifier
    monkeypatch.setattr(classifier, "DRIVER_BYTES", driver)
    monkeypatch.setattr(classifier, "SUMS_BYTES", sums)
    monkeypatch.setattr(classifier, "BLOCK", block)
    rows = [(f"{'good' if i % 3 else 'bad'} day {i % 11} of {i % 5} " * (i % 4), "abc"[i * i % 7 % 3]) for i in range(90)]
    rows += [(None, "c"), ("", "a"), ("only", "d"), ("x " * 300 + "y", "b")]
    df = spark.createDataFrame([*rows, *rows[:40], ("good", None)], "text string, y string").repartition(5)
    model = TextClassifier.fit(df, "text", "y", buckets=32, rounds=6)
    weights, bias = descended(rows, 32, 6)
    assert model.labels == ["a", "b", "c", "d"]
    assert np.allclose(model.weights, weights, atol=1e-12) and np.allclose(model.bias, bias, atol=1e-12)


def test_bounds_and_empty_tables(spark):
    df = spark.createDataFrame([(i, f"w{i}", f"l{i}") for i in range(5)], "i long, text string, y string")
    with pytest.raises(ValueError):
        TextClassifier.fit(df, "text", "y", max_labels=3)
    with pytest.raises(ValueError):
        TextClassifier([], np.zeros((1 << 20, 9)), np.zeros(9))
    one = TextClassifier.fit(df.where("i = 1"), "text", "y")
    assert one.predict(pd.Series(["x"])).label[0] == "l1"


def test_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    out = QUERIES["classifier_scores"](spark, SF)
    assert out.count() == docs.count()
    held = out.where("held_out").join(labels, "doc_id").select((F.col("label") == F.col("quality").cast("string")).cast("int").alias("ok"), "quality")
    got = {r.quality: r.share for r in held.groupBy("quality").agg(F.avg("ok").alias("share")).collect()}
    assert got[1] > 0.85 and got[0] > 0.55, got
    both = docs.where("lang is not null").select("doc_id", "text", "lang")  # another label of the same rows
    model = TextClassifier.fit(both.where("doc_id % 5 <> 0"), "text", "lang", per_label=300)
    right = model.scorer(spark).score(both.where("doc_id % 5 = 0"), "text").select(F.avg((F.col("emotion_label") == F.col("lang")).cast("int"))).first()[0]
    assert right > 0.98, right
