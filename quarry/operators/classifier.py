"""A linear text classifier, learned from labelled rows and run in Arrow batches behind the scorer protocol.

Features are the counts of a text's lower-cased words and word pairs, hashed by CRC-32 into ``buckets`` and scaled to
length one.  The model is multinomial logistic regression with an L2 penalty.  It is fitted on all labelled rows, whole texts; copies
of a text under one label count as one row.  Tasks turn the rows into blocks of features, written once to the shared folder, and every
round of the descent reads all blocks: each task adds up the gradient of its blocks, and the driver gets ``buckets x labels`` numbers a
task, of which tasks make one sum before if they are many.  Blocks of a few megabytes in all are held by the driver, which then takes the same steps
by itself.  The fitted weights, ``buckets x labels`` numbers, are broadcast after a check of their size; every row and whole texts
are scored.  Only a caller that gives ``per_label`` has the model fitted on a sample: of every label the ``per_label`` texts that hash smallest.

NULL and word-less texts have no features and get the label of the greatest bias; rows without a label are not learned from.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.scoring import PandasModelScorer
from quarry.session import shared_dir

WORD = re.compile(r"\w+")
MODEL_BYTES = 64 << 20
HASH_BITS = 16  # a label's hashes are counted in as many bins as these bits can tell
BLOCK = 1 << 17  # words and pairs in a block, or those of one longer text
DRIVER_BYTES = 16 << 20  # blocks of up to this size in all are held by the driver
SUMS_BYTES = 32 << 20  # of a round's sums, which the driver gets; more are added up by tasks first


def hashed(text: str | None, buckets: int) -> np.ndarray:
    """Buckets of a text's words and pairs of neighbouring words, sorted, each as often as it occurs."""
    words = [w.encode() for w in WORD.findall((text or "").lower())]
    found = [zlib.crc32(w) for w in words]
    found += [zlib.crc32(b" " + w, before) for before, w in zip(found, words[1:])]  # goes on from the sum of the word before
    return np.sort(np.array(found, np.int64) % buckets)


class Rows:
    """Rows of sorted buckets side by side, their counts scaled to length one: products with a matrix of weights and with its gradient.

    A bucket that a row has n times is held n times, so that no counts are; buckets take the fewest bytes that hold them.
    A row without features has a bucket of no weight, so that none is empty.
    """

    def __init__(self, rows: list[np.ndarray]):
        none = np.zeros(1, np.int64)
        full = np.array([len(r) > 0 for r in rows], bool)
        index = np.concatenate([none[:0], *[r if len(r) else none for r in rows]])
        self.size = np.array([max(1, len(r)) for r in rows], np.int64)
        self.index = index.astype(np.min_scalar_type(index.max(initial=0)))
        start = self.start()
        new = np.append(True, index[1:] != index[:-1])[:len(index)]
        new[start] = True
        run = np.flatnonzero(new)
        self.scale = full / np.sqrt(np.add.reduceat(np.square(np.diff(run, append=len(index))), np.searchsorted(run, start)))

    def start(self) -> np.ndarray:
        return np.cumsum(self.size) - self.size

    def times(self, weights: np.ndarray) -> np.ndarray:
        at, start = self.index.astype(np.intp), self.start()
        return np.stack([np.add.reduceat(w.take(at, mode="clip"), start) * self.scale for w in weights.T], axis=1)

    def back(self, errors: np.ndarray, buckets: int) -> np.ndarray:
        at = self.index.astype(np.intp)
        return np.stack([np.bincount(at, np.repeat(e * self.scale, self.size), buckets) for e in errors.T], axis=1)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def near_rows(labelled: DataFrame, per_label: int, max_labels: int) -> tuple[DataFrame, list[str]]:
    """The rows (label, t, ..) whose hash ``t`` may be among the ``per_label`` smallest of their label, and the labels.  Runs a job.

    Distinct hashes are counted per label and bin of hashes; a label's rows are kept up to the bin in which its sample ends,
    so little more than the sample travels on, and of the rest only hashes.
    """
    place = F.shiftright("t", 64 - HASH_BITS)
    counts = labelled.select("label", "t").distinct().groupBy("label", place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("label").orderBy("bin")) - F.col("n")
    ends = (counts.withColumn("before", before).where(F.col("before") < per_label).groupBy("label").agg(F.max("bin").alias("end"))
            .limit(max_labels + 1).collect())
    if len(ends) > max_labels:
        raise ValueError(f"more than {max_labels} labels")
    last = labelled.sparkSession.createDataFrame(ends, "label string, end long")
    return labelled.join(F.broadcast(last), "label").where(place <= F.col("end")).drop("end"), sorted(r["label"] for r in ends)


class TextClassifier:
    def __init__(self, labels: list[str], weights: np.ndarray, bias: np.ndarray):
        self.labels, self.weights, self.bias = labels, weights, bias
        if weights.nbytes > MODEL_BYTES:
            raise ValueError(f"the model takes {weights.nbytes} bytes, at most {MODEL_BYTES} are broadcast")

    @classmethod
    def fit(cls, df: DataFrame, text_col: str, label_col: str, per_label: int | None = None, buckets: int = 1 << 16,
            max_labels: int = 50, rounds: int = 120, penalty: float = 1e-5) -> TextClassifier:
        """Learns from all labelled rows of ``df``, or from ``per_label`` texts of each label."""
        text = F.col(text_col)
        rows = (df.where(F.col(label_col).isNotNull())
                .select(F.col(label_col).cast("string").alias("label"), text.alias("text"), F.xxhash64(text).alias("t"),
                        F.xxhash64(F.lit(1), text, F.length(text)).alias("u")))  # 128 bits of hash
        if per_label is not None:
            rows = near_rows(rows, per_label, max_labels)[0]
        rows = rows.groupBy("label", "t", "u").agg(F.first("text").alias("text"))
        if per_label is not None:
            first = F.row_number().over(Window.partitionBy("label").orderBy("t", "u"))
            rows = rows.withColumn("n", first).where(F.col("n") <= per_label)
        blocks = in_blocks(rows.select("label", "text"), buckets)
        try:
            found = (blocks.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
                     .limit(max_labels + 1).collect())
            if len(found) > max_labels:
                raise ValueError(f"more than {max_labels} labels")
            n = {r["label"]: r["n"] for r in sorted(found)}
            model = cls([*n], np.zeros((buckets, len(n))), np.zeros(len(n)))  # its size is checked before the work
            if len(n) > 1:
                model.weights, model.bias = train(gradient_of(blocks, n), len(n), buckets, rounds, penalty)
            return model
        finally:
            dropped(blocks)

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        return softmax(Rows([hashed(t, len(self.weights)) for t in texts]).times(self.weights) + self.bias)

    def predict(self, texts: pd.Series) -> pd.DataFrame:
        if not len(texts):
            return pd.DataFrame({"label": pd.Series([], dtype=str), "score": pd.Series([], dtype=float)})
        p = self.probabilities(texts.tolist())
        return pd.DataFrame({"label": [self.labels[i] for i in p.argmax(axis=1)], "score": p.max(axis=1)})

    def scorer(self, spark, dedupe: bool = True) -> PandasModelScorer:
        """This model behind the scorer protocol."""
        held = spark.sparkContext.broadcast(self)
        return PandasModelScorer(lambda texts, model: model.predict(texts), load=lambda: held.value, dedupe=dedupe)


def in_blocks(rows: DataFrame, buckets: int) -> DataFrame:
    """labels, block: the features of ``rows`` (label, text), written to the shared folder.  ``block`` is Rows with the places of
    their labels and the labels' names, pickled; ``labels`` has the label of each of its rows."""
    def packed(labels: list[str], held: list[np.ndarray]) -> pa.RecordBatch:
        names, place = np.unique(np.array(labels, object), return_inverse=True)
        block = pickle.dumps((Rows(held), place.astype(np.min_scalar_type(len(names))), names.tolist()), 5)
        return pa.RecordBatch.from_arrays([pa.array([labels], pa.list_(pa.string())), pa.array([block], pa.binary())], names=["labels", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, held, size = [], [], 0
        for b in batches:
            for label, text in zip(b.column(0), b.column(1)):
                labels.append(label.as_py())
                held.append(hashed(text.as_py(), buckets))
                size += len(held[-1]) + 1
                if size >= BLOCK:
                    yield packed(labels, held)
                    labels, held, size = [], [], 0
        if held:
            yield packed(labels, held)

    spark, schema = rows.sparkSession, "labels array<string>, block binary"
    path = shared_dir(spark, "classifier")
    # small groups of rows, as a reader holds one of them at a time
    (rows.mapInArrow(run, schema).write.option("compression", "none").option("parquet.block.size", 16 << 20)
     .option("parquet.block.size.row.check.min", 8).option("parquet.page.size.row.check.min", 8).parquet(path))
    out = spark.read.schema(schema).parquet(path)
    out._scratch = path
    return out


def dropped(blocks: DataFrame) -> None:
    """Deletes blocks that no round reads any more."""
    path = blocks.sparkSession._jvm.org.apache.hadoop.fs.Path(blocks._scratch)
    path.getFileSystem(blocks.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def added(blocks: Iterable[bytes], n: dict[str, int], w: np.ndarray) -> np.ndarray:
    """The gradient of the mean loss over the rows of ``blocks``, in which every label weighs alike; ``n``: rows of each label, in order."""
    at, share = {name: i for i, name in enumerate(n)}, 1 / (len(n) * np.array([*n.values()], float))
    total = np.zeros(w.shape)
    for block in blocks:
        rows, place, names = pickle.loads(block)
        label = np.array([at[x] for x in names])[place]
        z = rows.times(w[:, :-1].T) + w[:, -1]
        error = softmax(np.column_stack([z, -z.sum(axis=1)]))
        error[np.arange(len(label)), label] -= 1
        error = error[:, :-1] * share[label][:, None]
        total[:, :-1] += rows.back(error, w.shape[1] - 1).T
        total[:, -1] += error.sum(axis=0)
    return total


def gradient_of(blocks: DataFrame, n: dict[str, int]) -> Callable[[np.ndarray], np.ndarray]:
    """The gradient over all ``blocks`` as a function of the weights: by the driver if they are small, else a job a call."""
    if (blocks.agg(F.sum(F.octet_length("block"))).first()[0] or 0) <= DRIVER_BYTES:
        held = [bytes(r["block"]) for r in blocks.select("block").collect()]
        return lambda w: added(held, n, w)
    sc, schema = blocks.sparkSession.sparkContext, "label int, part binary"
    blocks = blocks.select("block").coalesce(sc.defaultParallelism)  # a task for each core, and a sum for each task
    tasks = blocks.rdd.getNumPartitions()

    def parts(total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([x.tobytes() for x in total], pa.binary())],
                                          names=["label", "part"])

    def gradient(w: np.ndarray) -> np.ndarray:
        held = sc.broadcast(w)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield parts(added((x.as_py() for b in batches for x in b.column(0)), n, held.value))

        def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for b in batches:
                for k, x in zip(b.column(0).to_pylist(), b.column(1)):
                    sums[k] = sums.get(k, 0) + np.frombuffer(x.as_py())
            for k, x in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["label", "part"])

        sums = blocks.mapInArrow(run, schema)
        if tasks * w.nbytes > SUMS_BYTES:
            sums = sums.repartition(len(w), "label").mapInArrow(both, schema)
        total = np.zeros(w.shape)
        for r in sums.collect():
            total[r["label"]] += np.frombuffer(r["part"])
        held.destroy()
        return total
    return gradient


def train(gradient: Callable[[np.ndarray], np.ndarray], labels: int, buckets: int, rounds: int, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases by accelerated gradient descent on the mean loss.

    Rows have length one, or root two with the bias, so the loss is 1-smooth and steps of the gradient itself are safe.  A row of
    weights stands for a label and ends in its bias.  The rows sum to zero, as the errors of a text do, so the last one is not computed.
    """
    weights = np.zeros((labels - 1, buckets + 1))
    w, t = weights, 1.0
    for _ in range(rounds):
        new = w - gradient(w).round(15)  # the sums' last digits hang on the order in which tasks are added up
        new[:, :-1] -= penalty * w[:, :-1]
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        w = new + (t - 1) / after * (new - weights)
        weights, t = new, after
    weights = np.vstack([weights, -weights.sum(axis=0)])
    return weights[:, :-1].T, weights[:, -1]
