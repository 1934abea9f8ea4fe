"""Language identification with language-bitmask n-gram filters.

Learning: every n-gram of the training texts (bytes of the lower-cased text with
everything but letters as single spaces) is counted per language.  An n-gram belongs to
a language if its rate there is at least ``share`` of its best rate in any language.  The
pairs go into a bit-sliced Bloom filter: a cell is a mask with a bit per language, in as many 64-bit words as they need,
an n-gram's ``HASHES`` cells get its languages' bits, and the AND of its cells returns
all languages that contain it, true ones and false positives, in one look-up.  The filter's size follows the number of n-grams.

Prediction: over the n-grams of a text, the set bits are counted per language
(popcounts c of n).  A language's false-positive rate f is the product of its bit's
densities in the filter's halves; (c - f n) / (1 - f) estimates the true members, which,
weighted per n-gram length and normalised, decide.  Ties go to the language with more
training documents, then to the smaller name.

What is learned from is bounded: the ``most_languages`` languages of the most documents, about ``per_language`` documents of each,
chosen by a hash of id and text over the whole table, and of each language its most frequent n-grams, at most ``keys_per_language`` (fewer where
these would be over ``most_pairs`` altogether; those of about one count go together), so a rare language keeps as many as a frequent one.  Everything else covers all
rows and whole texts.

Defined results: a null text, and one without a letter, is ``und`` with score 0; a text
without a learned n-gram gets the first language by the tie rule, score 0; null languages
are not learned from; with nothing to learn from, as in an empty table, every text is ``und``; repeated rows each
get the same result; very long texts are read in pieces that overlap; the columns read get names of their own, so others can't
clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from quarry.llm.common import attach, col, map_batches, written

SIZES = (3, 5)
HASHES = 2
LETTER = re.compile(r"[^\W\d_]")
#: ASCII that is no letter becomes a space
LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
CHUNK = 1 << 20


def letters(text: str | None) -> bytes:
    return b" " + b" ".join(text.lower().encode().translate(LETTERS).split()) + b" " if text else b""


def grams(raw: np.ndarray, size: int) -> np.ndarray:
    """The n-grams of a byte array as numbers, exactly (``size`` up to 7 bytes)."""
    n = len(raw) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = raw[:n].astype(np.uint64)
    for j in range(1, size):
        out |= raw[j:j + n].astype(np.uint64) << np.uint64(8 * j)
    return out | np.uint64(size << 56)


class Filter:
    """Bit-sliced Bloom filter: per cell a mask of languages, in words of 64 (fewer bits for few languages).  Pair i says that the
    n-gram ``keys[i]`` belongs to the language ``owners[i]``."""

    def __init__(self, langs: list[str], keys: np.ndarray, owners: np.ndarray, bits_per_key: int = 16):
        self.langs = langs
        self.bits = max(10, int(np.ceil(np.log2(max(1, len(np.unique(keys))) * bits_per_key))))
        self.words = [range(a, min(a + 64, len(langs))) for a in range(0, max(1, len(langs)), 64)]
        slots = list(self.slots(keys))
        self.cells = []  # by word, by hash
        false = []
        for word in self.words:
            kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if 8 * t().itemsize >= len(word))
            own = (owners >= word.start) & (owners < word.stop)
            bit = np.left_shift(kind(1), (owners[own] - word.start).astype(kind))
            halves = [np.zeros(1 << (self.bits - 1), kind) for _ in range(HASHES)]
            for cells, slot in zip(halves, slots):
                np.bitwise_or.at(cells, slot[own], bit)
            self.cells.append(halves)
            false.append(np.prod([[(cells >> kind(b) & kind(1)).mean() for b in range(len(word))] for cells in halves], axis=0))
        self.false = np.concatenate(false)

    def slots(self, keys: np.ndarray) -> Iterator[np.ndarray]:
        for m in MULTIPLIERS:
            mixed = (keys ^ (keys >> np.uint64(29))) * np.uint64(m)
            yield (mixed >> np.uint64(64 - self.bits + 1)).astype(np.int64)

    def masks(self, keys: np.ndarray) -> list[np.ndarray]:
        """Masks of each word of languages."""
        slots = list(self.slots(keys))
        out = []
        for halves in self.cells:
            found = halves[0][slots[0]]
            for cells, slot in zip(halves[1:], slots[1:]):
                found = found & cells[slot]
            out.append(found)
        return out

    def tally(self, keys: np.ndarray) -> np.ndarray:
        """Popcounts per language."""
        return np.concatenate([_tally(m, len(word)) for m, word in zip(self.masks(keys), self.words)])

    def counts(self, raw: np.ndarray) -> np.ndarray:
        """Corrected members per language among the n-grams of ``raw``, summed over sizes, and their number."""
        out, total = np.zeros(len(self.langs)), 0
        for size in SIZES:
            for at in range(0, max(1, len(raw) - size + 1), CHUNK):
                keys = grams(raw[at:at + CHUNK + size - 1], size)
                if not len(keys):
                    continue
                out += size * np.clip((self.tally(keys) - self.false * len(keys)) / (1 - self.false), 0, None)
                total += size * len(keys)
        return out / total if total else out


def _tally(masks: np.ndarray, n: int) -> np.ndarray:
    """Popcount per language bit."""
    if n <= 8:
        by_mask = np.bincount(masks, minlength=256)
        return np.array([by_mask[(np.arange(256) >> b & 1) == 1].sum() for b in range(n)], float)
    return np.array([np.count_nonzero(masks >> masks.dtype.type(b) & masks.dtype.type(1)) for b in range(n)], float)


def held_out(id_col: Column, folds: int = 5, fold: int = 0) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def learn(train: DataFrame, per_language: int = 2000, share: float = 0.5, least: int = 3, most_languages: int = 1024,
          keys_per_language: int = 1 << 18, most_pairs: int = 1 << 22) -> Filter:
    """Fits a filter on (doc_id, text, lang); see the module's text for what bounds the sample and the n-grams."""
    train = train.where("lang is not null and text is not null")
    sizes = {r[0]: r[1] for r in train.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages).collect()}
    langs = sorted(sizes, key=lambda x: (-sizes[x], x))
    if not langs:
        return Filter([], np.zeros(0, np.uint64), np.zeros(0, np.int64))
    spark = train.sparkSession
    drawn = spark.createDataFrame([(x, i, min(1 << 40, (per_language << 40) // sizes[x])) for i, x in enumerate(langs)], "lang string, i int, part long")
    spot = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40))
    # at most most_languages rows are broadcast
    sample = train.join(F.broadcast(drawn), "lang").where(spot < F.col("part")).select("text", "i")

    def count(batches):
        for batch in batches:
            found: dict[int, list] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found.setdefault(lang, []).append(letters(text))
            for lang, texts in found.items():
                raw = np.frombuffer(b"\0".join(texts), np.uint8)
                for size in SIZES:
                    keys, n = np.unique(grams(raw, size), return_counts=True)
                    yield pa.RecordBatch.from_pydict({
                        "gram": pa.array(keys.view(np.int64)), "i": pa.array(np.full(len(keys), lang, np.int32)), "n": pa.array(n, pa.int64())})

    counted = written(map_batches(sample, count, "gram long, i int, n long").groupBy("gram", "i").agg(F.sum("n").alias("n")), "grams")
    size = F.shiftright("gram", 56)
    total = counted.groupBy("i", size.alias("size")).agg(F.sum("n").alias("total"))  # a row per language and size
    rated = counted.withColumn("size", size).join(F.broadcast(total), ["i", "size"]).withColumn("rate", F.col("n") / F.col("total"))
    # a group holds a row per language at most
    best = rated.groupBy("gram").agg(F.max("rate").alias("best"), F.sum("n").alias("all"), F.collect_list(F.struct("i", "rate", "n")).alias("of"))
    pairs = written(best.where(F.col("all") >= least).select("gram", "best", F.inline("of")).where(F.col("rate") >= share * F.col("best"))
                    .select("gram", "i", "n"), "pairs")
    # a language's n-grams down to the least count that keeps them within the bound: from the numbers of n-grams of about each count
    most = min(keys_per_language, most_pairs // len(langs))
    running = F.sum("count").over(Window.partitionBy("i").orderBy(F.desc("step")))
    floors = (pairs.groupBy("i", F.floor(4 * F.log2("n")).alias("step")).agg(F.count("*").alias("count"), F.min("n").alias("n"))
              .withColumn("kept", running).where(F.col("kept") <= most).groupBy("i").agg(F.min("n").alias("floor")))
    pairs = pairs.join(F.broadcast(floors), "i").where(F.col("n") >= F.col("floor")).select("gram", "i").toArrow()  # a floor a language
    return Filter(langs, pairs["gram"].to_numpy().view(np.uint64), pairs["i"].to_numpy().astype(np.int64))


def predict(docs: DataFrame, model: Filter, keep: list[str]) -> DataFrame:
    """``row`` (the kept columns), lang_pred and score of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        m = shared.value

        def one(text):
            if not m.langs or not text or not LETTER.search(text):
                return "und", 0.0
            c = m.counts(np.frombuffer(letters(text), np.uint8))
            i = int(np.argmax(c))  # the first of equals: langs stand in the order of the tie rule
            return m.langs[i], float(min(1.0, c[i]))

        def fn(texts):
            got = [one(t) for t in texts]
            return {"lang_pred": [g[0] for g in got], "score": [g[1] for g in got]}
        return fn

    return attach(docs, keep, ["text"], "lang_pred string, score double", start)


def report(docs: DataFrame, per_language: int = 2000) -> DataFrame:
    """The contract's digest: doc_id, held_out, lang_pred, score."""
    train = docs.select(col(docs, "doc_id").alias("doc_id"), col(docs, "text").alias("text"), col(docs, "lang").alias("lang"))
    model = learn(train.where(~held_out(F.col("doc_id"))), per_language)
    return predict(docs.select("doc_id", "text"), model, ["doc_id"]).select(
        F.col("row.doc_id").alias("doc_id"), held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score")
