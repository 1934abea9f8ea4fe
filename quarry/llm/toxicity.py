"""Toxicity by a weighted lexicon matched with an Aho-Corasick automaton.

Folding: lower case, compatibility and look-alike letters to Latin ones, letters with accents to the plain ones, digits and signs
that stand for letters inside a word back to letters, everything else to single spaces.

Learning, on a bounded sample of labelled rows: near copies in the sample are dropped (rows
that share a third of their five-word shingles with an earlier one).  Words that several rows hold, no more of them toxic than
the sample is, are plain and left aside.  Over the other words, word beginnings of
``STEM`` letters and whole words are counted per label; an entry is kept if its rows are toxic
significantly too often for chance (binomial, corrected for the number of candidates)
and its forms, a row's different words that begin with it, stand mostly in toxic rows.  Its weight is the smoothed log-odds of the
forms.  Of entries that begin each other only the one of the most forms in toxic rows, less half those in clean ones, stays, of
equal ones the shortest, so a stem stands for its forms.  Contexts (a
matched word alone, or with the word before it or after it) that occur no more in toxic rows than the sample's share become exception
phrases: matches inside them don't count.  Score: a logistic
model of the sum of matched weights, of that sum per hundred words, and of the different words matched after the first.

Scoring runs over whole texts of all rows, with nothing but the text as input.  Defined results:
null, empty and word-less texts have no match and get the score of zero weight; repeated rows
each get the same result; with no labelled rows the lexicon is empty and every score is the
prior 0; null labels are not learned from; of labels that contradict each other the toxic one counts; an empty table gives an
empty table; kept columns travel in a struct, so names can't clash; very long texts are matched whole, in time that grows with
their length.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quarry.llm.common import attach, map_batches, written

STEM = range(4, 11)

# Look-alike letters and the Latin letters they stand for.
ALIKE = {"а": "a", "α": "a", "в": "b", "с": "c", "ϲ": "c", "ԁ": "d", "е": "e", "ε": "e", "ѐ": "e", "һ": "h", "і": "i", "ι": "i", "ı": "i",
         "ј": "j", "к": "k", "κ": "k", "ӏ": "l", "м": "m", "п": "n", "ո": "n", "о": "o", "ο": "o", "σ": "o", "р": "p", "ρ": "p", "ԛ": "q",
         "ѕ": "s", "т": "t", "τ": "t", "υ": "u", "ս": "u", "ν": "v", "ѵ": "v", "ԝ": "w", "ω": "w", "х": "x", "χ": "x", "у": "y", "γ": "y"}
# Digits and signs used as letters.
AS_LETTER = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}

LEET = re.compile(r"[0134578@$]+(?=[^\W\d_])")
LEET_TABLE = str.maketrans(AS_LETTER)
ASCII_FOLD = {i: " " for i in range(128) if not (chr(i).isalpha())} | {i: chr(i).lower() for i in range(65, 91)}
#: Latin letters with accents become the plain ones
PLAIN = {c: d[0] for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if len(d := unicodedata.normalize("NFD", chr(c))) > 1 and d[0].isascii()}
#: accents that stand by themselves, zero-width characters and soft hyphens vanish
FOLD = ASCII_FOLD | PLAIN | {ord(a): b for a, b in ALIKE.items()} | {c: None for c in (*range(0x300, 0x370), 0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)}
ODD = re.compile("[^\x00-ɏ]")
INNER = re.compile(r"[^\W\d_](?:[0134578@$]+)[^\W\d_]|(?<!\S)[0134578@$]+[^\W\d_]")


def fold(text: str | None) -> str:
    """Folded words, each between single spaces: `` a b ``."""
    if not text:
        return " "
    if ODD.search(text):
        text = unicodedata.normalize("NFKC", text)
    text = text.lower()
    if INNER.search(text):
        text = LEET.sub(lambda m: m.group().translate(LEET_TABLE), text)
    words = text.translate(FOLD).split()
    return f" {' '.join(words)} " if words else " "


class Lexicon:
    """Entries (`` stem`` or `` word ``) with weights, exception phrases, and the score's coefficients."""

    def __init__(self, weights: dict[str, float], exceptions: list[str] = (), beta: tuple = (-30.0, 0.0, 0.0, 0.0)):
        self.weights, self.exceptions, self.beta = weights, list(exceptions), tuple(beta)
        self.machine = None

    def __getstate__(self):
        return {**self.__dict__, "machine": None}

    def find(self, folded: str) -> list[tuple[int, str]]:
        """(start, entry) of the matches outside exception phrases."""
        if not self.weights:
            return []
        if self.machine is None:
            self.machine = ahocorasick.Automaton()
            for phrase in self.exceptions:
                self.machine.add_word(phrase, (phrase, True))
            for entry in self.weights:
                self.machine.add_word(entry, (entry, False))
            self.machine.make_automaton()
        hits, safe = [], []
        for end, (entry, exempt) in self.machine.iter(folded):
            (safe if exempt else hits).append((end - len(entry) + 1, entry))
        if safe:
            safe.sort()
            starts, reach = [b for b, _ in safe], list(accumulate((b + len(p) for b, p in safe), max))
            # the furthest end of the phrases that begin no later than the match
            hits = [(a, e) for a, e in hits if not (k := bisect_right(starts, a)) or reach[k - 1] < a + len(e)]
        return hits

    def features(self, folded: str) -> tuple[float, float, float]:
        """Sum of the matched weights, that sum per hundred words, and the different words matched after the first, all damped."""
        hits = self.find(folded)
        words = {folded[a:folded.index(" ", a + 1)] for a, _ in hits}
        total = sum(self.weights[e] for _, e in hits)
        return (float(np.log1p(total)), float(np.log1p(100 * total / max(1, folded.count(" ") - 1))),
                float(np.log1p(max(0, len(words) - 1))))

    def score(self, folded: str) -> float:
        x = self.beta[0] + sum(b * f for b, f in zip(self.beta[1:], self.features(folded)))
        return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))


def held_out(id_col: Column, folds: int = 4, fold: int = 2) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def _independent(sample: DataFrame) -> DataFrame:
    """The sample without near copies of an earlier row (by id hash)."""
    def shingles(batches):
        for batch in batches:
            for key, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words.split()
                own = sorted({hash_of(words[i:i + 5]) for i in range(max(1, len(words) - 4))})
                yield pa.RecordBatch.from_pydict({"key": pa.array([key] * len(own), pa.int64()), "s": pa.array(own, pa.int64())})

    def hash_of(words):
        import xxhash
        return xxhash.xxh64_intdigest(" ".join(words)) - (1 << 63)

    rows = map_batches(sample.select("key", "folded"), shingles, "key long, s long")
    first = rows.groupBy("s").agg(F.min("key").alias("first"))
    shared = rows.join(first, "s").groupBy("key").agg(F.avg((F.col("first") < F.col("key")).cast("double")).alias("shared"))
    return sample.join(shared.where("shared < 0.34").select("key"), "key", "left_semi")


def draw(docs: DataFrame, labels: DataFrame, sample_rows: int = 16_000) -> DataFrame:
    """key, text, toxic: about ``sample_rows`` labelled rows, chosen by a hash of the id over all labels.
    The chosen labels are few by that bound and are broadcast; no text is shuffled."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    part = min(1 << 40, (sample_rows << 40) // max(1, n))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < part)
    return (docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
            .select(F.xxhash64("doc_id", "text").alias("key"), "text", "toxic"))


def learn(drawn: DataFrame, chance: float = 0.01, least_share: float = 0.5) -> Lexicon:
    """Fits a lexicon on a bounded sample (key, text, toxic)."""
    def start():
        return lambda texts: {"folded": [fold(t) for t in texts]}
    drawn = attach(drawn.dropDuplicates(["key"]), ["key", "toxic"], ["text"], "folded string", start).select("row.*", "folded")
    sample = written(_independent(written(drawn, "toxic-drawn")), "toxic-sample")
    size = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}  # two rows
    toxic, clean = size.get(1, 0), size.get(0, 0)
    if not toxic or not clean:
        return Lexicon({})
    base = toxic / (toxic + clean)

    def words(batches):
        for batch in batches:
            for key, folded, label in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                own = sorted(set(folded.split()))
                yield pa.RecordBatch.from_pydict({"key": pa.array([key] * len(own), pa.int64()), "word": pa.array(own, pa.string()),
                                                  "toxic": pa.array([label] * len(own), pa.int32())})

    held = written(map_batches(sample.select("key", "folded", "toxic"), words, "key long, word string, toxic int"), "toxic-words")
    plain = held.groupBy("word").agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).where((F.col("n") >= 3) & (F.col("t") <= base * F.col("n")))
    odd = held.join(plain.select("word"), "word", "left_anti")
    stems = F.transform(F.filter(F.array(*[F.lit(k) for k in STEM]), lambda k: k <= F.length("word")), lambda k: F.concat(F.lit(" "), F.left("word", k)))
    entries = F.explode(F.array_append(stems, F.concat(F.lit(" "), F.col("word"), F.lit(" "))))
    by_row = odd.select("key", "toxic", entries.alias("entry")).groupBy("key", "toxic", "entry").agg(F.count("*").alias("forms"))
    seen = written(by_row.groupBy("entry").agg(F.sum("toxic").cast("long").alias("t"), F.count("*").alias("n"), F.sum("forms").alias("forms"),
                                               F.sum(F.col("forms") * F.col("toxic")).alias("toxic_forms")).where("t >= 3"), "toxic-entries")
    tried = max(1, seen.count())
    scored = []
    for r in seen.where(F.col("toxic_forms") >= least_share * F.col("forms")).toLocalIterator():
        if tried * _tail(r.t, r.n, base) < chance:
            clean_forms = r.forms - r.toxic_forms
            odds = float(np.log((r.toxic_forms + 0.5) / (toxic + 1)) - np.log((clean_forms + 0.5) / (clean + 1)))
            scored.append((clean_forms - 2 * r.toxic_forms, len(r.entry), r.entry, odds))
    weights: dict[str, float] = {}
    begun: set[str] = set()  # beginnings of the entries taken
    for _, _, entry, odds in sorted(scored):
        if entry not in begun and not any(entry[:k] in weights for k in range(2, len(entry))):
            weights[entry] = odds
            begun.update(entry[:k] for k in range(2, len(entry)))
    lexicon = Lexicon(weights)
    lexicon = Lexicon(weights, _exceptions(sample, lexicon, base))
    points = _features(sample, lexicon, ["toxic"]).select("row.toxic", "x").toArrow()  # about sample_rows rows of numbers
    lexicon.beta = _logistic(np.array(points["x"].to_pylist()), points["toxic"].to_numpy())
    return lexicon


def _tail(t: int, n: int, p: float) -> float:
    """Chance of t or more out of n."""
    from math import exp, lgamma, log
    return sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * log(p) + (n - k) * log(1 - p)) for k in range(t, n + 1))


def _exceptions(sample: DataFrame, lexicon: Lexicon, base: float, least: int = 2) -> list[str]:
    """Words and two-word contexts around matches in ``least`` rows or more, of which no larger a share is toxic than of all."""
    def contexts(batches):
        for batch in batches:
            for folded, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = set()
                for at, _ in lexicon.find(folded):
                    end = folded.index(" ", at + 1)
                    after, before = folded.find(" ", end + 1), folded.rfind(" ", 0, at) if at else -1
                    own.add(folded[at:end + 1])
                    if after > 0:
                        own.add(folded[at:after + 1])
                    if before >= 0:
                        own.add(folded[before:end + 1])
                yield pa.RecordBatch.from_pydict({"phrase": pa.array(list(own), pa.string()), "toxic": pa.array([label] * len(own), pa.int32())})

    rows = map_batches(sample.select("folded", "toxic"), contexts, "phrase string, toxic int")
    return [r[0] for r in rows.groupBy("phrase").agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))
            .where((F.col("t") <= base * F.col("n")) & (F.col("n") >= least)).orderBy("phrase").toLocalIterator()]


def _features(sample: DataFrame, lexicon: Lexicon, keep: list[str]) -> DataFrame:
    def start():
        def fn(folded):
            return {"x": [lexicon.features(f) for f in folded]}
        return fn
    return attach(sample, keep, ["folded"], "x array<double>", start)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 50) -> tuple:
    """Ridge logistic regression by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    beta, penalty = np.zeros(x.shape[1]), ridge * np.diag([1e-3, *[1] * (x.shape[1] - 1)])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ beta)
        beta = beta + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(b) for b in beta)


def score(docs: DataFrame, lexicon: Lexicon, keep: list[str]) -> DataFrame:
    """``row`` (the kept columns) and the score of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def start():
        return lambda texts: {"score": [shared.value.score(fold(t)) for t in texts]}
    return attach(docs, keep, ["text"], "score double", start)


def report(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample_rows: int = 16_000) -> DataFrame:
    """The contract's digest: doc_id, held_out, score, predicted."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(~held_out(F.col("doc_id")))
    scored = score(docs.select("doc_id", "text"), learn(draw(docs, known, sample_rows)), ["doc_id"])
    return scored.select(F.col("row.doc_id").alias("doc_id"), held_out(F.col("row.doc_id")).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
