"""Quality rules as a short-circuit cascade.

Each rule rejects a document from a few lazily computed features.  On a
sample, every rule is timed with all features it needs and its rejections are
counted; the cascade then runs the rules in falling order of rejections per
second and stops at the first one that rejects.  The order changes the work,
never the verdict: a document is kept if no rule rejects it.

The rules hold for texts of every script: capitals are counted among all letters (a text of few cased letters is not
rejected for an acronym), and the length of words is bounded only by what is not of a script written without blanks.  The
contract's base rule of 20 words holds too, so an unspaced text needs 20 runs between blanks.

Defined results: null, empty and blank texts have no words and are rejected
(too few words); repeated rows each get the same verdict; rules that reject alike per second run in the order of their cost, then
name; an empty table gives an empty result; kept columns travel in a struct, so names can't clash; very long texts are handled
whole, one batch at a time.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame, functions as F

from quarry.llm.common import BLANKS, attach

SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
WINDOW = 8
ASCII = re.compile("[\\x00-\\x7f]+")
#: Scripts that don't part words by blanks, with their punctuation: Thai, Lao, Tibetan, Myanmar, Khmer, Tai, Balinese,
#: Javanese, Yi, kana, Bopomofo, Han, full-width forms.
UNSPACED = ((0x0E00, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19FF), (0x1A20, 0x1AAF), (0x1B00, 0x1B7F), (0x2E80, 0x312F),
            (0x3190, 0x4DBF), (0x4E00, 0xA4CF), (0xA980, 0xA9FF), (0xAA60, 0xAADF), (0xF900, 0xFAFF), (0xFE30, 0xFE4F),
            (0xFF00, 0xFFEF), (0x1AFF0, 0x1B16F), (0x20000, 0x3FFFF))


class Features:
    """Features of one text, each computed when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def raw(self) -> bytes:
        return self.text.encode()

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - (len(self.raw) - len(self.raw.translate(None, BLANKS)))

    def count(self, of: bytes) -> int:
        return len(self.raw) - len(self.raw.translate(None, of))

    @cached_property
    def n_symbols(self) -> int:
        return self.count(SYMBOLS)

    @cached_property
    def n_upper(self) -> int:
        return self.count(UPPER)

    @cached_property
    def n_lower(self) -> int:
        return self.count(LOWER)

    @cached_property
    def wide(self) -> Counter:
        """Characters beyond ASCII."""
        return Counter() if len(self.raw) == len(self.text) else Counter(ASCII.sub("", self.text))

    @cached_property
    def n_letters(self) -> int:
        return self.n_upper + self.n_lower + sum(n for c, n in self.wide.items() if c.isalpha())

    @cached_property
    def n_capitals(self) -> int:
        return self.n_upper + sum(n for c, n in self.wide.items() if c.isalpha() and c.isupper())

    @cached_property
    def n_unspaced(self) -> int:
        return sum(n for c, n in self.wide.items() if c >= "\u0e00" and any(a <= ord(c) <= b for a, b in UNSPACED))

    @cached_property
    def lines(self) -> list[bytes]:
        """The \\n-split lines that hold a word."""
        return [x for x in self.raw.split(b"\n") if x and not x.isspace()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_runs(self) -> int:
        """Words equal to the word before them."""
        return sum(a == b for a, b in zip(self.words, self.words[1:]))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words in windows of eight words that occur twice or more."""
        words, n = self.words, self.n_words - WINDOW + 1
        if n < 2:
            return 0
        h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
        key = h[:n].copy()
        for j in range(1, WINDOW):
            key *= np.uint64(0x9E3779B97F4A7C15)
            key += h[j:j + n]
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        if not same.any():
            return 0
        hot = np.zeros(n, bool)
        hot[order[1:][same]] = hot[order[:-1][same]] = True
        places = np.flatnonzero(hot).tolist()  # windows whose hash repeats; now by their words
        windows = [tuple(words[i:i + WINDOW]) for i in places]
        seen = Counter(windows)
        step = np.zeros(len(words) + 1, np.int64)
        for i, w in zip(places, windows):
            if seen[w] > 1:
                step[i] += 1
                step[i + WINDOW] -= 1
        return int((np.cumsum(step) > 0).sum())


Rule = tuple[str, Callable[[Features], bool]]

#: Base rules of the contract, then the rules of this operator, for texts of every script.  All thresholds are integers.
RULES: tuple[Rule, ...] = (
    ("short", lambda f: f.n_words < 20),
    ("repeats", lambda f: 100 * f.n_repeat_words > 30 * f.n_words),
    ("symbols", lambda f: 4 * f.n_symbols > f.n_words),
    ("capitals", lambda f: 2 * f.n_capitals > f.n_letters),
    ("word_runs", lambda f: 10 * f.n_runs > 3 * f.n_words),
    ("word_length", lambda f: f.word_chars < 2 * f.n_words or f.word_chars - f.n_unspaced > 40 * f.n_words),
    ("duplicate_lines", lambda f: 10 * f.n_dup_lines > 6 * len(f.lines)),
)

def measure(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000) -> list[dict]:
    """Per rule: rows of the sample, rejections, and seconds with all features computed afresh.

    The sample is a seeded Bernoulli draw of about ``sample_rows`` rows over the whole table.
    """
    def start():
        def fn(texts):
            out = []
            for text in texts:
                row = []
                for name, rejects in rules:
                    began = time.perf_counter_ns()
                    bad = rejects(Features(text))
                    row.append({"rule": name, "ns": time.perf_counter_ns() - began, "bad": bool(bad)})
                out.append(row)
            return {"tried": out}
        return fn

    n = docs.count()
    part = docs.select("text").sample(fraction=min(1.0, sample_rows / max(1, n)), seed=8)
    tried = attach(part, [], ["text"], "tried array<struct<rule:string,ns:long,bad:boolean>>", start) \
        if part.columns else part
    return [r.asDict() for r in tried.select(F.explode("tried").alias("t")).groupBy(F.col("t.rule").alias("rule"))
            .agg(F.count("*").alias("rows"), F.sum(F.col("t.bad").cast("long")).alias("rejected"),
                 (F.sum("t.ns") / 1e9).alias("seconds")).collect()]


def ordered(stats: list[dict], rules: tuple[Rule, ...] = RULES) -> tuple[Rule, ...]:
    """Rules by falling rejections per second; rules that rejected nothing come last, cheapest first."""
    by = {s["rule"]: s for s in stats}
    zero = {"rejected": 0, "seconds": 0.0}

    def rank(rule: Rule):
        s = by.get(rule[0], zero)
        return (-s["rejected"] / max(s["seconds"], 1e-9), s["seconds"], rule[0])
    return tuple(sorted(rules, key=rank))


def _cascade(rules: tuple[Rule, ...], digest: bool):
    def start():
        def fn(texts):
            out = {"kept": []}
            if digest:
                out |= {c: [] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
            for text in texts:
                f = Features(text)
                out["kept"].append(not any(rejects(f) for _, rejects in rules))
                if digest:
                    for c in out.keys() - {"kept"}:
                        out[c].append(getattr(f, c))
            return out
        return fn
    return start


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000) -> DataFrame:
    """``docs`` without the rejected rows, same columns."""
    rules = ordered(measure(docs, rules, sample_rows), rules)
    judged = attach(docs, docs.columns, ["text"], "kept boolean", _cascade(rules, False))
    return judged.where("kept").select("row.*")


def report(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000) -> DataFrame:
    """The contract's digest: base figures of every text, and the cascade's verdict."""
    rules = ordered(measure(docs, rules, sample_rows), rules)
    fields = "kept boolean, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
    df = attach(docs, ["doc_id"], ["text"], fields, _cascade(rules, True))
    failed = (F.col("n_words") < 20) | (F.lit(100) * F.col("n_repeat_words") > F.lit(30) * F.col("n_words"))
    return df.select(F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines",
                     "n_repeat_words", failed.alias("base_failed"), (F.col("kept") & ~failed).alias("kept"))
