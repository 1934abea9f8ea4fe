"""Line dedup over overlapping three-line windows.

A text is split at \\n; lines that hold more than blanks, trimmed, are numbered
in order, and every ``width`` consecutive ones form a window, identified by a
128-bit hash.  The first occurrence of a window is the smallest (doc_id, text
hash, position); every other occurrence is later.  A line that any later
occurrence covers is removed; overlapping occurrences merge into one covered
run.  The earliest copy of a line is never covered by a later occurrence, so no
line disappears from the corpus.

With ``passage`` (the pipeline's stage: 50) runs of fewer lines that together hold more words than
that are windows too, so a long line or pair of lines is also found between other neighbours and in
texts of one or two lines.  ``report`` follows its SQL and has none of these.  Repeats that begin or
end within a line are not seen.

Plan: windows are built inside the row (no shuffle), counted with map-side
partial aggregation, and only windows that repeat are joined back (a common
window is a hot key on one side of that join, against a single row on the
other, which adaptive skew handling splits).  Per document only its own covered
positions are gathered.

Defined results: null, empty and blank texts and, without ``passage``, texts of fewer
than ``width`` such lines have no windows and stay as they are; rows that repeat id and text
are one document and each get its result; null ids come first in the order;
blank lines are never removed; an empty table gives an empty table; very long texts are cut within the row; kept columns travel in a
struct, so names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quarry.llm.common import attach, col, written
from quarry.llm.decontaminate import with_text

TRIMMED = " \t\r\x0b\x0c"


def _key(docs: DataFrame) -> list[Column]:
    return [col(docs, "doc_id").alias("k_id"), F.xxhash64(F.coalesce(col(docs, "text"), F.lit(""))).alias("k_h")]


def line_windows(docs: DataFrame, width: int = 3, passage: int | None = None) -> DataFrame:
    """k_id, k_h, pos (of the window's first line, from 0), n (its lines) and the window's hash (a, b)."""
    lines = F.filter(F.transform(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(TRIMMED))), lambda x: x != "")

    def line(x: Column) -> Column:
        words = [] if passage is None else [F.size(F.split(x, f"[{TRIMMED}]+")).alias("words")]
        return F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(7), x, F.length(x)).alias("b"), *words)
    df = docs.select(*_key(docs), col(docs, "text").alias("text"))
    if passage is None:
        df = df.where(F.contains("text", F.lit("\n")))
    df = df.select("k_id", "k_h", F.transform(lines, line).alias("l"))
    if passage is None:
        df = df.where(F.size("l") >= width)

    def windows(n: int) -> Column:
        def window(i: Column) -> Column:
            part = [F.get("l", i + j) for j in range(n)]
            return F.struct(i.alias("pos"), F.lit(n).alias("n"), F.xxhash64(*[p["a"] for p in part]).alias("a"),
                            F.xxhash64(*[p["b"] for p in part]).alias("b"))
        spots = F.slice(F.sequence(F.lit(0), F.size("l")), F.lit(1), F.greatest(F.size("l") - (n - 1), F.lit(0)))
        if n < width:
            spots = F.filter(spots, lambda i: sum((F.get("l", i + j)["words"] for j in range(1, n)), F.get("l", i)["words"]) > passage)
        return F.transform(spots, window)
    every = F.concat(*[windows(n) for n in range(width if passage is None else 1, width + 1)])
    return df.select("k_id", "k_h", F.explode(every).alias("w")).select("k_id", "k_h", "w.pos", "w.n", "w.a", "w.b")


def covered(docs: DataFrame, width: int = 3, passage: int | None = None) -> DataFrame:
    """Per document with later occurrences: k_id, k_h and their sorted (pos, n)."""
    windows = line_windows(docs, width, passage)
    place = F.struct("k_id", "k_h", "pos")
    # written, so that the join deals both sides anew and can split a hot window's rows
    repeated = written(windows.groupBy("a", "b").agg(F.min(place).alias("first"), F.max(place).alias("last"))
                       .where(~F.col("first").eqNullSafe(F.col("last"))).select("a", "b", "first"), "repeated-windows")
    later = windows.join(repeated, ["a", "b"]).where(~place.eqNullSafe(F.col("first"))).select("k_id", "k_h", "pos", "n")
    return later.groupBy("k_id", "k_h").agg(F.sort_array(F.collect_set(F.struct("pos", "n"))).alias("later"))


def _without():
    def start():
        def fn(texts, laters):
            out = {"new_text": [], "n_lines": [], "n_removed": []}
            for text, later in zip(texts, laters):
                lines = (text or "").split("\n")
                at = [i for i, x in enumerate(lines) if x.strip(TRIMMED)]
                gone: set[int] = set()
                for w in later or ():
                    gone.update(at[w["pos"]:w["pos"] + w["n"]])
                if gone:
                    text = "\n".join(x for i, x in enumerate(lines) if i not in gone)
                out["new_text"].append(text)
                out["n_lines"].append(len(at))
                out["n_removed"].append(len(gone))
            return out
        return fn
    return start


def dedup(docs: DataFrame, width: int = 3, keep: list[str] | None = None, passage: int | None = None) -> DataFrame:
    """``row`` (the kept columns), new_text, n_lines (those with more than blanks) and n_removed."""
    keep = docs.columns if keep is None else keep
    spots = covered(docs, width, passage).withColumnsRenamed({"k_id": "s_id", "k_h": "s_h"})
    text = [] if "text" in keep else [col(docs, "text").alias("text")]
    nested = docs.select(*_key(docs), F.struct(*[col(docs, c).alias(c) for c in keep]).alias("row"), *text)
    joined = nested.join(spots, F.col("k_id").eqNullSafe(F.col("s_id")) & (F.col("k_h") == F.col("s_h")), "left")
    return (attach(joined, ["row"], ["text" if text else "row.text", "later"], "new_text string, n_lines long, n_removed long", _without())
            .select("row.row", "new_text", "n_lines", "n_removed"))


def remove_lines(docs: DataFrame, width: int = 3, passage: int | None = 50) -> DataFrame:
    """``docs`` with later occurrences cut from their texts, same columns and rows."""
    return with_text(dedup(docs, width, passage=passage), docs)


def report(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, the text without later occurrences, its line counts."""
    return dedup(docs, width, ["doc_id"]).select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_removed",
                                                 F.col("new_text").alias("text"))
