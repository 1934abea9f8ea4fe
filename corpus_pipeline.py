"""Training-data pipeline over ``documents``: quality rules, line dedup, SimHash near-dedup,
benchmark decontamination, best-fit packing.

Each stage works on all documents that the one before it kept.  All but the last return the columns of
``documents``; the last returns one row per packed piece.  ``run`` writes every stage's result as Parquet in
the shared folder and reads it again, so a lost executor costs at most part of one stage.

Defined results: rows with nulls, empty and very long texts, repeats and ties follow the stages' operators; an
empty table passes through every stage as an empty table; extra columns pass unread until packing, which returns
its own columns only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import decontaminate, linededup, packing, quality, simhash
from quarry.llm.common import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality.judge(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; lines under later occurrences of a three-line window, or of one or two lines of over 50 words,
    are cut from their texts."""
    return linededup.remove_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (four-word shingles, at most four differing bits)."""
    return simhash.keep_first(docs, shingle=4, max_bits=4)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated, without hit spans of a window's length or more."""
    return decontaminate.remove_spans(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    return packing.report(docs)


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near dedup", near_dedup),
          ("decontamination", decontamination), ("best-fit packing", best_fit_packing)]

#: SQL has neither the fingerprint's hash nor the tokenizer; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
