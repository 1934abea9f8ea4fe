"""File-name keyed joins of metadata, texts and measures.

Validation (T12/T13/T14) is part of the join's own plan: each side is grouped by the key,
which deals its rows as the join needs them, so it costs no shuffle and no job of its own; a key that is
NULL or repeats raises when the query runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.text import article_filename, strip_ws

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


class ValidationError(ValueError):
    """A one-to-one join precondition failed."""


def id_width(df: DataFrame, id_col: str = "id") -> Column:
    """Digit count of ``max(id)`` as a scalar subquery (one value, no cross join)."""
    return df.select(F.length(F.max(F.col(id_col)).cast("string")).alias("w")).scalar()


def with_filename(meta: DataFrame, id_col: str = "id", width: int | Column | None = None,
                  out: str = "filename") -> DataFrame:
    """Keep ``filename`` when present, else build it from ``id``, else fail.

    Width defaults to the digits of the largest id (``str.zfill`` semantics,
    never truncating).  A fixed ``width`` reproduces the fixed-width variant.
    """
    if out in meta.columns:
        return meta
    if id_col not in meta.columns:
        raise KeyError(f"metadata must have either a '{out}' or an '{id_col}' column")
    w = width if width is not None else id_width(meta, id_col)
    return meta.withColumn(out, article_filename(F.col(id_col), w))


def unique_by(df: DataFrame, key: str, side: str) -> DataFrame:
    """``df``, which raises when it runs if ``key`` is NULL or repeats (pandas ``validate='one_to_one'``).

    The grouping keeps one row of each key and counts them, so of a key that a third of the rows
    share a task gets one row per input partition.
    """
    rest = [c for c in df.columns if c != key]
    held = df.groupBy(F.col(f"`{key}`").alias("_key")).agg(F.count(F.lit(1)).alias("_rows"), *[F.first(f"`{c}`").alias(c) for c in rest])
    repeats = F.raise_error(F.concat(F.lit(f"{side} side is not unique on '{key}': e.g. "), F.col("_key").cast("string"))).cast("boolean")
    # in the key itself, as the planner drops NULL keys of a joined side before any filter would see them
    kind = df.schema[key].dataType
    known = F.coalesce(F.col("_key"), F.raise_error(F.lit(f"{side} side has NULL join keys in '{key}'")).cast(kind)).alias(key)
    return held.where(F.when(F.col("_rows") > 1, repeats).otherwise(F.lit(True))).select(*[known if c == key else F.col(f"`{c}`") for c in df.columns])


def validated_left_join(left: DataFrame, right: DataFrame, key: str, validate: bool = True) -> DataFrame:
    """One-to-one validated LEFT JOIN on ``key``.

    Shared non-key columns are rejected up front (pandas would suffix them
    and the later reorder would fail).  Keys that are NULL or repeat raise when the result is read.
    """
    shared = (set(left.columns) & set(right.columns)) - {key}
    if shared:
        raise ValidationError(f"columns on both sides besides '{key}': {sorted(shared)}")
    if validate:
        left, right = unique_by(left, key, "left"), unique_by(right, key, "right")
    return left.join(right, key, "left")


def template_order(joined: DataFrame, template_cols: list[str], measure_cols: list[str], key: str) -> DataFrame:
    """F8: template columns first, then the measure columns without the key."""
    return joined.select(*[F.col(f"`{c}`") for c in template_cols],
                         *[F.col(f"`{c}`") for c in measure_cols if c != key])


def fill_numeric(df: DataFrame, value=0) -> DataFrame:
    """fill NULLs of every numeric column (strings stay NULL)."""
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]
    return df.fillna(value, subset=cols) if cols else df


def template_measures(template: DataFrame, measures: DataFrame, key: str = "filename", id_col: str = "id",
                      width: int | None = 3, strip_keys: bool = False, fill: bool = False) -> DataFrame:
    """Template (with a built file-name key) LEFT JOIN measures, reordered.

    ``width=3`` is the fixed-width variant; ``width=None`` uses the digits of
    the largest id.  ``strip_keys`` strips both keys; ``fill`` zero-fills all
    numeric columns after the join (template's included).
    """
    t = template.withColumn(key, article_filename(F.col(id_col), width if width is not None
                                                  else id_width(template, id_col)))
    m = measures
    if strip_keys:
        t = t.withColumn(key, strip_ws(key))
        m = m.withColumn(key, strip_ws(key))
    out = template_order(validated_left_join(t, m, key), t.columns, m.columns, key)
    return fill_numeric(out) if fill else out


def first_int(c) -> Column:
    """First run of digits as bigint; a value without digits raises (ANSI cast of '')."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_extract(c, r"(\d+)", 1).cast("bigint")


def measures_with_id(measures: DataFrame, key: str = "filename", id_col: str = "id") -> DataFrame:
    """X8 + F8 + F10: id parsed from the file name, columns (id, filename, rest); blanks kept."""
    out = measures.withColumn(id_col, first_int(key))
    rest = [c for c in out.columns if c not in (id_col, key)]
    return out.select(id_col, key, *rest)


def combine_text(meta: DataFrame, texts: DataFrame, key: str = "filename", text_col: str = "text") -> DataFrame:
    """Metadata LEFT JOIN texts by file name; text stripped, missing -> ''."""
    t = texts.select(key, strip_ws(text_col).alias(text_col))
    return meta.join(t, key, "left").withColumn(text_col, F.coalesce(F.col(text_col), F.lit("")))
