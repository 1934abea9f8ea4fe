"""Profiling operators over any table.

All aggregates run as one pass with partial (map-side) aggregation; wide
outputs are turned into long form on the (tiny) aggregate row,
never by collecting data to the driver.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import quote_regex

NUMERIC_PREFIXES = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def _stack_long(row: DataFrame, names: list[str], key: str, value: str) -> DataFrame:
    pairs = [F.struct(F.lit(n).alias(key), F.col("`" + n.replace("`", "``") + "`").alias(value)) for n in names]
    return row.select(F.inline(F.array(*pairs)))


def flag_greater(df: DataFrame, col: str, threshold, out: str) -> DataFrame:
    """boolean ``col > threshold``, false when ``col`` is NULL."""
    return df.withColumn(out, F.coalesce(F.col(col) > F.lit(threshold), F.lit(False)))


def filter_greater(df: DataFrame, col: str, threshold) -> DataFrame:
    """rows with ``col > threshold`` (NULL never passes)."""
    return df.filter(F.col(col) > F.lit(threshold))


def mean_by(df: DataFrame, key: str, col: str, out: str | None = None) -> DataFrame:
    """A5: mean of ``col`` per ``key``; NULL keys are dropped (pandas groupby)."""
    return (df.filter(F.col(key).isNotNull()).groupBy(key)
            .agg(F.avg(col).alias(out or f"mean_{col}")))


def row_count(df: DataFrame) -> DataFrame:
    """Number of rows."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"))


def missing_counts(df: DataFrame) -> DataFrame:
    """NULL count per column, long form (column_name, n_missing), one pass."""
    row = df.agg(*[F.count_if(F.col("`" + c.replace("`", "``") + "`").isNull()).alias(c) for c in df.columns])
    return _stack_long(row, df.columns, "column_name", "n_missing")


def frame_info(df: DataFrame) -> DataFrame:
    """(column_name, ordinal, dtype, non_null) in one pass."""
    row = df.agg(*[F.count(F.col("`" + c.replace("`", "``") + "`")).alias(c) for c in df.columns])
    counts = _stack_long(row, df.columns, "column_name", "non_null")
    meta = df.sparkSession.createDataFrame(
        [(c, i + 1, t) for i, (c, t) in enumerate(df.dtypes)], "column_name string, ordinal int, dtype string")
    # both sides hold one row per column: a tiny, bounded join
    return meta.join(F.broadcast(counts), "column_name")


DESCRIBE_STATS = ("count", "mean", "std", "min", "p25", "p50", "p75", "max")


def _materialize(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back.

    (``checkpoint()`` without a persisted RDD would compute the input twice.)
    """
    from quarry.session import shared_dir
    path = shared_dir(df.sparkSession, "value-counts")
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def exact_percentiles(df: DataFrame, col: str, probs: list[float], by: list[str] | None = None,
                      extra_aggs: list[Column] | None = None) -> DataFrame:
    """Exact linear-interpolated percentiles (pandas ``linear``); NULL and NaN are dropped.

    One plan at every size, and no group or value ever sits in one task:

    * rows are counted per (group, value) with map-side combine, so ties collapse;
    * the counts are range-partitioned by (group, value) - a large group spans many
      ranges - and written to the shared folder with their range's number (this runs a job);
    * range totals per group, a small table, give each range the rows before it; a running
      count inside the range gives each value its ranks;
    * the values that hold the needed ranks, floor(p(n-1)) and the next, are picked.

    ``extra_aggs`` are computed per group over the same rows.
    """
    by = by or []
    keys = by or ["_all"]                      # ungrouped: one constant key
    x = F.col(col).cast("double")
    d = df.select(*by, F.col(col), x.alias("_x")).filter(F.col("_x").isNotNull() & ~F.isnan("_x"))
    if not by:
        d = d.withColumn("_all", F.lit(0))
    stats = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *(extra_aggs or []))
    counts = (d.groupBy(*keys, "_x").agg(F.count(F.lit(1)).alias("_c"))
              .repartitionByRange(*keys, "_x").withColumn("_part", F.spark_partition_id()))
    counts = _materialize(counts)
    totals = counts.groupBy(*keys, "_part").agg(F.sum("_c").alias("_t"))
    before = totals.select(*keys, "_part", (F.sum("_t").over(Window.partitionBy(*keys).orderBy("_part")) - F.col("_t")).alias("_off"))
    running = F.sum("_c").over(Window.partitionBy(*keys, "_part").orderBy("_x"))
    ranked = (counts.withColumn("_cum", running)
              .join(before.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)} | {"_part": "_p"}),
                    [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_part") == F.col("_p")])
              .withColumn("_to", F.col("_off") + F.col("_cum")).withColumn("_from", F.col("_to") - F.col("_c"))
              .select(*keys, "_x", "_from", "_to"))
    sizes = stats.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_n")
    ranked = ranked.join(sizes, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])

    def ranks(p):
        h = F.lit(float(p)) * (F.col("_n") - 1)
        return F.floor(h), F.least(F.floor(h) + 1, F.col("_n") - 1), h

    picks = []
    for t, p in enumerate(probs):
        k0, k1, _ = ranks(p)
        for j, k in enumerate((k0, k1)):
            picks.append(F.max(F.when((F.col("_from") <= k) & (k < F.col("_to")), F.col("_x"))).alias(f"_v{j}_{t}"))
    chosen = ranked.groupBy(*keys).agg(*picks).withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    out = stats.join(chosen, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    cols = []
    for t, p in enumerate(probs):
        k0, _, h = ranks(p)
        v0, v1 = F.col(f"_v0_{t}"), F.col(f"_v1_{t}")
        cols.append((v0 + (h - k0) * (v1 - v0)).alias(f"p{round(p * 100)}"))
    return out.select(*by, *[c for c in stats.columns if c not in keys and c != "_n"], *cols)


def describe(df: DataFrame, col: str, by: list[str] | None = None, exact: bool = True,
             accuracy: int = 10_000) -> DataFrame:
    """Count, mean, sample std, min, 25/50/75 % (linear), max of ``col`` [per ``by``].

    NULL and NaN are dropped, as pandas does.  ``exact=True`` uses
    :func:`exact_percentiles`; ``exact=False`` returns the GK sketch values (rank
    error <= n/accuracy) in one pass.
    """
    x = F.col(col)
    if dict(df.dtypes)[col] in ("float", "double"):
        df = df.withColumn(col, F.nanvl(x, F.lit(None)))
    qs = [0.25, 0.5, 0.75]
    stats = [F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
             F.min(x).cast("double").alias("min"), F.max(x).cast("double").alias("max")]
    if exact:
        agg = exact_percentiles(df, col, qs, by, extra_aggs=stats)
    else:
        g = df.groupBy(*by) if by else df
        agg = g.agg(*stats, F.percentile_approx(x, F.array(*[F.lit(q) for q in qs]), accuracy).alias("_q"))
        agg = agg.withColumns({f"p{int(q * 100)}": F.col("_q")[i].cast("double") for i, q in enumerate(qs)})
    return agg.select(*(by or []), "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def value_counts(df: DataFrame, col: str, top: int | None = None, out: str = "n") -> DataFrame:
    """Counts per value, NULL dropped, descending (ties by value); ``top`` keeps the first n.

    ``orderBy(...).limit(n)`` plans as a top-k per partition plus a merge
    (TakeOrderedAndProject), so only n rows per partition move.
    """
    vc = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias(out))
    vc = vc.orderBy(F.col(out).desc(), F.col(col).asc())
    return vc.limit(top) if top else vc


def mean_and_count(df: DataFrame, key: str, col: str) -> DataFrame | None:
    """A10: mean and non-NULL count of ``col`` per ``key`` (pivot_table), only if both exist."""
    if not {key, col} <= set(df.columns):
        return None
    return (df.filter(F.col(key).isNotNull()).groupBy(key)
            .agg(F.avg(col).alias(f"mean_{col}"), F.count(col).alias(f"count_{col}")))


def preview(df: DataFrame, order_by: list[str] | str, n: int = 5) -> DataFrame:
    """The first ``n`` rows by an explicit key (top-k, not a full sort)."""
    return df.orderBy(order_by).limit(n)


def recent_selection(df: DataFrame, ts_col: str, text_col: str, as_of: dt.date | str, days: int = 7,
                     terms=("Dr", "Prof", "Professor", "Mr", "Ms"), lang_col: str | None = "lang",
                     lang: str = "en", order_tie: str | None = None, pages: int = 5,
                     page_size: int = 100) -> DataFrame:
    """Rows mentioning any term, dated within [as_of - days, as_of], in ``lang``,
    newest first, at most ``pages * page_size``.  The date and language
    filters are plain predicates and reach the Parquet scan."""
    first, last = iso_window(F.lit(as_of).cast("date"), days)
    d = F.to_date(F.col(ts_col))
    cond = (d >= first.cast("date")) & (d <= last.cast("date"))
    if lang_col:
        cond = cond & (F.col(lang_col) == F.lit(lang))
    pattern = r"(?U)\b(?:" + "|".join(map(quote_regex, terms)) + r")\b"
    cond = cond & F.col(text_col).rlike(pattern)
    order = [F.col(ts_col).desc()] + ([F.col(order_tie).asc()] if order_tie else [])
    return df.filter(cond).orderBy(*order).limit(pages * page_size)


def iso_window(as_of: Column, days: int = 7) -> tuple[Column, Column]:
    """(from, to) as ISO date strings for a request window ending at ``as_of``."""
    return (F.date_format(F.date_sub(as_of, days), "yyyy-MM-dd"), F.date_format(as_of, "yyyy-MM-dd"))
