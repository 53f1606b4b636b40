"""Joining lagged macro series onto the loan panel.

Macro series hold one row per calendar month (or month x state). They are
written, counted, and broadcast if they are as small as that, so that the loan
panel does not move for these joins; a larger side is left to the planner. The
as-of join is resolved on the distinct times of the panel first and then applied
as an equi-join.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arrears.sources.scratch import BROADCAST_ROWS, small_side, written

MACRO_LAG = 3


def shift_months(series: DataFrame, date_col: str, months: int) -> DataFrame:
    """Move a series forward so a row dated T carries the value of T - months."""
    return series.withColumn(date_col, F.add_months(F.col(date_col), months))


def asof_backward(left: DataFrame, right: DataFrame, on: str, values: list[str]) -> DataFrame:
    """Left join each row of ``left`` to the last row of ``right`` whose
    ``on`` is at or before its own, even when that row's values are NULL."""
    return asof_backward_all(left, [(right, values)], on)


def asof_backward_all(left: DataFrame, series: list[tuple[DataFrame, list[str]]], on: str,
                      rows_per_range: int = BROADCAST_ROWS) -> DataFrame:
    """``asof_backward`` for several (series, value columns) at once.

    Resolution runs on the distinct ``on`` values of ``left`` unioned with all
    series, ordered by (time, side) so that equal times match. These rows are cut
    into ranges of time; the last row of each series in a range is carried over
    its edge to the ranges after it. The one resolved table joins back onto
    ``left``, which is read once for its times and once for the join, however
    many series."""
    types = [payload_type(df, values) for df, values in series]

    def side(df: DataFrame, k: int | None) -> DataFrame:
        payloads = [F.struct(*values) if i == k else F.lit(None).cast(types[i]) for i, (_, values) in enumerate(series)]
        return df.select(on, F.lit(int(k is None)).alias("_side"), *[p.alias(f"_m{i}") for i, p in enumerate(payloads)])

    u = side(left.select(on).distinct(), None)
    for i, (df, _) in enumerate(series):
        u = u.unionByName(side(df, i))
    u = written(left.sparkSession, u, "asof")
    n = u.count()
    marks = [f"_m{i}" for i in range(len(series))]
    ranges = max(1, math.ceil(n / rows_per_range))
    if ranges == 1:
        w = Window.partitionBy(F.lit(0)).orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, 0)
        hits = u.select(on, "_side", *[F.last(m, ignorenulls=True).over(w).alias(m) for m in marks])
    else:
        cut = written(left.sparkSession, u.repartitionByRange(ranges, on).withColumn("_range", F.spark_partition_id()), "asof-ranges")
        at = F.struct(on, "_side")
        ends = cut.groupBy("_range").agg(*[F.max_by(m, F.when(F.col(m).isNotNull(), at)).alias(m) for m in marks])
        before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)     # one row per range
        carried = small_side(ends.select("_range", *[F.last(m, ignorenulls=True).over(before).alias(f"{m}_before") for m in marks]), "asof-carried")
        w = Window.partitionBy("_range").orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, 0)
        local = cut.select("_range", on, "_side", *[F.last(m, ignorenulls=True).over(w).alias(m) for m in marks])
        hits = local.join(carried, "_range", "left").select(on, "_side", *[F.coalesce(m, f"{m}_before").alias(m) for m in marks])
    resolved = hits.where(F.col("_side") == 1).select(
        on, *[F.col(f"_m{i}.{v}").alias(v) for i, (_, values) in enumerate(series) for v in values])
    return left.join(F.broadcast(resolved) if n <= BROADCAST_ROWS else resolved, on, "left")


def one_row_per_key(series: DataFrame, keys: list[str]) -> DataFrame:
    """``series`` without rows of NULL keys (they match nothing); the job fails
    on a key that stands twice, which would multiply the panel's rows."""
    n = F.count(F.lit(1))
    twice = F.raise_error(F.concat_ws(" ", F.lit("macro series: more than one row for"), *[F.col(k).cast("string") for k in keys]))
    values = [c for c in series.columns if c not in keys]
    kept = series.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    return kept.groupBy(*keys).agg(*[F.when(n == 1, F.first(v)).otherwise(twice).alias(v) for v in values])


def payload_type(df: DataFrame, values: list[str]) -> str:
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return "struct<" + ",".join(f"{v}:{fields[v]}" for v in values) + ">"


def exact_month_join(left: DataFrame, macro: DataFrame, left_key: str, macro_key: str,
                     extra_keys: list[tuple[str, str]] | None = None) -> DataFrame:
    """Left equi-join on month (and more keys); months missing stay NULL.
    The macro side has one row per key (checked in the plan)."""
    macro = small_side(one_row_per_key(macro, [macro_key] + [mk for _, mk in extra_keys or []]), "macro")
    cond = left[left_key] == macro[macro_key]
    for lk, mk in extra_keys or []:
        cond = cond & (left[lk] == macro[mk])
    drop = [macro[macro_key]] + [macro[mk] for _, mk in extra_keys or []]
    out = left.join(macro, cond, "left")
    for d in drop:
        out = out.drop(d)
    return out


def state_with_fallback(panel: DataFrame, state_series: DataFrame, on: str, state_col: str,
                        series_state: str, value: str, fallback: str) -> DataFrame:
    """State value for (month, state), or the national value where absent.
    The series has one row per (month, state) (checked in the plan)."""
    s = small_side(one_row_per_key(state_series.withColumnRenamed(on, "_on").withColumnRenamed(value, "_v"), ["_on", series_state]), "state-macro")
    j = panel.join(s, (panel[on] == s["_on"]) & (panel[state_col] == s[series_state]), "left")
    return j.withColumn(value, F.coalesce(F.col("_v"), F.col(fallback))) \
            .drop("_on", "_v", s[series_state])


def coverage(df: DataFrame, cols: list[str]) -> DataFrame:
    """Percent of rows with a non-NULL value, per column."""
    return df.agg(*[(F.avg(F.col(c).isNotNull().cast("double")) * 100.0).alias(f"{c}_pct") for c in cols])
