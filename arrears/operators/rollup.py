"""Property rows to loan-months, and loans to a loan table.

All aggregates here are partial-aggregation friendly (``min_by`` over a
struct order, ``mode``, sums, means). Partial results of a loan-month are much
wider than the table columns they come from, and few rows share one, so the
panel's rows are dealt by loan-month before they are widened
(``panel.property_rows``); a loan that holds a third of the rows is then spread
over its months. Rows dealt in another way are combined map-side first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIRST_COLS = ["loan_uid", "asset_left", "cik", "year", "month", "payment_status",
              "origination_date", "maturity_date", "original_term", "io_term_months", "is_io",
              "payment_type", "state", "zip_code"]
MAX_COLS = ["default_flag"]
MEAN_COLS = ["interest_rate_orig", "interest_rate_curr", "occupancy_orig", "occupancy_current",
             "dscr_orig", "dscr_current"]
SUM_COLS = ["original_balance", "balance_begin", "balance_end", "appraisal_orig",
            "appraisal_current", "noi_orig", "noi_current"]
MODE_COLS = ["property_type"]


def first_non_null(col: str, order: str | Column) -> Column:
    """Value of ``col`` on the earliest row (by ``order``) where it is not NULL."""
    o = F.col(order) if isinstance(order, str) else order
    return F.min_by(F.col(col), F.when(F.col(col).isNotNull(), o))


def ac_key() -> Column:
    return F.concat_ws("_", F.col("asset_left").cast("string"), F.col("cik").cast("string"))


def loan_period_rollup(props: DataFrame, order: str = "row_order") -> DataFrame:
    """One row per (ac_key, report_period); only measures present are used. Rows
    with an ``ac_key`` keep it, so rows already dealt by it do not move again."""
    have = set(props.columns)
    props = props if "ac_key" in have else props.withColumn("ac_key", ac_key())
    aggs = []
    aggs += [first_non_null(c, order).alias(c) for c in FIRST_COLS if c in have]
    aggs += [F.max(c).alias(c) for c in MAX_COLS if c in have]
    aggs += [F.avg(c).alias(c) for c in MEAN_COLS if c in have]
    aggs += [F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in SUM_COLS if c in have]
    aggs += [F.mode(c, True).alias(c) for c in MODE_COLS if c in have]
    return props.groupBy("ac_key", "report_period").agg(*aggs)


def loan_table(props: DataFrame, loan: str = "loan_uid", period: str = "report_period",
               order: str = "row_order", flag: str = "default_flag",
               attrs: list[str] | None = None) -> DataFrame:
    """One row per loan: first non-null attributes by month (ties by row
    order), ever-default, first default month and year."""
    attrs = attrs or ["asset_number", "state", "property_type", "payment_type", "original_balance",
                      "original_term", "io_term_months", "is_io", "origination_date", "maturity_date"]
    o = F.struct(F.col(period), F.col(order))
    is_def = F.col(flag) == 1
    return props.groupBy(loan).agg(
        *[first_non_null(a, o).alias(a) for a in attrs],
        F.coalesce(F.max(flag), F.lit(0)).cast("int").alias("ever_defaulted"),
        F.min(F.when(is_def, F.col(period))).alias("first_default_period"),
        F.min(F.when(is_def, F.col("year"))).alias("first_default_year"),
    )
