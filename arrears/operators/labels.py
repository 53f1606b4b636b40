"""Forward default labels and the filters that go with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arrears.operators.windows import LOAN, ORDER, frame, loan_window, partition_max

HORIZON = 6


def forward_label_strict(flag: str = "default_flag", horizon: int = HORIZON,
                         loan: str = LOAN, order: str = ORDER) -> Column:
    """1 if any of the next ``horizon`` rows defaults, 0 if none does,
    NULL when fewer than ``horizon`` later rows exist (censored)."""
    f = frame(loan_window(loan, order), 1, horizon)
    return F.when(F.count(F.lit(1)).over(f) >= horizon,
                  F.max(F.col(flag)).over(f)).cast("double")


def month_index(period: str = ORDER) -> Column:
    """'yyyy-MM' to a running month number (year * 12 + month)."""
    p = F.col(period)
    return F.substring(p, 1, 4).cast("int") * 12 + F.substring(p, 6, 2).cast("int")


def forward_label_calendar(flag: str = "default_flag", horizon: int = HORIZON,
                           loan: str = LOAN, order: str = ORDER) -> Column:
    """Calendar form of the strict label: any default in the next ``horizon``
    calendar months (gaps count as months without a report); NULL when the
    loan is not observed through month t + horizon."""
    idx = month_index(order)
    w = Window.partitionBy(loan).orderBy(idx)
    ahead = F.max(F.col(flag)).over(w.rangeBetween(1, horizon))
    last = F.max(idx).over(Window.partitionBy(loan))
    return F.when(last >= idx + horizon, F.coalesce(ahead, F.lit(0))).cast("double")


def forward_label_lenient(flag: str = "default_flag", horizon: int = HORIZON,
                          loan: str = LOAN, order: str = ORDER) -> Column:
    """Like the strict label but a short future counts as no default."""
    f = frame(loan_window(loan, order), 1, horizon)
    return F.coalesce(F.max(F.col(flag)).over(f), F.lit(0)).cast("int")


def label_ever(flag: str = "default_flag", loan: str = LOAN) -> Column:
    return partition_max(flag, loan).cast("double")


def add_labels(panel: DataFrame, flag: str = "default_flag", loan: str = LOAN,
               order: str = ORDER) -> DataFrame:
    return panel.withColumns({
        "label_6m": forward_label_strict(flag, HORIZON, loan, order),
        "label_ever": label_ever(flag, loan),
    })


def uncensored(df: DataFrame, label: str = "label_6m") -> DataFrame:
    return df.where(F.col(label).isNotNull())


def drop_last_observation(df: DataFrame, loan: str, order: str) -> DataFrame:
    """Remove each loan's last month (single-month loans vanish)."""
    last = F.max(F.col(order)).over(Window.partitionBy(loan))
    return df.withColumn("_last", last).where(F.col(order) < F.col("_last")).drop("_last")


def early_flag_rows(df: DataFrame, flag: str = "default_flag", label: str = "label_6m") -> DataFrame:
    """Rows performing now but labelled as defaulting ahead."""
    return df.where((F.col(flag) == 0) & (F.col(label) == 1))
