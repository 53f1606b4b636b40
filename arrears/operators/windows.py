"""Per-loan window operators (row based, ordered by month).

Every operator here uses the same ``Window.partitionBy(loan).orderBy(order)``
so Catalyst plans one hash exchange and one sort for all of them.  Groups
are loans of a loan-month panel, i.e. at most one row per month, so a
group is bounded by the length of the observation window whatever the
table size; property-level skew is absorbed earlier by the rollup's
map-side combine.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

LOAN = "asset_number"
ORDER = "period"


def loan_window(loan: str = LOAN, order: str = ORDER) -> WindowSpec:
    return Window.partitionBy(loan).orderBy(order)


def frame(w: WindowSpec, start, end) -> WindowSpec:
    return w.rowsBetween(start, end)


def cumulative(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---------------------------------------------------------------- W1 / W2
def lag(x, w: WindowSpec, k: int = 1) -> Column:
    return F.lag(_c(x), k).over(w)


def lag_fill0(x, w: WindowSpec, k: int = 1) -> Column:
    """Previous row's value, 0 where there is none or it is NULL."""
    return F.coalesce(F.lag(_c(x), k).over(w), F.lit(0))


# ---------------------------------------------------------------- W4 / W5 / W6
def rolling_mean(x, w: WindowSpec, size: int, min_periods: int) -> Column:
    """Mean over the last ``size`` rows once ``min_periods`` of them are non-NULL."""
    f = frame(w, -(size - 1), 0)
    return F.when(F.count(_c(x)).over(f) >= min_periods, F.avg(_c(x)).over(f))


def trend_gap(x, w: WindowSpec, size: int = 3) -> Column:
    """Mean of the last ``size`` rows (any count) minus the current value."""
    return F.avg(_c(x)).over(frame(w, -(size - 1), 0)) - _c(x)


def momentum(x, w: WindowSpec, k: int) -> Column:
    return _c(x) - F.lag(_c(x), k).over(w)


# ---------------------------------------------------------------- W7
def run_length(hit: Column, w: WindowSpec) -> Column:
    """Length of the current run of rows where ``hit`` holds (NULL = not hit).

    Gaps and islands in one pass: the run is the distance to the last row
    where the condition failed, read from a cumulative max of row numbers,
    so no second partitioning is needed."""
    hit = F.coalesce(hit, F.lit(False))
    rn = F.row_number().over(w)
    last_miss = F.max(F.when(~hit, rn)).over(cumulative(w))
    return F.when(hit, rn - F.coalesce(last_miss, F.lit(0))).otherwise(F.lit(0)).cast("double")


def run_below(x, threshold: float, w: WindowSpec) -> Column:
    return run_length(_c(x) < F.lit(threshold), w)


def run_above(x, threshold: float, w: WindowSpec) -> Column:
    return run_length(_c(x) > F.lit(threshold), w)


# ---------------------------------------------------------------- W10 - W13
def running_max(x, w: WindowSpec) -> Column:
    return F.max(_c(x)).over(cumulative(w))


def rolling_sum(x, w: WindowSpec, size: int) -> Column:
    return F.sum(_c(x)).over(frame(w, -(size - 1), 0))


def rows_since_hit(x, w: WindowSpec) -> Column:
    """Rows since the last row where ``x = 1`` (inclusive); 0 if never."""
    rn = F.row_number().over(w)
    last_hit = F.max(F.when(_c(x) == 1, rn)).over(cumulative(w))
    return F.coalesce(rn - last_hit, F.lit(0)).cast("double")


def partition_max(x, loan: str = LOAN) -> Column:
    return F.max(_c(x)).over(Window.partitionBy(loan))


# ---------------------------------------------------------------- W14
def forward_fill(x, w: WindowSpec) -> Column:
    return F.last(_c(x), ignorenulls=True).over(cumulative(w))


def pct_change(x, w: WindowSpec, k: int = 12, scale: float = 100.0) -> Column:
    """Change over ``k`` rows after forward filling, times ``scale``."""
    ff = forward_fill(x, w)
    prev = F.lag(ff, k).over(w)
    return F.try_divide(ff, prev) * F.lit(scale) - F.lit(scale)


# ---------------------------------------------------------------- A18
def gap_months(order_date, w: WindowSpec) -> Column:
    nxt = F.lead(_c(order_date)).over(w)
    return F.round(F.months_between(nxt, _c(order_date)))

