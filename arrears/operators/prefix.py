"""Exact global order statistics without a global sort in one task.

``running_sums`` cuts the distinct order values into ranges, written once with
the number of their range, so that every later job sees the same cut. A window
inside each range and the sums of the ranges before it give the running sums.
Ranges grow in number with the data; if there are too many for one task, their
sums are run up by the same operator, level by level.

``wide_quantiles`` finds exact quantiles of many columns at once. Sketches of
all columns give each a bracket around the wanted rank, a second aggregation
counts exactly what lies below, at and inside the brackets. Both are combined in
each task, so a sketch or a few counts per column move. Brackets that still hold
too many values are narrowed again; only values inside the last ones move.
Sketches decide how much work is left, counts decide the result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arrears.sources.scratch import written

ROWS_PER_RANGE = 500_000        # distinct values that one window sorts (about)
RANGES_AT_ONCE = 65_536         # range sums that one window runs up
INSIDE = 100_000                # values of a bracket that move (about)
ACCURACY = 1000                 # of the sketch: rank error at most 1 / ACCURACY
GRID = 256                      # its quantiles that are asked for


# ---------------------------------------------------------------- running sums
def running_sums(df: DataFrame, order: str, cols: list[str], descending: bool = False,
                 rows_per_range: int = ROWS_PER_RANGE, at_once: int = RANGES_AT_ONCE) -> DataFrame:
    """Add ``cum_<c>``: inclusive running sums of ``cols`` over ``order``.

    ``df`` must hold one row per distinct ``order`` value (collapse first). It
    is the collapsed table, not the raw rows, that is written."""
    base = written(df.sparkSession, df, "collapsed")
    ranges = max(1, math.ceil(base.count() / rows_per_range))
    by = F.col(order).desc() if descending else F.col(order)
    if ranges == 1:
        whole = Window.partitionBy(F.lit(0)).orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
        return base.withColumns({f"cum_{c}": F.sum(c).over(whole) for c in cols})
    no = f"{order}_range"
    cut = written(df.sparkSession, base.repartitionByRange(ranges, order).withColumn(no, F.spark_partition_id()), "ranges")
    tot = [f"_tot_{c}" for c in cols]
    totals = cut.groupBy(no).agg(*[F.sum(c).alias(t) for t, c in zip(tot, cols)])
    if ranges <= at_once:
        at = F.col(no).desc() if descending else F.col(no)
        run = Window.partitionBy(F.lit(0)).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
        up = totals.withColumns({f"cum_{t}": F.sum(t).over(run) for t in tot})
    else:
        up = running_sums(totals, no, tot, descending, at_once, at_once)
    before = up.select(no, *[(F.col(f"cum_{t}") - F.col(t)).alias(f"_off_{c}") for t, c in zip(tot, cols)])
    if ranges <= at_once:
        before = F.broadcast(before)           # at most ``at_once`` rows of a few numbers
    inside = Window.partitionBy(no).orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    local = cut.withColumns({f"cum_{c}": F.sum(c).over(inside) for c in cols}).join(before, no)
    return local.withColumns({f"cum_{c}": F.col(f"cum_{c}") + F.coalesce(f"_off_{c}", F.lit(0)) for c in cols}) \
                .drop(no, *[f"_off_{c}" for c in cols])


# ---------------------------------------------------------------- quantiles
@dataclass
class _Bracket:
    """What is known of one column: values in (lo, hi) have ranks from ``base`` on."""
    ranks: list[int]
    n: int                                   # values inside
    base: int = 0
    lo: float | None = None                  # None: open
    hi: float | None = None
    margin: float = 2.0 / ACCURACY
    found: dict[int, float] = field(default_factory=dict)

    @property
    def open(self) -> list[int]:
        return [r for r in self.ranks if r not in self.found]

    def ends(self, grid: list[float]) -> tuple[float, float]:
        """Points of the grid below and above the open ranks."""
        low, high = (min(self.open) - self.base) / self.n, (max(self.open) + 1 - self.base) / self.n
        return grid[max(0, math.floor((low - self.margin) * GRID))], grid[min(GRID, math.ceil((high + self.margin) * GRID))]

    def narrow(self, a: float, b: float, below: int, at_a: int, between: int, at_b: int) -> None:
        """Counts of inside values around a and b decide where the ranks lie."""
        first, last = self.base + below, self.base + below + at_a + between
        rest = []
        for r in self.open:
            if first <= r < first + at_a:
                self.found[r] = a
            elif a < b and last <= r < last + at_b:
                self.found[r] = b
            else:
                rest.append(r)
        if rest and all(first + at_a <= r < last for r in rest):
            self.lo, self.hi, self.base, self.n = a, b, first + at_a, between
        elif rest:
            self.margin *= 8                 # the sketch was off: look wider


def _values(df: DataFrame, cols: list[str], of: dict[int, _Bracket]) -> DataFrame:
    """(i, x): the values of the columns in ``of`` that lie inside their brackets."""
    def bound(name: str) -> Column:
        return F.lit([getattr(of[i], name) if i in of else None for i in range(len(cols))] if any(getattr(b, name) is not None for b in of.values()) else [None]).cast("array<double>")
    items = F.array(*[F.struct(F.lit(i).alias("i"), F.col(cols[i]).cast("double").alias("x")) for i in of])
    x, lo, hi = F.col("e.x"), F.get(bound("lo"), F.col("e.i")), F.get(bound("hi"), F.col("e.i"))
    ok = x.isNotNull() & ~F.isnan(x) & (lo.isNull() | (x > lo)) & (hi.isNull() | (x < hi))
    return df.select(F.explode(items).alias("e")).where(ok).select("e.i", "e.x")


def _sketch(values: DataFrame) -> dict[int, tuple[int, list[float]]]:
    """Per column (a row each) the number of values and the grid of quantiles."""
    probs = [k / GRID for k in range(GRID + 1)]
    return {r["i"]: (r["n"], r["q"]) for r in values.groupBy("i").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("x", probs, ACCURACY).alias("q")).collect()}


def wide_quantiles(df: DataFrame, cols: list[str], q: float, inside: int = INSIDE) -> dict[str, float | None]:
    """Linear-interpolated quantile (pandas/NumPy 'linear' rule) of each
    column's values; NULL and NaN are no values; None for a column without any."""
    every = {i: _Bracket([], 0) for i in range(len(cols))}
    seen = _sketch(_values(df, cols, every))
    grids = {i: grid for i, (_, grid) in seen.items()}
    total = {i: n for i, (n, _) in seen.items()}
    todo = {i: _Bracket(sorted({math.floor(q * (n - 1)), math.ceil(q * (n - 1))}), n) for i, n in total.items()}
    while wide := {i: b for i, b in todo.items() if b.open and b.n > inside}:
        if not grids:
            grids = {i: grid for i, (_, grid) in _sketch(_values(df, cols, wide)).items()}
        ends = {i: b.ends(grids[i]) for i, b in wide.items()}
        a, b = (F.get(F.lit([ends[i][k] if i in ends else None for i in range(len(cols))]).cast("array<double>"), F.col("i")) for k in (0, 1))
        zone = F.when(F.col("x") < a, 0).when(F.col("x") == a, 1).when(F.col("x") < b, 2).when(F.col("x") == b, 3).otherwise(4)
        counts = dict.fromkeys(((i, z) for i in wide for z in range(5)), 0)
        # five rows a column
        counts.update({(r["i"], r["zone"]): r["n"] for r in _values(df, cols, wide).groupBy("i", zone.alias("zone")).agg(F.count(F.lit(1)).alias("n")).collect()})
        for i, bracket in wide.items():
            bracket.narrow(*ends[i], *(counts[i, z] for z in range(4)))
        grids = {}
    left = {i: b for i, b in todo.items() if b.open}
    if left:
        # equal values are counted before they move
        ties = _values(df, cols, left).groupBy("i", "x").agg(F.count(F.lit(1)).alias("n"))
        run = Window.partitionBy("i").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
        upto = ties.withColumn("upto", F.sum("n").over(run))
        ranks = F.get(F.lit([[r - left[i].base for r in left[i].open] if i in left else [] for i in range(len(cols))]).cast("array<array<bigint>>"), F.col("i"))
        hit = upto.where(F.exists(ranks, lambda r: (F.col("upto") > r) & (F.col("upto") - F.col("n") <= r)))
        for r in hit.collect():                         # two rows a column at most
            b = left[r["i"]]
            for k in b.open:
                if r["upto"] - r["n"] <= k - b.base < r["upto"]:
                    b.found[k] = r["x"]
    out: dict[str, float | None] = dict.fromkeys(cols)
    for i, b in todo.items():
        pos = q * (total[i] - 1)
        lo, hi = b.found[math.floor(pos)], b.found[math.ceil(pos)]
        out[cols[i]] = lo + (hi - lo) * (pos - math.floor(pos))
    return out


def exact_quantile(df: DataFrame, col: str, q: float) -> float | None:
    """The quantile of one column, None without values."""
    return wide_quantiles(df, [col], q)[col]
