"""As-of join: ranges of time with carried rows against a plain search."""

import numpy as np
import pytest

from arrears.operators import macro_join as MJ


@pytest.mark.parametrize("rows_per_range", [10_000, 37, 5])
def test_ranges_carry_the_last_row(spark, rows_per_range):
    rng = np.random.default_rng(8)
    times = rng.integers(0, 500, 300).tolist()
    one = {int(t): float(v) for t, v in zip(rng.choice(500, 40, replace=False), rng.normal(size=40))}
    two = {int(t): (None if i % 3 else float(t)) for i, t in enumerate(rng.choice(np.arange(200, 230), 9, replace=False))}
    left = spark.createDataFrame([(i, t) for i, t in enumerate(times)] + [(999, None)], "id int, t int").repartition(3)
    a = spark.createDataFrame(sorted(one.items()), "t int, a double")
    b = spark.createDataFrame(sorted(two.items()), "t int, b double")
    got = {r.id: (r.a, r.b) for r in MJ.asof_backward_all(left, [(a, ["a"]), (b, ["b"])], "t", rows_per_range=rows_per_range).collect()}

    def last(series, t):
        at = [k for k in series if k <= t]
        return series[max(at)] if at else None

    assert got.pop(999) == (None, None)
    assert got == {i: (last(one, t), last(two, t)) for i, t in enumerate(times)}


def test_a_large_side_is_not_broadcast(spark):
    from arrears.sources.scratch import small_side
    big = spark.range(50)
    plan = spark.range(9).join(small_side(big, "x", most=49), "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" not in plan
    plan = spark.range(9).join(small_side(big, "x", most=50), "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan
