"""Plan shape: the per-loan windows share one exchange; bounded sides are broadcast."""

import re

SMALL = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_windows_share_one_exchange(spark):
    from __spark_entry__ import queries
    plan = _plan(queries()["rolling_mean"](spark, SMALL))
    loan_ex = re.findall(r"Exchange hashpartitioning\(asset_number#\d+L?, \d+\)", plan)
    assert len(loan_ex) == 1, plan


def test_macro_joins_do_not_move_the_panel(spark):
    from __spark_entry__ import queries
    plan = _plan(queries()["asof_macro"](spark, SMALL))
    assert "BroadcastHashJoin" in plan or "BroadcastExchange" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_no_cross_products(spark):
    from __spark_entry__ import queries
    q = queries()
    for name in ("eda_overview", "eda_payment_type", "split_overlap", "tier_distribution", "flagship",
                 "feature_matrix", "threshold_sweep"):
        plan = _plan(q[name](spark, SMALL))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def _scans(df, column):
    return len(re.findall(r"FileScan parquet \[[^\]]*(?:" + column + ")", _plan(df)))


def test_fact_tables_are_not_read_over_and_over(spark):
    from __spark_entry__ import queries
    q = queries()
    assert _scans(q["tier_distribution"](spark, SMALL), "l_orderkey|l_partkey") == 1
    assert _scans(q["validation_carve"](spark, SMALL), "o_custkey") == 1
    # the panel; its times were read once before, for all three series at once, and written
    assert _scans(q["asof_macro"](spark, SMALL), "l_orderkey|l_partkey") == 1


def test_plans_do_not_depend_on_earlier_queries(spark):
    from __spark_entry__ import queries
    q = queries()
    for name in ("pr_curve", "auroc", "validation_carve", "train_medians", "smote_balance"):
        q[name](spark, SMALL).count()
        assert len(spark.sparkContext._jsc.getPersistentRDDs()) == 0, name
    assert _scans(q["tier_distribution"](spark, SMALL), "l_orderkey|l_partkey") == 1


def test_feature_slices_prepare_only_what_they_need(spark):
    """Slices of the matrix write nothing and read the panel once."""
    from __spark_entry__ import queries
    plan = _plan(queries()["stress_flags"](spark, SMALL))
    assert "Scan ExistingRDD" not in plan and len(re.findall(r"FileScan parquet \[[^\]]*(?:l_orderkey|l_partkey)", plan)) == 1


def test_fitted_slices_write_a_narrow_panel(spark):
    """Slices with fitted values read the narrow written panel, never the fact
    table again, and equal the whole matrix's columns."""
    from __spark_entry__ import queries
    q = queries()
    whole = q["feature_matrix"](spark, SMALL)
    for name in ("clip_p99", "interaction_product"):
        got = q[name](spark, SMALL)
        assert _scans(got, "l_orderkey|l_partkey") == 0 and "Scan ExistingRDD" not in _plan(got), name
        assert "orig_amount" not in _plan(got), name
        keys, cols = got.columns[:2], got.columns[2:]
        have = [c for c in cols if c in whole.columns]
        assert have
        want = {(r[0], r[1]): tuple(r[2:]) for r in whole.select(*keys, *have).collect()}
        rows = got.select(*keys, *have).collect()
        assert len(rows) == len(want) and all(want[r[0], r[1]] == tuple(r[2:]) for r in rows), name
