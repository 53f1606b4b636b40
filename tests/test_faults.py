"""Inputs the fixture tables do not hold: text keys, NULL features, small minorities, large doubles."""

import pytest
from pyspark.sql import functions as F

from arrears.operators import features as FE
from arrears.operators import macro_join as MJ
from arrears.operators import sampling as SM
from arrears.operators import splits as S
from arrears.operators import tiers as T
from arrears.plans.registry import fixed_round


def test_validation_carve_on_text_keys(spark):
    rows = [(f"16_10{i:04d}", f"19{90 + i % 3}-01") for i in range(500)]
    got = {r[0] for r in S.validation_loans(spark.createDataFrame(rows, "ac_key string, period string"), "ac_key", "period", 0.1).collect()}
    want = sorted(rows, key=lambda r: (r[1], r[0]), reverse=True)[:50]
    assert got == {r[0] for r in want}


def test_oversampling_refuses_what_it_cannot_fill(spark):
    few = spark.createDataFrame([(i, float(i), 1.0 if i < 4 else 0.0) for i in range(700)], "id long, a double, y double")
    with pytest.raises(ValueError, match="neighbours"):
        SM.oversample(spark, few, ["a"], "y", ["id"], 0.1, 5)
    nulls = spark.createDataFrame([(i, None if i == 3 else float(i), 1.0 if i < 9 else 0.0) for i in range(700)], "id long, a double, y double")
    with pytest.raises(ValueError, match="NULL in minority features: a"):
        SM.oversample(spark, nulls, ["a"], "y", ["id"], 0.1, 5)


def test_rounding_of_large_doubles(spark):
    rows = spark.createDataFrame([(3.6e10,), (-4.7e18,), (1.23456789049,)], "x double").select(fixed_round(F.col("x"), 9).alias("r")).collect()
    assert [r.r for r in rows] == [3.6e10, -4.7e18, 1.23456789]


def test_validation_carve_without_loans_or_months(spark):
    none = spark.createDataFrame([], "ac_key string, period string")
    assert S.mark_validation(none, "ac_key", "period").count() == 0
    odd = spark.createDataFrame([(None, "1990-01"), ("a", None), ("b", "1990-01"), ("c", "1990-02")], "ac_key string, period string")
    got = {r.ac_key: r._is_val for r in S.mark_validation(odd, "ac_key", "period").collect()}
    assert got == {None: False, "a": False, "b": False, "c": True}


def test_macro_series_with_two_rows_a_month_is_refused(spark):
    panel = spark.createDataFrame([(1, "1990-01"), (2, "1990-02"), (3, None)], "k long, ym string")
    once = spark.createDataFrame([("1990-01", 5.0), (None, 6.0), (None, 7.0)], "_ym string, v double")
    assert {r.k: r.v for r in MJ.exact_month_join(panel, once, "ym", "_ym").collect()} == {1: 5.0, 2: None, 3: None}
    with pytest.raises(Exception, match="more than one row for 1990-01"):
        MJ.exact_month_join(panel, once.union(once.where("_ym = '1990-01'")), "ym", "_ym").collect()


def test_too_many_categories_are_refused(spark):
    df = spark.range(12).selectExpr("cast(id as string) AS c")
    assert len(FE.category_list(df, "c", most=12)) == 12
    with pytest.raises(ValueError, match="more than 11 categories"):
        FE.category_list(df, "c", most=11)


def test_tier_tables_of_no_rows(spark):
    none = spark.createDataFrame([], "s double, y double")
    rows = T.tier_distribution(spark, none, "s", "y", ["rgb", "four"]).collect()
    assert len(rows) == 8 and all(r.n == 0 and r.share_pct == 0 and r.actual_rate_pct == 0 for r in rows)
