"""Properties from the test strategy: row counts kept, labels stay inside a loan,
cohort split disjoint, one row per key where a key is promised."""

from pyspark.sql import functions as F

from arrears.operators import labels as L
from arrears.sources import panel as P

SMALL = "/root/testdata/sf0.001"


def test_row_counts_preserved(spark):
    from __spark_entry__ import queries
    q = queries()
    n = P.loan_month_panel(spark, SMALL).count()
    for name in ("lag1", "run_length", "label_fwd_strict", "asof_macro", "state_macro_fallback",
                 "feature_matrix"):
        df = q[name](spark, SMALL)
        assert df.count() == n, name
        assert df.select("asset_number", "period").distinct().count() == n, name


def test_labels_do_not_cross_loans(spark):
    panel = P.loan_month_panel(spark, SMALL).select("asset_number", "period", "default_flag")
    a = L.add_labels(panel)
    # relabel loans: the label of a loan must not change when other loans change
    b = L.add_labels(panel.withColumn("default_flag", F.when(F.col("asset_number") % 2 == 0, F.lit(1))
                                      .otherwise(F.col("default_flag"))))
    odd_a = a.where(F.col("asset_number") % 2 == 1).select("asset_number", "period", "label_6m")
    odd_b = b.where(F.col("asset_number") % 2 == 1).select("asset_number", "period", "label_6m")
    assert odd_a.exceptAll(odd_b).count() == 0 and odd_b.exceptAll(odd_a).count() == 0


def test_cohort_split_disjoint_and_carve(spark):
    from __spark_entry__ import queries
    q = queries()
    ov = q["split_overlap"](spark, SMALL).first()
    assert ov["cohort_split_loans_in_both"] == 0
    parts = q["validation_carve"](spark, SMALL)
    per_loan = parts.groupBy("ac_key").agg(F.countDistinct("part").alias("k"))
    assert per_loan.where("k > 1").count() == 0
