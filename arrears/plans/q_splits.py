"""Splits, carve, encoding, imputation and their statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from arrears.operators import features as FE
from arrears.operators import splits as S
from arrears.plans.oracle_base import D, with_
from arrears.plans.q_features import FEATURES_SQL, frame as c_frame
from arrears.plans.registry import register
from arrears.sources import cohort as CO

CUT = FE.FIXTURE.cutoff
CCUT = FE.FIXTURE.cohort_cutoff

COHORT_SQL = f"""
cm AS (
  SELECT o_custkey AS ac_key, strftime(o_orderdate, '%Y-%m') AS report_period,
    max(CAST(o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' AND o_totalprice >= {D(400000)} AS INTEGER)) AS default_flag,
    CAST(count(*) AS DOUBLE) AS n_orders,
    avg(o_totalprice) / {D(1000)} AS avg_price, max(o_totalprice) / {D(1000)} AS max_price,
    avg(CAST(o_orderpriority = '1-URGENT' AS DOUBLE)) AS urgent_share,
    avg(CAST(o_orderstatus = 'O' AS DOUBLE)) AS open_share,
    avg(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice END) / {D(1000)} AS urgent_avg_price
  FROM orders GROUP BY 1, 2),
cpanel AS (
  SELECT cm.*, n.n_name AS state,
    CAST(COALESCE(max(default_flag) OVER (PARTITION BY cm.ac_key ORDER BY report_period
         ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING), 0) AS BIGINT) AS target,
    max(report_period) OVER (PARTITION BY cm.ac_key) AS last_p,
    min(report_period) OVER (PARTITION BY cm.ac_key) AS first_period
  FROM cm LEFT JOIN customer c ON cm.ac_key = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey),
cfr AS (SELECT *, CASE WHEN first_period < '{CCUT}' THEN 'train' ELSE 'test' END AS split
        FROM cpanel WHERE report_period < last_p),
ctrain_loans AS (SELECT ac_key, min(report_period) AS first_period FROM cfr WHERE split = 'train' GROUP BY 1),
cval_loans AS (
  SELECT ac_key, first_period FROM (
    SELECT ac_key, first_period,
           row_number() OVER (ORDER BY first_period DESC, ac_key DESC) AS rk,
           greatest(1, CAST(floor(count(*) OVER () * 0.1) AS BIGINT)) AS n_val
    FROM ctrain_loans) WHERE rk <= n_val),
cparts AS (
  SELECT cfr.*, CASE WHEN split = 'test' THEN 'test'
                     WHEN ac_key IN (SELECT ac_key FROM cval_loans) THEN 'val' ELSE 'train' END AS part
  FROM cfr)"""


def cohort_parts(spark, sf_dir):
    """The cohort frame with ``part``: train, val or test."""
    fr = S.cohort_split(CO.cohort_feature_frame(spark, sf_dir), "ac_key", "report_period", CCUT)
    cut = S.validation_cut(fr.where(F.col("split") == "train"), "ac_key", "report_period", 0.10)
    return fr.withColumn("part", F.when(F.col("split") == "test", F.lit("test"))
                         .when(S.in_validation(F.col("first_period"), "ac_key", cut), F.lit("val")).otherwise(F.lit("train")))


def c_labelled(spark, sf_dir):
    """Uncensored rows of the 70-feature matrix with the row-level split."""
    df = c_frame(spark, sf_dir).where(F.col("label_6m").isNotNull())
    return S.temporal_split(df, "period", CUT)


CSPLIT_SQL = FEATURES_SQL + f""",
csplit AS (SELECT *, CASE WHEN period < '{CUT}' THEN 'train' ELSE 'test' END AS split
           FROM cfeat WHERE label_6m IS NOT NULL)"""


@register("temporal_split", sql=with_(CSPLIT_SQL) + """
SELECT asset_number, period, split FROM csplit""")
def temporal_split(spark, sf_dir):
    return c_labelled(spark, sf_dir).select("asset_number", "period", "split")


STATS_SQL = """
SELECT 'row' AS scheme, split, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT asset_number) AS BIGINT) AS n_loans,
       min(period) AS first_period, max(period) AS last_period, avg(label_6m) AS positive_rate
FROM csplit GROUP BY split
UNION ALL
SELECT 'cohort', split, CAST(count(*) AS BIGINT), CAST(count(DISTINCT ac_key) AS BIGINT),
       min(report_period), max(report_period), avg(target)
FROM cfr GROUP BY split"""


@register("split_stats", dbl=["positive_rate"], sql=with_(CSPLIT_SQL + "," + COHORT_SQL) + STATS_SQL)
def split_stats(spark, sf_dir):
    row = S.split_stats(c_labelled(spark, sf_dir), "asset_number", "period", "label_6m") \
        .withColumn("scheme", F.lit("row"))
    fr = S.cohort_split(CO.cohort_feature_frame(spark, sf_dir), "ac_key", "report_period", CCUT)
    coh = S.split_stats(fr, "ac_key", "report_period", "target").withColumn("scheme", F.lit("cohort"))
    return row.unionByName(coh)


@register("split_warnings", dbl=["train_share_pct", "train_rate", "test_rate"], sql=with_(CSPLIT_SQL + "," + COHORT_SQL) + f"""
, st AS ({STATS_SQL}),
two AS (SELECT tr.scheme, tr.n_loans / (tr.n_loans + te.n_loans) * 100.0 AS share, tr.positive_rate AS train_rate, te.positive_rate AS test_rate
        FROM st tr JOIN st te ON tr.scheme = te.scheme AND tr.split = 'train' AND te.split = 'test')
SELECT scheme, CAST(share AS DOUBLE) AS train_share_pct, train_rate, test_rate, abs(train_rate - test_rate) > {D(0.05)} AS large_shift,
       share < {D(70)} OR share > {D(90)} AS share_outside
FROM two""")
def split_warnings(spark, sf_dir):
    return S.split_warnings(split_stats(spark, sf_dir))


@register("split_overlap", sql=with_(CSPLIT_SQL + "," + COHORT_SQL) + """
SELECT (SELECT CAST(count(*) AS BIGINT) FROM (SELECT asset_number FROM csplit WHERE split = 'train'
        INTERSECT SELECT asset_number FROM csplit WHERE split = 'test')) AS row_split_loans_in_both,
       (SELECT CAST(count(*) AS BIGINT) FROM (SELECT ac_key FROM cfr WHERE split = 'train'
        INTERSECT SELECT ac_key FROM cfr WHERE split = 'test')) AS cohort_split_loans_in_both""")
def split_overlap(spark, sf_dir):
    a = S.split_overlap(c_labelled(spark, sf_dir), "asset_number").withColumnRenamed(
        "loans_in_both", "row_split_loans_in_both")
    fr = S.cohort_split(CO.cohort_feature_frame(spark, sf_dir), "ac_key", "report_period", CCUT)
    b = S.split_overlap(fr, "ac_key").withColumnRenamed("loans_in_both", "cohort_split_loans_in_both")
    from arrears.operators.reports import one_row_join
    return one_row_join(a, b)


@register("cohort_split", sql=with_(COHORT_SQL) + """
SELECT ac_key, report_period, first_period, split FROM cfr""")
def cohort_split(spark, sf_dir):
    fr = S.cohort_split(CO.cohort_feature_frame(spark, sf_dir), "ac_key", "report_period", CCUT)
    return fr.select("ac_key", "report_period", "first_period", "split")


@register("validation_carve", sql=with_(COHORT_SQL) + """
SELECT ac_key, report_period, part FROM cparts""")
def validation_carve(spark, sf_dir):
    return cohort_parts(spark, sf_dir).select("ac_key", "report_period", "part")


@register("target_encode", dbl=["state_te"], sql=with_(COHORT_SQL) + """
, te AS (SELECT state, avg(target) AS m FROM cparts WHERE part = 'train' AND state IS NOT NULL GROUP BY 1),
g AS (SELECT avg(target) AS gm FROM cparts WHERE part = 'train')
SELECT p.ac_key, p.report_period, p.part, COALESCE(te.m, g.gm) AS state_te
FROM cparts p LEFT JOIN te ON p.state = te.state CROSS JOIN g""")
def target_encode(spark, sf_dir):
    parts = cohort_parts(spark, sf_dir)
    means, glob = S.fit_target_encoding(parts.where(F.col("part") == "train"), "state", "target")
    return S.apply_target_encoding(parts, "state", means, glob, "state_te") \
            .select("ac_key", "report_period", "part", "state_te")


@register("train_medians", dbl=["median"], sql=with_(CSPLIT_SQL) + f"""
SELECT feature, median(value) AS median FROM (
  UNPIVOT (SELECT {', '.join(f'CAST({f} AS DOUBLE) AS {f}' for f in FE.ALL_FEATURES)} FROM csplit WHERE split = 'train')
  ON {', '.join(FE.ALL_FEATURES)} INTO NAME feature VALUE value)
GROUP BY feature""")
def train_medians(spark, sf_dir):
    train = c_labelled(spark, sf_dir).where(F.col("split") == "train")
    return S.train_medians(train, FE.ALL_FEATURES)


_IMP = ["dscr_curr_lag1", "ltv_curr_lag1", "occupancy_lag1", "dscr_roll6m", "ltv_delta3m",
        "dscr_ltv_product", "unrate_lag3", "cpi_yoy_lag3"]


@register("impute_median", dbl=_IMP, sql=with_(CSPLIT_SQL) + f"""
, med AS (SELECT {', '.join(f'median({f}) AS m_{f}' for f in _IMP)} FROM csplit WHERE split = 'train')
SELECT asset_number, period, split, {', '.join(f'COALESCE({f}, m_{f}) AS {f}' for f in _IMP)}
FROM csplit CROSS JOIN med""")
def impute_median(spark, sf_dir):
    df = c_labelled(spark, sf_dir)
    meds = S.collect_medians(S.train_medians(df.where(F.col("split") == "train"), _IMP))
    return S.impute(df, meds).select("asset_number", "period", "split", *_IMP)


@register("class_ratio", dbl=["neg_pos_ratio", "scale_pos_weight"], sql=with_(CSPLIT_SQL) + """
SELECT CAST(sum(CASE WHEN label_6m = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_neg,
       CAST(sum(CASE WHEN label_6m = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_pos,
       sum(CASE WHEN label_6m = 0 THEN 1 ELSE 0 END) / sum(CASE WHEN label_6m = 1 THEN 1 ELSE 0 END) AS neg_pos_ratio,
       sum(CASE WHEN label_6m = 0 THEN 1 ELSE 0 END) / greatest(sum(CASE WHEN label_6m = 1 THEN 1 ELSE 0 END), 1)
         AS scale_pos_weight
FROM csplit WHERE split = 'train'""")
def class_ratio(spark, sf_dir):
    return S.class_ratio(c_labelled(spark, sf_dir).where(F.col("split") == "train"), "label_6m")
