"""Window operators and labels on the wide loan-month panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from arrears.functions import columns as C
from arrears.operators import labels as L
from arrears.operators import windows as W
from arrears.plans.oracle_base import LOAN_MONTH_PANEL, with_
from arrears.plans.registry import register
from arrears.sources import panel as P

KEYS = ["asset_number", "period"]
WIN = "WINDOW w AS (PARTITION BY asset_number ORDER BY period)"


def panel(spark, sf_dir):
    return P.loan_month_panel(spark, sf_dir)


def lagged_panel(spark, sf_dir):
    """Panel plus one-month lags of the three time-varying measures."""
    w = W.loan_window()
    return panel(spark, sf_dir).withColumns({
        "ltv_curr_lag1": W.lag("ltv_curr", w),
        "dscr_curr_lag1": W.lag("dscr_curr", w),
        "occupancy_lag1": W.lag("occ_curr", w),
    })


LAGGED_SQL = LOAN_MONTH_PANEL + f""",
lagged AS (
  SELECT *, lag(ltv_curr) OVER w AS ltv_curr_lag1, lag(dscr_curr) OVER w AS dscr_curr_lag1,
         lag(occ_curr) OVER w AS occupancy_lag1
  FROM panel {WIN}
)"""


@register("lag1", dbl=["ltv_curr_lag1", "dscr_curr_lag1", "occupancy_lag1"], sql=with_(LAGGED_SQL) + """
SELECT asset_number, period, ltv_curr_lag1, dscr_curr_lag1, occupancy_lag1,
       CAST(COALESCE(lag(default_flag) OVER (PARTITION BY asset_number ORDER BY period), 0) AS BIGINT) AS default_flag_lag1
FROM lagged""")
def lag1(spark, sf_dir):
    w = W.loan_window()
    return lagged_panel(spark, sf_dir).select(
        *KEYS, "ltv_curr_lag1", "dscr_curr_lag1", "occupancy_lag1",
        W.lag_fill0("default_flag", w).alias("default_flag_lag1"))


ROLL = ["dscr_roll3m", "dscr_roll6m", "ltv_roll3m", "ltv_roll6m", "occ_roll3m"]


@register("rolling_mean", dbl=ROLL, sql=with_(LAGGED_SQL) + f"""
SELECT asset_number, period,
  CASE WHEN count(dscr_curr_lag1) OVER r3 >= 2 THEN avg(dscr_curr_lag1) OVER r3 END AS dscr_roll3m,
  CASE WHEN count(dscr_curr_lag1) OVER r6 >= 3 THEN avg(dscr_curr_lag1) OVER r6 END AS dscr_roll6m,
  CASE WHEN count(ltv_curr_lag1) OVER r3 >= 2 THEN avg(ltv_curr_lag1) OVER r3 END AS ltv_roll3m,
  CASE WHEN count(ltv_curr_lag1) OVER r6 >= 3 THEN avg(ltv_curr_lag1) OVER r6 END AS ltv_roll6m,
  CASE WHEN count(occupancy_lag1) OVER r3 >= 2 THEN avg(occupancy_lag1) OVER r3 END AS occ_roll3m
FROM lagged
WINDOW r3 AS (PARTITION BY asset_number ORDER BY period ROWS BETWEEN 2 PRECEDING AND CURRENT ROW),
       r6 AS (PARTITION BY asset_number ORDER BY period ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)""")
def rolling_mean(spark, sf_dir):
    w = W.loan_window()
    return lagged_panel(spark, sf_dir).select(
        *KEYS,
        W.rolling_mean("dscr_curr_lag1", w, 3, 2).alias("dscr_roll3m"),
        W.rolling_mean("dscr_curr_lag1", w, 6, 3).alias("dscr_roll6m"),
        W.rolling_mean("ltv_curr_lag1", w, 3, 2).alias("ltv_roll3m"),
        W.rolling_mean("ltv_curr_lag1", w, 6, 3).alias("ltv_roll6m"),
        W.rolling_mean("occupancy_lag1", w, 3, 2).alias("occ_roll3m"))


MOM = ["dscr_delta3m", "dscr_delta6m", "ltv_delta3m", "ltv_delta6m", "occ_delta3m"]


@register("momentum", dbl=MOM, sql=with_(LAGGED_SQL) + f"""
SELECT asset_number, period,
  dscr_curr_lag1 - lag(dscr_curr_lag1, 3) OVER w AS dscr_delta3m,
  dscr_curr_lag1 - lag(dscr_curr_lag1, 6) OVER w AS dscr_delta6m,
  ltv_curr_lag1 - lag(ltv_curr_lag1, 3) OVER w AS ltv_delta3m,
  ltv_curr_lag1 - lag(ltv_curr_lag1, 6) OVER w AS ltv_delta6m,
  occupancy_lag1 - lag(occupancy_lag1, 3) OVER w AS occ_delta3m
FROM lagged {WIN}""")
def momentum(spark, sf_dir):
    w = W.loan_window()
    return lagged_panel(spark, sf_dir).select(
        *KEYS,
        W.momentum("dscr_curr_lag1", w, 3).alias("dscr_delta3m"),
        W.momentum("dscr_curr_lag1", w, 6).alias("dscr_delta6m"),
        W.momentum("ltv_curr_lag1", w, 3).alias("ltv_delta3m"),
        W.momentum("ltv_curr_lag1", w, 6).alias("ltv_delta6m"),
        W.momentum("occupancy_lag1", w, 3).alias("occ_delta3m"))


RUNS = ["dscr_consec_below1", "dscr_consec_below125", "ltv_consec_above90", "ltv_consec_above100"]


def _run_sql(col: str, cond: str, name: str) -> str:
    # Islands: a new island starts at every row where the condition fails.
    return f"""
{name}_h AS (
  SELECT asset_number, period, COALESCE({cond}, false) AS hit,
         sum(CASE WHEN COALESCE({cond}, false) THEN 0 ELSE 1 END) OVER
           (PARTITION BY asset_number ORDER BY period ROWS UNBOUNDED PRECEDING) AS isl
  FROM lagged),
{name}_r AS (
  SELECT asset_number, period,
         CAST(CASE WHEN hit THEN sum(CAST(hit AS INTEGER)) OVER
           (PARTITION BY asset_number, isl ORDER BY period ROWS UNBOUNDED PRECEDING) ELSE 0 END AS DOUBLE) AS {name}
  FROM {name}_h)"""


RUN_SQL = with_(LAGGED_SQL + "," + ",".join([
    _run_sql("dscr_curr_lag1", "dscr_curr_lag1 < 1.0", "dscr_consec_below1"),
    _run_sql("dscr_curr_lag1", "dscr_curr_lag1 < 1.25", "dscr_consec_below125"),
    _run_sql("ltv_curr_lag1", "ltv_curr_lag1 > 0.90", "ltv_consec_above90"),
    _run_sql("ltv_curr_lag1", "ltv_curr_lag1 > 1.00", "ltv_consec_above100"),
])) + """
SELECT a.asset_number, a.period, a.dscr_consec_below1, b.dscr_consec_below125,
       c.ltv_consec_above90, d.ltv_consec_above100
FROM dscr_consec_below1_r a
JOIN dscr_consec_below125_r b USING (asset_number, period)
JOIN ltv_consec_above90_r c USING (asset_number, period)
JOIN ltv_consec_above100_r d USING (asset_number, period)"""


def run_features(df, w):
    return {
        "dscr_consec_below1": W.run_below("dscr_curr_lag1", 1.00, w),
        "dscr_consec_below125": W.run_below("dscr_curr_lag1", 1.25, w),
        "ltv_consec_above90": W.run_above("ltv_curr_lag1", 0.90, w),
        "ltv_consec_above100": W.run_above("ltv_curr_lag1", 1.00, w),
    }


@register("run_length", dbl=RUNS, sql=RUN_SQL)
def run_length(spark, sf_dir):
    w = W.loan_window()
    df = lagged_panel(spark, sf_dir)
    return df.withColumns(run_features(df, w)).select(*KEYS, *RUNS)


LABEL_SQL = LOAN_MONTH_PANEL + """,
labelled AS (
  SELECT *,
    CASE WHEN count(*) OVER f6 >= 6 THEN CAST(max(default_flag) OVER f6 AS DOUBLE) END AS label_6m,
    CAST(COALESCE(max(default_flag) OVER f6, 0) AS BIGINT) AS target,
    CAST(max(default_flag) OVER (PARTITION BY asset_number) AS DOUBLE) AS label_ever
  FROM panel
  WINDOW f6 AS (PARTITION BY asset_number ORDER BY period ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING)
)"""


def labelled_panel(spark, sf_dir):
    return L.add_labels(panel(spark, sf_dir)).withColumn("target", L.forward_label_lenient())


@register("label_fwd_strict", dbl=["label_6m"], sql=with_(LABEL_SQL) + """
SELECT asset_number, period, CAST(default_flag AS BIGINT) AS default_flag, label_6m FROM labelled""")
def label_fwd_strict(spark, sf_dir):
    return labelled_panel(spark, sf_dir).select(*KEYS, "default_flag", "label_6m")


@register("label_fwd_lenient", sql=with_(LABEL_SQL) + """
SELECT asset_number, period, target FROM labelled""")
def label_fwd_lenient(spark, sf_dir):
    return labelled_panel(spark, sf_dir).select(*KEYS, "target")


@register("label_ever", dbl=["label_ever"], sql=with_(LABEL_SQL) + """
SELECT asset_number, period, label_ever FROM labelled""")
def label_ever(spark, sf_dir):
    return labelled_panel(spark, sf_dir).select(*KEYS, "label_ever")


@register("uncensored_rows", dbl=["label_6m"], sql=with_(LABEL_SQL) + """
SELECT asset_number, period, label_6m FROM labelled WHERE label_6m IS NOT NULL""")
def uncensored_rows(spark, sf_dir):
    return L.uncensored(labelled_panel(spark, sf_dir)).select(*KEYS, "label_6m")


@register("drop_last_obs", sql=with_(LABEL_SQL) + """
SELECT asset_number, period, target FROM (
  SELECT *, max(period) OVER (PARTITION BY asset_number) AS last_p FROM labelled) WHERE period < last_p""")
def drop_last_obs(spark, sf_dir):
    return L.drop_last_observation(labelled_panel(spark, sf_dir), "asset_number", "period") \
            .select(*KEYS, "target")


@register("early_flag_count", sql=with_(LABEL_SQL) + """
SELECT CAST(count(*) AS BIGINT) AS n_early FROM labelled WHERE default_flag = 0 AND label_6m = 1""")
def early_flag_count(spark, sf_dir):
    return L.early_flag_rows(labelled_panel(spark, sf_dir)).agg(F.count(F.lit(1)).alias("n_early"))


@register("label_stats", dbl=["coverage", "positive_rate", "ever_rate", "row_default_rate"],
          sql=with_(LABEL_SQL) + """
SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(label_6m) AS BIGINT) AS n_labelled,
       count(label_6m) / count(*) AS coverage, avg(label_6m) AS positive_rate,
       avg(label_ever) AS ever_rate, avg(default_flag) AS row_default_rate
FROM labelled""")
def label_stats(spark, sf_dir):
    return labelled_panel(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("label_6m").alias("n_labelled"),
        (F.count("label_6m") / F.count(F.lit(1))).alias("coverage"),
        F.avg("label_6m").alias("positive_rate"), F.avg("label_ever").alias("ever_rate"),
        F.avg("default_flag").alias("row_default_rate"))


PRIOR_SQL = LOAN_MONTH_PANEL + f""",
prior AS (
  SELECT *, COALESCE(lag(default_flag) OVER w, 0) AS def_lag1,
         row_number() OVER w AS rn
  FROM panel {WIN}
)"""


@register("prior_default_ever", sql=with_(PRIOR_SQL) + """
SELECT asset_number, period,
  CAST(max(def_lag1) OVER (PARTITION BY asset_number ORDER BY period ROWS UNBOUNDED PRECEDING) AS BIGINT) AS prior_default_ever
FROM prior""")
def prior_default_ever(spark, sf_dir):
    w = W.loan_window()
    df = panel(spark, sf_dir).withColumn("def_lag1", W.lag_fill0("default_flag", w))
    return df.select(*KEYS, W.running_max("def_lag1", w).alias("prior_default_ever"))


@register("defaults_12m", sql=with_(PRIOR_SQL) + """
SELECT asset_number, period,
  CAST(sum(def_lag1) OVER (PARTITION BY asset_number ORDER BY period ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS BIGINT) AS n_def_12m
FROM prior""")
def defaults_12m(spark, sf_dir):
    w = W.loan_window()
    df = panel(spark, sf_dir).withColumn("def_lag1", W.lag_fill0("default_flag", w))
    return df.select(*KEYS, W.rolling_sum("def_lag1", w, 12).alias("n_def_12m"))


@register("months_since_default", dbl=["months_since_def"], sql=with_(PRIOR_SQL) + """
SELECT asset_number, period,
  CAST(COALESCE(rn - max(CASE WHEN def_lag1 = 1 THEN rn END)
        OVER (PARTITION BY asset_number ORDER BY period ROWS UNBOUNDED PRECEDING), 0) AS DOUBLE) AS months_since_def
FROM prior""")
def months_since_default(spark, sf_dir):
    w = W.loan_window()
    df = panel(spark, sf_dir).withColumn("def_lag1", W.lag_fill0("default_flag", w))
    return df.select(*KEYS, W.rows_since_hit("def_lag1", w).alias("months_since_def"))


@register("trend_gap", dbl=["dscr_lag1", "dscr_3m_chg", "ltv_lag1", "ltv_3m_chg"],
          sql=with_(LOAN_MONTH_PANEL) + f"""
, feat AS (
  SELECT *, lag(COALESCE(dscr_curr, dscr_orig)) OVER w AS dscr_lag1,
            lag(COALESCE(ltv_curr, ltv_orig)) OVER w AS ltv_lag1
  FROM panel {WIN})
SELECT asset_number, period, dscr_lag1, ltv_lag1,
  avg(dscr_lag1) OVER r3 - dscr_lag1 AS dscr_3m_chg,
  avg(ltv_lag1) OVER r3 - ltv_lag1 AS ltv_3m_chg
FROM feat WINDOW r3 AS (PARTITION BY asset_number ORDER BY period ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def trend_gap(spark, sf_dir):
    w = W.loan_window()
    df = panel(spark, sf_dir).withColumns({
        "dscr_lag1": W.lag(F.coalesce(F.col("dscr_curr"), F.col("dscr_orig")), w),
        "ltv_lag1": W.lag(F.coalesce(F.col("ltv_curr"), F.col("ltv_orig")), w),
    })
    return df.select(*KEYS, "dscr_lag1", "ltv_lag1",
                     W.trend_gap("dscr_lag1", w).alias("dscr_3m_chg"),
                     W.trend_gap("ltv_lag1", w).alias("ltv_3m_chg"))


@register("gap_diagnostic", dbl=["pct_gapped"], sql=with_(LOAN_MONTH_PANEL) + f"""
, g AS (
  SELECT asset_number,
         round(datediff('month', period_dt, lead(period_dt) OVER w)) AS gap
  FROM panel {WIN})
SELECT CAST(count(DISTINCT CASE WHEN gap > 1 THEN asset_number END) AS BIGINT) AS gapped_loans,
       CAST(count(DISTINCT asset_number) AS BIGINT) AS total_loans,
       100.0 * count(DISTINCT CASE WHEN gap > 1 THEN asset_number END) / count(DISTINCT asset_number) AS pct_gapped
FROM g""")
def gap_diagnostic(spark, sf_dir):
    w = W.loan_window()
    df = panel(spark, sf_dir).withColumn("gap", W.gap_months("period_dt", w))
    gapped = F.when(F.col("gap") > 1, F.col("asset_number"))
    return df.agg(F.countDistinct(gapped).alias("gapped_loans"),
                  F.countDistinct("asset_number").alias("total_loans")) \
             .withColumn("pct_gapped", F.col("gapped_loans") * 100.0 / F.col("total_loans"))
