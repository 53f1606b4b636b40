"""70-feature loan-month matrix and its scalar parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from arrears.functions import columns as C
from arrears.operators import features as FE
from arrears.operators.prefix import exact_quantile, wide_quantiles
from arrears.plans.oracle_base import D, with_
from arrears.plans.q_macro import ASOF_SQL
from arrears.plans.registry import register
from arrears.sources import panel as P
from arrears.sources.scratch import written

KEYS = ["asset_number", "period"]
W_ = "PARTITION BY asset_number ORDER BY period"


def _run(cond: str, name: str, src: str) -> str:
    return f"""
{name}_h AS (
  SELECT asset_number, period, COALESCE({cond}, false) AS hit,
         sum(CASE WHEN COALESCE({cond}, false) THEN 0 ELSE 1 END) OVER ({W_} ROWS UNBOUNDED PRECEDING) AS isl
  FROM {src}),
{name}_r AS (
  SELECT asset_number, period,
         CAST(CASE WHEN hit THEN sum(CAST(hit AS INTEGER)) OVER
           (PARTITION BY asset_number, isl ORDER BY period ROWS UNBOUNDED PRECEDING) ELSE 0 END AS DOUBLE) AS {name}
  FROM {name}_h)"""


def _flag(cond: str) -> str:
    return f"CAST(COALESCE({cond}, false) AS DOUBLE)"


def _cap(x: str, cap: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN least({x}, {cap}) END"


PROPS = ", ".join(f"{_flag(f'property_type = {chr(39)}{t}{chr(39)}')} AS prop_{t}" for t in C.PROPERTY_TYPES)
COVID = FE.FIXTURE.covid

FEATURES_SQL = ASOF_SQL + f""",
cb AS (
  SELECT *,
    round_even(date_diff('day', period_dt, CAST(DATE '1899-12-30' + CAST(maturity_serial AS INTEGER) AS DATE))
         / {D(30.44)} * {D(10)}, 0) / {D(10)} AS months_to_maturity,
    lag(ltv_curr) OVER ({W_}) AS ltv_curr_lag1,
    lag(dscr_curr) OVER ({W_}) AS dscr_curr_lag1,
    lag(occ_curr) OVER ({W_}) AS occupancy_lag1
  FROM macro_panel),
p99 AS (SELECT quantile_cont(ltv_curr, 0.99) AS v FROM panel),
cb2 AS (
  SELECT cb.*,
    {_flag('months_to_maturity < 0')} AS past_maturity,
    {_cap('ltv_orig', D(2.0))} AS ltv_orig_capped,
    {_flag(f'ltv_orig > {D(0.8)}')} AS ltv_orig_high,
    CAST(ltv_orig IS NULL AS DOUBLE) AS ltv_orig_missing,
    {_cap('ltv_curr', 'p99.v')} AS ltv_curr_capped,
    {_flag(f'ltv_curr > {D(2.0)}')} AS ltv_curr_over2,
    {_cap('dscr_orig', D(10.0))} AS dscr_orig_capped,
    {_flag(f'dscr_orig < {D(1.0)}')} AS dscr_orig_below1,
    {_flag(f'dscr_orig >= {D(1.0)} AND dscr_orig < {D(1.25)}')} AS dscr_orig_below125,
    CAST(dscr_orig IS NULL AS DOUBLE) AS dscr_orig_missing,
    orig_rate * 100 AS interest_rate_pct,
    ln(1 + orig_amount) AS log_loan_amount,
    {PROPS},
    CAST(property_type IS NULL AS DOUBLE) AS prop_missing,
    CAST(state IS NULL AS DOUBLE) AS state_missing,
    {_flag(f"period BETWEEN '{COVID[0]}' AND '{COVID[1]}'")} AS covid_period,
    {_flag('io_flag = 1.0 AND months_to_maturity BETWEEN 0 AND 12')} AS io_near_maturity,
    CASE WHEN count(dscr_curr_lag1) OVER r3 >= 2 THEN avg(dscr_curr_lag1) OVER r3 END AS dscr_roll3m,
    CASE WHEN count(dscr_curr_lag1) OVER r6 >= 3 THEN avg(dscr_curr_lag1) OVER r6 END AS dscr_roll6m,
    CASE WHEN count(ltv_curr_lag1) OVER r3 >= 2 THEN avg(ltv_curr_lag1) OVER r3 END AS ltv_roll3m,
    CASE WHEN count(ltv_curr_lag1) OVER r6 >= 3 THEN avg(ltv_curr_lag1) OVER r6 END AS ltv_roll6m,
    CASE WHEN count(occupancy_lag1) OVER r3 >= 2 THEN avg(occupancy_lag1) OVER r3 END AS occ_roll3m,
    dscr_curr_lag1 - lag(dscr_curr_lag1, 3) OVER ({W_}) AS dscr_delta3m,
    dscr_curr_lag1 - lag(dscr_curr_lag1, 6) OVER ({W_}) AS dscr_delta6m,
    ltv_curr_lag1 - lag(ltv_curr_lag1, 3) OVER ({W_}) AS ltv_delta3m,
    ltv_curr_lag1 - lag(ltv_curr_lag1, 6) OVER ({W_}) AS ltv_delta6m,
    occupancy_lag1 - lag(occupancy_lag1, 3) OVER ({W_}) AS occ_delta3m,
    {_flag('months_to_maturity BETWEEN 0 AND 24')} AS near_maturity_flag,
    {_flag(f'dscr_curr_lag1 < {D(1.0)} AND ltv_curr_lag1 > {D(0.85)}')} AS dual_stress,
    CAST(dscr_curr IS NULL AS DOUBLE) AS dscr_curr_missing,
    CAST(occ_curr IS NULL AS DOUBLE) AS occ_curr_missing,
    CAST(ltv_curr IS NULL AS DOUBLE) AS ltv_curr_missing,
    {_flag('months_to_maturity BETWEEN 0 AND 12')} AS maturity_bucket_0_12,
    {_flag('months_to_maturity BETWEEN 12 AND 36')} AS maturity_bucket_12_36,
    CASE WHEN count(*) OVER f6 >= 6 THEN CAST(max(default_flag) OVER f6 AS DOUBLE) END AS label_6m,
    CAST(max(default_flag) OVER (PARTITION BY asset_number) AS DOUBLE) AS label_ever
  FROM cb, p99
  WINDOW r3 AS ({W_} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW),
         r6 AS ({W_} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW),
         f6 AS ({W_} ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING)),
meds AS (SELECT median(dscr_curr_lag1) AS m_dscr, median(ltv_curr_capped) AS m_ltv FROM cb2),
{_run(f'dscr_curr_lag1 < {D(1.0)}', 'dscr_consec_below1', 'cb2')},
{_run(f'dscr_curr_lag1 < {D(1.25)}', 'dscr_consec_below125', 'cb2')},
{_run(f'ltv_curr_lag1 > {D(0.9)}', 'ltv_consec_above90', 'cb2')},
{_run(f'ltv_curr_lag1 > {D(1.0)}', 'ltv_consec_above100', 'cb2')},
cfeat AS (
  SELECT cb2.*, a.dscr_consec_below1, b.dscr_consec_below125, c.ltv_consec_above90, d.ltv_consec_above100,
    COALESCE(ltv_curr_capped, {D(0)}) * near_maturity_flag AS ltv_x_near_mat,
    COALESCE(dscr_curr_lag1, meds.m_dscr) * COALESCE(ltv_curr_capped, meds.m_ltv) AS dscr_ltv_product,
    {_flag(f'dscr_delta3m < {D(-0.1)} AND ltv_delta3m > {D(0.02)}')} AS double_deterioration
  FROM cb2
  JOIN dscr_consec_below1_r a USING (asset_number, period)
  JOIN dscr_consec_below125_r b USING (asset_number, period)
  JOIN ltv_consec_above90_r c USING (asset_number, period)
  JOIN ltv_consec_above100_r d USING (asset_number, period)
  JOIN meds ON true)"""


def frame(spark, sf_dir):
    return FE.panel_features(spark, sf_dir, FE.FIXTURE)


# Columns that need the p99 cap, of these the one that needs the medians, and what they come from.
CAPPED = {"ltv_curr_capped", "ltv_x_near_mat", "dscr_ltv_product"}
IMPUTED = {"dscr_ltv_product"}
FITTED_FROM = ["period_dt", "maturity_serial", "ltv_curr", "dscr_curr"]


def _columns(spark, sf_dir, cols):
    """A few columns of the matrix from the operators they need: without fitted
    values nothing is written, and the planner drops what is not asked for.
    Fitted values take several passes, over the few panel columns they come
    from; the others are null there, and no asked column reads them."""
    panel = P.loan_month_panel(spark, sf_dir)
    cap, dscr, ltv = float("inf"), 0.0, 0.0
    if CAPPED & set(cols):
        narrow = written(spark, panel.select(*KEYS, *FITTED_FROM), "fitted-slice")
        panel = narrow.withColumns({f.name: F.lit(None).cast(f.dataType) for f in panel.schema if f.name not in narrow.columns})
        cap = exact_quantile(narrow, "ltv_curr", FE.P99)
    df = FE.base_features(panel, FE.FIXTURE, ltv_p99=cap)
    if IMPUTED & set(cols):
        medians = wide_quantiles(df.select("dscr_curr_lag1", "ltv_curr_capped"), ["dscr_curr_lag1", "ltv_curr_capped"], 0.5)
        dscr, ltv = medians["dscr_curr_lag1"], medians["ltv_curr_capped"]
    return FE.dynamic_features(df, dscr_median=dscr, ltv_capped_median=ltv).select(*KEYS, *cols)


def _reg(name: str, cols: list[str]):
    sql = with_(FEATURES_SQL) + f"\nSELECT {', '.join(KEYS + cols)} FROM cfeat"

    @register(name, dbl=cols, sql=sql)
    def q(spark, sf_dir):
        return _columns(spark, sf_dir, cols)
    return q


_reg("clip_const", ["ltv_orig_capped", "dscr_orig_capped"])
_reg("clip_p99", ["ltv_curr", "ltv_curr_capped"])
_reg("threshold_flags", ["ltv_orig_high", "ltv_curr_over2", "dscr_orig_below1", "dscr_orig_below125",
                         "past_maturity"])
_reg("missing_flags", ["ltv_orig_missing", "dscr_orig_missing", "prop_missing", "state_missing",
                       "dscr_curr_missing", "occ_curr_missing", "ltv_curr_missing"])
_reg("log1p_features", ["log_loan_amount", "interest_rate_pct"])
_reg("one_hot_fixed", [f"prop_{t}" for t in C.PROPERTY_TYPES])
_reg("months_to_maturity", ["months_to_maturity"])
_reg("maturity_buckets", ["near_maturity_flag", "maturity_bucket_0_12", "maturity_bucket_12_36"])
_reg("stress_flags", ["io_near_maturity", "dual_stress", "double_deterioration"])
_reg("interaction_product", ["ltv_x_near_mat", "dscr_ltv_product"])
_reg("regime_flags", ["covid_period"])

FM_DBL = {c: 9 for c in FE.ALL_FEATURES + ["label_6m", "label_ever"]}
FM_DBL.update({"orig_amount": 6, "sched_balance": 6, "valuation": 6, "noi_orig": 6})


@register("feature_matrix", dbl=FM_DBL, sql=with_(FEATURES_SQL) + f"""
SELECT {', '.join(KEYS + FE.ALL_FEATURES)}, label_6m, label_ever FROM cfeat""")
def feature_matrix(spark, sf_dir):
    return frame(spark, sf_dir).select(*KEYS, *FE.ALL_FEATURES, "label_6m", "label_ever")
