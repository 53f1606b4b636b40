"""Loan-period feature matrix on the property rollup."""

from __future__ import annotations

from arrears.operators import features as FE
from arrears.plans.oracle_base import D, with_
from arrears.plans.q_macro import MACRO_SQL
from arrears.plans.q_reports import ROLLUP_SQL, rollup
from arrears.plans.registry import register
from arrears.sources import macro as M
from arrears.sources import sinks as K

# Property types present in the fixture (p_type words); Spark derives the same list from the data.
PT = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
W_ = "PARTITION BY ac_key ORDER BY report_period"
RB = FE.FIXTURE.regime_breaks
CV = FE.FIXTURE.covid


def _ln1p0(x: str) -> str:
    return f"ln(1 + CASE WHEN {x} IS NOT NULL THEN greatest({x}, {D(0)}) END)"


LP_SQL = ROLLUP_SQL + "," + MACRO_SQL + f""",
lp1 AS (
  SELECT *,
    {_ln1p0('original_balance')} AS log_orig_balance,
    {_ln1p0('balance_end')} AS log_current_balance,
    CASE WHEN original_balance > 0 THEN (original_balance - balance_end) / original_balance ELSE {D(0)} END
      AS balance_paiddown,
    CAST(report_period || '-01' AS DATE) AS ym_dt,
    TRY_CAST(origination_date AS DATE) AS orig_dt,
    TRY_CAST(maturity_date AS DATE) AS mat_dt,
    COALESCE(lag(default_flag) OVER ({W_}), 0) AS def_lag1
  FROM rollup),
lp2 AS (
  SELECT *,
    CASE WHEN date_diff('day', orig_dt, ym_dt) IS NOT NULL
         THEN greatest(date_diff('day', orig_dt, ym_dt) / {D(30.44)}, {D(0)}) END AS loan_age_months,
    CASE WHEN date_diff('day', ym_dt, mat_dt) IS NOT NULL
         THEN greatest(date_diff('day', ym_dt, mat_dt) / {D(30.44)}, {D(0)}) END AS months_to_maturity,
    CASE payment_type WHEN 'Interest-Only' THEN {D(3)} WHEN 'Partial IO' THEN {D(2)}
                      WHEN 'Amortizing' THEN {D(1)} ELSE {D(0)} END AS payment_type_ord,
    COALESCE(interest_rate_curr, interest_rate_orig) AS interest_rate,
    COALESCE(CASE WHEN appraisal_current > 0 THEN balance_end / appraisal_current END,
             CASE WHEN appraisal_orig > 0 THEN original_balance / appraisal_orig END) AS ltv_feature,
    COALESCE(dscr_current, dscr_orig) AS dscr_feature,
    COALESCE(occupancy_current, occupancy_orig) AS occupancy,
    {_ln1p0('COALESCE(noi_current, noi_orig)')} AS log_noi,
    {_ln1p0('COALESCE(appraisal_current, appraisal_orig)')} AS log_appraisal,
    CAST(max(def_lag1) OVER ({W_} ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS prior_default_ever,
    CAST(sum(def_lag1) OVER ({W_} ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS DOUBLE) AS n_def_12m,
    CAST(COALESCE(row_number() OVER ({W_}) - max(CASE WHEN def_lag1 = 1 THEN rn END)
         OVER ({W_} ROWS UNBOUNDED PRECEDING), 0) AS DOUBLE) AS months_since_def,
    CAST(year AS DOUBLE) AS year_feat, CAST(month AS DOUBLE) AS month_feat,
    CAST(floor((month - 1) / 3) + 1 AS DOUBLE) AS quarter_feat,
    CAST(CASE WHEN report_period < '{RB[0]}' THEN 0 WHEN report_period <= '{RB[1]}' THEN 1 ELSE 2 END AS DOUBLE)
      AS macro_regime,
    CAST(COALESCE(report_period BETWEEN '{CV[0]}' AND '{CV[1]}', false) AS DOUBLE) AS covid_period,
    CAST(COALESCE(max(default_flag) OVER ({W_} ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING), 0) AS BIGINT) AS target,
    strftime(CAST(ym_dt - INTERVAL 3 MONTH AS DATE), '%Y-%m') AS ym_macro,
    {", ".join(f"CAST(COALESCE(property_type = '{p}', false) AS DOUBLE) AS pt_{p}" for p in PT)}
  FROM (SELECT *, row_number() OVER ({W_}) AS rn FROM lp1)),
lp3 AS (
  SELECT *,
    lag(dscr_feature) OVER ({W_}) AS dscr_lag1, lag(ltv_feature) OVER ({W_}) AS ltv_lag1
  FROM lp2),
lp4 AS (
  SELECT lp3.*,
    avg(dscr_lag1) OVER r3 - dscr_lag1 AS dscr_3m_chg,
    avg(ltv_lag1) OVER r3 - ltv_lag1 AS ltv_3m_chg,
    n.nat_10y_rate, n.nat_unrate, n.nat_gdp_yoy, s.state_unrate,
    max(report_period) OVER (PARTITION BY ac_key) AS last_p
  FROM lp3
  LEFT JOIN nat n ON lp3.ym_macro = n.ym
  LEFT JOIN state_m s ON lp3.ym_macro = s.ym AND lp3.state = s.state
  WINDOW r3 AS ({W_} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
lpf AS (SELECT * FROM lp4 WHERE report_period < last_p)"""

FEATS = FE.LOAN_PERIOD_FEATURES + [f"pt_{p}" for p in PT]
LP_KEYS = ["ac_key", "report_period"]


def frame(spark, sf_dir):
    return FE.loan_period_features(rollup(spark, sf_dir), M.national_macro(spark, sf_dir),
                                   M.state_monthly(spark, sf_dir), FE.FIXTURE)


@register("loan_period_features", dbl={c: 9 for c in FEATS},
          sql=with_(LP_SQL) + f"""
SELECT ac_key, loan_uid, report_period, CAST(year AS BIGINT) AS year, state, target, {', '.join(FEATS)} FROM lpf""")
def loan_period_features(spark, sf_dir):
    return frame(spark, sf_dir)


@register("feature_handoff", dbl={c: 9 for c in FEATS}, sql=with_(LP_SQL) + f"""
SELECT ac_key, report_period, {', '.join(FEATS)} FROM lpf""")
def feature_handoff(spark, sf_dir):
    """The matrix written, read back by the next stage, and its model inputs taken by exclusion."""
    path = K.fresh_path(spark, "features")
    frame(spark, sf_dir).write.mode("overwrite").parquet(path)
    df = FE.read_feature_matrix(spark, path)
    return df.select(*LP_KEYS, *FE.feature_columns_by_exclusion(df))


def _reg(name: str, cols: list[str], extra: list[str] | None = None):
    extra = extra or []
    sql = with_(LP_SQL) + f"\nSELECT {', '.join(LP_KEYS + extra + cols)} FROM lpf"

    @register(name, dbl=cols, sql=sql)
    def q(spark, sf_dir):
        return frame(spark, sf_dir).select(*LP_KEYS, *extra, *cols)
    return q


_reg("macro_lag_join", ["nat_10y_rate", "nat_unrate", "nat_gdp_yoy"])
_reg("macro_state_lag_join", ["state_unrate"], ["state"])
_reg("balance_paydown", ["balance_paiddown", "log_orig_balance", "log_current_balance"])
_reg("one_hot_dynamic", [f"pt_{p}" for p in PT])
_reg("loan_age", ["loan_age_months", "months_to_maturity"])
_reg("ordinal_map", ["payment_type_ord"])
_reg("coalesce_fallback", ["interest_rate", "ltv_feature", "dscr_feature", "occupancy", "log_noi", "log_appraisal"])
_reg("regime_macro", ["macro_regime", "covid_period", "year_feat", "month_feat", "quarter_feat"])
