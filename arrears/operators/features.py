"""Feature frames.

``panel_features``: the 70-column loan-month matrix (46 base + 24 dynamic
features) over the wide panel joined with lagged macro series.
``loan_period_features``: the 26 + ``pt_*`` loan-period matrix built on
the property rollup, with the lenient target and the last month removed.

Fitted constants (the p99 cap, whole-panel medians, the category list)
are computed as exact distributed aggregates and brought back as scalars.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrears.functions import columns as C
from arrears.operators import labels as L
from arrears.operators import macro_join as MJ
from arrears.operators import windows as W
from arrears.operators.prefix import exact_quantile, wide_quantiles
from arrears.session import ensure_checkpoint_dir
from arrears.sources import macro as M


@dataclass(frozen=True)
class Params:
    cutoff: str = "2022-01"                      # row-level split month (text compare)
    covid: tuple = ("2020-03", "2021-12")        # forbearance regime, inclusive
    regime_breaks: tuple = ("2022-03", "2023-07")
    years: tuple = (2016, 2025)                  # year spine of the annual reports
    cohort_cutoff: str = "2022-01-01"            # loan-level split (text compare)
    macro_lag: int = 3
    horizon: int = 6


REFERENCE = Params()
# The fixture panel spans 1995-01 .. 2001-11: the same calendar rules moved 22 years back.
FIXTURE = Params(cutoff="2000-01", covid=("1998-03", "1999-12"), regime_breaks=("2000-03", "2001-07"),
                 years=(1995, 2001), cohort_cutoff="1996-01-01")

# Fixed feature lists (names as in the reference, with the panel's clean names for raw columns).
BASE_FEATURES = [
    "orig_amount", "log_loan_amount", "orig_term", "orig_amort_term", "rate_type_code", "io_term",
    "interest_rate_pct", "io_flag", "balloon_flag", "grace_days", "sched_balance",
    "ltv_orig_capped", "ltv_orig_high", "ltv_orig_missing",
    "ltv_curr_capped", "ltv_curr_over2", "ltv_curr_lag1",
    "dscr_orig_capped", "dscr_orig_below1", "dscr_orig_below125", "dscr_orig_missing",
    "dscr_curr_lag1", "occ_orig", "occupancy_lag1", "valuation", "noi_orig", "sq_feet",
    "months_to_maturity", "past_maturity", "io_near_maturity",
    "prop_RT", "prop_OF", "prop_LO", "prop_MF", "prop_SS", "prop_MU", "prop_CH", "prop_IN", "prop_MH",
    "prop_missing", "state_missing", "covid_period",
    "unrate_lag3", "cpi_yoy_lag3", "dgs10_lag3", "state_ur_lag3",
]
NEW_FEATURES = [
    "dscr_roll3m", "dscr_roll6m", "ltv_roll3m", "ltv_roll6m", "occ_roll3m",
    "dscr_delta3m", "dscr_delta6m", "ltv_delta3m", "ltv_delta6m", "occ_delta3m",
    "dscr_consec_below1", "dscr_consec_below125", "ltv_consec_above90", "ltv_consec_above100",
    "near_maturity_flag", "ltv_x_near_mat", "dual_stress", "dscr_ltv_product", "double_deterioration",
    "dscr_curr_missing", "occ_curr_missing", "ltv_curr_missing",
    "maturity_bucket_0_12", "maturity_bucket_12_36",
]
ALL_FEATURES = BASE_FEATURES + NEW_FEATURES

LOAN_PERIOD_FEATURES = [
    "log_orig_balance", "log_current_balance", "balance_paiddown",
    "loan_age_months", "months_to_maturity", "payment_type_ord", "interest_rate",
    "ltv_feature", "dscr_feature", "dscr_3m_chg", "ltv_3m_chg",
    "occupancy", "log_appraisal", "log_noi",
    "prior_default_ever", "n_def_12m", "months_since_def",
    "nat_10y_rate", "nat_unrate", "nat_gdp_yoy", "state_unrate",
    "year_feat", "month_feat", "quarter_feat", "macro_regime", "covid_period",
]

# Thresholds of the base and dynamic features (fixed values).
LTV_ORIG_CAP, LTV_ORIG_HIGH, LTV_CURR_EXTREME = 2.0, 0.8, 2.0
DSCR_ORIG_CAP = 10.0
P99 = 0.99


# ---------------------------------------------------------------- base features
def months_to_maturity_1dp(maturity_dt, period_dt):
    """Average-month distance rounded to one decimal (ties cannot occur: 30.44 is not dyadic)."""
    return F.rint(C.months_between_days(maturity_dt, period_dt) * 10.0) / 10.0


def base_features(panel: DataFrame, params: Params = FIXTURE, ltv_p99: float | None = None) -> DataFrame:
    w = W.loan_window()
    if ltv_p99 is None:
        ltv_p99 = exact_quantile(panel, "ltv_curr", P99)
    mat = C.excel_serial_to_date("maturity_serial")
    df = panel.withColumns({
        "maturity_dt": mat,
        "months_to_maturity": months_to_maturity_1dp(mat, F.col("period_dt")),
    })
    df = df.withColumns({
        "past_maturity": C.flag(F.col("months_to_maturity") < 0),
        "ltv_orig_capped": C.clip_upper("ltv_orig", LTV_ORIG_CAP),
        "ltv_orig_high": C.flag(F.col("ltv_orig") > LTV_ORIG_HIGH),
        "ltv_orig_missing": C.missing_flag("ltv_orig"),
        "ltv_curr_capped": C.clip_upper("ltv_curr", ltv_p99) if ltv_p99 is not None else F.col("ltv_curr"),
        "ltv_curr_over2": C.flag(F.col("ltv_curr") > LTV_CURR_EXTREME),
        "dscr_orig_capped": C.clip_upper("dscr_orig", DSCR_ORIG_CAP),
        "dscr_orig_below1": C.flag(F.col("dscr_orig") < 1.0),
        "dscr_orig_below125": C.flag((F.col("dscr_orig") >= 1.0) & (F.col("dscr_orig") < 1.25)),
        "dscr_orig_missing": C.missing_flag("dscr_orig"),
        "interest_rate_pct": F.col("orig_rate") * 100,
        "log_loan_amount": F.log1p("orig_amount"),
        **{f"prop_{t}": C.flag(F.col("property_type") == t) for t in C.PROPERTY_TYPES},
        "prop_missing": C.missing_flag("property_type"),
        "state_missing": C.missing_flag("state"),
        "ltv_curr_lag1": W.lag("ltv_curr", w),
        "dscr_curr_lag1": W.lag("dscr_curr", w),
        "occupancy_lag1": W.lag("occ_curr", w),
        "covid_period": C.regime_between("period", *params.covid),
    })
    return df.withColumn("io_near_maturity",
                         C.flag((F.col("io_flag") == 1.0) & F.col("months_to_maturity").between(0, 12)))


def dynamic_features(df: DataFrame, dscr_median: float | None = None,
                     ltv_capped_median: float | None = None, fit_rows=None) -> DataFrame:
    """The 24 rolling / momentum / run / interaction / missing / bucket features."""
    w = W.loan_window()
    df = df.withColumns({
        "dscr_roll3m": W.rolling_mean("dscr_curr_lag1", w, 3, 2),
        "dscr_roll6m": W.rolling_mean("dscr_curr_lag1", w, 6, 3),
        "ltv_roll3m": W.rolling_mean("ltv_curr_lag1", w, 3, 2),
        "ltv_roll6m": W.rolling_mean("ltv_curr_lag1", w, 6, 3),
        "occ_roll3m": W.rolling_mean("occupancy_lag1", w, 3, 2),
        "dscr_delta3m": W.momentum("dscr_curr_lag1", w, 3),
        "dscr_delta6m": W.momentum("dscr_curr_lag1", w, 6),
        "ltv_delta3m": W.momentum("ltv_curr_lag1", w, 3),
        "ltv_delta6m": W.momentum("ltv_curr_lag1", w, 6),
        "occ_delta3m": W.momentum("occupancy_lag1", w, 3),
        "dscr_consec_below1": W.run_below("dscr_curr_lag1", 1.00, w),
        "dscr_consec_below125": W.run_below("dscr_curr_lag1", 1.25, w),
        "ltv_consec_above90": W.run_above("ltv_curr_lag1", 0.90, w),
        "ltv_consec_above100": W.run_above("ltv_curr_lag1", 1.00, w),
        "near_maturity_flag": C.between_flag("months_to_maturity", 0, 24),
        "dual_stress": C.flag((F.col("dscr_curr_lag1") < 1.0) & (F.col("ltv_curr_lag1") > 0.85)),
        "dscr_curr_missing": C.missing_flag("dscr_curr"),
        "occ_curr_missing": C.missing_flag("occ_curr"),
        "ltv_curr_missing": C.missing_flag("ltv_curr"),
        "maturity_bucket_0_12": C.between_flag("months_to_maturity", 0, 12),
        "maturity_bucket_12_36": C.between_flag("months_to_maturity", 12, 36),
    })
    if dscr_median is None or ltv_capped_median is None:
        # the windowed frame feeds both the fitted medians and the final matrix
        ensure_checkpoint_dir(df.sparkSession)
        df = df.checkpoint(eager=True)
        meds = wide_quantiles(fit_rows(df) if fit_rows else df, ["dscr_curr_lag1", "ltv_curr_capped"], 0.5)
        dscr_median = meds["dscr_curr_lag1"] if dscr_median is None else dscr_median
        ltv_capped_median = meds["ltv_curr_capped"] if ltv_capped_median is None else ltv_capped_median
    return df.withColumns({
        "ltv_x_near_mat": F.coalesce(F.col("ltv_curr_capped"), F.lit(0.0)) * F.col("near_maturity_flag"),
        "dscr_ltv_product": F.coalesce(F.col("dscr_curr_lag1"), F.lit(dscr_median).cast("double"))
        * F.coalesce(F.col("ltv_curr_capped"), F.lit(ltv_capped_median).cast("double")),
        "double_deterioration": C.flag((F.col("dscr_delta3m") < -0.1) & (F.col("ltv_delta3m") > 0.02)),
    })


# ---------------------------------------------------------------- macro (C flow)
def c_macro_series(spark, sf_dir: str, lag: int = 3):
    """Lagged monthly series: (period_dt, unrate_lag3, cpi_yoy_lag3, dgs10_lag3)
    for the as-of join, and (period_dt, state, state_ur_lag3)."""
    unrate = M.monthly_mean(M.monthly_unrate(spark, sf_dir), "unrate", fill_empty_months=False)
    cpi = M.yoy_change(M.monthly_mean(M.monthly_cpi(spark, sf_dir), "cpi", fill_empty_months=False),
                       "cpi", "cpi_yoy")
    dgs = M.monthly_mean(M.daily_rate(spark, sf_dir), "dgs10", fill_empty_months=False)
    series = []
    for frame, col in ((unrate, "unrate"), (cpi, "cpi_yoy"), (dgs, "dgs10")):
        s = MJ.shift_months(frame.select(F.col("date").alias("period_dt"), col), "period_dt", lag)
        series.append(s.withColumnRenamed(col, f"{col}_lag{lag}"))
    st = M.state_monthly(spark, sf_dir).select(
        F.add_months(C.period_to_date("ym"), lag).alias("period_dt"), F.col("state").alias("state_code"),
        F.col("state_unrate").alias(f"state_ur_lag{lag}"))
    return series, st


def join_c_macro(panel: DataFrame, spark, sf_dir: str, lag: int = 3) -> DataFrame:
    series, st = c_macro_series(spark, sf_dir, lag)
    df = MJ.asof_backward_all(panel, [(s, [c for c in s.columns if c != "period_dt"]) for s in series], "period_dt")
    return MJ.state_with_fallback(df, st, "period_dt", "state", "state_code",
                                  f"state_ur_lag{lag}", f"unrate_lag{lag}")


def panel_features(spark, sf_dir: str, params: Params = FIXTURE, panel: DataFrame | None = None,
                   fit_on: str = "all") -> DataFrame:
    """``fit_on='all'`` fits the p99 cap and the interaction medians on every
    row (as the reference does); ``fit_on='train'`` uses rows before the cutoff."""
    from arrears.sources import panel as P
    panel = panel if panel is not None else P.loan_month_panel(spark, sf_dir)
    # Several passes (fitted p99 and medians, then the matrix) read the panel:
    # write it once to the shared checkpoint folder (lineage cut, small plans).
    ensure_checkpoint_dir(spark)
    panel = panel.checkpoint(eager=True)
    fit = (lambda d: d) if fit_on == "all" else (lambda d: d.where(F.col("period") < F.lit(params.cutoff)))
    df = base_features(panel, params, ltv_p99=exact_quantile(fit(panel), "ltv_curr", P99))
    df = dynamic_features(df, fit_rows=fit)
    df = L.add_labels(df)
    return join_c_macro(df, spark, sf_dir, params.macro_lag)


# ---------------------------------------------------------------- loan-period (step 24)
def loan_period_features(rollup: DataFrame, national: DataFrame, state: DataFrame,
                         params: Params = FIXTURE, categories: list[str] | None = None) -> DataFrame:
    w = W.loan_window("ac_key", "report_period")
    ym_dt = C.period_to_date("report_period")
    df = rollup.withColumns({
        "log_orig_balance": C.log1p_floor0("original_balance"),
        "log_current_balance": C.log1p_floor0("balance_end"),
        "balance_paiddown": C.balance_paydown("original_balance", "balance_end"),
        "ym_dt": ym_dt,
        "orig_dt": F.try_to_date("origination_date", "yyyy-MM-dd"),
        "mat_dt": F.try_to_date("maturity_date", "yyyy-MM-dd"),
    })
    ltv_curr = C.guarded_ratio("balance_end", "appraisal_current")
    ltv_orig = C.guarded_ratio("original_balance", "appraisal_orig")
    df = df.withColumns({
        "loan_age_months": C.clip_lower(C.months_between_days("ym_dt", "orig_dt"), 0.0),
        "months_to_maturity": C.clip_lower(C.months_between_days("mat_dt", "ym_dt"), 0.0),
        "payment_type_ord": C.payment_type_ordinal("payment_type"),
        "interest_rate": F.coalesce("interest_rate_curr", "interest_rate_orig"),
        "ltv_feature": F.coalesce(ltv_curr, ltv_orig),
        "dscr_feature": F.coalesce("dscr_current", "dscr_orig"),
        "occupancy": F.coalesce("occupancy_current", "occupancy_orig"),
        "log_noi": C.log1p_floor0(F.coalesce("noi_current", "noi_orig")),
        "log_appraisal": C.log1p_floor0(F.coalesce("appraisal_current", "appraisal_orig")),
        "def_lag1": W.lag_fill0("default_flag", w),
    })
    df = df.withColumns({
        "dscr_lag1": W.lag("dscr_feature", w),
        "ltv_lag1": W.lag("ltv_feature", w),
        "prior_default_ever": W.running_max("def_lag1", w).cast("double"),
        "n_def_12m": W.rolling_sum("def_lag1", w, 12).cast("double"),
        "months_since_def": W.rows_since_hit("def_lag1", w),
        "year_feat": F.col("year").cast("double"),
        "month_feat": F.col("month").cast("double"),
        "quarter_feat": C.quarter_of_month("month").cast("double"),
        "macro_regime": C.macro_regime("report_period", *params.regime_breaks).cast("double"),
        "covid_period": C.regime_between("report_period", *params.covid),
        "target": L.forward_label_lenient("default_flag", params.horizon, "ac_key", "report_period"),
        "ym_macro": F.date_format(F.add_months(ym_dt, -params.macro_lag), "yyyy-MM"),
    })
    df = df.withColumns({
        "dscr_3m_chg": W.trend_gap("dscr_lag1", w),
        "ltv_3m_chg": W.trend_gap("ltv_lag1", w),
    })
    if categories is None:
        categories = category_list(rollup, "property_type")
    df = df.withColumns({f"pt_{c}": C.flag(F.col("property_type") == c) for c in categories})
    df = MJ.exact_month_join(df, national.withColumnRenamed("ym", "_ym_n"), "ym_macro", "_ym_n")
    st = state.select(F.col("ym").alias("_ym_s"), F.col("state").alias("_st"), "state_unrate")
    df = MJ.exact_month_join(df, st, "ym_macro", "_ym_s", [("state", "_st")])
    df = L.drop_last_observation(df, "ac_key", "report_period")
    feats = LOAN_PERIOD_FEATURES + [f"pt_{c}" for c in categories]
    return df.select("ac_key", "loan_uid", "report_period", "year", "state", "target", *feats)


MAX_CATEGORIES = 1000     # each becomes a column


def category_list(df: DataFrame, col: str, most: int = MAX_CATEGORIES) -> list[str]:
    """Distinct non-NULL categories, sorted; more than ``most`` are an error."""
    found = df.select(col).where(F.col(col).isNotNull()).distinct().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"{col} has more than {most} categories: not a category column")
    return sorted(r[0] for r in found)


# Keys, report year and target of the loan-period frame: never model inputs.
NON_FEATURES = {"ac_key", "loan_uid", "report_period", "year", "state", "target"}


def feature_columns_by_exclusion(df: DataFrame) -> list[str]:
    """Every column that is not a key, date or target."""
    return [c for c in df.columns if c not in NON_FEATURES]


def read_feature_matrix(spark, path: str) -> DataFrame:
    """A feature matrix handed off as parquet between stages."""
    return spark.read.parquet(path)
