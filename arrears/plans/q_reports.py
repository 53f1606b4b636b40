"""Rollup, loan table and portfolio reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from arrears.operators import reports as R
from arrears.operators import rollup as RU
from arrears.operators.features import FIXTURE
from arrears.plans.oracle_base import CLEAN_PROPERTY_ROWS, LOAN_MONTH_PANEL, with_
from arrears.plans.registry import register
from arrears.sources import panel as P

FIRSTS = RU.FIRST_COLS
MEANS = RU.MEAN_COLS
SUMS = RU.SUM_COLS


def _first_sql(c: str, order: str = "row_order") -> str:
    return f"arg_min({c}, {order}) FILTER (WHERE {c} IS NOT NULL) AS {c}"


ROLLUP_SQL = CLEAN_PROPERTY_ROWS + f""",
props_k AS (SELECT *, concat_ws('_', asset_left, cik) AS ac_key FROM props),
roll_mode AS (
  SELECT ac_key, report_period, property_type FROM (
    SELECT ac_key, report_period, property_type,
           row_number() OVER (PARTITION BY ac_key, report_period ORDER BY count(*) DESC, property_type) AS rk
    FROM props_k WHERE property_type IS NOT NULL GROUP BY ac_key, report_period, property_type) WHERE rk = 1),
roll_agg AS (
  SELECT ac_key, report_period,
    {", ".join(_first_sql(c) for c in FIRSTS)},
    max(default_flag) AS default_flag,
    {", ".join(f"avg({c}) AS {c}" for c in MEANS)},
    {", ".join(f"COALESCE(sum({c}), 0) AS {c}" for c in SUMS)}
  FROM props_k GROUP BY ac_key, report_period),
rollup AS (
  SELECT a.*, m.property_type FROM roll_agg a
  LEFT JOIN roll_mode m ON a.ac_key = m.ac_key AND a.report_period = m.report_period)"""

LOAN_ATTRS = ["asset_number", "state", "property_type", "payment_type", "original_balance",
              "original_term", "io_term_months", "is_io", "origination_date", "maturity_date"]

LOANS_SQL = ROLLUP_SQL + f""",
loans AS (
  SELECT loan_uid,
    {", ".join(_first_sql(c, "{'p': report_period, 'o': row_order}") for c in LOAN_ATTRS)},
    CAST(COALESCE(max(default_flag), 0) AS INTEGER) AS ever_defaulted,
    min(CASE WHEN default_flag = 1 THEN report_period END) AS first_default_period,
    min(CASE WHEN default_flag = 1 THEN year END) AS first_default_year
  FROM props GROUP BY loan_uid)"""

ROLL_DBL = {**{c: 9 for c in MEANS + ["original_term", "io_term_months"]}, **{c: 6 for c in SUMS}}


def rollup(spark, sf_dir):
    return RU.loan_period_rollup(P.property_rows(spark, sf_dir, by_loan_month=True))


def loans(spark, sf_dir, props=None):
    props = props if props is not None else P.property_rows(spark, sf_dir)
    return RU.loan_table(props, attrs=LOAN_ATTRS)


@register("loan_period_rollup", dbl=ROLL_DBL, sql=with_(ROLLUP_SQL) + """
SELECT * REPLACE (CAST(default_flag AS BIGINT) AS default_flag, CAST(year AS BIGINT) AS year,
                  CAST(month AS BIGINT) AS month) FROM rollup""")
def loan_period_rollup(spark, sf_dir):
    return rollup(spark, sf_dir)


@register("modal_type", sql=with_(ROLLUP_SQL) + """
SELECT ac_key, report_period, property_type FROM rollup""")
def modal_type(spark, sf_dir):
    props = P.property_rows(spark, sf_dir).withColumn("ac_key", RU.ac_key())
    return props.groupBy("ac_key", "report_period").agg(F.mode("property_type", True).alias("property_type"))


@register("loan_table", dbl={"original_balance": 6, "original_term": 9, "io_term_months": 9,
                             "first_default_year": 9},
          sql=with_(LOANS_SQL) + """
SELECT * REPLACE (CAST(ever_defaulted AS BIGINT) AS ever_defaulted,
                  CAST(first_default_year AS DOUBLE) AS first_default_year) FROM loans""")
def loan_table(spark, sf_dir):
    # A nullable year travels as DOUBLE so both engines hand over the same dtype.
    return loans(spark, sf_dir).withColumn("first_default_year", F.col("first_default_year").cast("double"))


@register("panel_overview", dbl=["default_rate_pct"], sql=with_(LOAN_MONTH_PANEL) + """
SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT asset_number) AS BIGINT) AS n_loans,
       min(period) AS first_period, max(period) AS last_period, avg(default_flag) * 100.0 AS default_rate_pct
FROM panel""")
def panel_overview(spark, sf_dir):
    return R.panel_overview(P.loan_month_panel(spark, sf_dir), "asset_number", "period", "default_flag")


@register("eda_overview", dbl=["months_per_loan", "default_rate_pct"], sql=with_(LOANS_SQL) + """
SELECT CAST(p.n_obs AS BIGINT) AS n_obs, CAST(l.n_loans AS BIGINT) AS n_loans, p.first_period, p.last_period,
       p.n_obs / l.n_loans AS months_per_loan, CAST(l.n_def AS BIGINT) AS n_defaulted,
       CAST(l.n_loans - l.n_def AS BIGINT) AS n_never_defaulted,
       CASE WHEN l.n_loans > 0 THEN l.n_def / l.n_loans * 100.0 ELSE 0.0 END AS default_rate_pct
FROM (SELECT count(*) AS n_obs, min(report_period) AS first_period, max(report_period) AS last_period FROM props) p,
     (SELECT count(DISTINCT loan_uid) AS n_loans, sum(ever_defaulted) AS n_def FROM loans) l""")
def eda_overview(spark, sf_dir):
    props = P.property_rows(spark, sf_dir)
    return R.eda_overview(props, loans(spark, sf_dir, props))


def _annual_sql(years) -> str:
    return f""",
yrs AS (SELECT CAST(range AS INTEGER) AS year FROM range({years[0]}, {years[1] + 1})),
act AS (SELECT year, count(*) AS n FROM (SELECT DISTINCT year, loan_uid FROM props) GROUP BY year),
fd AS (SELECT first_default_year AS year, count(*) AS d FROM loans WHERE first_default_year IS NOT NULL GROUP BY 1),
annual AS (
  SELECT y.year, CAST(COALESCE(a.n, 0) AS BIGINT) AS active_loans, CAST(COALESCE(f.d, 0) AS BIGINT) AS first_time_defaults,
         floor(CASE WHEN COALESCE(a.n, 0) > 0 THEN COALESCE(f.d, 0) / a.n * 100.0 ELSE 0.0 END * 100.0 + 0.5) / 100.0
           AS default_rate_pct
  FROM yrs y LEFT JOIN act a USING (year) LEFT JOIN fd f USING (year))"""


@register("eda_annual_default", dbl=["default_rate_pct"],
          sql=with_(LOANS_SQL + _annual_sql(FIXTURE.years)) + """
SELECT CAST(year AS BIGINT) AS year, active_loans, first_time_defaults, default_rate_pct FROM annual""")
def eda_annual_default(spark, sf_dir):
    props = P.property_rows(spark, sf_dir)
    return R.annual_default(spark, props, loans(spark, sf_dir, props), FIXTURE.years)


@register("eda_peak_year", dbl=["default_rate_pct"], sql=with_(LOANS_SQL + _annual_sql(FIXTURE.years)) + """
SELECT CAST(year AS BIGINT) AS year, active_loans, first_time_defaults, default_rate_pct FROM annual
ORDER BY default_rate_pct DESC, year LIMIT 1""")
def eda_peak_year(spark, sf_dir):
    return R.peak_year(eda_annual_default(spark, sf_dir))


@register("eda_payment_type", dbl=["share_pct", "default_rate_pct"], sql=with_(LOANS_SQL) + """
, cats AS (SELECT * FROM (VALUES ('Interest-Only'), ('Partial IO'), ('Amortizing'), ('Other')) t(payment_type)),
agg AS (SELECT payment_type, count(*) AS n, sum(ever_defaulted) AS d FROM loans GROUP BY 1),
tot AS (SELECT count(*) AS total FROM loans)
SELECT c.payment_type, CAST(COALESCE(a.n, 0) AS BIGINT) AS unique_loans,
       CASE WHEN t.total > 0 THEN COALESCE(a.n, 0) / t.total * 100.0 ELSE 0.0 END AS share_pct,
       CAST(COALESCE(a.d, 0) AS BIGINT) AS defaulted,
       CASE WHEN COALESCE(a.n, 0) > 0 THEN COALESCE(a.d, 0) / a.n * 100.0 ELSE 0.0 END AS default_rate_pct
FROM cats c LEFT JOIN agg a USING (payment_type), tot t""")
def eda_payment_type(spark, sf_dir):
    return R.payment_type_breakdown(spark, loans(spark, sf_dir))


def _annual_type_sql(years) -> str:
    rates = []
    for t, name in R.ANNUAL_TYPES.items():
        rates.append(f"CASE WHEN count(*) FILTER (WHERE l.payment_type = '{t}') > 0 THEN "
                     f"count(*) FILTER (WHERE l.payment_type = '{t}' AND l.first_default_year = a.year) / "
                     f"count(*) FILTER (WHERE l.payment_type = '{t}') * 100.0 ELSE 0.0 END AS {name}")
    zero = ", ".join(f"COALESCE(r.{n}, 0.0) AS {n}" for n in R.ANNUAL_TYPES.values())
    return f""",
yrs AS (SELECT CAST(range AS INTEGER) AS year FROM range({years[0]}, {years[1] + 1})),
r AS (SELECT a.year, {", ".join(rates)}
      FROM (SELECT DISTINCT year, loan_uid FROM props) a JOIN loans l USING (loan_uid) GROUP BY a.year)
SELECT CAST(y.year AS BIGINT) AS year, {zero} FROM yrs y LEFT JOIN r USING (year)"""


@register("eda_annual_by_type", dbl=list(R.ANNUAL_TYPES.values()),
          sql=with_(LOANS_SQL) + _annual_type_sql(FIXTURE.years).lstrip(",").replace("yrs AS", "\n, yrs AS", 1))
def eda_annual_by_type(spark, sf_dir):
    props = P.property_rows(spark, sf_dir)
    return R.annual_by_payment_type(spark, props, loans(spark, sf_dir, props), FIXTURE.years)


@register("eda_state", dbl=["default_rate_pct"], sql=with_(LOANS_SQL) + """
SELECT state, CAST(count(loan_uid) AS BIGINT) AS total_loans, CAST(sum(ever_defaulted) AS BIGINT) AS defaulted,
       sum(ever_defaulted) / count(loan_uid) * 100.0 AS default_rate_pct
FROM loans GROUP BY state HAVING count(loan_uid) >= 10""")
def eda_state(spark, sf_dir):
    return R.group_default_table(loans(spark, sf_dir), "state", min_loans=10)


@register("eda_property_type", dbl=["default_rate_pct"], sql=with_(LOANS_SQL) + """
SELECT property_type, CAST(count(loan_uid) AS BIGINT) AS total_loans, CAST(sum(ever_defaulted) AS BIGINT) AS defaulted,
       sum(ever_defaulted) / count(loan_uid) * 100.0 AS default_rate_pct
FROM loans GROUP BY property_type""")
def eda_property_type(spark, sf_dir):
    return R.group_default_table(loans(spark, sf_dir), "property_type")
