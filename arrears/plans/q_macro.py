"""Macro sources and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from arrears.operators import features as FE
from arrears.operators import macro_join as MJ
from arrears.plans.oracle_base import D, LOAN_MONTH_PANEL, with_
from arrears.plans.registry import register
from arrears.sources import macro as M
from arrears.sources import panel as P

MACRO_SQL = f"""
daily AS (SELECT CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) / {D(49999)} AS dgs10
          FROM orders GROUP BY 1),
unrate_m AS (SELECT date, CASE WHEN month(date) % 5 <> 0 THEN v END AS unrate FROM (
               SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, avg(o_totalprice) / {D(29989)} AS v
               FROM orders GROUP BY 1)),
cpi_m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, avg(o_totalprice) / {D(997)} AS cpi
          FROM orders GROUP BY 1),
gdp_q AS (SELECT CAST(date_trunc('quarter', o_orderdate) AS DATE) AS date, avg(o_totalprice) / {D(10007)} AS gdp
          FROM orders GROUP BY 1),
state_m AS (SELECT strftime(o.o_orderdate, '%Y-%m') AS ym, n.n_name AS state,
                   avg(o.o_totalprice) / {D(29989)} AS state_unrate
            FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
            JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY 1, 2),
dgs_m AS (SELECT CAST(date_trunc('month', date) AS DATE) AS date, avg(dgs10) AS dgs10 FROM daily GROUP BY 1),
dgs_spine AS (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 MONTH)) AS DATE) AS date FROM dgs_m),
dgs_resampled AS (SELECT s.date, m.dgs10 FROM dgs_spine s LEFT JOIN dgs_m m USING (date)),
cpi_yoy AS (
  SELECT date, cpi,
         (ff / lag(ff, 12) OVER (ORDER BY date)) * 100.0 - 100.0 AS cpi_yoy
  FROM (SELECT date, cpi, last_value(cpi IGNORE NULLS) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS ff
        FROM cpi_m)),
gdp_spine AS (SELECT CAST(unnest(generate_series(min(date), CAST(max(date) + INTERVAL 3 MONTH AS DATE), INTERVAL 1 MONTH)) AS DATE) AS date FROM gdp_q),
gdp_ff AS (SELECT s.date, last_value(q.gdp IGNORE NULLS) OVER (ORDER BY s.date ROWS UNBOUNDED PRECEDING) AS gdp
           FROM gdp_spine s LEFT JOIN gdp_q q USING (date)),
gdp_yoy AS (
  SELECT date, gdp,
         (ff / lag(ff, 12) OVER (ORDER BY date)) * 100.0 - 100.0 AS gdp_yoy
  FROM (SELECT date, gdp, last_value(gdp IGNORE NULLS) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS ff
        FROM gdp_ff)),
nat AS (
  SELECT COALESCE(a.ym, b.ym, c.ym) AS ym, a.nat_10y_rate, b.nat_unrate, c.nat_gdp_yoy
  FROM (SELECT strftime(date, '%Y-%m') AS ym, dgs10 AS nat_10y_rate FROM dgs_resampled) a
  FULL JOIN (SELECT strftime(date, '%Y-%m') AS ym, unrate AS nat_unrate FROM unrate_m) b ON a.ym = b.ym
  FULL JOIN (SELECT strftime(date, '%Y-%m') AS ym, gdp_yoy AS nat_gdp_yoy FROM gdp_yoy) c
    ON COALESCE(a.ym, b.ym) = c.ym)"""

LAGGED_MACRO_SQL = MACRO_SQL + """,
unrate_l AS (SELECT CAST(date + INTERVAL 3 MONTH AS DATE) AS period_dt, unrate AS unrate_lag3 FROM unrate_m),
cpi_l AS (SELECT CAST(date + INTERVAL 3 MONTH AS DATE) AS period_dt, cpi_yoy AS cpi_yoy_lag3 FROM cpi_yoy),
dgs_l AS (SELECT CAST(date + INTERVAL 3 MONTH AS DATE) AS period_dt, dgs10 AS dgs10_lag3 FROM dgs_m),
state_l AS (SELECT CAST(CAST(ym || '-01' AS DATE) + INTERVAL 3 MONTH AS DATE) AS period_dt, state AS state_code,
                   state_unrate AS state_ur_lag3 FROM state_m)"""

ASOF_SQL = LOAN_MONTH_PANEL + "," + LAGGED_MACRO_SQL + """,
asof1 AS (SELECT p.*, u.unrate_lag3 FROM panel p ASOF LEFT JOIN unrate_l u ON p.period_dt >= u.period_dt),
asof2 AS (SELECT p.*, c.cpi_yoy_lag3 FROM asof1 p ASOF LEFT JOIN cpi_l c ON p.period_dt >= c.period_dt),
asof3 AS (SELECT p.*, d.dgs10_lag3 FROM asof2 p ASOF LEFT JOIN dgs_l d ON p.period_dt >= d.period_dt),
macro_panel AS (
  SELECT p.*, COALESCE(s.state_ur_lag3, p.unrate_lag3) AS state_ur_lag3
  FROM asof3 p LEFT JOIN state_l s ON p.period_dt = s.period_dt AND p.state = s.state_code)"""


@register("macro_monthly_mean", dbl=["dgs10"], sql=with_(MACRO_SQL) + """
SELECT strftime(date, '%Y-%m') AS ym, dgs10 FROM dgs_resampled""")
def macro_monthly_mean(spark, sf_dir):
    m = M.monthly_mean(M.daily_rate(spark, sf_dir), "dgs10", fill_empty_months=True)
    return m.select(F.date_format("date", "yyyy-MM").alias("ym"), "dgs10")


@register("macro_national", dbl=["nat_10y_rate", "nat_unrate", "nat_gdp_yoy"], sql=with_(MACRO_SQL) + """
SELECT * FROM nat""")
def macro_national(spark, sf_dir):
    return M.national_macro(spark, sf_dir)


@register("yoy_change", dbl=["cpi", "cpi_yoy"], sql=with_(MACRO_SQL) + """
SELECT strftime(date, '%Y-%m') AS ym, cpi, cpi_yoy FROM cpi_yoy""")
def yoy_change(spark, sf_dir):
    s = M.yoy_change(M.monthly_cpi(spark, sf_dir), "cpi", "cpi_yoy")
    return s.select(F.date_format("date", "yyyy-MM").alias("ym"), "cpi", "cpi_yoy")


@register("quarterly_ffill_yoy", dbl=["gdp", "gdp_yoy"], sql=with_(MACRO_SQL) + """
SELECT strftime(date, '%Y-%m') AS ym, gdp, gdp_yoy FROM gdp_yoy""")
def quarterly_ffill_yoy(spark, sf_dir):
    q = M.quarterly_to_monthly_ffill(M.quarterly_gdp(spark, sf_dir), "gdp")
    s = M.yoy_change(q, "gdp", "gdp_yoy")
    return s.select(F.date_format("date", "yyyy-MM").alias("ym"), "gdp", "gdp_yoy")


@register("macro_outer_merge", dbl=["unrate", "cpi_yoy", "dgs10"], sql=with_(MACRO_SQL) + """
SELECT COALESCE(a.ym, b.ym, c.ym) AS ym, a.unrate, b.cpi_yoy, c.dgs10
FROM (SELECT strftime(date, '%Y-%m') AS ym, unrate FROM unrate_m) a
FULL JOIN (SELECT strftime(date, '%Y-%m') AS ym, cpi_yoy FROM cpi_yoy) b ON a.ym = b.ym
FULL JOIN (SELECT strftime(date, '%Y-%m') AS ym, dgs10 FROM dgs_m) c ON COALESCE(a.ym, b.ym) = c.ym""")
def macro_outer_merge(spark, sf_dir):
    un = M.monthly_unrate(spark, sf_dir).select(F.date_format("date", "yyyy-MM").alias("ym"), "unrate")
    cpi = M.yoy_change(M.monthly_cpi(spark, sf_dir), "cpi", "cpi_yoy") \
        .select(F.date_format("date", "yyyy-MM").alias("ym"), "cpi_yoy")
    dgs = M.monthly_mean(M.daily_rate(spark, sf_dir), "dgs10", fill_empty_months=False) \
        .select(F.date_format("date", "yyyy-MM").alias("ym"), "dgs10")
    return M.outer_merge([un, cpi, dgs], "ym")


def c_macro_panel(spark, sf_dir):
    panel = P.loan_month_panel(spark, sf_dir).select("asset_number", "period", "period_dt", "state")
    return FE.join_c_macro(panel, spark, sf_dir, FE.FIXTURE.macro_lag)


@register("asof_macro", dbl=["unrate_lag3", "cpi_yoy_lag3", "dgs10_lag3"], sql=with_(ASOF_SQL) + """
SELECT asset_number, period, unrate_lag3, cpi_yoy_lag3, dgs10_lag3 FROM macro_panel""")
def asof_macro(spark, sf_dir):
    return c_macro_panel(spark, sf_dir).select("asset_number", "period", "unrate_lag3", "cpi_yoy_lag3",
                                               "dgs10_lag3")


@register("state_macro_fallback", dbl=["state_ur_lag3"], sql=with_(ASOF_SQL) + """
SELECT asset_number, period, state, state_ur_lag3 FROM macro_panel""")
def state_macro_fallback(spark, sf_dir):
    return c_macro_panel(spark, sf_dir).select("asset_number", "period", "state", "state_ur_lag3")


@register("macro_coverage", dbl=["unrate_lag3_pct", "dgs10_lag3_pct", "cpi_yoy_lag3_pct", "state_ur_lag3_pct"],
          sql=with_(ASOF_SQL) + """
SELECT avg(CAST(unrate_lag3 IS NOT NULL AS DOUBLE)) * 100.0 AS unrate_lag3_pct,
       avg(CAST(dgs10_lag3 IS NOT NULL AS DOUBLE)) * 100.0 AS dgs10_lag3_pct,
       avg(CAST(cpi_yoy_lag3 IS NOT NULL AS DOUBLE)) * 100.0 AS cpi_yoy_lag3_pct,
       avg(CAST(state_ur_lag3 IS NOT NULL AS DOUBLE)) * 100.0 AS state_ur_lag3_pct
FROM macro_panel""")
def macro_coverage(spark, sf_dir):
    return MJ.coverage(c_macro_panel(spark, sf_dir), ["unrate_lag3", "dgs10_lag3", "cpi_yoy_lag3", "state_ur_lag3"])


def _state_files(spark, sf_dir):
    from arrears.sources import sinks as K
    return M.write_state_files(M.state_monthly(spark, sf_dir), K.fresh_path(spark, "state_series"))


@register("macro_state_by_file", dbl=["state_unrate"], sql=with_(MACRO_SQL) + """
SELECT ym, state, state_unrate FROM state_m""")
def macro_state_by_file(spark, sf_dir):
    from arrears.sources.tables import read_table
    dim = read_table(spark, sf_dir, "nation", "n_name").select(
        F.col("n_name").alias("state_name"), F.col("n_name").alias("state"))
    return M.read_state_by_file(spark, _state_files(spark, sf_dir), dim)


@register("macro_state", dbl=["state_unrate"], sql=with_(MACRO_SQL) + """
SELECT ym, state, state_unrate FROM state_m""")
def macro_state(spark, sf_dir):
    return M.read_state_by_header(spark, _state_files(spark, sf_dir))
