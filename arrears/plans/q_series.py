"""Sheet-per-file series with planted faults (S4, S5, S6, U1), and row samples (M7, M8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from arrears.operators import sampling as SM
from arrears.plans.oracle_base import with_
from arrears.plans.q_macro import MACRO_SQL
from arrears.plans.q_metrics import SCORED_SQL, scored
from arrears.plans.registry import register
from arrears.sources import macro as M
from arrears.sources import series as SE
from arrears.sources.scratch import fresh_path

# The fixture's nations stand for the first states of the dimension, by number.
STATES = sorted(M.US_STATE_CODES.items())
NATIONS = 25
_VALUES = ", ".join(f"({i}, '{name}', '{code}')" for i, (name, code) in enumerate(STATES[:NATIONS]))
STATE_SQL = MACRO_SQL + f""",
state_names(i, us_name, us_code) AS (VALUES {_VALUES}),
us_state_m AS (SELECT ym, us_code AS state, state_unrate FROM state_m JOIN nation ON n_name = state JOIN state_names ON i = n_nationkey)"""
# Planted: a state that the dimension lacks, a lock file, a file without header.
PLANTED = [("Unemployment Rate in Atlantis", "title\nDATE,ATUR\n1990-01-01,1.5\nnot a date,2\n1990-02-01,."),
           ("~$Unemployment Rate in Texas", "date,TXUR\n1990-01-01,9"),
           ("Unemployment Rate in Texas (copy)", "\\x00\\x01 no sheet")]


def _state_folder(spark, sf_dir):
    names = spark.createDataFrame([(i, *s) for i, s in enumerate(STATES[:NATIONS])], "i long, us_name string, us_code string")
    nation = spark.read.parquet(f"{sf_dir.rstrip('/')}/nation.parquet").select(F.col("n_name").alias("state"), F.col("n_nationkey").alias("i"))
    us = M.state_monthly(spark, sf_dir).withColumn("date", F.concat("ym", F.lit("-01"))).join(F.broadcast(nation), "state").join(F.broadcast(names), "i")
    sheets = SE.sheet_text(us, F.concat(F.lit("Unemployment Rate in "), "us_name"), F.concat("us_code", F.lit("UR")), "date", "state_unrate", ["us_name", "us_code"])
    return SE.write_sheets(sheets.unionByName(spark.createDataFrame(PLANTED, "name string, content string")), fresh_path(spark, "state-sheets"))


@register("series_state_by_header", dbl=["state_unrate"], sql=with_(STATE_SQL) + """
SELECT * FROM us_state_m UNION ALL SELECT '1990-01', 'AT', 1.5 UNION ALL SELECT '1990-02', 'AT', NULL""")
def series_state_by_header(spark, sf_dir):
    """Any readable sheet counts; its header names the state."""
    return SE.state_by_header(SE.scan_sheets(spark, _state_folder(spark, sf_dir)))


@register("series_state_by_name", dbl=["state_unrate"], sql=with_(STATE_SQL) + """
SELECT * FROM us_state_m""")
def series_state_by_name(spark, sf_dir):
    """Only names that the state dimension holds."""
    return SE.state_by_name(SE.scan_sheets(spark, _state_folder(spark, sf_dir)), M.us_state_dim(spark))


@register("series_file_report", sql=with_(STATE_SQL) + """
SELECT 'read' AS status, CAST(count(DISTINCT state) AS BIGINT) AS n_files FROM us_state_m
UNION ALL SELECT unnest(['temporary', 'unreadable', 'unknown name']), 1""")
def series_file_report(spark, sf_dir):
    """What was read and what was left out, and why."""
    return SE.file_report(SE.with_state_names(SE.scan_sheets(spark, _state_folder(spark, sf_dir)), M.us_state_dim(spark)))


def _national_folder(spark, sf_dir):
    """Two of the three national series; the GDP sheet is not there."""
    daily = M.daily_rate(spark, sf_dir).withColumn("k", F.lit("DGS10")).withColumnRenamed("dgs10", "v")
    un = M.monthly_unrate(spark, sf_dir).withColumn("k", F.lit("UNRATE")).withColumnRenamed("unrate", "v")
    return SE.write_sheets(SE.sheet_text(daily.unionByName(un), F.col("k"), F.col("k"), "date", "v", ["k"]), fresh_path(spark, "national-sheets"))


@register("series_national", dbl=["nat_10y_rate", "nat_unrate", "nat_gdp_yoy"], sql=with_(MACRO_SQL) + """
SELECT COALESCE(a.ym, b.ym) AS ym, nat_10y_rate, nat_unrate, CAST(NULL AS DOUBLE) AS nat_gdp_yoy
FROM (SELECT strftime(date, '%Y-%m') AS ym, dgs10 AS nat_10y_rate FROM dgs_resampled) a
FULL JOIN (SELECT strftime(date, '%Y-%m') AS ym, unrate AS nat_unrate FROM unrate_m) b ON a.ym = b.ym""")
def series_national(spark, sf_dir):
    """S4 with an absent series: skipped in the merge, a NULL column for who joins."""
    return SE.with_all_national(SE.national(spark, _national_folder(spark, sf_dir)), spark)


N_SEEDED, N_HEAD = 2000, 1000        # fixed values: rows that the reference explains


@register("sample_head", dbl=["score"], sql=with_(SCORED_SQL) + f"""
SELECT asset_number, period, score FROM scored ORDER BY asset_number, period LIMIT {N_HEAD}""")
def sample_head(spark, sf_dir):
    """M8."""
    return SM.head_sample(scored(spark, sf_dir), ["asset_number", "period"], N_HEAD).select("asset_number", "period", "score")


@register("sample_seeded", sql=with_(SCORED_SQL) + f"""
SELECT least({N_SEEDED}, count(*)) AS n_rows, least({N_SEEDED}, count(*)) AS n_distinct, least({N_SEEDED}, count(*)) AS n_of_table, true AS same_again FROM scored""")
def sample_seeded(spark, sf_dir):
    """M7: what holds for any draw without replacement, and that a draw can be repeated."""
    rows = scored(spark, sf_dir)
    keys = ["asset_number", "period"]
    one = SM.seeded_sample(rows, keys, N_SEEDED).select(*keys)
    two = SM.seeded_sample(rows.repartition(3), keys, N_SEEDED).select(*keys, F.lit(True).alias("again"))
    there = rows.select(*keys, F.lit(True).alias("there"))
    both = one.join(two, keys, "left").join(there, keys, "left")
    return both.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(*keys).alias("n_distinct"), F.count("there").alias("n_of_table"),
                    (F.count("again") == F.count(F.lit(1))).alias("same_again"))
