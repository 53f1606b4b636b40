"""Sources and cleaning scalars over the whole property sheet."""

from __future__ import annotations

from pyspark.sql import functions as F

from arrears.functions import columns as C
from arrears.operators.reports import one_row_join
from arrears.plans.oracle_base import (CLEAN_PROPERTY_ROWS, D, LOAN_MONTH_PANEL, RAW_PROPERTY_ROWS,
                                       serial_text_sql, with_, zip_sql)
from arrears.plans.registry import register
from arrears.sources import panel as P
from arrears.sources import sheets as SH
from arrears.sources import sinks as K

PANEL_DBL = ["orig_amount", "orig_term", "orig_amort_term", "orig_rate", "rate_type_code",
             "io_term", "io_flag", "balloon_flag", "grace_days", "year_built", "valuation",
             "sq_feet", "ltv_orig", "occ_orig", "noi_orig", "dscr_orig", "ltv_curr", "dscr_curr",
             "occ_curr"]
MONEY = {"sched_balance": 6, "gross_balance": 6, "appraisal_curr": 6}


def _panel_out(df):
    return df.withColumn("period_dt", F.date_format("period_dt", "yyyy-MM-dd"))


@register("scan_panel", dbl={**{c: 9 for c in PANEL_DBL}, **MONEY}, sql=with_(LOAN_MONTH_PANEL) + """
SELECT * REPLACE (strftime(period_dt, '%Y-%m-%d') AS period_dt,
                  CAST(default_flag AS BIGINT) AS default_flag,
                  CAST(first_due_serial AS BIGINT) AS first_due_serial,
                  CAST(maturity_serial AS BIGINT) AS maturity_serial)
FROM panel""")
def scan_panel(spark, sf_dir):
    return _panel_out(P.loan_month_panel(spark, sf_dir))


RAW_DBL = ["original_balance", "original_term", "interest_rate_orig", "io_term_months",
           "balance_begin", "interest_rate_curr", "balance_end", "appraisal_orig",
           "appraisal_current", "occupancy_orig", "noi_orig", "dscr_orig", "occupancy_current",
           "noi_current", "dscr_current"]


@register("scan_positional", dbl=RAW_DBL, sql=with_(RAW_PROPERTY_ROWS) + """
SELECT * EXCLUDE (row_order) REPLACE (CAST(default_flag AS BIGINT) AS default_flag),
       row_order.o AS l_orderkey, CAST(row_order.l AS BIGINT) AS l_linenumber, row_order.p AS l_partkey
FROM raw_props""")
def scan_positional(spark, sf_dir):
    df = P.raw_property_rows(spark, sf_dir)
    return df.select(*[c for c in df.columns if c != "row_order"],
                     F.col("row_order.l_orderkey").alias("l_orderkey"),
                     F.col("row_order.l_linenumber").alias("l_linenumber"),
                     F.col("row_order.l_partkey").alias("l_partkey"))


SHEET_NUM = ["default_flag", "orig_amount", "orig_term", "orig_rate", "io_term", "ltv_orig", "occ_orig", "dscr_orig",
             "ltv_curr", "dscr_curr", "occ_curr", "maturity_serial"]


@register("sheet_panel", dbl=SHEET_NUM, sql=with_(LOAN_MONTH_PANEL) + f"""
SELECT CAST(asset_number AS VARCHAR) AS asset_number, period, strftime(period_dt, '%Y-%m-%d') AS period_dt, property_type, state,
       {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in SHEET_NUM)}
FROM panel""")
def sheet_panel(spark, sf_dir):
    """The panel through its wide sheet: written, and read by the name whitelist."""
    path = SH.write_panel_sheet(P.loan_month_panel(spark, sf_dir), K.fresh_path(spark, "panel-sheet"))
    return _panel_out(SH.read_panel_sheet(spark, path)).select(
        "asset_number", "period", "period_dt", "property_type", "state", *SHEET_NUM)


@register("sheet_positional", dbl=["original_balance", "balance_end", "noi_current", "dscr_current"], sql=with_(RAW_PROPERTY_ROWS) + f"""
SELECT asset_number, report_period, payment_status, state, property_type, {zip_sql("zip_code")} AS zip_code,
       CAST(original_balance AS DOUBLE) AS original_balance, CAST(balance_end AS DOUBLE) AS balance_end,
       CAST(noi_current AS DOUBLE) AS noi_current, CAST(dscr_current AS DOUBLE) AS dscr_current,
       CAST(default_flag AS BIGINT) AS default_flag, count(*) OVER (PARTITION BY 1) AS n_places
FROM raw_props""")
def sheet_positional(spark, sf_dir):
    """The property sheet written, and read by column position; ``n_places``
    counts the distinct places of its rows in the input."""
    path = SH.write_positional_sheet(P.raw_property_rows(spark, sf_dir), K.fresh_path(spark, "property-sheet"))
    df = SH.read_positional_sheet(spark, path)
    rows = df.select("asset_number", "report_period", "payment_status", "state", "property_type", C.clean_zip("zip_code").alias("zip_code"),
                     *[C.coerce_numeric(F.col(c)).alias(c) for c in ("original_balance", "balance_end", "noi_current", "dscr_current")],
                     F.col("default_flag").cast("long").alias("default_flag"))
    return one_row_join(rows, df.agg(F.count_distinct("row_order").alias("n_places")))


@register("period_parse", sql=with_(LOAN_MONTH_PANEL) + """
SELECT DISTINCT period, strftime(TRY_CAST(period || '-01' AS DATE), '%Y-%m-%d') AS period_dt FROM panel""")
def period_parse(spark, sf_dir):
    p = P.loan_month_panel(spark, sf_dir).select("period").distinct()
    return p.select("period", F.date_format(C.period_to_date("period"), "yyyy-MM-dd").alias("period_dt"))


@register("excel_serial_date", sql=with_(LOAN_MONTH_PANEL) + """
SELECT DISTINCT CAST(maturity_serial AS BIGINT) AS maturity_serial,
       strftime(DATE '1899-12-30' + CAST(maturity_serial AS INTEGER), '%Y-%m-%d') AS maturity_dt
FROM panel""")
def excel_serial_date(spark, sf_dir):
    p = P.loan_month_panel(spark, sf_dir).select("maturity_serial").distinct()
    return p.select("maturity_serial",
                    F.date_format(C.excel_serial_to_date("maturity_serial"), "yyyy-MM-dd").alias("maturity_dt"))


@register("mixed_date_text", sql=with_(RAW_PROPERTY_ROWS) + f"""
SELECT DISTINCT origination_date AS raw_origination, maturity_date AS raw_maturity,
       {serial_text_sql('origination_date')} AS origination_date,
       {serial_text_sql('maturity_date')} AS maturity_date
FROM raw_props""")
def mixed_date_text(spark, sf_dir):
    r = P.raw_property_rows(spark, sf_dir).select("origination_date", "maturity_date").distinct()
    return r.select(F.col("origination_date").alias("raw_origination"),
                    F.col("maturity_date").alias("raw_maturity"),
                    C.mixed_date_text("origination_date").alias("origination_date"),
                    C.mixed_date_text("maturity_date").alias("maturity_date"))


@register("coerce_numeric", dbl=["zip_number", "noi_number"], sql=with_(RAW_PROPERTY_ROWS) + """
SELECT zip_code AS raw_text, TRY_CAST(zip_code AS DOUBLE) AS zip_number,
       CAST(count(*) AS BIGINT) AS n_rows, sum(TRY_CAST(CAST(noi_current AS VARCHAR) AS DOUBLE)) AS noi_number
FROM raw_props GROUP BY zip_code""")
def coerce_numeric(spark, sf_dir):
    r = P.raw_property_rows(spark, sf_dir)
    return (r.groupBy(F.col("zip_code").alias("raw_text"))
             .agg(F.count(F.lit(1)).alias("n_rows"),
                  F.sum(C.coerce_numeric("noi_current")).alias("noi_number"))
             .withColumn("zip_number", C.coerce_numeric("raw_text")))


@register("coerce_bool", sql=with_(RAW_PROPERTY_ROWS) + """
SELECT DISTINCT is_io AS raw_is_io, payment_status AS raw_status,
       COALESCE(lower(is_io) = 'true', false) AS is_io,
       COALESCE(lower(payment_status) = 'true', false) AS status_bool
FROM raw_props""")
def coerce_bool(spark, sf_dir):
    r = P.raw_property_rows(spark, sf_dir).select("is_io", "payment_status").distinct()
    return r.select(F.col("is_io").alias("raw_is_io"), F.col("payment_status").alias("raw_status"),
                    C.coerce_bool("is_io").alias("is_io"),
                    C.coerce_bool("payment_status").alias("status_bool"))


@register("period_parts", sql=with_(RAW_PROPERTY_ROWS) + """
SELECT DISTINCT report_period,
       CAST(TRY_CAST(substr(report_period, 1, 4) AS INTEGER) AS BIGINT) AS year,
       CAST(TRY_CAST(substr(report_period, 6, 2) AS INTEGER) AS BIGINT) AS month,
       CAST(floor((TRY_CAST(substr(report_period, 6, 2) AS INTEGER) - 1) / 3) + 1 AS BIGINT) AS quarter
FROM raw_props""")
def period_parts(spark, sf_dir):
    r = P.raw_property_rows(spark, sf_dir).select("report_period").distinct()
    m = C.period_month("report_period")
    return r.select("report_period", C.period_year("report_period").alias("year"),
                    m.alias("month"), C.quarter_of_month(m).alias("quarter"))


@register("clean_zip", sql=with_(RAW_PROPERTY_ROWS) + f"""
SELECT zip_code AS raw_zip, {zip_sql('zip_code')} AS zip5, CAST(count(*) AS BIGINT) AS n_rows
FROM raw_props GROUP BY zip_code""")
def clean_zip(spark, sf_dir):
    r = P.raw_property_rows(spark, sf_dir)
    return (r.groupBy(F.col("zip_code").alias("raw_zip")).agg(F.count(F.lit(1)).alias("n_rows"))
             .withColumn("zip5", C.clean_zip("raw_zip")))


@register("guarded_ratio", dbl=["ltv_orig", "ltv_current"], sql=with_(CLEAN_PROPERTY_ROWS) + """
SELECT row_order.o AS l_orderkey, CAST(row_order.l AS BIGINT) AS l_linenumber, row_order.p AS l_partkey,
       ltv_orig, ltv_current FROM props""")
def guarded_ratio(spark, sf_dir):
    r = P.property_rows(spark, sf_dir)
    return r.select(F.col("row_order.l_orderkey").alias("l_orderkey"),
                    F.col("row_order.l_linenumber").alias("l_linenumber"),
                    F.col("row_order.l_partkey").alias("l_partkey"), "ltv_orig", "ltv_current")


@register("loan_uid", sql=with_(CLEAN_PROPERTY_ROWS) + """
SELECT loan_uid, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT report_period) AS BIGINT) AS n_months
FROM props GROUP BY loan_uid""")
def loan_uid(spark, sf_dir):
    r = P.property_rows(spark, sf_dir)
    return r.groupBy("loan_uid").agg(F.count(F.lit(1)).alias("n_rows"),
                                     F.countDistinct("report_period").alias("n_months"))


IO_TEXT, TERM_TEXT = "{} % 7 = 3", "{} % 11 = 5"      # line numbers and part keys of rows whose number is text


@register("payment_type_lenient", sql=with_(CLEAN_PROPERTY_ROWS) + f"""
, texts AS (SELECT is_io, CASE WHEN {IO_TEXT.format('row_order.l')} THEN 'n/a' ELSE CAST(io_term_months AS VARCHAR) END AS io_text,
                   CASE WHEN {TERM_TEXT.format('row_order.p')} THEN 'x' ELSE CAST(original_term AS VARCHAR) END AS term_text FROM props),
nums AS (SELECT *, COALESCE(TRY_CAST(io_text AS DOUBLE), 0) AS io, COALESCE(TRY_CAST(term_text AS DOUBLE), 0) AS term FROM texts)
SELECT io_text = 'n/a' AS io_bad, term_text = 'x' AS term_bad,
       CASE WHEN io_text = 'n/a' OR term_text = 'x' THEN 'Other'
            WHEN is_io OR (io > 0 AND term > 0 AND io >= term * {D(C.IO_SHARE_OF_TERM)}) THEN 'Interest-Only'
            WHEN io > 0 THEN 'Partial IO' ELSE 'Amortizing' END AS payment_type,
       CAST(count(*) AS BIGINT) AS n
FROM nums GROUP BY ALL""")
def payment_type_lenient(spark, sf_dir):
    """Without a payment type column, numbers that cannot be read give 'Other'."""
    r = P.property_rows(spark, sf_dir)
    io = F.when(F.expr(IO_TEXT.format("row_order.l_linenumber")), "n/a").otherwise(F.col("io_term_months").cast("string"))
    term = F.when(F.expr(TERM_TEXT.format("row_order.l_partkey")), "x").otherwise(F.col("original_term").cast("string"))
    t = r.select("is_io", io.alias("io"), term.alias("term"))
    return t.select((F.col("io") == "n/a").alias("io_bad"), (F.col("term") == "x").alias("term_bad"),
                    C.payment_type_lenient("is_io", "io", "term").alias("payment_type")).groupBy("io_bad", "term_bad", "payment_type").agg(F.count(F.lit(1)).alias("n"))


@register("payment_type", sql=with_(CLEAN_PROPERTY_ROWS) + """
SELECT DISTINCT asset_number, is_io, io_term_months, original_term, payment_type FROM props""",
          dbl=["io_term_months", "original_term"])
def payment_type(spark, sf_dir):
    r = P.property_rows(spark, sf_dir)
    return r.select("asset_number", "is_io", "io_term_months", "original_term", "payment_type").distinct()
