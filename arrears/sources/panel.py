"""Loan panels bound to the test tables.

One line item plays one property row, one supplier one loan, and the ship
month the report month (see FIXTURES.md, part B).  Two panels come out:

* ``raw_property_rows`` / ``clean_property_rows``: the property-month sheet
  (several rows per loan-month) with text-typed, partly dirty columns, and
  its cleaned form with a composite ``loan_uid``.
* ``loan_month_panel``: the wide loan-month panel, one row per
  (``asset_number``, ``period``), rolled up from the property rows.

Scale notes: lineitem is joined to part (by part key) and supplier (by
supplier key) with no hint, so the planner picks sort-merge or broadcast
from the sizes it sees; only ``nation`` (25 rows by definition) is
broadcast explicitly.  The loan-month rollup is a partial aggregation, so
a loan holding a third of all rows is combined map-side before the
shuffle and its groups are at most one row per month afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arrears.functions import columns as C
from arrears.sources.tables import read_table

# Binding constants (fixture rules, FIXTURES.md B1).
FLAG_DISCOUNT = 0.095
FLAG_QUANTITY = 48
LTV_SCALE = 60000.0
# p_type word -> property type code used by the fixed one-hot list.
PTYPE_TO_CODE = {"ECONOMY": "RT", "LARGE": "OF", "MEDIUM": "LO", "PROMO": "MF",
                 "SMALL": "SS", "STANDARD": "MU"}
SERIAL_1994 = 34335               # serial day of 1994-01-01

# Total order of property rows inside a loan-month ("input order").
ROW_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]


def _property_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey",
                    "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
                    "l_returnflag", "l_linestatus", "l_shipdate")
    part = read_table(spark, sf_dir, "part", "p_partkey", "p_type", "p_retailprice", "p_size")
    supp = read_table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey")
    nation = read_table(spark, sf_dir, "nation", "n_nationkey", "n_name")
    supp_state = supp.join(F.broadcast(nation), supp.s_nationkey == nation.n_nationkey)
    return (li.join(part, li.l_partkey == part.p_partkey)
              .join(supp_state, li.l_suppkey == supp_state.s_suppkey))


def default_flag_expr() -> Column:
    return ((F.col("l_returnflag") == "R") & (F.col("l_discount") >= FLAG_DISCOUNT)
            & (F.col("l_quantity") >= FLAG_QUANTITY)).cast("int")


def _raw_zip() -> Column:
    pk = F.col("l_partkey").cast("string")
    k = F.col("l_partkey") % 6
    return (F.when(k == 0, pk)
            .when(k == 1, F.concat(pk, F.lit("-"), F.lpad(F.col("l_linenumber").cast("string"), 4, "0")))
            .when(k == 2, F.concat(pk, F.lit(".0")))
            .when(k == 3, F.concat(F.lit(" "), pk, F.lit(" ")))
            .when(k == 4, F.lit(""))
            .when(F.col("l_linenumber") % 2 == 0, F.lit(None).cast("string"))
            .otherwise(F.lit("n/a")))


def _raw_serial_or_text(offset_days: Column) -> Column:
    """Every fifth loan carries ISO text, the rest a serial day number."""
    serial = F.lit(SERIAL_1994) + offset_days
    text = F.date_format(F.date_add(F.lit("1899-12-30").cast("date"), serial.cast("int")), "yyyy-MM-dd")
    return F.when(F.col("l_suppkey") % 5 == 0, text).otherwise(serial.cast("string"))


def _loan_text() -> tuple[Column, Column]:
    """Text keys of a loan: ``asset_left`` and ``cik``."""
    return F.col("l_suppkey").cast("string"), (F.lit(1000000) + F.col("s_nationkey")).cast("string")


def raw_property_rows(spark: SparkSession, sf_dir: str, by_loan_month: bool = False) -> DataFrame:
    """Property-month sheet: 28 named columns, dirty text where a sheet has it.
    ``by_loan_month`` adds ``ac_key`` and brings the rows of a loan-month to one
    task while they are still the few narrow columns of the tables."""
    base, extra = _property_base(spark, sf_dir), []
    left, cik = _loan_text()
    month = F.date_format("l_shipdate", "yyyy-MM")
    if by_loan_month:
        base = base.withColumns({"ac_key": F.concat_ws("_", left, cik), "_month": month}).repartition("ac_key", "_month")
        month, extra = F.col("_month"), ["ac_key"]
    s = F.col("l_suppkey")
    start = s % 365
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    rate_orig = F.lit(0.03) + (s % 5) * F.lit(0.005)
    return base.select(
        s.cast("string").alias("asset_number"),
        _raw_serial_or_text(start).alias("origination_date"),
        (F.lit(250500.0) + (s % 50) * F.lit(12500.0)).alias("original_balance"),
        (F.lit(36) + (s % 8) * 12).cast("double").alias("original_term"),
        _raw_serial_or_text(start + (F.lit(3) + s % 8) * 365).alias("maturity_date"),
        rate_orig.alias("interest_rate_orig"),
        ((s % 4) * 12).cast("double").alias("io_term_months"),
        F.concat(F.lit("PT"), (s % 3).cast("string")).alias("payment_type_code"),
        F.when(s % 3 == 0, F.lit("True")).otherwise(F.lit("False")).alias("is_io"),
        F.col("l_extendedprice").alias("balance_begin"),
        (rate_orig + F.col("l_tax") / 10).alias("interest_rate_curr"),
        net.alias("balance_end"),
        F.col("l_linestatus").alias("payment_status"),
        F.col("n_name").alias("state"),
        _raw_zip().alias("zip_code"),
        F.col("p_type").alias("property_type"),
        (F.col("p_retailprice") * 100).alias("appraisal_orig"),
        F.when(F.col("l_tax") > 0, F.col("l_quantity") * F.col("p_retailprice")).alias("appraisal_current"),
        (F.lit(0.85) + (s % 10) / 100.0).alias("occupancy_orig"),
        (F.col("p_retailprice") * 8).alias("noi_orig"),
        (F.lit(1.0) + F.col("p_size") / 100.0).alias("dscr_orig"),
        F.when(F.col("l_quantity") > 2, F.col("l_quantity") / 50).alias("occupancy_current"),
        F.when(F.col("l_tax") > 0, net * 0.1).alias("noi_current"),
        F.when(F.col("l_tax") != 0, F.lit(0.4) + 15 * F.col("l_tax")).alias("dscr_current"),
        left.alias("asset_left"),
        cik.alias("cik"),
        month.alias("report_period"),
        default_flag_expr().alias("default_flag"),
        F.struct(*[F.col(c) for c in ROW_ORDER]).alias("row_order"),
        *extra,
    )


def clean_property_rows(raw: DataFrame) -> DataFrame:
    """Typed, cleaned property rows with ``loan_uid`` and ``payment_type``."""
    num = ["original_balance", "original_term", "interest_rate_orig", "io_term_months",
           "balance_begin", "interest_rate_curr", "balance_end", "appraisal_orig",
           "appraisal_current", "occupancy_orig", "noi_orig", "dscr_orig",
           "occupancy_current", "noi_current", "dscr_current"]
    df = raw.withColumns({
        "origination_date": C.mixed_date_text("origination_date"),
        "maturity_date": C.mixed_date_text("maturity_date"),
        **C.coerce_numeric_cols(raw, num),
        "default_flag": (C.coerce_flag_int("default_flag") if dict(raw.dtypes)["default_flag"] == "string"
                         else F.coalesce(F.col("default_flag"), F.lit(0)).cast("int")),
        "is_io": C.coerce_bool("is_io"),
        "year": C.period_year("report_period"),
        "month": C.period_month("report_period"),
        "zip_code": C.clean_zip("zip_code"),
    })
    df = df.withColumns({
        "ltv_orig": C.guarded_ratio("original_balance", "appraisal_orig"),
        "ltv_current": C.guarded_ratio("balance_end", "appraisal_current"),
        "loan_uid": C.loan_uid("origination_date", "maturity_date", "zip_code",
                               "property_type", "original_balance"),
    })
    return df.withColumn("payment_type",
                         C.payment_type("is_io", "io_term_months", "original_term"))


def property_rows(spark: SparkSession, sf_dir: str, by_loan_month: bool = False) -> DataFrame:
    return clean_property_rows(raw_property_rows(spark, sf_dir, by_loan_month))


def loan_month_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide loan-month panel: key (asset_number, period), 29 clean names.

    Measures are built from exact integer sums (cents, percentage points,
    units) and one final division, so the result does not depend on the
    order in which partial sums are merged."""
    base = _property_base(spark, sf_dir)
    # Exact integer units: cents, percentage points, 1e-4 dollars for net amounts.
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    disc_pp = F.round(F.col("l_discount") * 100).cast("long")
    tax_pp = F.round(F.col("l_tax") * 100).cast("long")
    net_u = cents * (F.lit(100) - disc_pp)
    qty = F.col("l_quantity").cast("long")
    retail_c = F.round(F.col("p_retailprice") * 100).cast("long")
    n = F.count(F.lit(1))
    monthly = (base
               .withColumn("period", F.date_format("l_shipdate", "yyyy-MM"))
               .groupBy(F.col("l_suppkey").alias("asset_number"), "period")
               .agg(F.max(default_flag_expr()).alias("default_flag"),
                    F.min(tax_pp).alias("_min_tax"), (F.sum(tax_pp).cast("double") / n).alias("_avg_tax"),
                    F.max(disc_pp).alias("_max_disc"), F.sum(net_u).alias("_sum_net"),
                    F.min(qty).alias("_min_qty"), (F.sum(qty).cast("double") / n).alias("_avg_qty"),
                    F.sum(cents).alias("_sum_cents"),
                    F.sum(F.when(tax_pp > 0, qty * retail_c)).alias("_appr_c"),
                    F.mode("p_type", True).alias("_ptype"),
                    F.first("n_name").alias("state"),
                    n.alias("n_properties")))
    a = F.col("asset_number")
    code = F.lit(None).cast("string")
    for word, c in PTYPE_TO_CODE.items():
        code = F.when(F.col("_ptype") == word, F.lit(c)).otherwise(code)
    loan_w = Window.partitionBy("asset_number")
    period_dt = C.period_to_date("period")
    first_dt = F.min(period_dt).over(loan_w)
    orig_term = (F.lit(36) + (a % 8) * 12).cast("double")
    orig_amount = F.lit(1000000.0) + (a % 100) * F.lit(25000.0)
    epoch = F.lit(C.EXCEL_EPOCH).cast("date")
    return monthly.select(
        a, "period", period_dt.alias("period_dt"), "default_flag",
        orig_amount.alias("orig_amount"),
        orig_term.alias("orig_term"),
        F.lit(360.0).alias("orig_amort_term"),
        (F.lit(0.03) + (a % 5) * F.lit(0.005)).alias("orig_rate"),
        (F.lit(1) + a % 2).cast("double").alias("rate_type_code"),
        ((a % 4) * 12).cast("double").alias("io_term"),
        C.flag(a % 3 == 0).alias("io_flag"),
        C.flag(a % 2 == 0).alias("balloon_flag"),
        (F.lit(5) + a % 11).cast("double").alias("grace_days"),
        F.concat(F.lit("L"), (F.lit(1) + a % 2).cast("string")).alias("lien_code"),
        F.concat(F.lit("PT"), (a % 3).cast("string")).alias("payment_type_code"),
        (F.col("_sum_net").cast("double") / 10000.0).alias("sched_balance"),
        F.datediff(first_dt, epoch).alias("first_due_serial"),
        F.datediff(F.add_months(first_dt, orig_term.cast("int")), epoch).alias("maturity_serial"),
        code.alias("property_type"),
        "state",
        (F.lit(1950) + a % 60).cast("double").alias("year_built"),
        (orig_amount * 1.25).alias("valuation"),
        (F.lit(20000) + (a % 40) * 2500).cast("double").alias("sq_feet"),
        F.when(a % 13 != 0, (F.lit(55) + a % 40) / 100.0).alias("ltv_orig"),
        ((F.lit(80) + a % 20) / 100.0).alias("occ_orig"),
        (orig_amount * 0.09).alias("noi_orig"),
        F.when(a % 17 != 0, (F.lit(85) + (a % 16) * 5) / 100.0).alias("dscr_orig"),
        F.when(F.col("_max_disc") < 10, F.col("_sum_net").cast("double") / F.col("n_properties")
               / 10000.0 / LTV_SCALE).alias("ltv_curr"),
        F.when(F.col("_min_tax") != 0, F.lit(0.4) + F.lit(15.0) * F.col("_avg_tax") / 100.0).alias("dscr_curr"),
        F.when(F.col("_min_qty") > 2, F.col("_avg_qty") / 50.0).alias("occ_curr"),
        (F.col("_sum_cents").cast("double") / 100.0).alias("gross_balance"),
        (F.col("_appr_c").cast("double") / 100.0).alias("appraisal_curr"),
        F.col("_ptype").alias("property_type_raw"),
        "n_properties",
    )
