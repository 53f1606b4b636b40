"""Portfolio report tables.

Each report is a DataFrame, not text.  Category and year spines are
small fixed lists joined on the left so empty groups still appear with
zeros; everything else is ``groupBy`` with partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arrears.functions import columns as C


def fixed_round(x: Column, places: int) -> Column:
    scale = float(10 ** places)
    return F.floor(x * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def pct(num: Column, den: Column) -> Column:
    """num / den * 100, 0 on an empty denominator."""
    return F.when(den > 0, num.cast("double") / den * 100.0).otherwise(F.lit(0.0))


def one_row_join(df: DataFrame, single: DataFrame) -> DataFrame:
    """Attach the columns of a one-row aggregate to every row of ``df`` as
    scalar subqueries (evaluated once; no join, no cross product)."""
    return df.withColumns({c: single.select(c).scalar() for c in single.columns})


def panel_overview(panel: DataFrame, loan: str, period: str, flag: str) -> DataFrame:
    return panel.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(loan).alias("n_loans"),
                     F.min(period).alias("first_period"), F.max(period).alias("last_period"),
                     (F.avg(flag) * 100.0).alias("default_rate_pct"))


def eda_overview(props: DataFrame, loans: DataFrame) -> DataFrame:
    p = props.agg(F.count(F.lit(1)).alias("n_obs"), F.min("report_period").alias("first_period"),
                  F.max("report_period").alias("last_period"))
    lo = loans.agg(F.countDistinct("loan_uid").alias("n_loans"),
                   F.sum("ever_defaulted").cast("long").alias("n_defaulted"))
    j = one_row_join(p, lo)
    return j.select("n_obs", "n_loans", "first_period", "last_period",
                    (F.col("n_obs") / F.col("n_loans")).alias("months_per_loan"),
                    "n_defaulted", (F.col("n_loans") - F.col("n_defaulted")).alias("n_never_defaulted"),
                    pct(F.col("n_defaulted"), F.col("n_loans")).alias("default_rate_pct"))


def year_spine(spark: SparkSession, years: tuple) -> DataFrame:
    return spark.range(years[0], years[1] + 1).select(F.col("id").cast("int").alias("year"))


def annual_default(spark: SparkSession, props: DataFrame, loans: DataFrame, years: tuple) -> DataFrame:
    """Active loans per year, first-time defaults per year, rate (2 dp)."""
    active = props.select("year", "loan_uid").distinct().groupBy("year") \
        .agg(F.count(F.lit(1)).alias("active_loans"))
    first = loans.where(F.col("first_default_year").isNotNull()) \
        .groupBy(F.col("first_default_year").alias("year")).agg(F.count(F.lit(1)).alias("first_time_defaults"))
    s = year_spine(spark, years)
    j = s.join(F.broadcast(active), "year", "left").join(F.broadcast(first), "year", "left")
    a = F.coalesce(F.col("active_loans"), F.lit(0))
    d = F.coalesce(F.col("first_time_defaults"), F.lit(0))
    return j.select("year", a.alias("active_loans"), d.alias("first_time_defaults"),
                    fixed_round(pct(d, a), 2).alias("default_rate_pct"))


def peak_year(annual: DataFrame) -> DataFrame:
    """First year with the highest rate (earliest year wins ties)."""
    return annual.orderBy(F.col("default_rate_pct").desc(), F.col("year").asc()).limit(1)


def payment_type_breakdown(spark: SparkSession, loans: DataFrame) -> DataFrame:
    spine = spark.createDataFrame([(i, t) for i, t in enumerate(C.PAYMENT_TYPES)], "ord int, payment_type string")
    agg = loans.groupBy("payment_type").agg(F.count(F.lit(1)).alias("unique_loans"),
                                            F.sum("ever_defaulted").alias("defaulted"))
    total = loans.agg(F.count(F.lit(1)).alias("_total"))
    j = one_row_join(spine.join(F.broadcast(agg), "payment_type", "left"), total)
    n = F.coalesce(F.col("unique_loans"), F.lit(0))
    d = F.coalesce(F.col("defaulted"), F.lit(0))
    return j.select("payment_type", n.alias("unique_loans"), pct(n, F.col("_total")).alias("share_pct"),
                    d.cast("long").alias("defaulted"), pct(d, n).alias("default_rate_pct"))


ANNUAL_TYPES = {"Interest-Only": "interest_only_pct", "Partial IO": "partial_io_pct",
                "Amortizing": "amortizing_pct"}


def annual_by_payment_type(spark: SparkSession, props: DataFrame, loans: DataFrame, years: tuple) -> DataFrame:
    """Per year and type: loans active that year whose first default is that year."""
    active = props.select("year", "loan_uid").distinct()
    j = active.join(loans.select("loan_uid", "payment_type", "first_default_year"), "loan_uid")
    j = j.where(F.col("payment_type").isin(list(ANNUAL_TYPES)))
    agg = j.groupBy("year").pivot("payment_type", list(ANNUAL_TYPES)).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((F.col("first_default_year") == F.col("year")).cast("int")).alias("d"))
    s = year_spine(spark, years).join(F.broadcast(agg), "year", "left")
    cols = []
    for t, name in ANNUAL_TYPES.items():
        n = F.coalesce(F.col(f"{t}_n"), F.lit(0))
        d = F.coalesce(F.col(f"{t}_d"), F.lit(0))
        cols.append(pct(d, n).alias(name))
    return s.select("year", *cols)


def group_default_table(loans: DataFrame, by: str, min_loans: int = 0) -> DataFrame:
    g = loans.groupBy(by).agg(F.count("loan_uid").alias("total_loans"),
                              F.sum("ever_defaulted").cast("long").alias("defaulted"))
    g = g.withColumn("default_rate_pct", F.col("defaulted") / F.col("total_loans") * 100.0)
    if min_loans:
        g = g.where(F.col("total_loans") >= min_loans)
    return g.orderBy(F.col("default_rate_pct").desc(), F.col(by))
