"""Macro series bound to the orders table (FIXTURES.md B3).

Each series is a ``groupBy`` over calendar buckets, so its size is the
number of months (or months x states) in the observed time range, not the
number of orders.  That bound is what makes the later broadcasts of these
series safe at any data volume.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arrears.sources.tables import read_table

# Binding scales that bring order totals to rate-like magnitudes (primes, so
# scaled averages do not end in exact decimal ties).
DAILY_SCALE = 49999.0        # "10-year rate"
UNRATE_SCALE = 29989.0       # "unemployment rate"
CPI_SCALE = 997.0           # "price level"
GDP_SCALE = 10007.0             # "output"
NULL_MONTH_MOD = 5           # months with month % 5 == 0 report no unemployment value


def _orders(spark, sf_dir):
    return read_table(spark, sf_dir, "orders", "o_orderdate", "o_totalprice", "o_custkey")


def daily_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, dgs10): one row per order day."""
    o = _orders(spark, sf_dir)
    return (o.groupBy(F.to_date("o_orderdate").alias("date"))
             .agg((F.avg("o_totalprice") / DAILY_SCALE).alias("dgs10")))


def monthly_unrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, unrate) first-of-month; some months carry a NULL value."""
    o = _orders(spark, sf_dir)
    m = o.groupBy(F.trunc(F.to_date("o_orderdate"), "month").alias("date")) \
         .agg((F.avg("o_totalprice") / UNRATE_SCALE).alias("unrate"))
    return m.withColumn("unrate", F.when(F.month("date") % NULL_MONTH_MOD != 0, F.col("unrate")))


def monthly_cpi(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir)
    return (o.groupBy(F.trunc(F.to_date("o_orderdate"), "month").alias("date"))
             .agg((F.avg("o_totalprice") / CPI_SCALE).alias("cpi")))


def quarterly_gdp(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir)
    return (o.groupBy(F.trunc(F.to_date("o_orderdate"), "quarter").alias("date"))
             .agg((F.avg("o_totalprice") / GDP_SCALE).alias("gdp")))


def state_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ym, state, state_unrate): customer nation x month cells that exist."""
    o = _orders(spark, sf_dir)
    c = read_table(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    n = read_table(spark, sf_dir, "nation", "n_nationkey", "n_name")
    cn = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey)
    j = o.join(cn, o.o_custkey == cn.c_custkey)
    return (j.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("ym"), F.col("n_name").alias("state"))
             .agg((F.avg("o_totalprice") / UNRATE_SCALE).alias("state_unrate")))


# ---------------------------------------------------------------- A3 / S3
def month_spine(df: DataFrame, date_col: str = "date", extra_months: int = 0) -> DataFrame:
    """Every first-of-month from the first to the last month (+ extra)."""
    bounds = df.agg(F.min(F.trunc(date_col, "month")).alias("lo"),
                    F.max(F.trunc(date_col, "month")).alias("hi"))
    return bounds.select(F.explode(F.sequence(
        "lo", F.add_months("hi", extra_months), F.expr("interval 1 month"))).alias(date_col))


def monthly_mean(daily: DataFrame, value: str, date_col: str = "date",
                 fill_empty_months: bool = True) -> DataFrame:
    """Daily values to monthly means; with ``fill_empty_months`` a month with
    no observation is emitted with a NULL mean (calendar resampling)."""
    m = (daily.where(F.col(date_col).isNotNull())
              .groupBy(F.trunc(date_col, "month").alias(date_col))
              .agg(F.avg(value).alias(value)))
    if not fill_empty_months:
        return m
    return month_spine(m, date_col).join(m, date_col, "left")


# ---------------------------------------------------------------- W14 / W15
def series_window(date_col: str = "date") -> Window:
    # Calendar-bounded series: one row per month of the observed range.
    return Window.orderBy(date_col)


def yoy_change(series: DataFrame, value: str, out: str, date_col: str = "date", k: int = 12) -> DataFrame:
    """Row-based change over ``k`` rows after forward filling, in percent."""
    w = series_window(date_col)
    ff = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    s = series.withColumn("_ff", ff)
    return s.withColumn(out, F.try_divide(F.col("_ff"), F.lag("_ff", k).over(w)) * 100.0 - 100.0).drop("_ff")


def quarterly_to_monthly_ffill(q: DataFrame, value: str, date_col: str = "date") -> DataFrame:
    """Quarter-start values spread to a monthly spine that runs three months past
    the last quarter start, each month taking the latest known value."""
    spine = month_spine(q, date_col, extra_months=3)
    j = spine.join(q, date_col, "left")
    w = series_window(date_col).rowsBetween(Window.unboundedPreceding, 0)
    return j.withColumn(value, F.last(value, ignorenulls=True).over(w))


def national_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ym, nat_10y_rate, nat_unrate, nat_gdp_yoy), outer-merged on month."""
    dgs = monthly_mean(daily_rate(spark, sf_dir), "dgs10") \
        .select(F.date_format("date", "yyyy-MM").alias("ym"), F.col("dgs10").alias("nat_10y_rate"))
    un = monthly_unrate(spark, sf_dir) \
        .select(F.date_format("date", "yyyy-MM").alias("ym"), F.col("unrate").alias("nat_unrate"))
    gdp = yoy_change(quarterly_to_monthly_ffill(quarterly_gdp(spark, sf_dir), "gdp"), "gdp", "gdp_yoy") \
        .select(F.date_format("date", "yyyy-MM").alias("ym"), F.col("gdp_yoy").alias("nat_gdp_yoy"))
    return outer_merge([dgs, un, gdp], "ym")


def outer_merge(frames: list[DataFrame], key: str) -> DataFrame:
    out = None
    for f in frames:
        out = f if out is None else out.join(f, key, "full")
    return out


# ---------------------------------------------------------------- S5 / S6 / U1
def write_state_files(state: DataFrame, path: str) -> str:
    """One folder per state series, named like a downloaded file
    ("Unemployment Rate in <name>"), each holding (date, value, series_id)."""
    out = state.select(F.concat(F.lit("Unemployment Rate in "), F.col("state")).alias("file_name"),
                       F.concat(F.col("state"), F.lit("UR")).alias("series_id"),
                       F.to_date(F.concat(F.col("ym"), F.lit("-01"))).alias("date"),
                       F.col("state_unrate").alias("value"))
    out.write.mode("overwrite").partitionBy("file_name").parquet(path)
    return path


def read_state_by_file(spark: SparkSession, path: str, name_to_code: DataFrame) -> DataFrame:
    """One multi-file read; the state comes from the file name, mapped to
    a code through a small name -> code dimension; unknown names are dropped."""
    raw = (spark.read.option("ignoreCorruptFiles", "true").parquet(path)
                .select("date", "value", F.col("_metadata.file_path").alias("_path")))
    name = F.regexp_extract(F.url_decode(F.col("_path")), r"Unemployment Rate in (.+?)/", 1)
    df = raw.withColumn("state_name", name).where(F.col("date").isNotNull())
    return (df.join(F.broadcast(name_to_code), "state_name")          # dimension: one row per state
              .select(F.date_format("date", "yyyy-MM").alias("ym"), "state",
                      F.col("value").cast("double").alias("state_unrate")))


def read_state_by_header(spark: SparkSession, path: str, suffix: str = "UR") -> DataFrame:
    """The same multi-file read, the state taken from each series'
    header (the series id without its measure suffix)."""
    raw = spark.read.parquet(path).select("date", "value", "series_id")
    return (raw.where(F.col("date").isNotNull())
               .select(F.date_format("date", "yyyy-MM").alias("ym"),
                       F.regexp_replace("series_id", f"{suffix}$", "").alias("state"),
                       F.col("value").cast("double").alias("state_unrate")))


# Fixed values that must equal the reference's: state names (as they appear in
# the series file names) and their two-letter codes, including both spellings
# of the District of Columbia.
US_STATE_CODES = {
    "Alabama": "AL", "Alaska": "AK", "Arizona": "AZ", "Arkansas": "AR",
    "California": "CA", "Colorado": "CO", "Connecticut": "CT", "Delaware": "DE",
    "Florida": "FL", "Georgia": "GA", "Hawaii": "HI", "Idaho": "ID",
    "Illinois": "IL", "Indiana": "IN", "Iowa": "IA", "Kansas": "KS",
    "Kentucky": "KY", "Louisiana": "LA", "Maine": "ME", "Maryland": "MD",
    "Massachusetts": "MA", "Michigan": "MI", "Minnesota": "MN",
    "Mississippi": "MS", "Missouri": "MO", "Montana": "MT", "Nebraska": "NE",
    "Nevada": "NV", "New Hampshire": "NH", "New Jersey": "NJ",
    "New Mexico": "NM", "New York": "NY", "North Carolina": "NC",
    "North Dakota": "ND", "Ohio": "OH", "Oklahoma": "OK", "Oregon": "OR",
    "Pennsylvania": "PA", "Rhode Island": "RI", "South Carolina": "SC",
    "South Dakota": "SD", "Tennessee": "TN", "Texas": "TX", "Utah": "UT",
    "Vermont": "VT", "Virginia": "VA", "Washington": "WA",
    "West Virginia": "WV", "Wisconsin": "WI", "Wyoming": "WY",
    "the District of Columbia": "DC", "District of Columbia": "DC",
}


def us_state_dim(spark: SparkSession) -> DataFrame:
    """Default name -> code dimension for state series named by US state."""
    return spark.createDataFrame(sorted(US_STATE_CODES.items()), "state_name string, state string")
