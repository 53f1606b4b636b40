"""Macro series held as one text sheet per file.

A sheet is comma-separated text: lines before its header are passed over, the
header's first cell names the date and the second the value column. Files are
read whole, one row per file, by any file system that Spark reads; a folder of
sheets is bounded by the number of series, not by the panel.

Every file gets a status, so that what is left out can be counted:

* ``temporary``: the name starts with ``~`` (an editor's lock file);
* ``unreadable``: no header line;
* ``unknown name``: only where the key comes from the name, which the
  dimension does not hold;
* ``read``: all others.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arrears.functions import columns as C
from arrears.sources import macro as M

DATE_HEADERS = ("date", "observation_date")
STATE_FILE = r"^Unemployment Rate in (.+)$"
# National series: file name -> (value column, result column). Fixed values.
NATIONAL = {"DGS10": ("dgs10", "nat_10y_rate"), "UNRATE": ("unrate", "nat_unrate"), "GDP": ("gdp", "nat_gdp_yoy")}
NATIONAL_COLUMNS = [c for _, c in NATIONAL.values()]


def write_sheets(sheets: DataFrame, path: str) -> str:
    """``sheets`` (name, content): one folder per sheet, named like its file."""
    sheets.select(F.col("name").alias("sheet"), "content").write.partitionBy("sheet").text(path)
    return path


def sheet_text(series: DataFrame, name: F.Column, header: F.Column, date: str, value: str, by: list[str]) -> DataFrame:
    """One sheet per group of ``by``: (name, content), a title line before the header."""
    line = F.concat_ws(",", F.col(date).cast("string"), F.coalesce(F.col(value).cast("string"), F.lit(".")))
    lines = series.groupBy(*by).agg(F.sort_array(F.collect_list(line)).alias("lines"))
    return lines.select(name.alias("name"), F.concat_ws("\n", F.lit("monthly series"), F.concat(F.lit("observation_date,"), header), F.array_join("lines", "\n")).alias("content"))


def scan_sheets(spark: SparkSession, folder: str) -> DataFrame | None:
    """(name, status, column, lines) per file; None if the folder is not there."""
    try:
        raw = spark.read.text(folder, wholetext=True, recursiveFileLookup=True)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    path = F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B"))
    path = F.url_decode(F.regexp_replace(path, r"\+", "%2B"))          # partition folders are escaped once more
    name = F.regexp_replace(F.regexp_extract(F.regexp_replace(path, r"/part-[^/]*$", ""), r"([^/]+)$", 1), r"^sheet=|\.(csv|txt)$", "")
    lines = F.split("value", r"\r?\n")
    first = F.transform("lines", lambda x: F.lower(F.trim(F.split(x, ",")[0])).isin(*DATE_HEADERS) & (F.size(F.split(x, ",")) >= 2))
    files = raw.select(name.alias("name"), lines.alias("lines")).withColumn("at", F.array_position(first, F.lit(True)))
    return files.select(
        "name", F.when(F.col("name").startswith("~"), "temporary").when(F.col("at") == 0, "unreadable").otherwise("read").alias("status"),
        F.when(F.col("at") > 0, F.trim(F.split(F.get("lines", F.col("at").cast("int") - 1), ",")[1])).alias("column"),
        F.when(F.col("at") > 0, F.slice("lines", F.col("at").cast("int") + 1, F.size("lines"))).alias("lines"))


def observations(files: DataFrame, *keep: str) -> DataFrame:
    """The dated values of the files that were read: date, value and ``keep``."""
    cells = F.split("line", ",")
    rows = files.where(F.col("status") == "read").select(*keep, F.explode("lines").alias("line"))
    return rows.select(*keep, F.trim(cells[0]).alias("_d"), F.trim(F.get(cells, 1)).alias("_v")).select(
        *keep, F.try_to_date(C.mixed_date_text("_d"), "yyyy-MM-dd").alias("date"), C.coerce_numeric("_v").alias("value")).where(F.col("date").isNotNull())


def state_by_header(files: DataFrame) -> DataFrame:
    """(ym, state, state_unrate); the state is the first two characters of the value column's name."""
    keyed = files.withColumn("state", F.substring("column", 1, 2))
    return observations(keyed, "state").select(F.date_format("date", "yyyy-MM").alias("ym"), "state", F.col("value").alias("state_unrate"))


def with_state_names(files: DataFrame, name_to_code: DataFrame) -> DataFrame:
    """The state from the file's name; names that the dimension lacks get a status of their own."""
    named = files.withColumn("state_name", F.regexp_extract("name", STATE_FILE, 1))
    # dimension: one row per state
    joined = named.join(F.broadcast(name_to_code), "state_name", "left")
    return joined.withColumn("status", F.when((F.col("status") == "read") & F.col("state").isNull(), "unknown name").otherwise(F.col("status")))


def state_by_name(files: DataFrame, name_to_code: DataFrame) -> DataFrame:
    return observations(with_state_names(files, name_to_code), "state").select(
        F.date_format("date", "yyyy-MM").alias("ym"), "state", F.col("value").alias("state_unrate"))


def file_report(files: DataFrame) -> DataFrame:
    """(status, n_files)."""
    return files.groupBy("status").agg(F.count(F.lit(1)).alias("n_files"))


def national(spark: SparkSession, folder: str) -> DataFrame | None:
    """(ym, and a column per series that is there), outer-merged on month;
    series without a readable file are skipped, None if all are."""
    files = scan_sheets(spark, folder)
    if files is None:
        return None
    # one row per national series
    there = {r["name"] for r in files.where((F.col("status") == "read") & F.col("name").isin(*NATIONAL)).select("name").distinct().collect()}
    frames = []
    for name, (value, out) in NATIONAL.items():
        if name not in there:
            continue
        s = observations(files.where(F.col("name") == name)).withColumnRenamed("value", value)
        if name == "DGS10":
            s = M.monthly_mean(s, value).withColumnRenamed(value, out)
        elif name == "GDP":
            s = M.yoy_change(M.quarterly_to_monthly_ffill(s, value), value, out)
        else:
            s = s.withColumnRenamed(value, out)
        frames.append(s.select(F.date_format("date", "yyyy-MM").alias("ym"), out))
    return M.outer_merge(frames, "ym") if frames else None


def with_all_national(macro: DataFrame | None, spark: SparkSession) -> DataFrame:
    """``macro`` with every national column, absent series as NULL columns; no rows without any series."""
    if macro is None:
        return spark.createDataFrame([], "ym string, " + ", ".join(f"{c} double" for c in NATIONAL_COLUMNS))
    return macro.select("ym", *[F.col(c) if c in macro.columns else F.lit(None).cast("double").alias(c) for c in NATIONAL_COLUMNS])
