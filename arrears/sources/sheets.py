"""Readers for the reference's own sheet layouts, exported as CSV or parquet.

* ``read_panel_sheet`` (S1): a wide loan-month sheet; only whitelisted
  column names are read (absent ones are skipped) and renamed to clean names.
* ``read_positional_sheet`` (S2): a property-month sheet whose columns are
  taken by position; the header row is skipped and short rows are padded
  with NULL (CSV ``PERMISSIVE``).  Input order is kept as ``row_order`` for
  the "first non-null in input order" rollup.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arrears.functions import columns as C

# Fixed values that must equal the reference's: raw column names of the wide
# panel sheet (including two odd spellings and one trailing space) and the
# clean names used here.
PANEL_COLUMNS = {
    "assets.assetNumber": "asset_number",
    "period": "period",
    "Default_Flag": "default_flag",
    "assets.originalLoanAmount": "orig_amount",
    "assets.originalTermLoanNumber": "orig_term",
    "assets.originalAmortizationTermNumber": "orig_amort_term",
    "assets.originalInterestRatePercentage": "orig_rate",
    "assets.originalInterestRateTypeCode": "rate_type_code",
    "assets.originalInterestOnlyTermNumber": "io_term",
    "assets.interestOnlyIndicator": "io_flag",
    "assets.balloonIndicator": "balloon_flag",
    "assets.graceDaysAllowedNumber": "grace_days",
    "assets.lienPositionSecuritizationCode": "lien_code",
    "assets.paymentTypeCode": "payment_type_code",
    "assets.scheduledPrincipalBalanceSecuritizationAmount": "sched_balance",
    "assets.firstLoanPaymentDueDate": "first_due_serial",
    "assets.maturityDate": "maturity_serial",
    "property.propertyTypeCode": "property_type",
    "property.propertyState": "state",
    "property.yearBuiltNumber": "year_built",
    "property.ValuationSecuritizationAmount": "valuation",
    "property.netRentableSquareFeetSecuritizationNumber": "sq_feet",
    "LTV-Origination": "ltv_orig",
    "property.physicalOccupancySecuritizationPercentage": "occ_orig",
    "property.netOperatingIncomeSecuritizationAmount": "noi_orig",
    "property.debtSerWFBiceCoWFBerageNetOperatingIncomeSecuritizationPercentage": "dscr_orig",
    "LTV-Current ": "ltv_curr",
    "property.mostRecentDebtSerWFBiceCoWFBerageNetOperatingIncomePercentage": "dscr_curr",
    "property.mostRecentPhysicalOccupancyPercentage": "occ_curr",
}

# Fixed values that must equal the reference's: zero-based column positions of
# the property-month sheet.
PROPERTY_COLUMN_POSITIONS = {
    "asset_number": 5, "origination_date": 9, "original_balance": 10, "original_term": 11,
    "maturity_date": 12, "interest_rate_orig": 14, "io_term_months": 18, "payment_type_code": 23,
    "is_io": 30, "balance_begin": 39, "interest_rate_curr": 41, "balance_end": 47,
    "payment_status": 54, "state": 61, "zip_code": 62, "property_type": 64,
    "appraisal_orig": 70, "appraisal_current": 74, "occupancy_orig": 77, "noi_orig": 84,
    "dscr_orig": 88, "occupancy_current": 104, "noi_current": 109, "dscr_current": 112,
    "asset_left": 149, "cik": 150, "report_period": 151, "default_flag": 152,
}

TEXT_COLUMNS = {"asset_number", "period", "lien_code", "payment_type_code", "property_type", "state"}


def _quoted(name: str):
    return F.col("`" + name.replace("`", "``") + "`")


def _read(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    if fmt == "csv":
        return spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    return spark.read.format(fmt).load(path)


def read_panel_sheet(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Whitelisted columns under clean names, plus ``period_dt``."""
    df = _read(spark, path, fmt)
    # match on trimmed names: exports may or may not keep the trailing space
    wanted = {raw.strip(): clean for raw, clean in PANEL_COLUMNS.items()}
    cols = []
    for name in df.columns:
        clean = wanted.get(name.strip())
        if clean is None:
            continue
        c = _quoted(name)
        cols.append((c.cast("string") if clean in TEXT_COLUMNS else C.coerce_numeric(c)).alias(clean))
    out = df.select(*cols)
    if "period" in out.columns:
        out = out.withColumn("period_dt", C.period_to_date("period"))
    return out


def read_positional_sheet(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """The 28 property-sheet columns by position (text), plus ``row_order``:
    file path, start of the block within the file, and place within the block.
    (Spark packs blocks into tasks by size, so a row id alone is not input order.)"""
    df = _read(spark, path, fmt)
    n = len(df.columns)
    cols = [(df[df.columns[i]] if i < n else F.lit(None)).cast("string").alias(name)
            for name, i in PROPERTY_COLUMN_POSITIONS.items()]
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                     F.monotonically_increasing_id().alias("row"))
    return df.select(*cols, place.alias("row_order"))


def write_panel_sheet(panel: DataFrame, path: str) -> str:
    """The wide loan-month sheet of ``panel``'s whitelisted columns, as CSV."""
    raw = {clean: name for name, clean in PANEL_COLUMNS.items()}
    cols = [F.col(c).alias(raw[c]) for c in panel.columns if c in raw]
    panel.select(*cols).write.mode("overwrite").option("header", True).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


SHEET_ROWS = 1_000_000       # of a compressed file, which one task reads


def write_positional_sheet(rows: DataFrame, path: str) -> str:
    """The property-month sheet: known columns at their positions, the others
    blank. Most of a line is delimiters, so files are compressed."""
    at = {i: name for name, i in PROPERTY_COLUMN_POSITIONS.items()}
    cols = [(F.col(at[i]).cast("string") if i in at else F.lit(None).cast("string")).alias(f"c{i}") for i in range(max(at) + 1)]
    rows.select(*cols).write.mode("overwrite").option("header", True).option("compression", "lz4").option("maxRecordsPerFile", SHEET_ROWS).csv(path)
    return path
