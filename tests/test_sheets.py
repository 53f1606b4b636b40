"""Sheet readers: whitelist by name (odd spellings, trailing space) and by position."""

import uuid

from pyspark.sql import functions as F

from arrears.session import scratch_path
from arrears.sources import panel as P
from arrears.sources import sheets as SH


def test_panel_sheet_round_trip(spark):
    panel = P.loan_month_panel(spark, "/root/testdata/sf0.001")
    inverse = {v: k for k, v in SH.PANEL_COLUMNS.items()}
    raw = panel.select(*[F.col(c).alias(inverse[c]) for c in inverse if c in panel.columns],
                       F.lit("junk").alias("assets.originatorName"))
    path = scratch_path(spark, f"sheet-{uuid.uuid4().hex[:8]}")
    raw.write.option("header", True).option("ignoreTrailingWhiteSpace", False).csv(path)
    back = SH.read_panel_sheet(spark, path)
    assert "assets.originatorName" not in back.columns and "ltv_curr" in back.columns
    cols = ["asset_number", "period", "ltv_curr", "dscr_curr", "maturity_serial"]
    a = panel.select(F.col("asset_number").cast("string"), "period", "ltv_curr", "dscr_curr",
                     F.col("maturity_serial").cast("double"))
    b = back.select(*cols)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_positional_sheet(spark):
    raw = P.raw_property_rows(spark, "/root/testdata/sf0.001").limit(50)
    width = 153
    by_pos = {i: name for name, i in SH.PROPERTY_COLUMN_POSITIONS.items()}
    cols = [(F.col(by_pos[i]).cast("string") if i in by_pos else F.lit(f"x{i}")).alias(f"c{i}")
            for i in range(width)]
    path = scratch_path(spark, f"pos-{uuid.uuid4().hex[:8]}")
    raw.select(*cols).coalesce(1).write.option("header", True).csv(path)
    back = SH.read_positional_sheet(spark, path)
    assert back.count() == 50
    # CSV trims padding and reads empty text as NULL; the cleaned zip is what the pipeline uses
    from arrears.functions import columns as C
    a = raw.select("asset_number", "report_period", C.clean_zip("zip_code").alias("z"))
    b = back.select("asset_number", "report_period", C.clean_zip("zip_code").alias("z"))
    assert a.exceptAll(b).count() == 0
    cleaned = P.clean_property_rows(back)
    assert cleaned.where("loan_uid IS NULL").count() == 0
