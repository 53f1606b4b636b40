"""Sheet-per-file series: headers, lock files, faults, absent series; the feed's order audit."""

from pyspark.sql import functions as F

from arrears.operators import features as FE
from arrears.sources import macro as M
from arrears.sources import series as SE
from arrears.sources import sinks as K
from arrears.plans import q_sinks as QS

SHEETS = [("Unemployment Rate in Texas", "title, with, commas\nfrequency,monthly\nDATE,TXUR,note\n1990-01-01,5.5,x\n32905,6\nbad,1\n1990-03-01,.\n"),
          ("Unemployment Rate in the District of Columbia", "observation_date,DCUR\r\n1990-01-01,7\r\n"),
          ("~$Unemployment Rate in Texas", "date,TXUR\n1990-01-01,9"), ("Unemployment Rate in Nowhere", "date,NOUR\n1990-01-01,4"),
          ("GDP", ""), ("notes", "just text")]


def folder(spark, sheets):
    return SE.write_sheets(spark.createDataFrame(sheets, "name string, content string"), K.fresh_path(spark, "sheets"))


def test_state_sheets(spark):
    files = SE.scan_sheets(spark, folder(spark, SHEETS))
    got = {tuple(r) for r in SE.state_by_header(files).collect()}
    texas = {("1990-01", "TX", 5.5), ("1990-02", "TX", 6.0), ("1990-03", "TX", None)}
    assert got == texas | {("1990-01", "DC", 7.0), ("1990-01", "NO", 4.0)}
    dim = M.us_state_dim(spark)
    assert {tuple(r) for r in SE.state_by_name(files, dim).collect()} == texas | {("1990-01", "DC", 7.0)}
    report = {r.status: r.n_files for r in SE.file_report(SE.with_state_names(files, dim)).collect()}
    assert report == {"read": 2, "temporary": 1, "unreadable": 2, "unknown name": 1}


def test_plain_files_of_a_folder(spark, tmp_path):
    (tmp_path / "Unemployment Rate in New York.csv").write_text("date,NYUR\n1990-01-01,5\n")
    (tmp_path / "Unemployment Rate in Ohio.txt").write_bytes(b"\xff\xfe\x00 not a sheet")
    files = SE.scan_sheets(spark, str(tmp_path))
    assert [tuple(r) for r in SE.state_by_name(files, M.us_state_dim(spark)).collect()] == [("1990-01", "NY", 5.0)]


def test_national_series_may_be_absent(spark):
    gdp = "observation_date,GDP\n" + "\n".join(f"{1990 + i // 4}-{1 + 3 * (i % 4):02d}-01,{100 + i}" for i in range(8))
    rates = "DATE,DGS10\n1990-01-02,8\n1990-01-03,.\n1990-01-04,9\n1990-03-01,7"
    one = SE.national(spark, folder(spark, [("DGS10", rates)]))
    assert one.columns == ["ym", "nat_10y_rate"]
    assert {tuple(r) for r in one.collect()} == {("1990-01", 8.5), ("1990-02", None), ("1990-03", 7.0)}
    both = SE.with_all_national(SE.national(spark, folder(spark, [("DGS10", rates), ("GDP", gdp)])), spark)
    rows = {r.ym: r for r in both.collect()}
    assert both.columns == ["ym", *SE.NATIONAL_COLUMNS] and len(rows) == 25 and all(r.nat_unrate is None for r in rows.values())
    assert abs(rows["1991-01"].nat_gdp_yoy - 4.0) < 1e-9 and rows["1990-12"].nat_gdp_yoy is None
    assert SE.national(spark, K.fresh_path(spark, "nothing")) is None
    assert SE.national(spark, folder(spark, [("GDP", "no sheet")])) is None
    none = SE.with_all_national(None, spark)
    panel = spark.createDataFrame([("1990-01",)], "ym_macro string")
    joined = FE.MJ.exact_month_join(panel, none.withColumnRenamed("ym", "_ym"), "ym_macro", "_ym")
    assert joined.first().asDict() == {"ym_macro": "1990-01"} | dict.fromkeys(SE.NATIONAL_COLUMNS)


def test_order_audit(spark):
    rows = [(i, f"1990-{1 + i % 12:02d}", "RT", "NY", 1.0, i % 97 / 100, "RED", i % 4) for i in range(2000)]
    df = spark.createDataFrame(rows, QS.FEED_SCHEMA)
    order = ["tier_rank", F.col("default_prob_6m").desc(), "asset_number", "period"]

    def audit(frame):
        path = K.write_risk_feed(frame, K.fresh_path(spark, "feed"))
        return K.order_inversions(spark, path, QS.FEED_SCHEMA, QS.feed_order()).first()

    good = audit(df.repartitionByRange(4, *order).sortWithinPartitions(*order))
    assert (good.n_rows, good.n_parts, good.inside_parts, good.between_parts) == (2000, 4, 0, 0)
    loose = audit(df.repartition(4).sortWithinPartitions(*order))
    assert loose.inside_parts == 0 and loose.between_parts > 0
    assert audit(df.repartition(1).orderBy(F.rand(1))).inside_parts > 500
    assert audit(df.limit(0)).n_rows == 0
