"""What moves and what is written stays as narrow as the tables it comes from."""

import glob
import os

from arrears.operators import rollup as RU
from arrears.plans import q_reports as R
from arrears.sources import panel as P
from arrears.sources import sheets as SH
from arrears.sources.scratch import fresh_path

SF = "/root/testdata/sf0.001"


def test_rollup_deals_narrow_rows_and_moves_them_once(spark):
    got = R.rollup(spark, SF)
    plan = got._jdf.queryExecution().executedPlan().toString().splitlines()
    dealt = [i for i, line in enumerate(plan) if "Exchange" in line and "ac_key" in line]
    partial = [i for i, line in enumerate(plan) if "partial_min_by" in line]
    assert len(dealt) == 1 and "REPARTITION_BY_COL" in plan[dealt[0]]
    assert partial and max(partial) < dealt[0]          # nothing is combined, hence widened, before the move
    plain = RU.loan_period_rollup(P.property_rows(spark, SF))
    assert got.schema == plain.schema
    key = ["ac_key", "report_period"]
    exact = [c for c in got.columns if c not in RU.MEAN_COLS + RU.SUM_COLS]
    assert [tuple(r) for r in got.select(exact).orderBy(key).collect()] == [tuple(r) for r in plain.select(exact).orderBy(key).collect()]


def test_rollup_makes_the_key_of_rows_without_one(spark):
    rows = spark.createDataFrame([("7", "1", "2000-01", 2, "b"), ("7", "1", "2000-01", 1, None), ("7", None, "2000-01", 1, "c")],
                                 "asset_left string, cik string, report_period string, row_order int, state string")
    assert {(r["ac_key"], r["state"]) for r in RU.loan_period_rollup(rows).collect()} == {("7_1", "b"), ("7", "c")}


def test_positional_sheet_is_written_small(spark):
    raw = P.raw_property_rows(spark, SF)
    path = SH.write_positional_sheet(raw, fresh_path(spark, "sheet-small"))
    files = [f for f in glob.glob(path.removeprefix("file:") + "/*") if "part-" in f]
    n = raw.count()
    assert sum(os.path.getsize(f) for f in files) < 200 * n        # 320 with 152 plain delimiters a line
    back = SH.read_positional_sheet(spark, path)
    assert back.select("row_order").distinct().count() == n
    assert sorted(r[0] for r in back.select("asset_number").collect()) == sorted(r[0] for r in raw.select("asset_number").collect())
