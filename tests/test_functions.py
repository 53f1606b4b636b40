"""Hand-computed goldens for the cleaning scalars and null rules (dirty-text fixtures)."""

import datetime as dt

from pyspark.sql import functions as F

from arrears.functions import columns as C


def one_col(spark, values, typ="string"):
    return spark.createDataFrame([(v,) for v in values], f"x {typ}")


def test_clean_zip(spark):
    vals = ["04512", "4512-99", "4512.0", " 4512 ", "", None, "abc", "123456"]
    got = [r[0] for r in one_col(spark, vals).select(C.clean_zip("x")).collect()]
    assert got == ["04512", "04512", "04512", "04512", "00000", "00000", "00000", "123456"]


def test_serial_and_mixed_dates(spark):
    df = one_col(spark, ["43831", "0", None, "2020-01-01", "43831.7"])
    got = [r[0] for r in df.select(C.mixed_date_text("x")).collect()]
    assert got == ["2020-01-01", "1899-12-30", None, "2020-01-01", "2020-01-01"]
    d = spark.createDataFrame([(43831,)], "n int").select(C.excel_serial_to_date("n")).first()[0]
    assert d == dt.date(2020, 1, 1)


def test_numbers_and_bools(spark):
    got = [r[0] for r in one_col(spark, ["1.5", "n/a", "", None]).select(C.coerce_numeric("x")).collect()]
    assert got == [1.5, None, None, None]
    got = [r[0] for r in one_col(spark, ["True", "TRUE", "1", None]).select(C.coerce_bool("x")).collect()]
    assert got == [True, True, False, False]


def test_balance_key_half_even(spark):
    df = spark.createDataFrame([(500.0,), (1500.0,), (2500.0,), (2500.5,)], "b double")
    got = [r[0].split("_")[-1] for r in df.select(C.loan_uid(F.lit("o"), F.lit("m"), F.lit("z"), F.lit("t"), "b"))
           .collect()]
    assert got == ["0", "2000", "2000", "3000"]


def test_boundaries(spark):
    df = spark.createDataFrame([(0.0,), (12.0,), (24.0,), (36.0,), (None,)], "m double")
    rows = df.select(C.between_flag("m", 0, 12).alias("a"), C.between_flag("m", 12, 36).alias("b")).collect()
    assert [(r.a, r.b) for r in rows] == [(1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 1.0), (0.0, 0.0)]
    caps = spark.createDataFrame([(3.0,), (None,), (1.0,)], "x double").select(C.clip_upper("x", 2.0)).collect()
    assert [r[0] for r in caps] == [2.0, None, 1.0]


def test_payment_type(spark):
    df = spark.createDataFrame([(True, 0.0, 0.0), (False, 120.0, 120.0), (False, 12.0, 120.0),
                                (False, None, None), (None, 12.0, None)],
                               "io boolean, iot double, term double")
    got = [r[0] for r in df.select(C.payment_type("io", "iot", "term")).collect()]
    assert got == ["Interest-Only", "Interest-Only", "Partial IO", "Amortizing", "Partial IO"]


def test_payment_type_lenient(spark):
    df = spark.createDataFrame([(True, "0", "0"), (False, "x", "120"), (False, "12", "120"),
                                (False, None, None), (False, "0", "0")],
                               "io boolean, iot string, term string")
    got = [r[0] for r in df.select(C.payment_type_lenient("io", "iot", "term")).collect()]
    assert got == ["Interest-Only", "Other", "Partial IO", "Amortizing", "Amortizing"]
