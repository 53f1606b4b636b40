"""Column expressions for cleaning and scalar features.

All of these are plain ``pyspark.sql.functions`` compositions, so they run
inside whole-stage codegen.  Missing values are SQL NULL throughout; the
helpers below carry the panel's null rules:

* a comparison that meets NULL is false, then becomes 0.0 (``flag``);
* ``between`` is inclusive on both ends and false on NULL;
* caps and floors leave NULL alone (Spark's ``least``/``greatest`` skip
  NULL arguments, so they are always guarded).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's for right results.
EXCEL_EPOCH = "1899-12-30"          # day 0 of spreadsheet serial dates
DAYS_PER_MONTH = 30.44              # average month length used for durations
PROPERTY_TYPES = ["RT", "OF", "LO", "MF", "SS", "MU", "CH", "IN", "MH"]
PAYMENT_TYPES = ["Interest-Only", "Partial IO", "Amortizing", "Other"]
PAYMENT_TYPE_ORDINAL = {"Interest-Only": 3, "Partial IO": 2, "Amortizing": 1, "Other": 0}
IO_SHARE_OF_TERM = 0.9


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---------------------------------------------------------------- null algebra
def flag(cond: Column) -> Column:
    """Boolean condition as 0.0/1.0 where NULL counts as false."""
    return F.coalesce(cond, F.lit(False)).cast("double")


def between_flag(x, lo, hi) -> Column:
    return flag(_c(x).between(lo, hi))


def clip_upper(x, cap) -> Column:
    x = _c(x)
    return F.when(x.isNotNull(), F.least(x, F.lit(cap) if not isinstance(cap, Column) else cap))


def clip_lower(x, floor) -> Column:
    x = _c(x)
    return F.when(x.isNotNull(), F.greatest(x, F.lit(floor)))


def missing_flag(x) -> Column:
    return _c(x).isNull().cast("double")


# ---------------------------------------------------------------- dates
def period_to_date(period) -> Column:
    """'yyyy-MM' text to the first day of that month; bad text to NULL."""
    return F.try_to_date(F.concat(_c(period), F.lit("-01")), "yyyy-MM-dd")


def excel_serial_to_date(serial) -> Column:
    """Spreadsheet serial day number (days since 1899-12-30) to DATE."""
    days = _c(serial).cast("double")
    ok = days.between(-693593, 2958465)          # year 1 .. 9999-12-31
    return F.when(ok, F.date_add(F.lit(EXCEL_EPOCH).cast("date"), F.floor(days).cast("int")))


def mixed_date_text(raw) -> Column:
    """A date held as serial number or text, returned as 'yyyy-MM-dd' text.

    Numbers are taken as serial days (integer part); anything else keeps
    its own text; NULL stays NULL."""
    raw = _c(raw).cast("string")
    as_date = F.date_format(excel_serial_to_date(raw.try_cast("double")), "yyyy-MM-dd")
    return F.coalesce(as_date, raw)


def months_between_days(later, earlier) -> Column:
    """Duration in average months: day difference / 30.44."""
    return F.datediff(_c(later), _c(earlier)) / F.lit(DAYS_PER_MONTH)


# ---------------------------------------------------------------- coercions
def coerce_numeric(x) -> Column:
    return _c(x).cast("string").try_cast("double")


def coerce_numeric_cols(df, cols: list[str]) -> dict:
    """Numeric coercion per column that parses text only where the column
    holds text; numeric columns are just cast (no string round trip)."""
    types = dict(df.dtypes)
    return {c: (coerce_numeric(c) if types.get(c) == "string" else F.col(c).cast("double")) for c in cols}


def coerce_bool(x) -> Column:
    """True only for text 'true' in any case; everything else (and NULL) false."""
    return F.coalesce(F.lower(_c(x).cast("string")) == F.lit("true"), F.lit(False))


def coerce_flag_int(x) -> Column:
    return F.coalesce(coerce_numeric(x), F.lit(0.0)).cast("int")


def period_year(period) -> Column:
    return F.substring(_c(period), 1, 4).try_cast("int")


def period_month(period) -> Column:
    return F.substring(_c(period), 6, 2).try_cast("int")


def quarter_of_month(month) -> Column:
    return (F.floor((_c(month) - 1) / 3) + 1).cast("int")


def clean_zip(x) -> Column:
    """Five-digit zip text: part before '-', read as a number, zero padded;
    empty, NULL or unreadable values give '00000'."""
    head = F.split(F.trim(_c(x).cast("string")), "-").getItem(0)
    digits = head.try_cast("double").try_cast("long").cast("string")
    # zero-pad short values only: lpad would cut longer ones to five characters
    padded = F.when(F.length(digits) >= 5, digits).otherwise(F.lpad(digits, 5, "0"))
    return F.coalesce(padded, F.lit("00000"))


# ---------------------------------------------------------------- ratios
def guarded_ratio(num, den) -> Column:
    den = _c(den)
    return F.when(den > 0, _c(num) / den)


def balance_paydown(orig, end) -> Column:
    """(orig - end) / orig, or 0.0 when orig is not positive / missing."""
    orig = _c(orig)
    return F.when(orig > 0, (orig - _c(end)) / orig).otherwise(F.lit(0.0))


def log1p_floor0(x) -> Column:
    return F.log1p(clip_lower(x, 0.0))


# ---------------------------------------------------------------- keys
def loan_uid(orig_date, mat_date, zip5, prop_type, balance) -> Column:
    """orig_mat_zip_type_balance with the balance rounded half-even to 1000."""
    bal = F.coalesce(coerce_numeric(balance), F.lit(0.0))
    bal_k = F.bround(bal, -3).cast("long").cast("string")
    return F.concat_ws(
        "_",
        F.coalesce(_c(orig_date), F.lit("NA")),
        F.coalesce(_c(mat_date), F.lit("NA")),
        F.coalesce(_c(zip5), F.lit("00000")),
        F.coalesce(_c(prop_type).cast("string"), F.lit("NA")),
        bal_k,
    )


# ---------------------------------------------------------------- categories
def payment_type(is_io, io_months, orig_term) -> Column:
    io = F.coalesce(_c(io_months), F.lit(0.0))
    term = F.coalesce(_c(orig_term), F.lit(0.0))
    interest_only = F.coalesce(_c(is_io), F.lit(False)) | (
        (io > 0) & (term > 0) & (io >= term * F.lit(IO_SHARE_OF_TERM)))
    return (F.when(interest_only, F.lit("Interest-Only"))
            .when(io > 0, F.lit("Partial IO"))
            .otherwise(F.lit("Amortizing")))


def payment_type_ordinal(ptype) -> Column:
    expr = F.lit(0)
    for name, val in PAYMENT_TYPE_ORDINAL.items():
        expr = F.when(_c(ptype) == name, F.lit(val)).otherwise(expr)
    return expr.cast("double")


def one_hot(x, values, prefix: str) -> list[Column]:
    return [flag(_c(x) == F.lit(v)).alias(f"{prefix}{v}") for v in values]


def regime_between(period, lo: str, hi: str) -> Column:
    """Inclusive text-range flag on 'yyyy-MM' periods."""
    return flag(_c(period).between(F.lit(lo), F.lit(hi)))


def macro_regime(period, first_break: str, second_break: str) -> Column:
    """0 before ``first_break``; 1 up to and including ``second_break``; then 2."""
    p = _c(period)
    return (F.when(p < F.lit(first_break), F.lit(0))
            .when(p <= F.lit(second_break), F.lit(1))
            .otherwise(F.lit(2)))


def payment_type_lenient(is_io, io_months, orig_term) -> Column:
    """Classifier used when no payment type column exists: like
    ``payment_type`` but unparseable term numbers give 'Other'."""
    io_raw, term_raw = _c(io_months), _c(orig_term)
    io = F.coalesce(io_raw.cast("string").try_cast("double"), F.lit(0.0))
    term = F.coalesce(term_raw.cast("string").try_cast("double"), F.lit(0.0))
    bad = ((io_raw.isNotNull() & io_raw.cast("string").try_cast("double").isNull())
           | (term_raw.isNotNull() & term_raw.cast("string").try_cast("double").isNull()))
    io_flag = F.coalesce(_c(is_io), F.lit(False))
    interest_only = io_flag | ((io > 0) & (term > 0) & (io >= term * F.lit(IO_SHARE_OF_TERM)))
    return (F.when(bad, F.lit("Other"))
            .when(interest_only, F.lit("Interest-Only"))
            .when(io > 0, F.lit("Partial IO"))
            .when((term > 0) | ~io_flag, F.lit("Amortizing"))
            .otherwise(F.lit("Other")))
