"""Train/test splits, validation carve, target encoding, median imputation.

Fitted values (state means, medians) are computed on training rows only
and applied to every part; they are small per-group tables (one row per
state or per feature), joined by broadcast or brought back as scalars.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arrears.operators.prefix import running_sums, wide_quantiles
from arrears.sources.scratch import written


# ---------------------------------------------------------------- M1
def temporal_split(df: DataFrame, period: str, cutoff: str, embargo_months: int = 0) -> DataFrame:
    """Row-level split on month text: before the cutoff is train.

    With ``embargo_months`` > 0 the last months before the cutoff, whose
    forward labels look past it, are marked 'embargo' instead of train."""
    train_end = cutoff
    if embargo_months:
        d = F.add_months(F.to_date(F.concat(F.lit(cutoff[:7]), F.lit("-01"))), -embargo_months)
        train_end = F.date_format(d, "yyyy-MM")
    p = F.col(period)
    lim = F.lit(train_end) if isinstance(train_end, str) else train_end
    return df.withColumn("split", F.when(p < lim, F.lit("train"))
                         .when(p < F.lit(cutoff), F.lit("embargo")).otherwise(F.lit("test")))


# ---------------------------------------------------------------- M2 / W16
def first_period(loan: str, period: str) -> Column:
    return F.min(period).over(Window.partitionBy(loan))


def cohort_split(df: DataFrame, loan: str, period: str, cutoff: str, as_date: bool = False) -> DataFrame:
    """Loan-level split: a loan goes wholly to train when its first month
    compares (as text) below the cutoff.  Text comparison puts '2022-01'
    before '2022-01-01', so that month's new loans train; ``as_date=True``
    compares first-of-month dates instead (they then test)."""
    df = df.withColumn("first_period", first_period(loan, period))
    if as_date:
        first = F.to_date(F.concat(F.col("first_period"), F.lit("-01")))
        is_train = first < F.to_date(F.lit(cutoff))
    else:
        is_train = F.col("first_period") < F.lit(cutoff)
    return df.withColumn("split", F.when(is_train, F.lit("train")).otherwise(F.lit("test")))


# ---------------------------------------------------------------- M3
def validation_cut(train: DataFrame, loan: str, period: str, fraction: float = 0.10):
    """(boundary month, key) of the last ``fraction`` of loans by first month
    (at least one), ties on the first month broken by the larger loan key;
    None without any loan. Loans without a month, or without a key, are not
    carved.

    The cut is found without a global sort: counts per first month (one row
    per month) locate the boundary month, and an exact order statistic of
    the keys inside that month finishes it."""
    # one row per loan, read by the two small jobs below
    loans = written(train.sparkSession, train.where(F.col(loan).isNotNull()).groupBy(loan).agg(F.min(period).alias("first_period"))
                    .where(F.col("first_period").isNotNull()), "carve-loans")
    # Loans per first month: one row per calendar month, brought back whole.
    months = sorted(((r["first_period"], r["n"]) for r in
                     loans.groupBy("first_period").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    if not months:
        return None
    n_val = max(1, int(sum(n for _, n in months) * fraction))
    before, boundary = 0, None
    for m, n in months:                       # latest month first
        if before + n >= n_val:
            boundary = m
            break
        before += n
    in_month = loans.where(F.col("first_period") == boundary).select(F.col(loan).alias("_k"))
    ranked = running_sums(in_month.withColumn("_one", F.lit(1)), "_k", ["_one"], descending=True)
    key_cut = ranked.where(F.col("cum__one") == n_val - before).select("_k").first()["_k"]
    return boundary, key_cut


def in_validation(first: Column, loan: str, cut) -> Column:
    """Whether a loan whose first month is ``first`` lies beyond the cut."""
    if cut is None:
        return F.lit(False)
    boundary, key = cut
    beyond = (first > F.lit(boundary)) | ((first == F.lit(boundary)) & (F.col(loan) >= F.lit(key)))
    return F.coalesce(beyond, F.lit(False))


def mark_validation(train: DataFrame, loan: str, period: str, fraction: float = 0.10, out: str = "_is_val") -> DataFrame:
    """``train`` with a flag on the rows of the carved loans (no join)."""
    cut = validation_cut(train, loan, period, fraction)
    return train.withColumn(out, in_validation(first_period(loan, period), loan, cut))


def validation_loans(train: DataFrame, loan: str, period: str, fraction: float = 0.10) -> DataFrame:
    """The carved loans, one row each."""
    return mark_validation(train, loan, period, fraction).where("_is_val").select(loan).distinct()


# ---------------------------------------------------------------- M4
def fit_target_encoding(train: DataFrame, key: str, target: str):
    """Per-key mean of the target on train, plus the global mean."""
    means = train.where(F.col(key).isNotNull()).groupBy(key).agg(F.avg(target).alias("_te"))
    glob = train.agg(F.avg(target)).first()[0]
    return means, glob


def apply_target_encoding(df: DataFrame, key: str, means: DataFrame, glob: float, out: str) -> DataFrame:
    # One row per key value, which may be many: the planner picks the join by measured size.
    return (df.join(means, key, "left")
              .withColumn(out, F.coalesce(F.col("_te"), F.lit(glob)))
              .drop("_te"))


# ---------------------------------------------------------------- A13 / M5
def train_medians(train: DataFrame, features: list[str]) -> DataFrame:
    """Exact median of every feature on train rows: (feature, median), without
    the features that have no value."""
    found = wide_quantiles(train, features, 0.5)
    return train.sparkSession.createDataFrame([(f, m) for f, m in found.items() if m is not None], "feature string, median double")


def impute(df: DataFrame, medians: dict[str, float]) -> DataFrame:
    """Fill NULLs with the fitted medians; a feature with no median stays NULL."""
    return df.withColumns({f: F.coalesce(F.col(f), F.lit(m).cast("double"))
                           for f, m in medians.items() if m is not None})


def collect_medians(med_df: DataFrame) -> dict[str, float]:
    # One row per feature: a small, feature-bounded collect.
    return {r["feature"]: r["median"] for r in med_df.collect()}


# ---------------------------------------------------------------- A15 / A19 / U2
def class_ratio(df: DataFrame, label: str) -> DataFrame:
    neg = F.sum(F.when(F.col(label) == 0, 1).otherwise(0))
    pos = F.sum(F.when(F.col(label) == 1, 1).otherwise(0))
    return df.agg(neg.cast("long").alias("n_neg"), pos.cast("long").alias("n_pos")).select(
        "n_neg", "n_pos",
        (F.col("n_neg") / F.col("n_pos")).alias("neg_pos_ratio"),
        (F.col("n_neg") / F.greatest(F.col("n_pos"), F.lit(1))).alias("scale_pos_weight"))


def split_stats(df: DataFrame, loan: str, period: str, label: str) -> DataFrame:
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct(loan).alias("n_loans"),
        F.min(period).alias("first_period"), F.max(period).alias("last_period"),
        F.avg(label).alias("positive_rate"))


def split_overlap(df: DataFrame, loan: str) -> DataFrame:
    tr = df.where(F.col("split") == "train").select(loan)
    te = df.where(F.col("split") == "test").select(loan)
    return tr.intersect(te).agg(F.count(F.lit(1)).alias("loans_in_both"))


def split_warnings(stats: DataFrame, shift: float = 0.05, low: float = 70.0, high: float = 90.0) -> DataFrame:
    """One row per scheme of ``split_stats`` rows (with a ``scheme`` column):
    the training share of loans, the positive rates, and whether the rates
    differ by more than ``shift`` or the share is outside ``low`` to ``high``."""
    def of(split: str, col: str):
        return F.max(F.when(F.col("split") == split, F.col(col)))
    by = stats.groupBy("scheme").agg(
        F.coalesce(of("train", "n_loans"), F.lit(0)).alias("_tr"), F.coalesce(of("test", "n_loans"), F.lit(0)).alias("_te"),
        of("train", "positive_rate").alias("train_rate"), of("test", "positive_rate").alias("test_rate"))
    share = F.try_divide(F.col("_tr"), F.col("_tr") + F.col("_te")) * 100.0
    return by.select(
        "scheme", share.alias("train_share_pct"), "train_rate", "test_rate",
        (F.abs(F.col("train_rate") - F.col("test_rate")) > shift).alias("large_shift"),
        ((share < low) | (share > high)).alias("share_outside"))
