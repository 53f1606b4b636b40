"""Exact quantiles and rank metrics against brute force on small fixtures."""

import numpy as np
import pytest

from arrears.operators import metrics as MT
from arrears.operators.prefix import _Bracket, exact_quantile, running_sums, wide_quantiles


def test_exact_quantile(spark):
    rng = np.random.default_rng(3)
    vals = np.round(rng.normal(size=3000), 2).tolist() + [5.0] * 1000 + [None] * 50
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    arr = np.array([v for v in vals if v is not None])
    for q in (0.0, 0.1, 0.5, 0.99, 1.0):
        assert abs(exact_quantile(df, "x", q) - np.quantile(arr, q)) < 1e-12


@pytest.mark.parametrize("inside", [3, 40, 100_000])
def test_wide_quantiles(spark, inside):
    """Brackets narrowed over several rounds, ties at their ends, columns without values."""
    rng = np.random.default_rng(4)
    n = 3000
    cols = {"a": rng.exponential(size=n), "b": np.round(rng.normal(size=n), 1), "c": (rng.random(n) < 0.5).astype(float),
            "d": np.where(rng.random(n) < 0.3, np.nan, rng.normal(size=n)), "e": np.full(n, 7.0), "f": np.full(n, np.nan), "g": np.arange(n) % 2 * 1e300}
    rows = [tuple(None if np.isnan(v) and i % 2 else float(v) for v in r) for i, r in enumerate(zip(*cols.values()))]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols)).repartition(3)
    for q in (0.0, 0.5, 0.99, 1.0):
        got = wide_quantiles(df, list(cols), q, inside=inside)
        assert got.pop("f") is None
        for c, v in got.items():
            x = cols[c][~np.isnan(cols[c])]
            assert v == pytest.approx(np.quantile(x, q), rel=1e-12), (c, q)
    assert wide_quantiles(df.limit(0), ["a"], 0.5) == {"a": None}


def test_bracket_that_misses_is_widened():
    b = _Bracket([50], 101)
    b.narrow(60.0, 70.0, 60, 1, 9, 1)
    assert b.open == [50] and b.lo is None and b.margin > 2 / 1000
    b.narrow(40.0, 60.0, 40, 1, 19, 1)
    assert (b.lo, b.hi, b.base, b.n) == (40.0, 60.0, 41, 19)


@pytest.mark.parametrize("descending", [False, True])
def test_running_sums_over_three_levels(spark, descending):
    """Ranges of about 10 values, 4 range sums at once: sums of sums of sums."""
    rng = np.random.default_rng(6)
    keys = rng.permutation(400)
    df = spark.createDataFrame([(f"k{k:04d}", int(k) % 7, 1) for k in keys], "k string, n int, one int")
    got = {r["k"]: (r["cum_n"], r["cum_one"]) for r in running_sums(df, "k", ["n", "one"], descending, rows_per_range=10, at_once=4).collect()}
    acc = [0, 0]
    for k in sorted(keys, reverse=descending):
        acc = [acc[0] + int(k) % 7, acc[1] + 1]
        assert got[f"k{k:04d}"] == tuple(acc)


def test_running_sums(spark):
    rows = [(float(i % 97), 1) for i in range(2000)]
    df = spark.createDataFrame(rows, "k double, one int").groupBy("k").sum("one").withColumnRenamed("sum(one)", "n")
    got = {r["k"]: r["cum_n"] for r in running_sums(df, "k", ["n"]).collect()}
    counts = {}
    for k, _ in rows:
        counts[k] = counts.get(k, 0) + 1
    acc = 0
    for k in sorted(counts):
        acc += counts[k]
        assert got[k] == acc


def brute_auc(s, y):
    pos = [a for a, b in zip(s, y) if b == 1]
    neg = [a for a, b in zip(s, y) if b == 0]
    tot = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def brute_ap(s, y):
    ths = sorted(set(s), reverse=True)
    P = sum(y)
    ap, prev_r = 0.0, 0.0
    for t in ths:
        tp = sum(1 for a, b in zip(s, y) if a >= t and b == 1)
        fp = sum(1 for a, b in zip(s, y) if a >= t and b == 0)
        r = tp / P
        ap += (r - prev_r) * (tp / (tp + fp))
        prev_r = r
    return ap


def test_auroc_ap_with_ties(spark):
    rng = np.random.default_rng(5)
    s = np.round(rng.uniform(size=600), 2).tolist()
    y = [int(rng.random() < 0.2 + 0.5 * v) for v in s]
    df = spark.createDataFrame(list(zip(s, y)), "score double, y int")
    auc = MT.auroc(df, "score", "y").first()[0]
    ap = MT.average_precision(df, "score", "y").first()[0]
    assert abs(auc - brute_auc(s, y)) < 1e-12
    assert abs(ap - brute_ap(s, y)) < 1e-12
    # invariant under a monotone map of the scores
    df2 = df.selectExpr("exp(3 * score) AS score", "y")
    assert abs(MT.auroc(df2, "score", "y").first()[0] - auc) < 1e-12
