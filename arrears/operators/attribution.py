"""Per-row attributions for boosted trees.

Path-dependent tree SHAP values (Lundberg, Erion & Lee, "Consistent
individualized feature attribution for tree ensembles", 2018) in margin space.

A leaf with d features on its path gives a row one of 2**d contributions,
by which of the d features send the row towards the leaf. Those are worked out
once per leaf, for all subsets, as polynomials in the subset's size; a row then
needs its decisions at the inner nodes and one table look-up per leaf and
feature, done for a batch of rows at a time. The ensemble is broadcast (trees x
nodes), tables are made by the tasks, and rows are spread by Spark.

Local accuracy holds per row: sum(phi) + base = margin, where
P(y=1) = 1 / (1 + exp(-margin)).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arrears.operators.boosting import MARGIN_SHIFT, Model, is_leaf, margins
from arrears.session import ship_package

ROWS = 8192              # rows evaluated at once
MOST = 12                # features on one path: a leaf's table has 2**MOST rows at most
UNIT = float(1 << MARGIN_SHIFT)


@dataclass
class Leaf:
    features: np.ndarray                          # distinct features on the path
    steps: list[list[tuple[int, bool]]]           # per feature its nodes and whether the path goes left
    table: np.ndarray                             # (d, 2**d): contribution by pattern of satisfied features


def leaf_paths(tree: dict) -> list[tuple[float, dict[int, tuple[float, list[tuple[int, bool]]]]]]:
    """Per leaf its value and, by feature, the share of rows that its nodes send
    towards the leaf and those nodes."""
    leaf, n = is_leaf(tree), tree["n"].astype(float)
    out, todo = [], [(0, {})]
    while todo:
        node, path = todo.pop()
        if leaf[node]:
            out.append((tree["value"][node] / UNIT, path))
            continue
        f = int(tree["feature"][node])
        share, steps = path.get(f, (1.0, []))
        for child, left in ((int(tree["left"][node]), True), (int(tree["right"][node]), False)):
            todo.append((child, path | {f: (share * n[child] / n[node], steps + [(node, left)])}))
    return out


def subset_tables(value: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Shapley contributions (leaves, 2**d, d) of leaves with ``d`` features: a
    feature outside the subset passes its ``share``, one inside passes 1 or 0."""
    leaves, d = share.shape
    one = ((np.arange(1 << d)[:, None] >> np.arange(d)) & 1).astype(float)
    weight = np.array([factorial(s) * factorial(d - 1 - s) / factorial(d) for s in range(d)])
    out = np.empty((leaves, 1 << d, d))
    for j in range(d):
        by_size = np.zeros((leaves, 1 << d, d))
        by_size[:, :, 0] = 1.0
        for i in range(d):
            if i != j:
                by_size[:, :, 1:] = by_size[:, :, 1:] * share[:, None, i, None] + by_size[:, :, :-1] * one[None, :, i, None]
                by_size[:, :, 0] *= share[:, None, i]
        out[:, :, j] = value[:, None] * (one[None, :, j] - share[:, None, j]) * (by_size @ weight)
    return out


def path_tables(tree: dict) -> list[Leaf]:
    paths = leaf_paths(tree)
    by_depth: dict[int, list] = {}
    for value, path in paths:
        if len(path) > MOST:
            raise ValueError(f"more than {MOST} features on one path")
        if path:
            by_depth.setdefault(len(path), []).append((value, path))
    out = []
    for group in by_depth.values():
        tables = subset_tables(np.array([v for v, _ in group]), np.array([[s for s, _ in p.values()] for _, p in group]))
        out += [Leaf(np.array(list(p)), [steps for _, steps in p.values()], np.ascontiguousarray(t.T)) for (_, p), t in zip(group, tables)]
    return out


def expected_value(tree: dict) -> float:
    leaf = is_leaf(tree)
    return float((tree["value"][leaf] / UNIT * tree["n"][leaf]).sum() / max(tree["n"][0], 1))


def tree_shap(tree: dict, leaves: list[Leaf], x: np.ndarray) -> np.ndarray:
    """Contributions (features, rows) of one tree to rows ``x`` (features, rows)."""
    phi, n = np.zeros(x.shape), x.shape[1]
    inner = np.flatnonzero(~is_leaf(tree))
    go = np.zeros((len(tree["left"]), n), np.uint16)
    v = x[tree["feature"][inner]]
    go[inner] = np.where(np.isnan(v), tree["missing_left"][inner, None], v <= tree["threshold"][inner, None])
    stay = 1 - go
    pattern, both, got = np.empty(n, np.uint16), np.empty(n, np.uint16), np.empty(n)
    for leaf in leaves:
        pattern[:] = 0
        for steps in reversed(leaf.steps):          # the first feature is the lowest bit
            hit, *more = (go[k] if left else stay[k] for k, left in steps)
            for h in more:
                hit = np.bitwise_and(hit, h, out=both)
            pattern += pattern
            pattern += hit
        at = pattern.astype(np.intp)
        for f, part in zip(leaf.features, leaf.table):
            phi[f] += part.take(at, out=got, mode="clip")       # a pattern is always inside its table
    return phi


class Explainer:
    """Path tables of an ensemble, made once per task."""

    def __init__(self, trees: list[dict], base: int):
        self.trees, self.first = trees, base
        self.leaves = [path_tables(t) for t in trees]
        self.base = base / UNIT + sum(expected_value(t) for t in trees)

    def phi(self, x: np.ndarray) -> np.ndarray:
        """(rows, features) for ``x`` (rows, features)."""
        out = np.empty(x.shape)
        for a in range(0, len(x), ROWS):
            part = np.ascontiguousarray(x[a:a + ROWS].T)
            phi = np.zeros(part.shape)
            for tree, leaves in zip(self.trees, self.leaves):
                phi += tree_shap(tree, leaves, part)
            out[a:a + ROWS] = phi.T
        return out

    def margin(self, x: np.ndarray) -> np.ndarray:
        return margins(self.trees, self.first, np.ascontiguousarray(x.T)) / UNIT


# ---------------------------------------------------------------- Spark jobs
def _matrix(pdf: pd.DataFrame, features: list[str]) -> np.ndarray:
    return pdf[features].to_numpy(dtype=float, na_value=np.nan)


def mean_abs_attribution(spark: SparkSession, df: DataFrame, model: Model) -> DataFrame:
    """Mean |phi| per feature over all rows of ``df``, ranked."""
    ship_package(spark)
    features = model.features
    bc = spark.sparkContext.broadcast((model.trees, model.base))

    def per_batch(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        explain = None
        for pdf in it:
            if pdf.empty:
                continue
            explain = explain or Explainer(*bc.value)
            phi = explain.phi(_matrix(pdf, features))
            yield pd.DataFrame({"feature": features, "sum_abs": np.abs(phi).sum(axis=0),
                                "n": np.full(len(features), len(pdf), dtype=np.int64)})

    partial = df.select(*features).mapInPandas(per_batch, "feature string, sum_abs double, n long")
    agg = partial.groupBy("feature").agg((F.sum("sum_abs") / F.sum("n")).alias("mean_abs_shap"))
    return agg.orderBy(F.col("mean_abs_shap").desc(), "feature")


def row_attributions(spark: SparkSession, df: DataFrame, model: Model, keys: list[str]) -> DataFrame:
    """(keys, feature, phi, base, margin) for every row of ``df``."""
    ship_package(spark)
    features = model.features
    bc = spark.sparkContext.broadcast((model.trees, model.base))
    key_types = {f.name: f.dataType.simpleString() for f in df.schema.fields if f.name in keys}

    def per_batch(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        explain = None
        for pdf in it:
            if pdf.empty:
                continue
            explain = explain or Explainer(*bc.value)
            X = _matrix(pdf, features)
            phi, base, mg = explain.phi(X), explain.base, explain.margin(X)
            n, m = phi.shape
            out = {k: np.repeat(pdf[k].to_numpy(), m) for k in keys}
            out.update({"feature": np.tile(np.array(features, dtype=object), n), "phi": phi.ravel(),
                        "base": np.full(n * m, base), "margin": np.repeat(mg, m)})
            yield pd.DataFrame(out)

    schema = ", ".join(f"{k} {key_types[k]}" for k in keys) + \
        ", feature string, phi double, base double, margin double"
    return df.select(*keys, *features).mapInPandas(per_batch, schema)


def top_features_per_row(attr: DataFrame, keys: list[str], k: int = 5) -> DataFrame:
    """The k largest |phi| per row, with the sign as direction."""
    w = Window.partitionBy(*keys).orderBy(F.abs("phi").desc(), "feature")
    return (attr.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
                .withColumn("direction", F.when(F.col("phi") > 0, F.lit("raises risk"))
                            .otherwise(F.lit("lowers risk"))))
