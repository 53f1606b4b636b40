"""Tree SHAP: local accuracy, agreement with brute-force Shapley values, and the Spark jobs."""

import itertools
import math

import numpy as np

from arrears.operators import attribution as AT
from arrears.operators import boosting as B


def _fit(spark, **params):
    rng = np.random.default_rng(7)
    x = np.round(rng.normal(size=(400, 4)), 2)
    y = ((x[:, 0] + 0.5 * x[:, 1] * (x[:, 2] > 0) + 0.3 * rng.normal(size=400)) > 0).astype(int)
    x[rng.random(x.shape) < 0.05] = np.nan
    rows = [(i, *(None if np.isnan(v) else float(v) for v in r), int(t)) for i, (r, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, d double, y int")
    p = B.TreeParams(rounds=6, eta=0.3, start_at_mean=True, **params)
    return B.fit(spark, df, list("abcd"), "y", p, weight=2.0), df, x


def _expected(tree, x, known):
    """Value of a row of which only the features in ``known`` are known."""
    def rec(j):
        left, right = tree["left"][j], tree["right"][j]
        if left == j:
            return tree["value"][j] / AT.UNIT
        f = int(tree["feature"][j])
        if f in known:
            go = tree["missing_left"][j] if np.isnan(x[f]) else x[f] <= tree["threshold"][j]
            return rec(left if go else right)
        return (tree["n"][left] * rec(left) + tree["n"][right] * rec(right)) / tree["n"][j]
    return rec(0)


def test_against_brute_force(spark):
    for params in ({"growth": "level", "max_depth": 3}, {"growth": "leaf", "max_depth": 6, "max_leaves": 12}):
        model, _, x = _fit(spark, **params)
        explain = AT.Explainer(model.trees, model.base)
        phi = explain.phi(x)
        np.testing.assert_allclose(phi.sum(axis=1) + explain.base, explain.margin(x), atol=1e-9)
        m = x.shape[1]
        for r in (0, 7, 100, int(np.flatnonzero(np.isnan(x).any(axis=1))[0])):
            want = np.zeros(m)
            for t in model.trees:
                for i in range(m):
                    others = [j for j in range(m) if j != i]
                    for k in range(m):
                        for some in itertools.combinations(others, k):
                            weight = math.factorial(k) * math.factorial(m - k - 1) / math.factorial(m)
                            want[i] += weight * (_expected(t, x[r], {*some, i}) - _expected(t, x[r], set(some)))
            np.testing.assert_allclose(phi[r], want, atol=1e-9)


def test_jobs(spark):
    model, df, x = _fit(spark, growth="leaf", max_depth=4, max_leaves=9)
    phi = AT.Explainer(model.trees, model.base).phi(x)
    ranked = {r["feature"]: r["mean_abs_shap"] for r in AT.mean_abs_attribution(spark, df.repartition(3), model).collect()}
    np.testing.assert_allclose([ranked[f] for f in "abcd"], np.abs(phi).mean(axis=0), atol=1e-12)
    rows = AT.row_attributions(spark, df, model, ["id"]).toPandas()
    assert len(rows) == x.size
    scores = B.score(spark, model, df).select("id", "pred_proba").toPandas().set_index("id")["pred_proba"]
    for i, g in rows.groupby("id"):
        np.testing.assert_allclose(g["phi"].to_numpy(), phi[i], atol=1e-12)
        assert abs(1 / (1 + math.exp(-(g["phi"].sum() + g["base"].iloc[0]))) - scores[i]) < 1e-9
    top = AT.top_features_per_row(AT.row_attributions(spark, df.limit(3), model, ["id"]), ["id"], 2).collect()
    assert len(top) == 6 and {r["rank"] for r in top} == {1, 2}


def _by_leaf(tree, leaves, x):
    """Contributions row set by row set, as plainly as the leaves say."""
    phi = np.zeros(x.shape)
    go = np.zeros((len(tree["left"]), x.shape[1]), dtype=bool)
    for i in np.flatnonzero(~B.is_leaf(tree)):
        v = x[tree["feature"][i]]
        go[i] = np.where(np.isnan(v), tree["missing_left"][i], v <= tree["threshold"][i])
    for leaf in leaves:
        pattern = np.zeros(x.shape[1], np.int64)
        for j, steps in enumerate(leaf.steps):
            hit = np.logical_and.reduce([go[n] if left else ~go[n] for n, left in steps])
            pattern |= hit.astype(np.int64) << j
        phi[leaf.features] += leaf.table[:, pattern]
    return phi


def test_attributions_are_those_of_the_leaves_and_faster():
    import time
    rng = np.random.default_rng(1)
    t = B.Tree()
    front = [t.add(1 << 12, 0)]
    for _ in range(62):
        a = front.pop(0)
        pair = (t.add(t.n[a] // 2, int(rng.integers(-9**8, 9**8))), t.add(t.n[a] - t.n[a] // 2, int(rng.integers(-9**8, 9**8))))
        t.split(a, B.Split(1.0, int(rng.integers(0, 20)), 5, bool(rng.integers(0, 2)), (0, 0, 0), (0, 0, 0)), float(rng.normal()), pair)
        front += pair
    t.depth = 6
    tree = t.packed()
    leaves = AT.path_tables(tree)
    x = rng.normal(size=(20, AT.ROWS))
    x[rng.random(x.shape) < 0.1] = np.nan

    def seconds(f, rows):
        took = []
        for _ in range(5):
            start = time.perf_counter()
            for a in range(0, x.shape[1], rows):
                f(tree, leaves, np.ascontiguousarray(x[:, a:a + rows]))
            took.append(time.perf_counter() - start)
        return min(took)

    np.testing.assert_array_equal(AT.tree_shap(tree, leaves, x), _by_leaf(tree, leaves, x))
    assert seconds(AT.tree_shap, AT.ROWS) < 0.8 * seconds(_by_leaf, 2048)
