"""Model jobs: scores, comparison, importance.

Scores of a trained model have no SQL oracle; ``model_audit`` and
``attribution_audit`` check what must hold for any model against SQL counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from arrears.operators import boosting as B
from arrears.operators import features as FE
from arrears.operators import metrics as MT
from arrears.operators import models as MD
from arrears.operators import splits as S
from arrears.plans.q_features import frame as c_frame
from arrears.plans.oracle_base import with_
from arrears.plans.q_splits import COHORT_SQL, CSPLIT_SQL, cohort_parts
from arrears.plans.registry import register
from arrears.sources.cohort import COHORT_FEATURES
from arrears.sources.scratch import fresh_path, written

CUT = FE.FIXTURE.cutoff
FEATS = FE.ALL_FEATURES
KEYS = ["asset_number", "period"]


def c_model_data(spark, sf_dir, label: str = "label_6m", medians: dict | None = None, frame=None):
    """Imputed train (with a validation flag) and test frames of the 70-feature
    matrix; ``frame`` reuses a matrix that is already prepared."""
    frame = c_frame(spark, sf_dir) if frame is None else frame
    df = written(spark, S.temporal_split(frame.where(F.col(label).isNotNull()), "period", CUT), "model-rows")
    train = df.where(F.col("split") == "train")
    test = df.where(F.col("split") == "test")
    if medians is None:
        medians = S.collect_medians(S.train_medians(train, FEATS))
    train = S.mark_validation(S.impute(train, medians), "asset_number", "period", 0.10)
    return train, S.impute(test, medians), medians


def _fit_score(spark, sf_dir, params, label="label_6m"):
    train, test, _ = c_model_data(spark, sf_dir, label)
    model = MD.fit(spark, train, FEATS, label, params)
    return model, B.score(spark, model, test).select(*KEYS, label, "pred_proba")


@register("model_a_scores")
def model_a_scores(spark, sf_dir):
    return _fit_score(spark, sf_dir, MD.MODEL_A)[1]


@register("model_c_scores")
def model_c_scores(spark, sf_dir):
    return _fit_score(spark, sf_dir, MD.MODEL_C)[1]


@register("model_lifecycle_scores")
def model_lifecycle_scores(spark, sf_dir):
    # Six-month medians are reused for the lifecycle model.
    frame = c_frame(spark, sf_dir)
    _, _, med = c_model_data(spark, sf_dir, "label_6m", frame=frame)
    train, test, _ = c_model_data(spark, sf_dir, "label_ever", med, frame)
    model = MD.fit(spark, train, FEATS, "label_ever", MD.MODEL_C)
    return B.score(spark, model, test).select(*KEYS, "label_ever", "pred_proba")


def cohort_model_data(spark, sf_dir):
    parts = cohort_parts(spark, sf_dir)
    tr = parts.where(F.col("part") == "train")
    means, glob = S.fit_target_encoding(tr, "state", "target")
    feats = COHORT_FEATURES + ["state_te"]
    parts = written(spark, S.apply_target_encoding(parts, "state", means, glob, "state_te"), "cohort-rows")
    med = S.collect_medians(S.train_medians(parts.where(F.col("part") == "train"), feats))
    full = S.impute(parts, med).withColumn("_is_val", F.col("part") == "val")
    return full.where(F.col("part") != "test"), full.where(F.col("part") == "test"), feats


@register("model_cohort_scores")
def model_cohort_scores(spark, sf_dir):
    train, test, feats = cohort_model_data(spark, sf_dir)
    model = MD.fit(spark, train, feats, "target", MD.MODEL_COHORT)
    return B.score(spark, model, test).select("ac_key", "report_period", "target", "pred_proba")


@register("feature_importance")
def feature_importance(spark, sf_dir):
    """Of the cohort model, as in the reference."""
    train, _, feats = cohort_model_data(spark, sf_dir)
    return MD.top_importance(spark, MD.fit(spark, train, feats, "target", MD.MODEL_COHORT), 20).select("feature", "gain", "n_splits", "share")


def _metrics_row(scored, label):
    a = MT.auroc(scored, "pred_proba", label).first()["auroc"]
    p = MT.average_precision(scored, "pred_proba", label).first()["average_precision"]
    return a, p


NAMES = {"A": "A: boosted trees, 70 features", "B": "B: boosted trees + oversampling, 70 features",
         "C": "C: leaf-wise boosted trees, 70 features", "lifecycle": "lifecycle (ever-default), model C settings"}


def six_month_and_lifecycle(spark, sf_dir):
    """Models A, B (oversampled), C and the lifecycle model on one prepared
    matrix: name -> (training rows, features, label, settings, test rows). The
    lifecycle model reuses the six-month medians."""
    from arrears.operators import sampling as SM
    frame = c_frame(spark, sf_dir)
    train, test, med = c_model_data(spark, sf_dir, frame=frame)
    synth = SM.oversample(spark, train.where(~F.col("_is_val")), FEATS, "label_6m", KEYS, 0.1, 5, 42)
    balanced = train.select(*FEATS, "label_6m", "_is_val").unionByName(
        synth.select(*FEATS, "label_6m").withColumn("_is_val", F.lit(False)))
    ltrain, ltest, _ = c_model_data(spark, sf_dir, "label_ever", med, frame)
    return {"A": (train, FEATS, "label_6m", MD.MODEL_A, test), "B": (balanced, FEATS, "label_6m", MD.MODEL_A, test),
            "C": (train, FEATS, "label_6m", MD.MODEL_C, test), "lifecycle": (ltrain, FEATS, "label_ever", MD.MODEL_C, ltest)}


@register("model_comparison")
def model_comparison(spark, sf_dir):
    """Reference rows, models A, B, C and the lifecycle model: AUROC and PR-AUC,
    the gap to the old baseline, rounds looked at and the best one."""
    rows = [(name, auc, ap, None, None, None) for name, auc, ap in MD.REFERENCE_ROWS]
    by = {}
    data = six_month_and_lifecycle(spark, sf_dir)
    models = MD.fit_all(spark, {name: d[:4] for name, d in data.items()})
    for name, (_, _, label, _, test) in data.items():
        model = models[name]
        auc, ap = by[name] = _metrics_row(B.score(spark, model, test), label)
        rows.append((NAMES[name], auc, ap, (auc - MD.BASELINE_AUROC) * 100.0, model.rounds_fitted, model.best_round))
    for gap, x, y in (("gap: C - A", "C", "A"), ("gap: lifecycle - C", "lifecycle", "C")):
        rows.append((gap, by[x][0] - by[y][0], by[x][1] - by[y][1], (by[x][0] - by[y][0]) * 100.0, None, None))
    return spark.createDataFrame(rows, "model string, auroc double, pr_auc double, auroc_vs_baseline_pp double, rounds_fitted int, best_round int")


def _audit_sql(model: str, keys: str, label: str, source: str) -> str:
    return f"""SELECT {model} AS model, n_rows, n_positive, n_keys, n_rows AS n_in_range, n_rows AS n_same_again
FROM (SELECT count(*) AS n_rows, CAST(sum({label}) AS BIGINT) AS n_positive, count(DISTINCT ({keys})) AS n_keys FROM {source})"""


@register("model_audit", sql=with_(CSPLIT_SQL + "," + COHORT_SQL) + " UNION ALL ".join((
    _audit_sql("unnest(['A', 'B', 'C'])", "asset_number, period", "label_6m", "csplit WHERE split = 'test'"),
    _audit_sql("'lifecycle'", "asset_number, period", "label_ever", f"cfeat WHERE label_ever IS NOT NULL AND period >= '{CUT}'"),
    _audit_sql("'cohort'", "ac_key, report_period", "target", "cparts WHERE part = 'test'"))))
def model_audit(spark, sf_dir):
    """Every test row of each model is scored once, inside (0, 1),
    with its own label, and alike by the model written and read back."""
    data = six_month_and_lifecycle(spark, sf_dir)
    train, test, feats = cohort_model_data(spark, sf_dir)
    data["cohort"] = (train, feats, "target", MD.MODEL_COHORT, test)
    models = MD.fit_all(spark, {name: d[:4] for name, d in data.items()})
    out = None
    for name, (_, _, label, _, rows) in data.items():
        model, keys = models[name], ["ac_key", "report_period"] if name == "cohort" else KEYS
        path = fresh_path(spark, f"model-{name}")
        B.save(spark, model, path)
        both = B.score(spark, B.load(spark, path), B.score(spark, model, rows), "again")
        one = both.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(label).cast("long").alias("n_positive"), F.count_distinct(*keys).alias("n_keys"),
                       F.count_if((F.col("pred_proba") > 0) & (F.col("pred_proba") < 1)).alias("n_in_range"),
                       F.count_if(F.col("pred_proba") == F.col("again")).alias("n_same_again")).select(F.lit(name).alias("model"), "*")
        out = one if out is None else out.unionByName(one)
    return out
