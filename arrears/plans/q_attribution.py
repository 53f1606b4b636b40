"""Attribution jobs on model C.

Attributions of a trained model have no SQL oracle; ``attribution_audit``
checks what must hold for any model, and its row counts, against SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from arrears.operators import attribution as AT
from arrears.operators import boosting as B
from arrears.operators import features as FE
from arrears.operators import models as MD
from arrears.operators import tiers as T
from arrears.plans.oracle_base import with_
from arrears.plans.q_models import FEATS, KEYS, c_model_data
from arrears.plans.q_splits import CSPLIT_SQL
from arrears.plans.registry import register
from arrears.sources import sinks as K


def _model_and_test(spark, sf_dir):
    train, test, _ = c_model_data(spark, sf_dir)
    return MD.fit(spark, train, FEATS, "label_6m", MD.MODEL_C), test


@register("attribution_ranking")
def attribution_ranking(spark, sf_dir):
    model, test = _model_and_test(spark, sf_dir)
    return AT.mean_abs_attribution(spark, test, model)


@register("attribution_share")
def attribution_share(spark, sf_dir):
    rank = attribution_ranking(spark, sf_dir)
    new = F.col("feature").isin(FE.NEW_FEATURES)
    return rank.agg(
        F.sum(F.when(new, F.col("mean_abs_shap")).otherwise(0.0)).alias("new_features"),
        F.sum(F.when(~new, F.col("mean_abs_shap")).otherwise(0.0)).alias("base_features")) \
        .withColumn("new_share_pct", F.col("new_features") / (F.col("new_features") + F.col("base_features")) * 100.0)


@register("row_explanations")
def row_explanations(spark, sf_dir):
    model, test = _model_and_test(spark, sf_dir)
    top = T.top_k(B.score(spark, model, test), "pred_proba", KEYS, 5)       # the five highest-risk rows
    attr = AT.row_attributions(spark, top, model, KEYS)
    return AT.top_features_per_row(attr, KEYS, 5).select(*KEYS, "rank", "feature", "phi", "direction")


CLOSE = 1e-9


@register("attribution_audit", sql=with_(CSPLIT_SQL) + f"""
, t AS (SELECT CAST(count(*) AS BIGINT) AS n FROM csplit WHERE split = 'test')
SELECT unnest(['rows whose attributions add up to their margin', 'rows whose margin gives their score',
               'rows scored alike by the model read back']) AS what, n AS n_ok FROM t
UNION ALL
SELECT unnest(['features ranked once each', 'features with a gain share, all adding up to 1']), {len(FEATS)}""")
def attribution_audit(spark, sf_dir):
    """Model C: how many test rows and features hold to what any model must.
    The model directory (K4) and the ranking (K3) are read back from where
    they were written."""
    model, test = _model_and_test(spark, sf_dir)
    path = K.fresh_path(spark, "model-c")
    B.save(spark, model, path)
    again = B.load(spark, path)
    sums = AT.row_attributions(spark, test, model, KEYS).groupBy(*KEYS).agg(
        F.sum("phi").alias("phi"), F.first("base").alias("base"), F.first("margin").alias("margin"))
    scores = B.score(spark, again, B.score(spark, model, test), "pred_again").select(*KEYS, "pred_proba", "pred_again")
    rows = sums.join(scores, KEYS).agg(
        F.count_if(F.abs(F.col("phi") + F.col("base") - F.col("margin")) < CLOSE).alias("a"),
        F.count_if(F.abs(1 / (1 + F.exp(-F.col("margin"))) - F.col("pred_proba")) < CLOSE).alias("b"),
        F.count_if(F.col("pred_proba") == F.col("pred_again")).alias("c"))
    ranked = K.write_attribution_ranking(AT.mean_abs_attribution(spark, test, model), K.fresh_path(spark, "ranking"))
    ranking = spark.read.schema("feature string, mean_abs_shap double").option("header", True).csv(ranked)
    n_ranked = ranking.where(F.col("feature").isin(FEATS) & (F.col("mean_abs_shap") >= 0)).agg(F.countDistinct("feature").alias("n"))
    gain = B.gain_importance(spark, model)
    n_gain = gain.agg(F.when(F.abs(F.sum("share") - 1) < CLOSE, F.count(F.lit(1))).otherwise(0).alias("n"))
    rows = rows.select(F.explode(F.array(*[F.struct(F.lit(what).alias("what"), F.col(c).alias("n_ok")) for what, c in (
        ("rows whose attributions add up to their margin", "a"), ("rows whose margin gives their score", "b"),
        ("rows scored alike by the model read back", "c"))])).alias("r")).select("r.what", "r.n_ok")
    return (rows.unionByName(n_ranked.select(F.lit("features ranked once each").alias("what"), F.col("n").alias("n_ok")))
            .unionByName(n_gain.select(F.lit("features with a gain share, all adding up to 1").alias("what"), F.col("n").cast("long").alias("n_ok"))))
