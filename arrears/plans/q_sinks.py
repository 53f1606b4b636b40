"""Sinks written and read back (K1, K2, K5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from arrears.operators import metrics as MT
from arrears.operators import tiers as T
from arrears.plans.oracle_base import with_
from arrears.plans.q_loanperiod import LP_SQL, frame as lp_frame
from arrears.plans.q_metrics import SCORED_SQL, _tier_sql, curve_pr, score_expr, score_sql
from arrears.plans.registry import register
from arrears.sources import sinks as K


@register("sink_predictions", dbl=["pred_proba"], sql=with_(LP_SQL) + f"""
SELECT ac_key, loan_uid, report_period, target, pred_proba, {_tier_sql('pred_proba', 'four')} AS risk_tier
FROM (SELECT *, {score_sql('ltv_feature', 'dscr_feature', 'occupancy')} AS pred_proba FROM lpf)""")
def sink_predictions(spark, sf_dir):
    df = lp_frame(spark, sf_dir)
    pred = df.withColumn("pred_proba", score_expr(F.col("ltv_feature"), F.col("dscr_feature"), F.col("occupancy"))) \
             .withColumn("risk_tier", T.tier("pred_proba", "four"))
    path = K.write_predictions(pred, K.fresh_path(spark, "predictions"))
    return spark.read.parquet(path)


FEED_SCHEMA = ("asset_number long, period string, property_type string, state string, orig_amount double, "
               "default_prob_6m double, risk_tier string, tier_rank int")


def _feed(spark, sf_dir):
    from arrears.plans.q_metrics import scored
    return T.risk_feed(scored(spark, sf_dir), "score", ("asset_number", "period")).select(
        "asset_number", "period", "property_type", "state", "orig_amount",
        F.col("score").alias("default_prob_6m"), "risk_tier", "tier_rank")


@register("risk_feed_csv", dbl={"default_prob_6m": 9, "orig_amount": 6}, sql=with_(SCORED_SQL) + f"""
SELECT asset_number, period, property_type, state, orig_amount, score AS default_prob_6m,
       {_tier_sql('score', 'rgb')} AS risk_tier,
       CAST(CASE {_tier_sql('score', 'rgb')} WHEN 'RED' THEN 0 WHEN 'ORANGE' THEN 1 WHEN 'YELLOW' THEN 2 ELSE 3 END
            AS BIGINT) AS tier_rank
FROM scored""")
def risk_feed_csv(spark, sf_dir):
    path = K.write_risk_feed(_feed(spark, sf_dir), K.fresh_path(spark, "risk_feed"))
    return spark.read.schema(FEED_SCHEMA).option("header", True).csv(path)


def feed_order():
    return [F.col("tier_rank"), -F.col("default_prob_6m"), F.col("asset_number"), F.col("period")]


@register("risk_feed_order", sql=with_(SCORED_SQL) + """
SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(0 AS BIGINT) AS inside_parts, CAST(0 AS BIGINT) AS between_parts FROM scored""")
def risk_feed_order(spark, sf_dir):
    """K2: the written feed's rows stand in feed order, inside parts and from part to part."""
    path = K.write_risk_feed(_feed(spark, sf_dir), K.fresh_path(spark, "risk_feed"))
    return K.order_inversions(spark, path, FEED_SCHEMA, feed_order()).drop("n_parts")


@register("run_metrics", dbl=["auroc", "average_precision", "best_threshold", "precision_at_half",
                              "recall_at_half", "f1_at_half"], sql=with_(SCORED_SQL) + """
, a AS (SELECT sum(pos * (cum_neg - neg + neg / 2.0)) / (sum(pos) * sum(neg)) AS auroc
        FROM (SELECT *, sum(neg) OVER (ORDER BY score ROWS UNBOUNDED PRECEDING) AS cum_neg FROM sc)),
ap AS (SELECT sum(pos * (CAST(tp AS DOUBLE) / (tp + fp))) / sum(pos) AS average_precision FROM curve),
h AS (SELECT count(*) FILTER (WHERE score >= 0.5 AND label_6m = 1) AS tp,
             count(*) FILTER (WHERE score >= 0.5 AND label_6m = 0) AS fp,
             count(*) FILTER (WHERE score < 0.5 AND label_6m = 1) AS fn FROM scored),
h2 AS (SELECT CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0.0 END AS p,
              CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0.0 END AS r FROM h)
SELECT CAST((SELECT count(*) FROM scored) AS BIGINT) AS n_scored, a.auroc, ap.average_precision,
       (SELECT threshold FROM best_eps) AS best_threshold,
       h2.p AS precision_at_half, h2.r AS recall_at_half,
       CASE WHEN h2.p + h2.r > 0 THEN 2 * h2.p * h2.r / (h2.p + h2.r) ELSE 0.0 END AS f1_at_half
FROM a, ap, h2""")
def run_metrics(spark, sf_dir):
    s, c = curve_pr(spark, sf_dir)
    auc = MT.auroc(s, "score", "label_6m").first()["auroc"]
    ap = MT.average_precision(s, "score", "label_6m").first()["average_precision"]
    best = MT.best_f1_threshold(c, "f1_eps").first()["threshold"]
    half = MT.confusion_at(s, "score", "label_6m", {"half": 0.5}).first()
    n = s.count()
    rec = spark.createDataFrame(
        [(n, auc, ap, best, half["precision"], half["recall"], half["f1"])],
        "n_scored long, auroc double, average_precision double, best_threshold double, "
        "precision_at_half double, recall_at_half double, f1_at_half double")
    path = K.write_run_metrics(rec, K.fresh_path(spark, "run_metrics"))
    return spark.read.schema(rec.schema).json(path)
