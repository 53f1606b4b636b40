"""Oversampling and the model trained on its output (M6, G3).  Rows-only checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from arrears.operators import boosting as B
from arrears.operators import models as MD
from arrears.operators import sampling as SM
from arrears.plans.oracle_base import with_
from arrears.plans.q_models import FEATS, KEYS, c_model_data
from arrears.plans.q_splits import CSPLIT_SQL
from arrears.plans.registry import register

RATIO, K, SEED = 0.1, 5, 42      # reference settings (fixed values)


def balanced_train(spark, sf_dir):
    train, test, _ = c_model_data(spark, sf_dir)
    fit_rows = train.where(~F.col("_is_val"))
    synth = SM.oversample(spark, fit_rows, FEATS, "label_6m", KEYS, RATIO, K, SEED)
    return train, synth, test


SMOTE_SQL = with_(CSPLIT_SQL + """,
tr_loans AS (SELECT asset_number, min(period) AS first_period FROM csplit WHERE split = 'train' GROUP BY 1),
val AS (
  SELECT asset_number FROM (
    SELECT asset_number, row_number() OVER (ORDER BY first_period DESC, asset_number DESC) AS rk,
           greatest(1, CAST(floor(count(*) OVER () * 0.1) AS BIGINT)) AS n_val FROM tr_loans) WHERE rk <= n_val),
fit AS (SELECT * FROM csplit WHERE split = 'train' AND asset_number NOT IN (SELECT asset_number FROM val)),
c AS (SELECT count(*) FILTER (WHERE label_6m = 0) AS n_neg, count(*) FILTER (WHERE label_6m = 1) AS n_pos FROM fit)""") + """
SELECT CAST(n_neg AS BIGINT) AS n_neg, CAST(n_pos AS BIGINT) AS n_pos_before,
       CAST(floor(0.1 * n_neg) - n_pos AS BIGINT) AS n_added,
       CAST(floor(0.1 * n_neg) AS DOUBLE) / n_neg AS ratio_after
FROM c"""


@register("smote_balance", dbl=["ratio_after"], sql=SMOTE_SQL)
def smote_balance(spark, sf_dir):
    """Class counts before and after oversampling; ``n_added`` counts the rows
    actually generated, so a row lost in the generation joins would show."""
    train, synth, _ = balanced_train(spark, sf_dir)
    fit_rows = train.where(~F.col("_is_val"))
    before = fit_rows.agg(F.sum(F.when(F.col("label_6m") == 0, 1).otherwise(0)).cast("long").alias("n_neg"),
                          F.sum(F.when(F.col("label_6m") == 1, 1).otherwise(0)).cast("long").alias("n_pos_before"))
    added = synth.agg(F.count(F.lit(1)).alias("n_added"))
    from arrears.operators.reports import one_row_join
    return one_row_join(before, added).withColumn(
        "ratio_after", (F.col("n_pos_before") + F.col("n_added")) / F.col("n_neg"))


@register("model_b_scores")
def model_b_scores(spark, sf_dir):
    train, synth, test = balanced_train(spark, sf_dir)
    syn = synth.select(*FEATS, "label_6m").withColumn("_is_val", F.lit(False))
    data = train.select(*FEATS, "label_6m", "_is_val").unionByName(syn)
    model = MD.fit(spark, data, FEATS, "label_6m", MD.MODEL_A)
    return B.score(spark, model, test).select(*KEYS, "label_6m", "pred_proba")
