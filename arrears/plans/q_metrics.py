"""Metrics and tiers on a deterministic score.

The score is a fixed bounded formula of the panel's current DSCR, LTV and
occupancy, rounded to three places so that ties occur (FIXTURES.md B4);
the label is the strict six-row label on test-period rows.  No model noise
reaches the oracle.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from arrears.operators import features as FE
from arrears.operators import labels as L
from arrears.operators import metrics as MT
from arrears.operators import tiers as T
from arrears.operators.reports import fixed_round
from arrears.plans.oracle_base import D, LOAN_MONTH_PANEL, with_
from arrears.plans.registry import register
from arrears.sources.scratch import written
from arrears.sources import panel as P

CUT = FE.FIXTURE.cutoff
SWEEP = {"t010": 0.10, "t030": 0.30, "t050": 0.50}


def score_expr(ltv, dscr, occ):
    raw = (F.lit(0.5) * (F.coalesce(ltv, F.lit(1.0)) - F.lit(0.5))
           + F.lit(0.6) * (F.lit(1.2) - F.coalesce(dscr, F.lit(1.2)))
           + F.lit(0.3) * (F.lit(0.6) - F.coalesce(occ, F.lit(0.6))))
    return fixed_round(F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)), 3)


def score_sql(ltv, dscr, occ) -> str:
    raw = (f"{D(0.5)} * (COALESCE({ltv}, {D(1.0)}) - {D(0.5)}) + {D(0.6)} * ({D(1.2)} - COALESCE({dscr}, {D(1.2)}))"
           f" + {D(0.3)} * ({D(0.6)} - COALESCE({occ}, {D(0.6)}))")
    return f"floor(least(greatest({raw}, {D(0)}), {D(1)}) * {D(1000)} + {D(0.5)}) / {D(1000)}"


def scored(spark, sf_dir):
    p = L.add_labels(P.loan_month_panel(spark, sf_dir))
    p = p.where(F.col("label_6m").isNotNull() & (F.col("period") >= F.lit(CUT)))
    return p.select("asset_number", "period", "property_type", "state", "orig_amount", "label_6m",
                    score_expr(F.col("ltv_curr"), F.col("dscr_curr"), F.col("occ_curr")).alias("score"))


SCORED_SQL = LOAN_MONTH_PANEL + f""",
lab AS (
  SELECT *, CASE WHEN count(*) OVER f6 >= 6 THEN CAST(max(default_flag) OVER f6 AS DOUBLE) END AS label_6m
  FROM panel WINDOW f6 AS (PARTITION BY asset_number ORDER BY period ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING)),
scored AS (
  SELECT asset_number, period, property_type, state, orig_amount, label_6m,
         {score_sql('ltv_curr', 'dscr_curr', 'occ_curr')} AS score
  FROM lab WHERE label_6m IS NOT NULL AND period >= '{CUT}'),
sc AS (SELECT score, CAST(sum(CASE WHEN label_6m = 1 THEN 1 ELSE 0 END) AS BIGINT) AS pos,
              CAST(sum(CASE WHEN label_6m = 0 THEN 1 ELSE 0 END) AS BIGINT) AS neg FROM scored GROUP BY score),
curve AS (
  SELECT score AS threshold, pos, neg,
         sum(pos) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp,
         sum(neg) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS fp
  FROM sc),
curve_pr AS (
  SELECT *, CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE {D(0)} END AS precision,
            CAST(tp AS DOUBLE) / (SELECT sum(pos) FROM sc) AS recall
  FROM curve),
curve_f1 AS (
  SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE {D(0)} END AS f1,
         2 * precision * recall / (precision + recall + {D(1e-9)}) AS f1_eps
  FROM curve_pr),
best AS (SELECT threshold, precision, recall, f1 FROM curve_f1 ORDER BY f1 DESC, threshold ASC LIMIT 1),
best_eps AS (SELECT threshold, precision, recall, f1_eps AS f1 FROM curve_f1 ORDER BY f1_eps DESC, threshold ASC LIMIT 1)"""


def curve_pr(spark, sf_dir):
    s = written(spark, scored(spark, sf_dir), "scored")   # the scored set feeds several metric jobs
    total_pos = s.agg(F.sum("label_6m")).first()[0] or 0
    return s, MT.with_pr_columns(MT.pr_curve(s, "score", "label_6m"), int(total_pos))


@register("auroc", dbl=["auroc"], sql=with_(SCORED_SQL) + """
SELECT sum(pos * (cum_neg - neg + neg / 2.0)) / (sum(pos) * sum(neg)) AS auroc
FROM (SELECT *, sum(neg) OVER (ORDER BY score ROWS UNBOUNDED PRECEDING) AS cum_neg FROM sc)""")
def auroc(spark, sf_dir):
    return MT.auroc(scored(spark, sf_dir), "score", "label_6m")


@register("average_precision", dbl=["average_precision"], sql=with_(SCORED_SQL) + """
SELECT sum(pos * (CAST(tp AS DOUBLE) / (tp + fp))) / sum(pos) AS average_precision FROM curve""")
def average_precision(spark, sf_dir):
    return MT.average_precision(scored(spark, sf_dir), "score", "label_6m")


@register("pr_curve", dbl=["threshold", "precision", "recall", "f1", "f1_eps"], sql=with_(SCORED_SQL) + """
SELECT threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, precision, recall, f1, f1_eps FROM curve_f1""")
def pr_curve(spark, sf_dir):
    _, c = curve_pr(spark, sf_dir)
    return c.select("threshold", "tp", "fp", "precision", "recall", "f1", "f1_eps")


@register("best_f1_threshold", dbl=["threshold", "precision", "recall", "f1"], sql=with_(SCORED_SQL) + """
SELECT 'plain' AS form, * FROM best UNION ALL SELECT 'eps' AS form, * FROM best_eps""")
def best_f1_threshold(spark, sf_dir):
    _, c = curve_pr(spark, sf_dir)
    return (MT.best_f1_threshold(c, "f1").withColumn("form", F.lit("plain"))
            .unionByName(MT.best_f1_threshold(c, "f1_eps").withColumn("form", F.lit("eps"))))


def _best(c, col="f1"):
    return MT.best_f1_threshold(c, col).first()["threshold"]


@register("threshold_sweep", dbl=["threshold", "precision", "recall", "f1"], sql=with_(SCORED_SQL) + """
, th AS (SELECT * FROM (VALUES ('t010', CAST(0.1 AS DOUBLE)), ('t030', CAST(0.3 AS DOUBLE)), ('t050', CAST(0.5 AS DOUBLE)))
         t(name, threshold) UNION ALL SELECT 'best', threshold FROM best),
cm AS (
  SELECT th.name, th.threshold,
         CAST(count(*) FILTER (WHERE s.score < th.threshold AND s.label_6m = 0) AS BIGINT) AS tn,
         CAST(count(*) FILTER (WHERE s.score >= th.threshold AND s.label_6m = 0) AS BIGINT) AS fp,
         CAST(count(*) FILTER (WHERE s.score < th.threshold AND s.label_6m = 1) AS BIGINT) AS fn,
         CAST(count(*) FILTER (WHERE s.score >= th.threshold AND s.label_6m = 1) AS BIGINT) AS tp
  FROM th, scored s GROUP BY th.name, th.threshold)
SELECT *, CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0.0 END AS precision,
          CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0.0 END AS recall,
          CASE WHEN tp > 0 THEN 2.0 * (CAST(tp AS DOUBLE) / (tp + fp)) * (CAST(tp AS DOUBLE) / (tp + fn))
               / ((CAST(tp AS DOUBLE) / (tp + fp)) + (CAST(tp AS DOUBLE) / (tp + fn))) ELSE 0.0 END AS f1
FROM cm""")
def threshold_sweep(spark, sf_dir):
    s, c = curve_pr(spark, sf_dir)
    return MT.confusion_at(s, "score", "label_6m", {**SWEEP, "best": _best(c)})


@register("metrics_at_half", dbl=["threshold", "precision", "recall", "f1"], sql=with_(SCORED_SQL) + """
, cm AS (SELECT CAST(count(*) FILTER (WHERE score < 0.5 AND label_6m = 0) AS BIGINT) AS tn,
                CAST(count(*) FILTER (WHERE score >= 0.5 AND label_6m = 0) AS BIGINT) AS fp,
                CAST(count(*) FILTER (WHERE score < 0.5 AND label_6m = 1) AS BIGINT) AS fn,
                CAST(count(*) FILTER (WHERE score >= 0.5 AND label_6m = 1) AS BIGINT) AS tp FROM scored)
SELECT 'half' AS name, CAST(0.5 AS DOUBLE) AS threshold, tn, fp, fn, tp,
       CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0.0 END AS precision,
       CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0.0 END AS recall,
       CASE WHEN tp > 0 THEN 2.0 * (CAST(tp AS DOUBLE) / (tp + fp)) * (CAST(tp AS DOUBLE) / (tp + fn))
            / ((CAST(tp AS DOUBLE) / (tp + fp)) + (CAST(tp AS DOUBLE) / (tp + fn))) ELSE 0.0 END AS f1
FROM cm""")
def metrics_at_half(spark, sf_dir):
    return MT.confusion_at(scored(spark, sf_dir), "score", "label_6m", {"half": 0.5})


@register("confusion_matrix", sql=with_(SCORED_SQL) + """
, sp AS (SELECT * FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) t(actual, predicted)),
c AS (SELECT CAST(label_6m AS INTEGER) AS actual, CAST(score >= (SELECT threshold FROM best_eps) AS INTEGER) AS predicted,
             count(*) AS n FROM scored GROUP BY 1, 2)
SELECT CAST(sp.actual AS BIGINT) AS actual, CAST(sp.predicted AS BIGINT) AS predicted,
       CAST(COALESCE(c.n, 0) AS BIGINT) AS n
FROM sp LEFT JOIN c USING (actual, predicted)""")
def confusion_matrix(spark, sf_dir):
    s, c = curve_pr(spark, sf_dir)
    return MT.confusion_matrix(s, "score", "label_6m", _best(c, "f1_eps"), spark)


def _tier_sql(col: str, scheme: str) -> str:
    tiers, _ = T.SCHEMES[scheme]
    parts = " ".join(f"WHEN {col} >= {D(lo)} THEN '{name}'" for name, lo in reversed(tiers[1:]))
    return f"CASE {parts} ELSE '{tiers[0][0]}' END"


@register("risk_tier_rgb", dbl=["score"], sql=with_(SCORED_SQL) + f"""
SELECT asset_number, period, score, {_tier_sql('score', 'rgb')} AS risk_tier FROM scored""")
def risk_tier_rgb(spark, sf_dir):
    return scored(spark, sf_dir).select("asset_number", "period", "score", T.tier("score", "rgb").alias("risk_tier"))


@register("risk_tier_4", dbl=["score"], sql=with_(SCORED_SQL) + f"""
SELECT asset_number, period, score, {_tier_sql('score', 'four')} AS risk_tier FROM scored""")
def risk_tier_4(spark, sf_dir):
    return scored(spark, sf_dir).select("asset_number", "period", "score", T.tier("score", "four").alias("risk_tier"))


def _tier_dist_sql(scheme: str) -> str:
    tiers, _ = T.SCHEMES[scheme]
    vals = ", ".join(f"({i}, '{n}')" for i, (n, _) in enumerate(tiers))
    return f"""
SELECT '{scheme}' AS scheme, d.tier, d.tier_order, CAST(COALESCE(a.n, 0) AS BIGINT) AS n,
       COALESCE(a.n, 0) / (SELECT count(*) FROM scored) * 100.0 AS share_pct,
       CASE WHEN COALESCE(a.n, 0) > 0 THEN a.pos / a.n * 100.0 ELSE 0.0 END AS actual_rate_pct
FROM (SELECT * FROM (VALUES {vals}) t(tier_order, tier)) d
LEFT JOIN (SELECT {_tier_sql('score', scheme)} AS tier, count(*) AS n, sum(label_6m) AS pos FROM scored GROUP BY 1) a
  USING (tier)"""


@register("tier_distribution", dbl=["share_pct", "actual_rate_pct"], sql=with_(SCORED_SQL)
          + _tier_dist_sql("rgb") + "\nUNION ALL" + _tier_dist_sql("four"))
def tier_distribution(spark, sf_dir):
    return T.tier_distribution(spark, scored(spark, sf_dir), "score", "label_6m", ["rgb", "four"])


def _action_sql(scheme: str) -> str:
    tiers, actions = T.SCHEMES[scheme]
    return "CASE tier " + " ".join(f"WHEN '{n}' THEN '{actions[n]}'" for n, _ in tiers) + " END"


@register("tier_actions", sql=with_(SCORED_SQL) + f"""
SELECT asset_number, period, rgb_tier, {_action_sql('rgb').replace('CASE tier', 'CASE rgb_tier')} AS rgb_action,
       four_tier, {_action_sql('four').replace('CASE tier', 'CASE four_tier')} AS four_action
FROM (SELECT *, {_tier_sql('score', 'rgb')} AS rgb_tier, {_tier_sql('score', 'four')} AS four_tier FROM scored)""")
def tier_actions(spark, sf_dir):
    s = scored(spark, sf_dir).select("asset_number", "period", "score")
    a = T.with_actions(spark, s, "score", "rgb").select(
        "asset_number", "period", F.col("tier").alias("rgb_tier"), F.col("action").alias("rgb_action"), "score")
    return T.with_actions(spark, a, "score", "four").select(
        "asset_number", "period", "rgb_tier", "rgb_action",
        F.col("tier").alias("four_tier"), F.col("action").alias("four_action"))


@register("top_risk", dbl=["score"], sql=with_(SCORED_SQL) + f"""
SELECT asset_number, period, score, {_tier_sql('score', 'rgb')} AS risk_tier FROM scored
ORDER BY score DESC, asset_number, period LIMIT 20""")
def top_risk(spark, sf_dir):
    s = scored(spark, sf_dir).withColumn("risk_tier", T.tier("score", "rgb"))
    return T.top_k(s, "score", ["asset_number", "period"], 20).select("asset_number", "period", "score", "risk_tier")


@register("risk_feed", dbl={"default_prob_6m": 9, "orig_amount": 6}, sql=with_(SCORED_SQL) + f"""
SELECT asset_number, period, property_type, state, orig_amount, score AS default_prob_6m,
       {_tier_sql('score', 'rgb')} AS risk_tier,
       CAST(CASE {_tier_sql('score', 'rgb')} WHEN 'RED' THEN 0 WHEN 'ORANGE' THEN 1 WHEN 'YELLOW' THEN 2 ELSE 3 END
            AS BIGINT) AS tier_rank
FROM scored""")
def risk_feed(spark, sf_dir):
    s = scored(spark, sf_dir)
    f = T.risk_feed(s, "score", ("asset_number", "period"))
    return f.select("asset_number", "period", "property_type", "state", "orig_amount",
                    F.col("score").alias("default_prob_6m"), "risk_tier", "tier_rank")
