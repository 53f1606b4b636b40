"""Risk tiers, tier tables, top-k and the ordered risk feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arrears.operators.reports import pct

# Fixed values that must equal the reference's: tier names, lower cut points
# (inclusive) and the recommended action per tier, for both schemes.
RGB_TIERS = [("GREEN", 0.0), ("YELLOW", 0.10), ("ORANGE", 0.30), ("RED", 0.50)]
RGB_ACTIONS = {
    "RED": "Immediate escalation — special servicing referral",
    "ORANGE": "Senior credit officer review — consider reserve increase",
    "YELLOW": "Monthly monitoring — analyst review",
    "GREEN": "Standard quarterly surveillance",
}
RGB_FEED_ORDER = ["RED", "ORANGE", "YELLOW", "GREEN"]
FOUR_TIERS = [("Tier 1 — Low Risk", 0.0), ("Tier 2 — Watch", 0.10), ("Tier 3 — High Risk", 0.30),
              ("Tier 4 — Critical", 0.60)]
FOUR_ACTIONS = {
    "Tier 1 — Low Risk": "Routine monitoring, standard reporting cycle.",
    "Tier 2 — Watch": "Enhanced monitoring, quarterly credit review.",
    "Tier 3 — High Risk": "Active workout planning, reserve increase, monthly reporting required.",
    "Tier 4 — Critical": "Immediate intervention, escalate to special servicing, initiate borrower contact.",
}
SCHEMES = {"rgb": (RGB_TIERS, RGB_ACTIONS), "four": (FOUR_TIERS, FOUR_ACTIONS)}


def tier(score, scheme: str = "rgb") -> Column:
    tiers, _ = SCHEMES[scheme]
    s = F.col(score) if isinstance(score, str) else score
    expr = F.lit(tiers[0][0])
    for name, lo in tiers[1:]:
        expr = F.when(s >= F.lit(lo), F.lit(name)).otherwise(expr)
    return expr


def tier_dim(spark: SparkSession, scheme: str) -> DataFrame:
    tiers, actions = SCHEMES[scheme]
    rows = [(i, name, lo, actions[name]) for i, (name, lo) in enumerate(tiers)]
    return spark.createDataFrame(rows, "tier_order int, tier string, lower_bound double, action string")


def tier_distribution(spark: SparkSession, scored: DataFrame, score: str, label: str, schemes: list[str]) -> DataFrame:
    """Per scheme and tier: count, share of all rows, actual positive rate;
    empty tiers show 0. ``scored`` is read once: rows are counted per
    combination of tiers, and those few rows are summed per scheme."""
    names = [f"_{s}" for s in schemes]
    cells = (scored.select(*[tier(score, s).alias(n) for s, n in zip(schemes, names)], F.col(label).cast("double").alias("_y"))
             .groupBy(*names).agg(F.count(F.lit(1)).alias("_n"), F.sum("_y").alias("_pos")))
    per = (cells.select("_n", "_pos", F.explode(F.array(*[
        F.struct(F.lit(s).alias("scheme"), F.col(n).alias("tier")) for s, n in zip(schemes, names)])).alias("_t"))
        .groupBy("_t.scheme", "_t.tier").agg(F.sum("_n").alias("_n"), F.sum("_pos").alias("_pos")))
    dims = None
    for s in schemes:
        d = tier_dim(spark, s).select(F.lit(s).alias("scheme"), "tier", "tier_order")
        dims = d if dims is None else dims.unionByName(d)
    n = F.coalesce(F.col("_n"), F.lit(0))
    total = F.sum(n).over(Window.partitionBy("scheme"))       # a scheme has a handful of tiers
    return dims.join(F.broadcast(per), ["scheme", "tier"], "left").select(
        "scheme", "tier", "tier_order", n.cast("long").alias("n"), pct(n, total).alias("share_pct"),
        pct(F.coalesce(F.col("_pos"), F.lit(0.0)), n).alias("actual_rate_pct"))


def with_actions(spark: SparkSession, scored: DataFrame, score: str, scheme: str) -> DataFrame:
    """Tier plus its recommended action (broadcast join to the 4-row dimension)."""
    d = tier_dim(spark, scheme).select("tier", "action", "tier_order")
    return scored.withColumn("tier", tier(score, scheme)).join(F.broadcast(d), "tier", "left")


def feed_rank(tier_col: str = "risk_tier") -> Column:
    expr = F.lit(len(RGB_FEED_ORDER))
    for i, name in enumerate(RGB_FEED_ORDER):
        expr = F.when(F.col(tier_col) == name, F.lit(i)).otherwise(expr)
    return expr


def risk_feed(scored: DataFrame, score: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """RED first, then ORANGE, YELLOW, GREEN; probability descending inside a
    tier, equal ones by the keys (which also cut rows tied on one score)."""
    df = scored.withColumn("risk_tier", tier(score, "rgb")).withColumn("tier_rank", feed_rank())
    return df.orderBy("tier_rank", F.col(score).desc(), *keys)


def top_k(scored: DataFrame, score: str, keys: list[str], k: int = 20) -> DataFrame:
    """Highest scores first; equal scores ordered by the keys (the limit is the report)."""
    return scored.orderBy(F.col(score).desc(), *keys).limit(k)
