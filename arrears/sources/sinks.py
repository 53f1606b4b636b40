"""Sinks: predictions parquet (K1), ordered risk-feed CSV (K2), run-metrics record (K5).

Paths default to a fresh folder under the cluster's shared
``spark.checkpoint.dir``; nothing is written to machine-local folders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arrears.sources.scratch import fresh_path  # noqa: F401

PREDICTION_COLUMNS = ["ac_key", "loan_uid", "report_period", "target", "pred_proba", "risk_tier"]


def write_predictions(df: DataFrame, path: str) -> str:
    df.select(*PREDICTION_COLUMNS).write.mode("overwrite").parquet(path)
    return path


def write_risk_feed(feed: DataFrame, path: str) -> str:
    """CSV with header, rows in feed order (the sort is range-partitioned,
    so part files are written in order)."""
    feed.write.mode("overwrite").option("header", True).csv(path)
    return path


def order_inversions(spark: SparkSession, path: str, schema: str, order: list[Column]) -> DataFrame:
    """K2's file order, as read back: (n_rows, n_parts, inversions inside parts,
    inversions between parts). Rows of a part are compared with the row before,
    and each part's first row with the last of the part before; parts follow
    each other by name. ``order`` must rise."""
    rows = spark.read.schema(schema).option("header", True).csv(path).select(
        F.struct(*order).alias("key"), F.col("_metadata.file_name").alias("part"),
        F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at"))
    line = Window.partitionBy("part").orderBy("at")            # one file of the sink
    stepped = rows.withColumn("back", F.coalesce(F.lag("key").over(line) > F.col("key"), F.lit(False)))
    parts = stepped.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count_if("back").alias("inside"),
                                        F.min_by("key", "at").alias("first"), F.max_by("key", "at").alias("last"))
    # one row per part file
    seam = parts.withColumn("torn", F.coalesce(F.lag("last").over(Window.partitionBy(F.lit(0)).orderBy("part")) > F.col("first"), F.lit(False)))
    return seam.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_parts"),
                    F.coalesce(F.sum("inside"), F.lit(0)).alias("inside_parts"), F.count_if("torn").alias("between_parts"))


def write_run_metrics(metrics: DataFrame, path: str) -> str:
    """A handful of metric rows as JSON lines."""
    metrics.coalesce(1).write.mode("overwrite").json(path)
    return path


def write_attribution_ranking(ranking: DataFrame, path: str) -> str:
    """K3: (feature, mean_abs_shap) as CSV, in rank order (one row per feature)."""
    ranking.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return path
