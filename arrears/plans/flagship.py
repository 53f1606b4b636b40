"""Flagship question: which loan-months default within six months, and how
does that rate move with the length of a running cash-flow shortfall?

scan -> loan-month rollup -> one-month lag -> run length below DSCR 1.0 ->
strict six-row label -> uncensored rows -> rate by run length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arrears.operators import labels as L
from arrears.operators import windows as W
from arrears.sources import panel as P


def shortfall_run_default_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.loan_window()
    df = P.loan_month_panel(spark, sf_dir).select("asset_number", "period", "default_flag", "dscr_curr")
    df = df.withColumn("dscr_curr_lag1", W.lag("dscr_curr", w))
    df = df.withColumns({
        "run_below1": W.run_below("dscr_curr_lag1", 1.0, w),
        "label_6m": L.forward_label_strict(),
    })
    return (L.uncensored(df)
            .groupBy(F.col("run_below1").cast("long").alias("run_below1"))
            .agg(F.count(F.lit(1)).alias("n_rows"),
                 F.sum("label_6m").cast("long").alias("n_default_6m"),
                 F.avg("label_6m").alias("default_rate_6m")))


from arrears.plans.oracle_base import LOAN_MONTH_PANEL, with_  # noqa: E402
from arrears.plans.registry import register  # noqa: E402

FLAGSHIP_SQL = with_(LOAN_MONTH_PANEL + """,
f1 AS (
  SELECT asset_number, period, default_flag,
         lag(dscr_curr) OVER (PARTITION BY asset_number ORDER BY period) AS dscr_lag1,
         CASE WHEN count(*) OVER f6 >= 6 THEN CAST(max(default_flag) OVER f6 AS DOUBLE) END AS label_6m
  FROM panel WINDOW f6 AS (PARTITION BY asset_number ORDER BY period ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING)),
f2 AS (
  SELECT *, sum(CASE WHEN COALESCE(dscr_lag1 < 1.0, false) THEN 0 ELSE 1 END)
              OVER (PARTITION BY asset_number ORDER BY period ROWS UNBOUNDED PRECEDING) AS isl
  FROM f1),
f3 AS (
  SELECT *, CASE WHEN COALESCE(dscr_lag1 < 1.0, false)
                 THEN count(*) FILTER (WHERE COALESCE(dscr_lag1 < 1.0, false)) OVER
                      (PARTITION BY asset_number, isl ORDER BY period ROWS UNBOUNDED PRECEDING) ELSE 0 END AS run_below1
  FROM f2)""") + """
SELECT CAST(run_below1 AS BIGINT) AS run_below1, CAST(count(*) AS BIGINT) AS n_rows,
       CAST(sum(label_6m) AS BIGINT) AS n_default_6m, avg(label_6m) AS default_rate_6m
FROM f3 WHERE label_6m IS NOT NULL GROUP BY 1"""


@register("flagship", dbl=["default_rate_6m"], sql=FLAGSHIP_SQL)
def flagship(spark, sf_dir):
    return shortfall_run_default_rate(spark, sf_dir)
