"""Tables written to the shared checkpoint folder and read back.

Unlike a persisted frame, a written table changes no other query's plan, does
not sit on executors' disks, and survives their loss.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arrears.session import scratch_path

BROADCAST_ROWS = 100_000         # of a few narrow columns: some megabytes
#: For rows of hundreds of kilobytes: by default a page's size is looked at
#: after 100 rows only, and a row group is read at once.
BLOCK_ROWS = {"parquet.page.size.row.check.min": "1", "parquet.block.size": str(16 << 20), "parquet.enable.dictionary": "false"}


def fresh_path(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table of its own under the shared folder."""
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, name: str, most: int = BROADCAST_ROWS) -> DataFrame:
    """The narrow ``df`` written and counted, with a broadcast hint only if it
    has at most ``most`` rows; a larger one is left to the planner."""
    table = written(df.sparkSession, df, name)
    return F.broadcast(table) if table.count() <= most else table
