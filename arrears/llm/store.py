"""Written intermediates in the shared checkpoint folder.

A table written there cuts lineage and survives lost executors. ``Scratch``
names one folder per operator call; ``drop`` removes what no later step reads.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from arrears.session import drop_path, scratch_path, ship_package

BATCH_ROWS = 500         # texts sent to a Python worker at once
BATCH_BYTES = 8 << 20    # and their bytes: a batch has buffers outside the heap, in the JVM and in the worker

#: For tables whose rows are megabytes. By default a page's size is looked at
#: after 100 rows only, so a whole task's rows became one page per column, with
#: codec buffers as large outside the heap; and a row group is read at once.
LARGE_ROWS = {
    "parquet.page.size.row.check.min": "1",
    "parquet.block.size": str(16 << 20),
    "parquet.enable.dictionary": "false",
}


def prepare(spark: SparkSession) -> None:
    """Ship the package, and bound the rows and bytes of an Arrow batch: the
    defaults of 10,000 texts or 64 MB would fill buffers outside the heap and
    in the workers. A batch holds one row at least."""
    ship_package(spark)
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key)
        if not now.rstrip("b").isdigit() or not 0 < int(now.rstrip("b")) <= most:
            spark.conf.set(key, str(most))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores as make it no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


class Scratch:
    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")
        prepare(spark)

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def write(self, df: DataFrame, name: str, large_rows: bool = False) -> DataFrame:
        df.write.mode("overwrite").options(**(LARGE_ROWS if large_rows else {})).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            drop_path(self.spark, self.path(name))
