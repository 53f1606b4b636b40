"""Registry of named queries: a Spark builder plus, where SQL can say the
same thing, an independent DuckDB oracle over the same tables.

``dbl`` lists the double columns of the result and the decimals both sides
round them to before comparison (sums and averages of doubles differ in
the last bits between engines).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DoubleType, FloatType, IntegerType, ShortType

from arrears.plans.oracle_base import rounded


@dataclass
class Entry:
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None
    dbl: dict = field(default_factory=dict)


REGISTRY: dict[str, Entry] = {}


def register(name: str, sql: str | None = None, dbl=None):
    if isinstance(dbl, (list, tuple)):
        dbl = {c: 9 for c in dbl}

    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Entry(fn, sql, dict(dbl or {}))
        return fn
    return deco


def fixed_round(x, places: int):
    """floor(x * 10^p + 0.5) / 10^p: plain IEEE steps, so the SQL oracle can
    apply the very same formula and exact decimal ties round alike."""
    scale = float(10 ** places)
    big = x * F.lit(scale)
    # beyond 2^62 a double has no fraction left, and floor() would leave BIGINT
    return F.when(F.abs(big) < F.lit(float(1 << 62)), F.floor(big + F.lit(0.5)).cast("double")).otherwise(big) / F.lit(scale)


def round_doubles(df: DataFrame, dbl: dict) -> DataFrame:
    """Round double columns (9 places unless ``dbl`` says otherwise); widen ints to BIGINT."""
    repl = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            repl[f.name] = fixed_round(F.col(f.name), dbl.get(f.name, 9))
        elif isinstance(f.dataType, (ByteType, ShortType, IntegerType)):
            repl[f.name] = F.col(f.name).cast("long")
    return df.withColumns(repl) if repl else df


def spark_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    e = REGISTRY[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return round_doubles(e.build(spark, sf_dir), e.dbl)
    run.__name__ = name
    return run


def oracle(name: str) -> str | None:
    e = REGISTRY[name]
    if e.sql is None:
        return None
    return rounded(e.sql.strip(), e.dbl)


def load_all() -> None:
    # Importing the plan modules fills REGISTRY.
    from arrears.plans import (  # noqa: F401
        flagship, q_panel, q_windows, q_macro, q_reports, q_features, q_loanperiod, q_splits, q_metrics, q_models, q_sinks, q_attribution, q_sampling, q_series,
    )
