"""Connected components by alternating star contraction, entirely in joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arrears.llm.store import Scratch

MAX_ROUNDS = 60          # rounds grow with the logarithm of the nodes; more means a fault
TASK_EDGES = 50_000      # edges of one task, so that small graphs do not run in many empty tasks


def _hang(edges: DataFrame) -> DataFrame:
    """edges (u, v): every v goes to the least of u and all its v."""
    least = edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return edges.join(least.hint("merge"), "u")


def _stars(edges: DataFrame) -> tuple[int, bool]:
    """(edges, whether every node hangs on one root that hangs on none)."""
    n, heads = edges.agg(F.count("*"), F.count_distinct("u")).first()
    if n != heads:
        return n, False
    return n, not edges.join(edges.select(F.col("u").alias("w")).hint("merge"), F.col("v") == F.col("w"), "left_semi").limit(1).count()


def components(spark: SparkSession, edges: DataFrame, name: str = "cc") -> DataFrame:
    """``edges`` (a, b: long) -> (node, root): the least node that can be
    reached, for every node that stands on an edge. Loops and nulls are
    ignored; an empty table gives an empty one.

    Each round is two grouped minima (combined before the shuffle) and joins
    back to the edges, written to the shared folder; the number of edges never
    grows beyond one per node and link. Rounds end when all edges hang on
    roots; edges that do so from the start need none.
    """
    s = Scratch(spark, name)
    cur = s.write(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                  .where("u <> v").distinct(), "e0")
    for i in range(MAX_ROUNDS):
        n, done = _stars(cur)
        if done:
            return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        tasks = 1 + n // TASK_EDGES
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(tasks)
        large = _hang(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").coalesce(tasks)
        joined = _hang(large).coalesce(tasks)
        small = joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        cur = s.write(small.select("e.u", "e.v").where("u <> v").distinct().coalesce(tasks), f"e{i + 1}")
        s.drop(f"e{i}")
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
