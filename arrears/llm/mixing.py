"""Mixing sources to target weights by hierarchical budgeting (DataFrame functions only).

The corpus is a tree: domain, language, source. A token budget flows from the
root down. At each node the children get shares by weight, but none more than
its supply (tokens times ``max_epochs``); what a child cannot use goes to its
siblings by weight, and only what they cannot take either is missing at the
parent, whose own siblings were offered it one level up. With children sorted
by supply per weight, the common rate is the largest of
``(budget - supplies before) / weights from here on``.

Each leaf then takes a token prefix of its seeded epochs: whole epochs first,
then the documents of the next epoch in the order of ``md5(seed:epoch:id)``
up to the budget, the last one cut (``take_tokens``). The running sum is made
in ``BINS`` bins of that hash: bins below the cut are taken whole, and only
the bin in which the budget ends is sorted, so no leaf is gathered, however
many rows it holds.

Defined results: a null domain, language or source is a node of its own; a
text without words (or null) has no tokens and is never taken; weights of 0
get nothing; a budget above all supply takes all of it; repeated rows are
rows of their own, equal ids in order of their token count; a null id is the
text "null". An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arrears.llm.store import Scratch

LEVELS = ("domain", "lang", "source")
BINS = 4096                       # three hex digits of the order hash
SEED = 13


def token_count(text: str = "text") -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def domain_of(source: str = "source") -> Column:
    """Four domains by the first digit of the source name's md5."""
    digit = F.substring(F.md5(F.coalesce(F.col(source), F.lit(""))), 1, 1)
    return F.when(digit < "4", "d0").when(digit < "8", "d1").when(digit < "c", "d2").otherwise("d3")


def _weight(level: str, weights: Mapping[str, Mapping[str, float]]) -> Column:
    out = F.lit(1.0)
    for name, w in weights.get(level, {}).items():
        out = F.when(F.col(level).eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(out)
    return out


def _same(a: DataFrame, b: DataFrame, cols: tuple[str, ...]) -> Column:
    cond = F.lit(True)
    for c in cols:
        cond = cond & a[c].eqNullSafe(b[c])
    return cond


def leaf_budgets(supply: DataFrame, budget: Column, weights: Mapping[str, Mapping[str, float]], max_epochs: int) -> DataFrame:
    """``supply`` (domain, lang, source, tokens) -> with ``budget``, in whole tokens.

    A node's cap is what the leaves below it can take whose weights are above 0
    on the whole path. The tables are one row per node; every level is one
    window over siblings."""
    live = supply
    for level in LEVELS:
        live = live.where(_weight(level, weights) > 0)
    nodes = {n: live.groupBy(*LEVELS[:n]).agg((F.sum("tokens") * max_epochs).cast("double").alias("cap")) for n in (1, 2, 3)}
    above = None
    for n in (1, 2, 3):
        parents, level = LEVELS[:n - 1], LEVELS[n - 1]
        cur = nodes[n].withColumn("w", _weight(level, weights)).where("w > 0 and cap > 0")
        if above is None:
            cur = cur.withColumn("given", budget.cast("double"))
        else:
            up = above.select(*[F.col(c).alias(f"up_{c}") for c in parents], F.col("share").alias("given"))
            cond = F.lit(True)
            for c in parents:
                cond = cond & cur[c].eqNullSafe(up[f"up_{c}"])
            cur = cur.join(up, cond).drop(*[f"up_{c}" for c in parents])
        siblings = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
        order = siblings.orderBy((F.col("cap") / F.col("w")), level)
        cur = cur.withColumns({"cap_before": F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap"),
                               "w_from": F.sum("w").over(siblings) - (F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("w"))})
        cur = cur.withColumn("rate", F.max((F.col("given") - F.col("cap_before")) / F.col("w_from")).over(siblings))
        above = cur.withColumn("share", F.least("cap", F.col("rate") * F.col("w"))).select(*LEVELS[:n], "share")
    return supply.join(above.withColumnsRenamed({c: f"up_{c}" for c in LEVELS}),
                       F.expr(" and ".join(f"{c} <=> up_{c}" for c in LEVELS))).select(
        *LEVELS, "tokens", F.floor("share").cast("long").alias("budget"))


def _order_hash(epoch: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))


def mix(spark: SparkSession, docs: DataFrame, weights: Mapping[str, Mapping[str, float]], budget_share: tuple[int, int] = (1, 1),
        max_epochs: int = 2, seed: int = SEED) -> DataFrame:
    """``docs`` (doc_id, text, domain, lang, source) -> one row per document
    and epoch taken: doc_id, domain, lang, source, epoch, n_tokens,
    take_tokens. The budget is ``budget_share`` of all tokens."""
    s = Scratch(spark, "mixing")
    rows = s.write(docs.select("doc_id", *LEVELS, token_count().alias("n_tokens")), "rows").where("n_tokens > 0")
    supply = s.write(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")), "supply")
    total = F.lit(supply.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0])
    budget = F.floor(total * budget_share[0] / budget_share[1])
    leaves = leaf_budgets(supply, budget, weights, max_epochs)
    # whole epochs, and what the next one still gives
    leaves = s.write(leaves.withColumns({"whole": F.expr("budget div tokens"), "rest": F.expr("budget % tokens")})
                     .withColumnsRenamed({c: f"leaf_{c}" for c in LEVELS}).drop("tokens"), "leaves")
    # one row per leaf: the planner broadcasts it where its size on disk allows, and else splits hot leaves
    known = rows.join(leaves, F.expr(" and ".join(f"{c} <=> leaf_{c}" for c in LEVELS))).drop(*[f"leaf_{c}" for c in LEVELS])
    cols = ["doc_id", *LEVELS, "epoch", "n_tokens", "take_tokens"]
    full = known.where("whole > 0").withColumn("epoch", F.explode(F.expr("sequence(0, int(whole) - 1)"))).withColumn("take_tokens", F.col("n_tokens"))
    last = known.where("rest > 0").withColumn("epoch", F.col("whole").cast("int"))
    last = last.withColumn("h", _order_hash(F.col("epoch"), seed)).withColumn("bin", F.conv(F.substring("h", 1, 3), 16, 10).cast("int"))
    bins = last.groupBy(*LEVELS, "bin").agg(F.sum("n_tokens").alias("t"), F.first("rest").alias("rest"))
    upto = F.sum("t").over(Window.partitionBy(*LEVELS).orderBy("bin"))
    edge = s.write(bins.withColumn("before", upto - F.col("t")).where("before < rest and before + t >= rest")
                   .select(*[F.col(c).alias(f"leaf_{c}") for c in LEVELS], F.col("bin").alias("edge"), "before"), "edges")
    last = last.join(edge, F.expr(" and ".join(f"{c} <=> leaf_{c}" for c in LEVELS))).drop(*[f"leaf_{c}" for c in LEVELS])
    below = last.where("bin < edge").withColumn("take_tokens", F.col("n_tokens"))
    inside = last.where("bin = edge").withColumn("start", F.col("before") - F.col("n_tokens") + F.sum("n_tokens").over(
        Window.partitionBy(*LEVELS).orderBy("h", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)))
    inside = inside.where("start < rest").withColumn("take_tokens", F.least("n_tokens", F.col("rest") - F.col("start")))
    return full.select(*cols).union(below.select(*cols)).union(inside.select(*cols))


WEIGHTS = {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 1}, "source": {"src0": 2}}


def mix_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents table under WEIGHTS: a budget of all its tokens, two epochs at most."""
    return mix(spark, docs.select("doc_id", "text", domain_of().alias("domain"), "lang", "source"), WEIGHTS)


def _level_sql(n: int) -> str:
    parents, level = LEVELS[:n - 1], LEVELS[n - 1]
    part = f"PARTITION BY {', '.join('c.' + p for p in parents)}" if parents else ""
    w = "1.0"
    for name, x in WEIGHTS[level].items():
        w = f"CASE WHEN {level} = '{name}' THEN {float(x)} ELSE {w} END"
    given = "(SELECT CAST(sum(tokens) AS DOUBLE) FROM supply)" if n == 1 else "u.share"
    join = "" if n == 1 else f"JOIN l{n - 1} u ON " + " AND ".join(f"c.{p} IS NOT DISTINCT FROM u.{p}" for p in parents)
    return f"""
c{n} AS (SELECT {', '.join(LEVELS[:n])}, CAST(sum(tokens) * 2 AS DOUBLE) AS cap, CAST({w} AS DOUBLE) AS w FROM supply GROUP BY ALL),
o{n} AS (SELECT c.*, {given} AS given,
  sum(cap) OVER ({part} ORDER BY cap / w, c.{level} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - cap AS cap_before,
  sum(w) OVER ({part}) - (sum(w) OVER ({part} ORDER BY cap / w, c.{level} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - w) AS w_from
  FROM c{n} c {join}),
l{n} AS (SELECT {', '.join(LEVELS[:n])}, least(cap, max((given - cap_before) / w_from) OVER ({part.replace('c.', '')}) * w) AS share FROM o{n})"""


ORACLE_SQL = rf"""
WITH rows AS (SELECT * FROM (
  SELECT doc_id, CASE WHEN d < '4' THEN 'd0' WHEN d < '8' THEN 'd1' WHEN d < 'c' THEN 'd2' ELSE 'd3' END AS domain, lang, source,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS n_tokens
  FROM (SELECT *, substr(md5(coalesce(source, '')), 1, 1) AS d FROM documents)) WHERE n_tokens > 0),
supply AS (SELECT domain, lang, source, sum(n_tokens) AS tokens FROM rows GROUP BY ALL),
{_level_sql(1)},{_level_sql(2)},{_level_sql(3)},
leaves AS (SELECT s.*, CAST(floor(l.share) AS BIGINT) AS budget FROM supply s JOIN l3 l
  ON s.domain IS NOT DISTINCT FROM l.domain AND s.lang IS NOT DISTINCT FROM l.lang AND s.source IS NOT DISTINCT FROM l.source),
epochs AS (SELECT r.*, l.budget, l.tokens, e.epoch FROM rows r JOIN leaves l
  ON r.domain IS NOT DISTINCT FROM l.domain AND r.lang IS NOT DISTINCT FROM l.lang AND r.source IS NOT DISTINCT FROM l.source
  CROSS JOIN (SELECT unnest([0, 1, 2]) AS epoch) e),
placed AS (SELECT *, epoch * tokens + sum(n_tokens) OVER (PARTITION BY domain, lang, source, epoch
  ORDER BY md5('{SEED}:' || epoch || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null')), n_tokens
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n_tokens AS start FROM epochs)
SELECT doc_id, domain, lang, source, CAST(epoch AS INTEGER) AS epoch, CAST(n_tokens AS BIGINT) AS n_tokens,
  CAST(least(n_tokens, budget - start) AS BIGINT) AS take_tokens FROM placed WHERE start < budget
"""
