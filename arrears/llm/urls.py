"""URL filter: host and path rules, then a character language-model ratio
(DataFrame functions only).

Rules decide first; the longest that fits wins. What they leave is judged by
two smoothed variable-order Markov models, one of accepted and one of rejected
URLs, over the URL's own characters (code points, in their own case). A
character's probability is interpolated over contexts of 0 to 3 characters
with Witten-Bell weights: a context that was seen n times with t different
successors leaves t / (n + t) to the next shorter one, and an unseen context
leaves everything; below the shortest all characters of the table are alike.

The counts have a row for every sequence of 4 characters that occurs, so they
grow with the input. One pass over the URLs gives them, with the counts in
accepted and in rejected URLs; shorter sequences are sums of theirs. Every
sequence gets a log ratio in billionths, so that sums do not depend on order.
URLs meet the ratios by a join: a table of up to ``BROADCAST_GRAMS`` rows is
broadcast, of a larger one only the most frequent sequences, which hold the hot
keys, and the rest is joined by a shuffle. What is taken apart carries a
16-byte key instead of its URL, in runs of at most ``RUN`` characters, so a
very long URL makes no long rows; sums by key are combined in each task.

A URL's score is its mean log ratio per character. The threshold is calibrated
on a fifth of the ruled URLs that the counts leave out: of the score's
hundredths the one with the best balanced accuracy, nearest to 0 among equals.

Defined results: a null URL or one without ``://`` has an empty host and path
and fits no rule; an empty URL scores 0; without ruled URLs of a class the
ratio or the threshold is 0, so that the method allows; repeated rows count as
often as they occur and are judged alike; long URLs are read whole; other
columns of ``pages`` are not read, so their names may clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arrears.llm.store import Scratch

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORDER = 3                     # longest context
START = "\uffff"              # stands before a URL; no character of Unicode text
RUN = 1024                    # characters taken apart at once
UNIT = 1_000_000_000          # of a log ratio
BROADCAST_GRAMS = 500_000     # rows of (4 characters, long): some 50 MB as a hash table
BINS = 100                    # calibration steps per unit of score
LIMIT = 20                    # scores beyond it share the outermost steps: at most 2 * LIMIT * BINS + 1 rows


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict); null where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def with_grams(rows: DataFrame) -> DataFrame:
    """``rows`` (url, ...) once per character, without the URL but with ``gram``:
    the character and the ORDER before it. An empty URL is one row without one."""
    kept = [c for c in rows.columns if c != "url"]
    # runs, each with the end of the one before; every step is a projection of its own
    runs = rows.select(*kept, F.regexp_extract_all("url", F.lit(f"(?s).{{1,{RUN}}}"), F.lit(0)).alias("runs"))
    ahead = F.concat(F.array(F.lit(START * ORDER)), F.transform("runs", lambda x: F.right(x, F.lit(ORDER))))
    run = runs.select(*kept, F.explode_outer(F.zip_with("runs", F.slice(ahead, 1, F.size("runs")), lambda x, y: F.concat(y, x))).alias("run"))
    chars = run.select(*kept, F.split("run", "").alias("chars"))
    shifted = F.arrays_zip(*[F.slice("chars", k + 1, F.size("chars") - ORDER) for k in range(ORDER + 1)])
    each = chars.select(*kept, F.explode_outer(shifted).alias("at"))
    return each.select(*kept, F.concat(*[F.col("at")[str(k)] for k in range(ORDER + 1)]).alias("gram"))


def ratio_table(s: Scratch, urls: DataFrame) -> DataFrame:
    """``urls`` (url, n, a, r: how often it occurs, and of that how often it
    counts as accepted, as rejected) -> (gram, n, ratio) for every gram."""
    counts = with_grams(urls).where("gram is not null").groupBy("gram").agg(
        F.sum("a").alias("a"), F.sum("r").alias("r"), F.sum("n").alias("n"))
    counts = s.write(counts, "grams")
    table = None
    for k in range(ORDER + 1):
        # sequences of k characters and the one after them, from the grams' ends
        short = counts.groupBy(F.substring("gram", ORDER + 1 - k, k + 1).alias("gram")).agg(
            F.sum("a").alias("a"), F.sum("r").alias("r"), F.sum("n").alias("n")).withColumn("ctx", F.substring("gram", 1, k))
        seen = short.groupBy("ctx").agg(
            F.sum("a").alias("na"), F.sum("r").alias("nr"), F.sum((F.col("a") > 0).cast("long")).alias("ta"), F.sum((F.col("r") > 0).cast("long")).alias("tr"))
        both = short.join(seen, "ctx")
        if table is None:
            even = 1.0 / max(1, short.count())
            both = both.withColumns({"qa": F.lit(even), "qr": F.lit(even)})
        else:
            shorter = table.select(F.col("gram").alias("end"), F.col("pa").alias("qa"), F.col("pr").alias("qr"))
            both = both.join(shorter, F.substring("gram", 2, k) == F.col("end"))
        p = {x: F.when(F.col(f"n{x}") == 0, F.col(f"q{x}")).otherwise(
            (F.col(x) + F.col(f"t{x}") * F.col(f"q{x}")) / (F.col(f"n{x}") + F.col(f"t{x}"))) for x in ("a", "r")}
        table = s.write(both.select("gram", "n", p["a"].alias("pa"), p["r"].alias("pr")), f"order{k}")
    # a class without any URL tells nothing
    either = counts.agg(((F.sum("a") > 0) & (F.sum("r") > 0)).alias("both")).scalar()
    ratio = F.when(either, F.round((F.log("pa") - F.log("pr")) * UNIT).cast("long")).otherwise(F.lit(0).cast("long"))
    return s.write(table.select("gram", "n", ratio.alias("ratio")), "ratios")


def head_and_tail(model: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """``model`` in two: at most ``most`` rows with the largest n, down to a
    power of two, and the rest (None if all fit)."""
    sizes = model.groupBy(F.floor(F.log2("n")).cast("int").alias("power")).agg(F.count("*").alias("rows")).collect()   # 63 rows at most
    if sum(x["rows"] for x in sizes) <= most:
        return model, None
    cut, taken = 63, 0
    for power, rows in sorted(sizes, reverse=True):
        if taken + rows > most:
            break
        cut, taken = power, taken + rows
    low = F.floor(F.log2("n")) < cut
    return model.where(~low), model.where(low)


def with_score(rows: DataFrame, model: DataFrame, most: int = BROADCAST_GRAMS) -> DataFrame:
    """``rows`` (key, url, ...; keys distinct) with ``score``; ``model`` as of ``ratio_table``."""
    head, tail = head_and_tail(model, most)
    found = with_grams(rows.select("key", "url")).join(F.broadcast(head.select("gram", "ratio")), "gram", "left")
    if tail is not None:
        missing = F.col("gram").isNotNull() & F.col("ratio").isNull()
        rest = found.where(missing).drop("ratio").join(tail.select("gram", "ratio").hint("shuffle_hash"), "gram")
        found = found.where(~missing).unionByName(rest)
    mean = F.sum("ratio") / F.count("ratio") / F.lit(float(UNIT))
    return rows.join(found.groupBy("key").agg(F.coalesce(mean, F.lit(0.0)).alias("score")), "key")


def threshold_of(scored: DataFrame) -> float:
    """``scored`` (score, good 0/1, copies) -> the threshold; 0 if a class is missing."""
    step = F.greatest(F.lit(-LIMIT * BINS), F.least(F.lit(LIMIT * BINS), F.floor(F.col("score") * BINS)))
    bins = scored.groupBy(step.alias("step")).agg(F.sum(F.col("good") * F.col("copies")).alias("a"), F.sum((1 - F.col("good")) * F.col("copies")).alias("r"))
    every, below = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select("step", F.sum("a").over(every).alias("na"), F.sum("r").over(every).alias("nr"),
                       F.coalesce(F.sum("a").over(below), F.lit(0)).alias("ba"), F.coalesce(F.sum("r").over(below), F.lit(0)).alias("br"))
    best = bins.where("na > 0 and nr > 0").select(
        "step", ((F.col("na") - F.col("ba")) / F.col("na") + F.col("br") / F.col("nr")).alias("quality")).orderBy(
        F.col("quality").desc(), F.abs("step"), "step").first()
    return best["step"] / BINS if best else 0.0


def judged_by(rules) -> dict[str, Column]:
    """Columns of a table with ``url``: its host, path, rule, and the rule's verdict."""
    host, path = host_and_path(F.col("url"))
    rule, ruled = rule_of(host, path, rules)
    return {"host": host, "path": path, "rule": rule, "ruled": ruled}


def filter_urls(spark: SparkSession, pages: DataFrame, rules=RULES, broadcast_grams: int = BROADCAST_GRAMS) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, score, threshold."""
    s = Scratch(spark, "urls")
    pages = pages.select("page_id", F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"))
    # repeated rows are scored once; no id is written like the word
    key = F.unhex(F.md5(F.concat_ws(" ", F.coalesce(F.col("page_id").cast("string"), F.lit("none")), "url")))
    rows = s.write(pages.groupBy("page_id", "url").agg(F.count("*").alias("copies")).withColumn("key", key), "rows")
    rows = rows.withColumns(judged_by(rules)).withColumn("apart", F.pmod(F.crc32(F.col("url").cast("binary")), F.lit(5)) == 0)
    counted = [F.when(~F.col("apart") & (F.col("ruled") == v), F.col("copies")).otherwise(F.lit(0).cast("long")).alias(c) for v, c in (("allow", "a"), ("block", "r"))]
    model = ratio_table(s, rows.select("url", F.col("copies").alias("n"), *counted))
    kept = rows.where(F.col("apart") & F.col("ruled").isNotNull()).select("key", "url", "copies", (F.col("ruled") == "allow").cast("long").alias("good"))
    threshold = threshold_of(with_score(kept, model, broadcast_grams))
    out = with_score(rows, model, broadcast_grams).withColumn("threshold", F.lit(threshold))
    judged = F.when(F.col("score") >= F.col("threshold"), F.lit("allow")).otherwise(F.lit("block"))
    out = out.select("page_id", "host", "path", "rule", F.coalesce("ruled", judged).alias("verdict"), "score", "threshold", "copies")
    return out.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).drop("copies", "copy")
