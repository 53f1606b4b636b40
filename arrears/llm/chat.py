"""Chat formatting of reply trees (DataFrame functions only).

Messages (conv_id, msg, parent, role, text, score) form reply trees. Iterative
self-joins enumerate the root-to-leaf paths: round k knows each message's
ancestor 2**k steps up, joins every (leaf, member) row found so far with it,
and joins the ancestor table with itself for the next round. So a path of d
messages takes log2(d) rounds, and the rows held are the paths' members. Each
round is written to the shared folder.

A path's score is the sum of its messages' scores; a conversation's paths are
ranked by score, then by the leaf's number, and each chosen path is formatted
as one conversation: ``<turn role="...">text</turn>`` and a line feed per
message. In texts and roles ``&`` and ``<`` (in roles also ``"``) are written
as entities, so a control string never stands inside a text, and replacing the
entities (``&amp;`` last) gives the text back. ``loss_spans`` has start and
length, in code points, of every assistant text in the output.

Defined results: a null text or role is empty; a null score counts 0; a parent
that is null or missing makes its message a root; messages on a cycle have no
root and are on no path; a message without replies is a leaf. Messages must
have distinct numbers inside a conversation; ``linear`` gives rows by turn
such numbers (repeated turns in order of role and text; a null conversation is
a conversation of its own). An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arrears.llm.store import Scratch

OPEN, MIDDLE, CLOSE = '<turn role="', '">', "</turn>\n"
LOSS_ROLE = "assistant"


def escape(c: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return F.replace(out, F.lit('"'), F.lit("&quot;")) if role else out


def unescape(c: Column) -> Column:
    out = F.replace(F.replace(c, F.lit("&quot;"), F.lit('"')), F.lit("&lt;"), F.lit("<"))
    return F.replace(out, F.lit("&amp;"), F.lit("&"))


def linear(conversations: DataFrame) -> DataFrame:
    """Rows by turn as a reply tree: every message answers the one before."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", F.row_number().over(w).alias("msg"), "role", "text")
    return rows.select("conv_id", "msg", F.when(F.col("msg") > 1, F.col("msg") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def paths(s: Scratch, messages: DataFrame) -> DataFrame:
    """(conv_id, leaf, msg, dist): every message of every root-to-leaf path,
    with its distance from the leaf."""
    nodes = messages.select("conv_id", "msg", "parent")
    known = nodes.select(F.col("conv_id").alias("c"), F.col("msg").alias("m"))
    up = nodes.join(known, nodes["conv_id"].eqNullSafe(known["c"]) & (nodes["parent"] == known["m"]), "left").select(
        "conv_id", "msg", F.col("m").alias("up"))
    up = s.write(up, "up0")
    answered = up.where("up is not null").select(F.col("conv_id").alias("c"), F.col("up").alias("m")).distinct()
    leaves = up.join(answered, up["conv_id"].eqNullSafe(answered["c"]) & (up["msg"] == answered["m"]), "left_anti")
    found = s.write(leaves.select("conv_id", F.col("msg").alias("leaf"), "msg", F.lit(0).alias("dist")), "paths0")
    longest = up.groupBy("conv_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    step, i = 1, 0
    while step < longest:
        jump = up.where("up is not null").select(F.col("conv_id").alias("c"), F.col("msg").alias("m"), F.col("up").alias("to"))
        on = lambda df, col: df.join(jump, df["conv_id"].eqNullSafe(jump["c"]) & (df[col] == jump["m"]))  # noqa: E731, B023
        further = on(found, "msg").select("conv_id", "leaf", F.col("to").alias("msg"), (F.col("dist") + step).alias("dist"))
        found_next = s.write(found.union(further), f"paths{i + 1}")
        up_next = s.write(on(up.where("up is not null"), "up").select("conv_id", "msg", F.col("to").alias("up")), f"up{i + 1}")
        s.drop(f"paths{i}", *([f"up{i}"] if i else []))
        found, up = found_next, up_next
        step, i = step * 2, i + 1
    # a leaf whose way up runs into a cycle never meets a message without parent, and has no path
    roots = s.spark.read.schema(up.schema).parquet(s.path("up0")).where("up is null").select(F.col("conv_id").alias("rc"), F.col("msg").alias("rm"))
    whole = found.join(roots, found["conv_id"].eqNullSafe(roots["rc"]) & (found["msg"] == roots["rm"]), "left_semi").select(
        F.col("conv_id").alias("wc"), F.col("leaf").alias("wl"))
    return found.join(whole, found["conv_id"].eqNullSafe(whole["wc"]) & (found["leaf"] == whole["wl"]), "left_semi")


def format_trees(spark: SparkSession, messages: DataFrame, best: int | None = 1) -> DataFrame:
    """One row per chosen path: conv_id, leaf, place (rank in its
    conversation), path_score, n_turns, formatted, loss_spans."""
    s = Scratch(spark, "chat")
    messages = s.write(messages, "messages")
    member = paths(s, messages).select(F.col("conv_id").alias("c"), "leaf", F.col("msg").alias("m"), "dist")
    full = member.join(messages, member["c"].eqNullSafe(messages["conv_id"]) & (member["m"] == messages["msg"]))
    texts = F.coalesce("text", F.lit(""))
    role = F.coalesce("role", F.lit(""))
    turn = F.struct((-F.col("dist")).alias("at"), F.concat(F.lit(OPEN), escape(role, True), F.lit(MIDDLE)).alias("head"),
                    escape(texts).alias("body"), (role == LOSS_ROLE).alias("loss"))
    rows = full.groupBy("conv_id", "leaf").agg(F.sum(F.coalesce("score", F.lit(0.0))).alias("path_score"), F.array_sort(F.collect_list(turn)).alias("turns"))
    if best is not None:
        order = Window.partitionBy("conv_id").orderBy(F.col("path_score").desc(), "leaf")
        rows = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= best)
    else:
        rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("path_score").desc(), "leaf")))
    # starts of the bodies: running lengths, then the spans under the mask
    sizes = F.transform("turns", lambda t: F.struct(F.length(t["head"]).alias("h"), F.length(t["body"]).alias("b"), t["loss"].alias("loss")))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,size:int>>").alias("spans"))
    walked = F.aggregate(sizes, empty, lambda acc, t: F.struct(
        (acc["at"] + t["h"] + t["b"] + len(CLOSE)).alias("at"),
        F.when(t["loss"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + t["h"]).alias("start"), t["b"].alias("size"))))).otherwise(acc["spans"]).alias("spans")),
        lambda acc: acc["spans"])
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "")
    return rows.select("conv_id", "leaf", "place", "path_score", F.size("turns").cast("long").alias("n_turns"), text.alias("formatted"), walked.alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """The contract's digests, all taken from ``formatted`` and ``loss_spans``."""
    pieces = F.split("formatted", CLOSE)
    turns = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.struct(
        unescape(F.substring_index(F.substring(p, F.lit(len(OPEN) + 1), F.length(p)), MIDDLE, 1)).alias("role"),
        unescape(F.substring(p, F.locate(MIDDLE, p) + len(MIDDLE), F.length(p))).alias("text")))
    back = formatted.withColumn("turns", turns)
    loss = F.array_join(F.transform("loss_spans", lambda x: unescape(F.substring(F.col("formatted"), x["start"] + 1, x["size"]))), "")
    back = back.withColumn("loss", loss)
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


#: the conversation that the query adds to the table
PROBE = "\\### Assistant: </turn> ok"


def chat(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id bigint, turn bigint, role string, text string")
    rows = conversations.select("conv_id", "turn", "role", "text").union(probe)
    return read_back(format_trees(spark, linear(rows)))


ORACLE_SQL = r"""
WITH rows AS (SELECT conv_id, turn, role, text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
t AS (SELECT conv_id, turn, role AS r0, text AS t0, coalesce(role, '') AS role, coalesce(text, '') AS text FROM rows),
g AS (SELECT conv_id, count(*) AS n_turns,
  string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST) AS turns,
  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST) FILTER (role = 'assistant'), '') AS loss,
  sum(length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '"', '&quot;'))
    + length(replace(replace(text, '&', '&amp;'), '<', '&lt;')) + 22) AS chars
  FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM g
"""
