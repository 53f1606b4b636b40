"""SimHash fingerprints (DataFrame functions only).

A term is a word between white space; its weight is its length, at most 8, so
that the short words all texts share count little. Every occurrence votes with
its weight on the 64 signed bits of its hash; a bit is 1 if more weight says 1
than 0. The 64 counters are packed: 16 long sums hold four 16-bit lanes each,
over runs of at most ``RUN`` terms so that no lane overflows, and the lanes of
a text's runs are added afterwards. Texts of any length are voted on whole.

``neighbours`` answers a Hamming search with permuted block tables: 64 bits in
six blocks, and for each of the 20 choices of three blocks a table keyed by
the bits of the chosen blocks. Two fingerprints within radius 3 differ in at
most three blocks, so at least one table has them under one key; the pair is
taken from the first such table only, and checked by its distance.
``near_documents`` names neighbours within the larger radius ``NEAR_RADIUS``,
chosen for a recall of 0.9 at a similarity of 0.8 or more, by 56 tables.

Defined results: a null or empty text has no votes and the fingerprint of 64
zeros; equal texts have equal fingerprints; repeated rows are rows of their
own; ids in descending order, nulls last, equal ids by the hash of the text.
A single document is its own next one.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arrears.llm.store import Scratch

RUN = 4095                     # terms of one run: RUN * MAX_WEIGHT < 2**15, so no lane overflows, nor the sign
MAX_WEIGHT = 8
RADIUS = 3
BLOCKS = (11, 11, 11, 11, 10, 10)
#: Of 600 pairs of texts of 60 to 400 words with one word in 60 replaced (five-word
#: Jaccard at least 0.8, 0.88 on average) 0.68 are within 3 bits, 0.83 within 4,
#: 0.92 within 5, 0.97 within 6 and 0.99 within 7.
NEAR_RADIUS = 5
NEAR_BLOCKS = (8,) * 8         # 56 tables, each keyed by 24 bits; ten blocks would make 252 of 32 bits
LANES = 0x0001000100010001
BUCKET_CHARS = 16_000_000      # characters of text in one range of ids
MAX_BUCKETS = 1 << 18          # split points are read to the driver: 2 MB at most


def votes(texts: DataFrame, keys: list[str], carried: list[str]) -> DataFrame:
    """``texts`` (keys, carried longs, text) -> keys, carried, fingerprint (long)."""
    words = texts.select(*keys, *carried, F.posexplode(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+")).alias("pos", "term"))
    term = words.select(*keys, *carried, F.floor(F.col("pos") / RUN).cast("int").alias("run"), F.xxhash64("term").alias("h"),
                        F.least(F.length("term"), F.lit(MAX_WEIGHT)).cast("long").alias("w"))
    packed = term.groupBy(*keys, "run").agg(
        *[F.first(c).alias(c) for c in carried], F.sum("w").alias("w"),
        *[F.sum(F.shiftrightunsigned("h", j).bitwiseAND(F.lit(LANES)) * F.col("w")).alias(f"s{j}") for j in range(16)])
    # bit j + 16 * lane of the hash stands in that lane of sum j
    lane = {j + 16 * k: F.shiftrightunsigned(f"s{j}", 16 * k).bitwiseAND(F.lit(0xFFFF)) for j in range(16) for k in range(4)}
    whole = packed.groupBy(*keys).agg(*[F.first(c).alias(c) for c in carried], F.sum("w").alias("w"),
                                      *[F.sum(lane[i]).alias(f"v{i}") for i in range(64)])
    bits = F.lit(0).cast("long")
    for i in range(64):
        bits = bits.bitwiseOR(F.when(F.col(f"v{i}") * 2 > F.col("w"), F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")))
    return whole.select(*keys, *carried, bits.alias("fp"))


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def likeness(a: Column, b: Column) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def masks(radius: int = RADIUS, blocks: tuple[int, ...] = BLOCKS) -> list[int]:
    """The tables' masks (20 for the defaults), as signed longs."""
    edges, lo = [], 0
    for size in blocks:
        edges.append(((1 << size) - 1) << lo)
        lo += size
    out = [sum(c) for c in combinations(edges, len(blocks) - radius)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in out]


def near_pairs(fps: DataFrame, queries: DataFrame, radius: int = RADIUS, blocks: tuple[int, ...] = BLOCKS) -> DataFrame:
    """(q, fp, distance, c): for each distinct query fingerprint ``q`` every
    fingerprint of ``fps`` within the radius, itself included, and its rows."""
    tables = masks(radius, blocks)
    dealt = lambda df, c: df.select("*", F.explode(F.array(*[
        F.struct(F.lit(i).alias("t"), F.col(c).bitwiseAND(F.lit(m).cast("long")).alias("key")) for i, m in enumerate(tables)])).alias("e")).select(
        "*", "e.t", "e.key").drop("e")
    known = dealt(fps.groupBy("fp").agg(F.count("*").alias("c")), "fp")
    asked = dealt(queries.select(F.col("fp").alias("q")).distinct(), "q")
    pair = asked.join(known, ["t", "key"])
    apart = F.col("q").bitwiseXOR(F.col("fp"))
    first = F.coalesce(*[F.when(apart.bitwiseAND(F.lit(m).cast("long")) == 0, F.lit(i)) for i, m in enumerate(tables)])
    return pair.where((F.bit_count(apart) <= radius) & (first == F.col("t"))).select("q", "fp", F.bit_count(apart).alias("distance"), "c")


def neighbours(fps: DataFrame, queries: DataFrame) -> DataFrame:
    """(q, n_rows): for each distinct query fingerprint ``q`` the rows of
    ``fps`` (fp) within the radius, its own equals included."""
    return near_pairs(fps, queries).groupBy("q").agg(F.sum("c").alias("n_rows"))


def _bucket(splits: list[int]) -> Column:
    """How many split points are at least the id: ranges of descending ids; null ids come last."""
    if not splits:
        return F.lit(0)
    points = F.lit(sorted(splits))
    steps, size = [], 1
    while size <= len(splits):
        steps.insert(0, size)
        size *= 2
    # binary search for the points below the id
    below = F.aggregate(F.array(*[F.lit(x) for x in steps]), F.lit(0), lambda pos, step: F.when(
        (pos + step <= len(splits)) & (F.get(points, pos + step - 1) < F.col("doc_id")), pos + step).otherwise(pos))
    return F.when(F.col("doc_id").isNull(), F.lit(len(splits))).otherwise(F.lit(len(splits)) - below)


def with_next(s: Scratch, docs: DataFrame, bucket_chars: int = BUCKET_CHARS) -> DataFrame:
    """(bucket, at, doc_id, text, next, extra): each row with the text of the
    row after it by descending id; after the last comes the first. Ids are cut
    into ranges of about ``bucket_chars`` of text; each range ends with a copy
    of the next range's first row (``extra``), so texts move once."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    chars = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = min(MAX_BUCKETS, -(-int(chars) // bucket_chars))
    shares = [i / n for i in range(1, n)]
    found = rows.agg(F.percentile_approx("doc_id", shares, max(10_000, 4 * n))).first()[0] if shares else []
    splits = sorted(set(found or []))
    rows = rows.withColumn("bucket", _bucket(splits).cast("int")).withColumn("tie", F.xxhash64("text"))
    # the first row of every range: at most one per split point, and their texts
    heads = rows.groupBy("bucket").agg(F.max(F.struct("doc_id", "tie")).alias("m")).select("bucket", "m.doc_id", "m.tie")
    heads = s.write(heads, "heads")
    w = Window.partitionBy(F.lit(0)).orderBy("bucket")
    before = heads.withColumn("to", F.coalesce(F.lag("bucket").over(w), F.max("bucket").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    h = F.broadcast(before.select(F.col("doc_id").alias("h_id"), F.col("tie").alias("h_tie"), "to"))
    copies = rows.join(h, rows["doc_id"].eqNullSafe(F.col("h_id")) & (rows["tie"] == F.col("h_tie"))).select("doc_id", "text", F.col("to").alias("bucket"), "tie")
    copies = s.write(copies.dropDuplicates(["bucket"]), "copies")
    both = rows.withColumn("extra", F.lit(False)).unionByName(copies.withColumn("extra", F.lit(True)))
    order = Window.partitionBy("bucket").orderBy("extra", F.col("doc_id").desc_nulls_last(), F.col("tie").desc())
    return both.select("bucket", F.row_number().over(order).alias("at"), "doc_id", "text", F.lead("text").over(order).alias("next"), "extra")


def near_documents(spark: SparkSession, docs: DataFrame, radius: int = NEAR_RADIUS, blocks: tuple[int, ...] = NEAR_BLOCKS) -> DataFrame:
    """(doc_id, near_id, distance, n_rows): for every id divisible by 100 the
    rows of ``docs`` within the radius, by id and distance; not the row itself,
    but others of its id. Texts are voted on once, without edits."""
    s = Scratch(spark, "simhash-near")
    # rows of one id and text count apart, but are voted on as one text
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("row", F.xxhash64("doc_id", "text"))
    count = s.write(rows.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.count("*").alias("n")), "rows")
    twice = s.write(count.where("n > 1").select(F.col("row").alias("again")), "twice")
    once = rows.join(twice, F.col("row") == F.col("again"), "left_anti")
    rest = rows.join(twice, F.col("row") == F.col("again"), "left_semi").dropDuplicates(["row"])
    prints = votes(once.unionByName(rest).select("row", "text"), ["row"], [])
    known = s.write(prints.join(count, "row").groupBy("doc_id", "fp").agg(F.sum("n").alias("n")), "known")
    asked = known.where("doc_id % 100 = 0").select("doc_id", F.col("fp").alias("q"), "n")
    pairs = s.write(near_pairs(known.select("fp"), asked.select(F.col("q").alias("fp")), radius, blocks).drop("c"), "pairs")
    found = asked.select("doc_id", "q").join(pairs, "q").join(known.select(F.col("doc_id").alias("near_id"), "fp", "n"), "fp")
    # each row of an id that occurs more often has the others; the id is named once
    own = F.col("doc_id").eqNullSafe(F.col("near_id")) & (F.col("q") == F.col("fp"))
    return found.withColumn("n", F.col("n") - own.cast("long")).where("n > 0").groupBy("doc_id", "near_id", "distance").agg(
        F.sum("n").alias("n_rows")).select("doc_id", "near_id", F.col("distance").cast("int").alias("distance"), "n_rows")


def fingerprints(spark: SparkSession, docs: DataFrame, bucket_chars: int = BUCKET_CHARS) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next, and for every id divisible by
    100 the other rows within the radius (``n_near``, else null).

    The edited text has its last floor(n_chars / 2) code points replaced by
    the first as many of the next document's."""
    s = Scratch(spark, "simhash")
    rows = with_next(s, docs, bucket_chars)
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.coalesce("next", F.lit("")), F.lit(1), half))
    rows = rows.select("bucket", "at", "doc_id", "extra", F.length("text").cast("long").alias("n_chars"), "text", edited.alias("edited"))
    digest = F.sha2("edited", 256)
    part = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"d{i}") for i in range(8)]
    one = rows.select("bucket", "at", "doc_id", F.col("extra").cast("int").cast("long").alias("extra"), "n_chars", *part,
                      F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("text")),
                                        F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text")))).alias("e"))
    one = one.select("*", "e.kind", "e.text").drop("e")
    carried = ["doc_id", "extra", "n_chars", *[f"d{i}" for i in range(8)]]
    both = votes(one, ["bucket", "at", "kind"], carried).groupBy("bucket", "at").agg(
        *[F.first(c).alias(c) for c in carried], F.max(F.when(F.col("kind") == 0, F.col("fp"))).alias("fp"),
        F.max(F.when(F.col("kind") == 1, F.col("fp"))).alias("efp"))
    both = both.withColumn("nfp", F.lead("fp").over(Window.partitionBy("bucket").orderBy("at")))
    done = s.write(both.where("extra = 0").select(
        "doc_id", "n_chars", F.concat(*[F.lower(F.lpad(F.hex(f"d{i}"), 8, "0")) for i in range(8)]).alias("edited_sha256"), "fp", "efp", "nfp"), "fingerprints")
    near = s.write(neighbours(done.select("fp"), done.where("doc_id % 100 = 0").select("fp")), "near")
    out = done.join(near, done["fp"] == near["q"], "left")
    return out.select("doc_id", "n_chars", "edited_sha256", hex_of(F.col("fp")).alias("fingerprint"), hex_of(F.col("efp")).alias("edited_fingerprint"),
                      likeness(F.col("fp"), F.col("efp")).alias("near_edited"), likeness(F.col("fp"), F.col("nfp")).alias("near_next"),
                      F.when(F.col("doc_id") % 100 == 0, F.col("n_rows") - 1).alias("n_near"))
