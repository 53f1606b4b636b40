"""Phrase collocations by dynamic itemset counting.

The corpus lies in ``SHARDS`` shards that are scanned in a cycle; a step scans
one shard and counts phrases of all lengths at once (Brin et al.). Single words
count from step 0. A longer phrase starts to count with the first step before
which both its subphrases (without the last, without the first word) have
reached the threshold, in the middle of their own counting, and goes on until
every shard was seen once: one full cycle, so its count is exact whenever it
began. Each occurrence of a phrase holds both subphrases, so none that reaches
the threshold is missed.

What the mappers know of reached subphrases is a table of one byte per slot and
length, the step from which the slot's phrases are reached; a phrase's slot is
a hash of its words. A slot shared with a reached phrase only lets more phrases
be counted, also for a full cycle: counts stay exact, the size is fixed. The
table fills up as the corpus grows, which costs pruning, not results.

Words are told apart by 64-bit hashes that include the language, phrases by
their words' hashes. Mappers count a batch before anything is shuffled, so a
hot phrase is one row of a batch.

Scores are exact: integers up to 10**14 a count, multiplied as 38-digit
decimals.

Defined results: a null text is empty; a null language is ``und``, together
with rows that say so; repeated rows count as often as they stand; ids are not
read; very long texts are cut at piece separators, where no phrase can lie;
an empty table gives no row; ties are broken by count, then by phrase in byte
order. Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arrears.llm.store import Scratch
from arrears.llm.text import LOWER, buffers, mix, slices, spans, word_hashes
from arrears.session import drop_path

MAX_WORDS = 3
MIN_COUNT = 10
SCALE = 1_000_000
INSIDE_PCT = 50
TOP = 2000
SHARDS = 2
SLOT_BITS = 24           # one byte a slot, in the driver and in each worker
STRETCH = 8 << 20        # bytes of text counted at once
SPREAD = 64              # parts of a language ranked before its last ranking

SEPARATORS = np.zeros(256, dtype=bool)
SEPARATORS[list(b".,;:!?\n\x0b\x0c\r")] = True
WORD = ~SEPARATORS
WORD[[9, 32]] = False


def _slot(words: list[Column], bits: int) -> Column:
    """As ``slots`` for numpy."""
    x = words[0]
    for i, w in enumerate(words[1:], 1):
        r = 21 * i % 64
        x = x.bitwiseXOR(F.shiftleft(w, r).bitwiseOR(F.shiftrightunsigned(w, 64 - r)))
    return F.shiftrightunsigned(x, 64 - bits)


def slots(words: list[np.ndarray], bits: int) -> np.ndarray:
    x = words[0]
    for i, w in enumerate(words[1:], 1):
        r = np.uint64(21 * i % 64)
        x = x ^ ((w << r) | (w >> (np.uint64(64) - r)))
    return (x >> np.uint64(64 - bits)).astype(np.int64)


def stretches(raw: np.ndarray, offsets: np.ndarray, tags: np.ndarray, size: int = STRETCH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows as they are, or one long row cut behind separators."""
    if len(offsets) > 2 or len(raw) <= size:
        yield raw, offsets, tags
        return
    ends = np.flatnonzero(SEPARATORS[raw]) + 1
    a = 0
    while a < len(raw):
        b = len(raw)
        if b - a > size:
            i = int(np.searchsorted(ends, a + size, side="right"))
            b = int(ends[i - 1]) if i and ends[i - 1] > a else int(ends[i]) if i < len(ends) else b
        yield raw[a:b], np.array([0, b - a]), tags
        a = b


class Counter:
    """Counts of one step: ``reached`` has a table per length from 1."""

    def __init__(self, step: int, shards: int, reached: list[np.ndarray], longest: int, bits: int):
        self.step, self.shards, self.reached, self.longest, self.bits = step, shards, reached, longest, bits

    def count(self, raw: np.ndarray, offsets: np.ndarray, tags: np.ndarray, langs: list[str]) -> Iterator[pa.RecordBatch]:
        starts, ends = spans(raw, offsets, WORD)
        if not len(starts):
            return
        row = np.searchsorted(offsets, starts, side="right") - 1
        h = mix(word_hashes(raw, starts, ends) ^ tags[row])
        if self.step < self.shards:
            order = np.argsort(h, kind="stable")
            first, n = self._runs([h[order]])
            one = order[first]
            low = LOWER[raw].tobytes()
            text = [low[a:b] for a, b in zip(starts[one].tolist(), ends[one].tolist())]
            yield self._batch([h[one]], n, np.zeros(len(n), np.int32), pa.array(text, pa.binary()).cast(pa.string()), pa.array([langs[r] for r in row[one].tolist()], pa.string()))
        piece = np.cumsum(SEPARATORS[raw])[starts]
        near = (row[1:] == row[:-1]) & (piece[1:] == piece[:-1])
        at = np.flatnonzero(near)
        for k in range(2, self.longest + 1):
            table = self.reached[k - 2]
            sub = table[slots([h[i:len(h) - k + 2 + i] for i in range(k - 1)], self.bits)]
            a, b = sub[at], sub[at + 1]
            at, since = at[(a > 0) & (b > 0)], np.maximum(a, b)[(a > 0) & (b > 0)].astype(np.int64)
            go = at[(since <= self.step) & (self.step < since + self.shards)]
            if len(go):
                words = [h[go + i] for i in range(k)]
                key = words[0]
                for w in words[1:]:
                    key = mix(key ^ (w >> np.uint64(1)))
                order = np.argsort(key)
                words = [w[order] for w in words]
                first, n = self._runs(words)
                words = [w[first] for w in words]
                started = np.maximum(table[slots(words[:-1], self.bits)], table[slots(words[1:], self.bits)])
                yield self._batch(words, n, started.astype(np.int32))
            # phrases of the next length stand where two of this one follow each other
            at = at[:-1][near[at[:-1] + k - 1] & (at[1:] == at[:-1] + 1)] if len(at) else at

    @staticmethod
    def _runs(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Where runs of equal words begin, and their lengths."""
        new = np.ones(len(words[0]), dtype=bool)
        new[1:] = False
        for w in words:
            new[1:] |= w[1:] != w[:-1]
        first = np.flatnonzero(new)
        return first, np.diff(np.append(first, len(new)))

    def _batch(self, words: list[np.ndarray], n: np.ndarray, since: np.ndarray, text: pa.Array | None = None, lang: pa.Array | None = None) -> pa.RecordBatch:
        cols = [pa.array(w.view(np.int64)) for w in words] + [pa.nulls(len(n), pa.int64())] * (self.longest - len(words))
        return pa.RecordBatch.from_arrays(
            cols + [pa.array(since), pa.nulls(len(n), pa.string()) if text is None else text, pa.nulls(len(n), pa.string()) if lang is None else lang, pa.array(n.astype(np.int64))],
            names=[f"w{i + 1}" for i in range(self.longest)] + ["since", "word", "lang", "n"])


def _length(longest: int) -> Column:
    return sum((F.col(f"w{i + 1}").isNotNull().cast("int") for i in range(longest)), F.lit(0))


def count_phrases(spark: SparkSession, docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, shards: int = SHARDS, bits: int = SLOT_BITS) -> tuple[DataFrame, DataFrame]:
    """``docs`` (text, lang) -> phrases (w1.., k, word, lang, n) with at least
    ``min_count`` occurrences, and all words of each language (lang, n)."""
    s = Scratch(spark, "collocations")
    place = F.pmod(F.monotonically_increasing_id(), F.lit(shards))
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    docs.select(lang.alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), place.alias("shard")).where("text <> ''") \
        .write.partitionBy("shard").parquet(s.path("corpus"))
    corpus = spark.read.schema("lang string, text string, shard int").parquet(s.path("corpus"))
    words = [f"w{i + 1}" for i in range(max_words)]
    keys = [*words, "since", "word", "lang"]
    schema = ", ".join(f"{w} bigint" for w in words) + ", since int, word string, lang string, n bigint"
    reached = [np.zeros(1 << bits, np.uint8) for _ in range(max_words - 1)]
    k = _length(max_words)
    open_rows, ended, step = None, [], 0
    while step < shards or any(bool(((t > 0) & (t + np.uint8(shards) > step)).any()) for t in reached):
        sent = spark.sparkContext.broadcast(Counter(step, shards, reached, max_words, bits))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counter = sent.value
            for b in batches:
                for part in slices(b, size=STRETCH):
                    langs = part.column("lang").to_pylist()
                    tags = part.column("tag").to_numpy().view(np.uint64)
                    for raw, offsets, tag in stretches(*buffers(part.column("text")), tags):
                        yield from counter.count(raw, offsets, tag, langs)

        found = corpus.where(F.col("shard") == step % shards).select("lang", "text", F.xxhash64("lang").alias("tag")).mapInArrow(scan, schema)
        if open_rows is not None:
            found = found.unionByName(open_rows)
        total = found.groupBy(*keys).agg(F.sum("n").alias("n"))
        done = F.col("since") + shards - 1 <= step
        name = f"counted-{step}"
        # a phrase that is complete and too rare is done with; all words stay, as their number is asked
        total.withColumns({"done": done, "k": k}).where(~F.col("done") | (F.col("k") == 1) | (F.col("n") >= min_count)) \
            .write.partitionBy("done").parquet(s.path(name))
        kept = spark.read.schema(f"{schema}, k int, done boolean").parquet(s.path(name))
        if step:
            drop_path(spark, s.path(f"counted-{step - 1}/done=false"))
        sent.unpersist()
        for length in range(1, max_words):
            slot = _slot([F.col(w) for w in words[:length]], bits) + 1
            maps = kept.where((F.col("k") == length) & (F.col("n") >= min_count)).select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("at")).agg(
                F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")).collect()
            table = reached[length - 1]
            for r in maps:             # one bit a slot: at most 2**bits / 8 bytes
                view = table[(r["at"] - 1) << 15:r["at"] << 15]
                now = np.unpackbits(np.frombuffer(r["bits"], np.uint8), bitorder="little")[:len(view)].astype(bool)
                view[now & (view == 0)] = step + 1
        open_rows = kept.where(~F.col("done")).drop("done", "k")
        ended.append(kept.where("done").drop("done", "since"))
        step += 1
    drop_path(spark, s.path("corpus"))
    phrases = ended[0]
    for t in ended[1:]:
        phrases = phrases.unionByName(t)
    return s.write(phrases.where(F.col("n") >= min_count), "phrases"), phrases.where("k = 1").groupBy("lang").agg(F.sum("n").alias("n"))


def _part(words: list[str], n: str, frequent: DataFrame) -> DataFrame:
    """Frequent phrases of as many words, under the names ``words`` have elsewhere."""
    k = len(words)
    return frequent.where(F.col("k") == k).select(*[F.col(f"w{i + 1}").alias(w) for i, w in enumerate(words)], F.col("n").alias(n))


def collocations(spark: SparkSession, docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, top: int | None = TOP, shards: int = SHARDS, bits: int = SLOT_BITS, inside_pct: int = INSIDE_PCT) -> DataFrame:
    """The ``top`` phrases of each language (all with None): lang, rank, phrase, a, l, r, n, score."""
    frequent, totals = count_phrases(spark, docs, max_words, min_count, shards, bits)
    scored = []
    for k in range(2, max_words + 1):
        ws = [f"w{i + 1}" for i in range(k)]
        cand = frequent.where(F.col("k") == k).select(*ws, F.col("n").alias("a"))
        for cut in range(1, k):
            cand = cand.join(_part(ws[:cut], f"l{cut}", frequent), ws[:cut]).join(_part(ws[cut:], f"r{cut}", frequent), ws[cut:])
        for cut in range(1, k):
            cand = cand.withColumn(f"s{cut}", F.expr(f"(cast({SCALE} as decimal(7,0)) * cast(a as decimal(14,0)) * cast(a as decimal(14,0))) div (cast(l{cut} as decimal(14,0)) * cast(r{cut} as decimal(14,0)))"))
        low = F.array_min(F.array(*[F.struct(F.col(f"s{c}").alias("score"), F.lit(c).alias("cut"), F.col(f"l{c}").alias("l"), F.col(f"r{c}").alias("r")) for c in range(1, k)]))
        cand = cand.select(*ws, "a", low.alias("low")).select(*ws, "a", "low.l", "low.r", "low.score")
        # the largest count of a longer phrase around it
        around = None
        for longer in range(k + 1, max_words + 1):
            for i in range(longer - k + 1):
                part = frequent.where(F.col("k") == longer).select(*[F.col(f"w{i + j + 1}").alias(ws[j]) for j in range(k)], F.col("n").alias("around"))
                around = part if around is None else around.unionByName(part)
        if around is not None:
            cand = cand.join(around.groupBy(*ws).agg(F.max("around").alias("around")), ws, "left").where(
                F.col("around").isNull() | (F.col("around") * 100 < F.col("a") * inside_pct)).drop("around")
        names = frequent.where("k = 1").select("w1", "word", "lang")
        for i, w in enumerate(ws):
            cand = cand.join(names.select(F.col("w1").alias(w), F.col("word").alias(f"t{i + 1}"), *([F.col("lang")] if i == 0 else [])), w)
        scored.append(cand.select("lang", F.concat_ws(" ", *[f"t{i + 1}" for i in range(k)]).alias("phrase"), "a", "l", "r", "score"))
    rows = scored[0]
    for t in scored[1:]:
        rows = rows.unionByName(t)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    if top is not None:
        # the best of each part of a language first, so that the last ranking meets SPREAD * top rows at most
        part = F.pmod(F.xxhash64("phrase"), F.lit(SPREAD))
        rows = rows.withColumn("part", part).withColumn("place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("place") <= top).drop("part", "place")
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    if top is not None:
        rows = rows.where(F.col("rank") <= top)
    return rows.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
