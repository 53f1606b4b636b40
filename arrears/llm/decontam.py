"""Benchmark decontamination on a distributed positional inverted index.

``build_index`` stores the postings of *every* word of the training texts:
one row per block of documents holds the block's distinct terms (64-bit
hashes, sorted), their counts, and their positions, term after term. Blocks
hold whole documents, about 2 MB of text each, and are written to the shared
folder, so a lost executor costs one block.

``match`` answers the benchmark's windows against the index. Per block it
keeps the windows whose terms are all present, takes each window's terms from
the rarest of the corpus on, and intersects posting lists shifted by the
term's offset in the window, until nothing is left or every term agrees. With
``slop`` above 0 every other term may stand up to that many words off its place
beside the rarest one, inside the same document (proximity matches); 0 gives
exact phrases.

The benchmark is a stated query set. It is sent in chunks of at most
``CHUNK_TERMS`` window terms; a larger benchmark is more chunks, one pass over
the index each, and the matches of all chunks are joined per document.

Defined results: null and wordless texts have no words, windows or hits; an
item shorter than a window is one window; repeated rows are documents of
their own; items without an id hit words, but are not counted or listed.
Only the named columns are read, so extra columns do not matter.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arrears.llm.store import Scratch, free_name
from arrears.llm.text import ALNUM, buffers, slices, words

WINDOW = 10
SLOP = 1
CHUNK_TERMS = 4_000_000      # 8 bytes each: at most 32 MB are sent to the executors at once

INDEX_SCHEMA = "block string, ids array<bigint>, firsts binary, terms binary, counts binary, positions binary"
MATCH_SCHEMA = "block string, ord int, item_id bigint, start bigint, length int, exact boolean"


def _index_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            h, first = words(*buffers(part.column("text")), ALNUM)
            order = np.argsort(h, kind="stable")
            terms, counts = np.unique(h, return_counts=True)
            yield pa.RecordBatch.from_arrays([
                pa.array([uuid.uuid4().hex]),
                pa.array([part.column("id").to_pylist()], pa.list_(pa.int64())),
                pa.array([first.astype("<i8").tobytes()], pa.binary()),
                pa.array([terms.astype("<u8").tobytes()], pa.binary()),
                pa.array([counts.astype("<u4").tobytes()], pa.binary()),
                pa.array([order.astype("<u4").tobytes()], pa.binary()),
            ], names=["block", "ids", "firsts", "terms", "counts", "positions"])


def build_index(scratch: Scratch, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return scratch.write(rows.mapInArrow(_index_batches, INDEX_SCHEMA), "index", large_rows=True)


def benchmark_windows(items: list[tuple], window: int = WINDOW) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """(vocabulary, {length: (item ids as objects, term numbers per window)}) of (item_id, text) rows."""
    texts = pa.array([t for _, t in items], pa.string())
    h, first = words(*buffers(texts), ALNUM)
    vocabulary, number = np.unique(h, return_inverse=True)
    found: dict[int, list] = {}
    for (item, _), a, b in zip(items, first[:-1].tolist(), first[1:].tolist()):
        size = min(window, b - a)
        for s in range(a, b - size + 1 if size else a):
            found.setdefault(size, []).append((item, number[s:s + size]))
    return vocabulary, {n: (np.array([x[0] for x in w], dtype=object), np.array([x[1] for x in w], dtype=np.int64))
                        for n, w in found.items()}


def _views(batch: pa.RecordBatch, *columns: tuple[str, str]) -> Iterator[list[np.ndarray]]:
    """Each row's binary columns as arrays on the batch's own memory."""
    for i in range(batch.num_rows):
        yield [np.frombuffer(batch.column(c)[i].as_buffer(), d) for c, d in columns]


def _place(vocabulary: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(terms, vocabulary)
    safe = np.minimum(at, max(len(terms) - 1, 0))
    return safe, (terms[safe] == vocabulary) if len(terms) else np.zeros(len(vocabulary), bool)


def _frequency_task(vocabulary):
    def run(batches):
        total = np.zeros(len(vocabulary.value), dtype=np.int64)
        for batch in batches:
            for terms, counts in _views(batch, ("terms", "<u8"), ("counts", "<u4")):
                at, present = _place(vocabulary.value, terms)
                total[present] += counts[at[present]]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["term", "n"])
    return run


def _near(postings: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Whether a posting lies in [lo, hi], both included."""
    at = np.searchsorted(postings, lo)
    ok = at < len(postings)
    ok[ok] = postings[at[ok]] <= hi[ok]
    return ok


def _match_task(sent, slop: int):
    def run(batches):
        vocabulary, windows, frequency = sent.value
        for batch in batches:
            every = _views(batch, ("firsts", "<i8"), ("terms", "<u8"), ("counts", "<u4"), ("positions", "<u4"))
            for block, (firsts, terms, counts, positions) in zip(batch.column("block").to_pylist(), every):
                ends = np.cumsum(counts, dtype=np.int64)
                at, present = _place(vocabulary, terms)
                got: list[tuple] = []
                for size, (items, term_rows) in windows.items():
                    for w in np.flatnonzero(present[term_rows].all(axis=1)).tolist():
                        numbers = term_rows[w]
                        starts = None
                        for off in np.argsort(frequency[numbers], kind="stable").tolist():
                            k = at[numbers[off]]
                            postings = positions[ends[k] - counts[k]:ends[k]].astype(np.int64)
                            if starts is None:           # the rarest term's places say which documents are asked
                                ord_ = np.searchsorted(firsts, postings, side="right") - 1
                                starts, first, last = postings - off, firsts[ord_], firsts[ord_ + 1] - 1
                                exact = (starts >= first) & (starts + size - 1 <= last)
                                ok = exact if not slop else np.ones(len(starts), bool)
                            else:
                                exact = exact & _near(postings, starts + off, starts + off)
                                ok = exact if not slop else _near(postings, np.maximum(starts + (off - slop), first), np.minimum(starts + (off + slop), last))
                            starts, ord_, first, last, exact = starts[ok], ord_[ok], first[ok], last[ok], exact[ok]
                            if not len(starts):
                                break
                        got += [(o, items[w], max(p, 0), size, e) for o, p, e in zip(ord_.tolist(), (starts - first).tolist(), exact.tolist())]
                if got:
                    yield pa.RecordBatch.from_arrays([
                        pa.array([block] * len(got)), pa.array([g[0] for g in got], pa.int32()),
                        pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int64()),
                        pa.array([g[3] for g in got], pa.int32()), pa.array([g[4] for g in got], pa.bool_())],
                        names=["block", "ord", "item_id", "start", "length", "exact"])
    return run


def _chunks(benchmark: DataFrame, id_col: str, text_col: str, window: int, limit: int) -> Iterator[list[tuple]]:
    """Item rows in runs whose windows hold at most ``limit`` terms (one item at least)."""
    rows = benchmark.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).toLocalIterator()
    chunk, held = [], 0
    for item, text in rows:
        size = window * (len(text or "") // 2 + 1)      # a word and its gap take two characters at least
        if chunk and held + size > limit:
            yield chunk
            chunk, held = [], 0
        chunk.append((item, text))
        held += size
    if chunk:
        yield chunk


def match(scratch: Scratch, index: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = 0,
          id_col: str = "item_id", text_col: str = "text", chunk_terms: int = CHUNK_TERMS) -> DataFrame:
    """Every occurrence of a benchmark window: (block, ord, item_id, start,
    length, exact), one per place of the window's rarest term."""
    spark = index.sparkSession
    out = spark.createDataFrame([], MATCH_SCHEMA)
    for i, chunk in enumerate(_chunks(benchmark, id_col, text_col, window, chunk_terms)):
        vocabulary, windows = benchmark_windows(chunk, window)
        known = spark.sparkContext.broadcast(vocabulary)
        counted = (index.select("terms", "counts").mapInArrow(_frequency_task(known), "term bigint, n bigint")
                   .groupBy("term").agg(F.sum("n").alias("n")).collect())     # one row per term of the chunk at most
        frequency = np.zeros(len(vocabulary), dtype=np.int64)
        for r in counted:
            frequency[r["term"]] = r["n"]
        sent = spark.sparkContext.broadcast((vocabulary, windows, frequency))
        found = scratch.write(index.select("block", "firsts", "terms", "counts", "positions")
                              .mapInArrow(_match_task(sent, slop), MATCH_SCHEMA), f"matches{slop}_{i}")
        out = found if i == 0 else out.union(found)
        known.unpersist()
        sent.unpersist()
    return out


def documents_of(s: Scratch, index: DataFrame) -> DataFrame:
    """(block, ord, doc_id, n_words) of every indexed document, written, so
    that the index itself can go."""
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                n = len(row["ids"])
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["block"]] * n, pa.string()), pa.array(np.arange(n), pa.int32()), pa.array(row["ids"], pa.int64()),
                    pa.array(np.diff(np.frombuffer(row["firsts"], "<i8")), pa.int64())], names=["block", "ord", "doc_id", "n_words"])
    return s.write(index.select("block", "ids", "firsts").mapInArrow(run, "block string, ord int, doc_id bigint, n_words bigint"), "documents")


def _per_document(matches: DataFrame) -> DataFrame:
    """Words inside any match, and the distinct items, per matched document."""
    w = Window.partitionBy("block", "ord").orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("length")
    fresh = matches.withColumn("until", F.coalesce(F.max(end).over(w), F.lit(0)))
    fresh = fresh.withColumn("new", F.greatest(F.lit(0), end - F.greatest("start", "until")))
    return fresh.groupBy("block", "ord").agg(
        F.sum("new").alias("n_hit"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                  chunk_terms: int = CHUNK_TERMS) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, items (sorted ids as
    strings), contaminated."""
    s = Scratch(spark, "decontam")
    index = build_index(s, docs)
    found = _per_document(match(s, index, benchmark, window, chunk_terms=chunk_terms))
    rows = documents_of(s, index)
    s.drop("index")
    out = (rows.join(found, ["block", "ord"], "left")
           .select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                   F.coalesce("items", F.array().cast("array<string>")).alias("items")))
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest of ``decontaminate`` per document."""
    return decontaminate(spark, docs, benchmark).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def proximity(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, slop: int = SLOP, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, items (with exact windows) and
    near_items (with proximity matches only), sorted ids as strings."""
    s = Scratch(spark, "decontam-near")
    index = build_index(s, docs)
    found = match(s, index, benchmark, window, slop).groupBy("block", "ord", "item_id").agg(F.max("exact").alias("exact"))
    rows = documents_of(s, index)
    s.drop("index")
    some = lambda exact: F.array_sort(F.collect_set(F.when(F.col("exact") == exact, F.col("item_id").cast("string"))))
    per = found.groupBy("block", "ord").agg(some(True).alias("items"), some(False).alias("near_items"))
    none = F.array().cast("array<string>")
    return rows.join(per, ["block", "ord"], "left").select("doc_id", "n_words", F.coalesce("items", none).alias("items"), F.coalesce("near_items", none).alias("near_items"))


def clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no benchmark window. A row
    is known by the 64-bit hash of its id and text, so rows that share an id
    keep their own verdicts, and nulls are values like any other."""
    s = Scratch(spark, "decontam-clean")
    key = F.xxhash64("doc_id", "text")
    index = build_index(s, docs.select(key.alias("doc_id"), "text"))
    found = match(s, index, benchmark, window).select("block", "ord").distinct()
    rows = documents_of(s, index)
    s.drop("index")
    name = free_name(docs, "_bad")
    bad = rows.join(found, ["block", "ord"], "left_semi").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(bad, key == bad[name], "left_anti")
