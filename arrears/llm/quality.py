"""Quality classifier: a linear SVM on naive-Bayes-scaled n-gram indicators.

Indicators of a text (present or not): all byte pairs, byte triples hashed to
2**16 places, and pairs and hashed triples of word shapes (kind of the first
and last byte, whether the word repeats the one before). ``log_ratios`` counts
them by class over *all* labelled training rows and takes the log ratio of
the smoothed shares. Each text's indicators are scaled by the ratios and
brought to length 1; dual coordinate descent then fits the hinge loss. A
logistic curve fitted on a part left out of a first fit turns margins into
probabilities.

The fit reads a documented sample: the ``SAMPLE`` labelled training rows with
the least hash of their id. Everything else covers all rows. Labels are used
of rows whose crc32(doc_id as text) mod 4 is not 2; only the text is an input.

Defined results: a null text is an empty one; it has no indicators and gets
the curve's value at the bias. Without labels of both classes the score is the
share of label 1 (0.5 without labels). Labels without a quality, and rows with
a null id, are no training rows; repeated labels of one id count as often.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arrears.llm.langid import fold, held_out
from arrears.llm.store import prepare
from arrears.llm.text import SPACED, buffers, mix, slices, spans, word_hashes

PAIRS, TRIPLES, SHAPES, SHAPES3 = 1 << 16, 1 << 16, 1 << 12, 1 << 15
SIZE = PAIRS + TRIPLES + SHAPES + SHAPES3
SAMPLE = 6000
SMOOTH = 1.0
COST = 1.0
EPOCHS = 25
SEED = 29
THRESHOLD = 0.7

KIND = np.full(256, 4, np.uint8)          # of a byte: lower, upper, digit, not ASCII, other
KIND[97:123], KIND[65:91], KIND[48:58], KIND[128:] = 0, 1, 2, 3


def _hashed(code: np.ndarray, size: int) -> np.ndarray:
    return (mix(code.astype(np.uint64)) % np.uint64(size)).astype(np.int64)


def indicators(raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted numbers of the indicators present, per row."""
    wide = raw.astype(np.int64)
    pair = (wide[:-1] << 8) | wide[1:] if len(raw) > 1 else np.zeros(0, np.int64)
    triple = _hashed((pair[:-1] << 8) | wide[2:], TRIPLES) + PAIRS if len(raw) > 2 else np.zeros(0, np.int64)
    starts, ends = spans(raw, offsets, SPACED)
    first = np.searchsorted(starts, offsets)
    h = word_hashes(raw, starts, ends)
    shape = np.zeros(len(h), np.int64)
    if len(h):
        again = np.zeros(len(h), bool)
        again[1:] = h[1:] == h[:-1]
        again[first[:-1][first[:-1] < len(h)]] = False
        shape = KIND[raw[starts]].astype(np.int64) * 5 + KIND[raw[ends - 1]] + 32 * again
    shape2 = shape[:-1] * 64 + shape[1:]
    shape3 = _hashed(shape2[:-1] * 64 + shape[2:], SHAPES3) + PAIRS + TRIPLES + SHAPES
    shape2 = shape2 + PAIRS + TRIPLES
    seen, out = np.zeros(SIZE, bool), []
    for i in range(len(offsets) - 1):
        a, b, c, d = int(offsets[i]), int(offsets[i + 1]), int(first[i]), int(first[i + 1])
        for codes, lo, hi in ((pair, a, b - 1), (triple, a, b - 2), (shape2, c, d - 1), (shape3, c, d - 2)):
            seen[codes[lo:max(lo, hi)]] = True
        on = np.flatnonzero(seen)
        seen[on] = False
        out.append(on)
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((2, SIZE), np.int64)
    rows = np.zeros(2, np.int64)
    for batch in batches:
        for part in slices(batch):
            for on, y in zip(indicators(*buffers(part.column("text"))), part.column("quality").to_pylist()):
                total[y, on] += 1
                rows[y] += 1
    some = np.flatnonzero(total.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1), pa.int64()), pa.array(np.append(total[0, some], rows[0]), pa.int64()),
                                      pa.array(np.append(total[1, some], rows[1]), pa.int64())], names=["f", "bad", "good"])


def log_ratios(labelled: DataFrame) -> tuple[np.ndarray, int, int]:
    """(ratio by indicator, rows of label 0, rows of label 1) over all labelled
    rows (text, quality). At most SIZE + 1 rows of sums reach the driver."""
    rows = labelled.mapInArrow(_count, "f bigint, bad bigint, good bigint").groupBy("f").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).collect()
    counts, n = np.zeros((2, SIZE)), [0, 0]
    for f, bad, good in rows:
        if f < 0:
            n = [bad, good]
        else:
            counts[:, f] = bad, good
    counts += SMOOTH
    share = counts / counts.sum(axis=1, keepdims=True)
    return np.log(share[1] / share[0]), n[0], n[1]


def descend(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Dual coordinate descent for the hinge loss with a bias as last weight."""
    w, a = np.zeros(SIZE + 1), np.zeros(len(y))
    for _ in range(EPOCHS):
        for i in rng.permutation(len(y)).tolist():
            f, v = rows[i], values[i]
            square = float(v @ v) + 1.0
            new = min(max(a[i] - (y[i] * (w[f] @ v + w[-1]) - 1) / square, 0.0), cost[i])
            if new != a[i]:
                step = (new - a[i]) * y[i]
                w[f] += step * v
                w[-1] += step
                a[i] = new
    return w


def _curve(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) of 1 / (1 + exp(-(a * margin + b))), by Newton steps on smoothed targets."""
    good, bad = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    x, p = np.stack([margin, np.ones_like(margin)], axis=1), np.array([1.0, 0.0])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ p, -30, 30)))
        g = x.T @ (q - target)
        step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + 1e-6 * np.eye(2), g)
        p = p - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(p[0]), float(p[1])


def _scaled(on: list[np.ndarray], ratio: np.ndarray) -> list[np.ndarray]:
    out = []
    for f in on:
        v = ratio[f]
        norm = float(np.sqrt(v @ v))
        out.append(v / norm if norm else v)
    return out


def _fit_task(sent):
    def run(table: pa.Table) -> pa.Table:
        ratio = sent.value
        rows = sorted(zip(table.column("key").to_pylist(), table.column("quality").to_pylist(), table.column("on").to_pylist()))
        on = [np.frombuffer(r[2], "<i4").astype(np.int64) for r in rows]
        y = np.array([1.0 if r[1] else -1.0 for r in rows])
        v, rng = _scaled(on, ratio), np.random.default_rng(SEED)
        cost = np.where(y > 0, COST, COST * max(1.0, (y > 0).sum() / max(1, (y < 0).sum())))
        left = np.arange(len(y)) % 4 == 0
        part = np.flatnonzero(~left)
        first = descend([on[i] for i in part], [v[i] for i in part], y[part], cost[part], rng)
        out = np.flatnonzero(left)
        margin = np.array([first[on[i]] @ v[i] + first[-1] for i in out])
        a, b = _curve(margin, y[out]) if len({*y[out].tolist()}) == 2 else (1.0, 0.0)
        model = (descend(on, v, y, cost, rng), a, b)
        return pa.table({"model": pa.array([pickle.dumps(model)], pa.binary())})
    return run


def _sample_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            on = indicators(*buffers(part.column("text")))
            yield pa.RecordBatch.from_arrays([part.column("key"), part.column("quality"), pa.array([x.astype("<i4").tobytes() for x in on], pa.binary())],
                                             names=["key", "quality", "on"])


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple:
    """("share", p) or ("svm", ratio, weights, a, b)."""
    prepare(spark)
    marks = labels.where((fold() != 2) & F.col("quality").isin(0, 1)).select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("quality"))
    texts = docs.where(fold() != 2).select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    # labels grow with the documents: the join is the same sort-merge join at every size
    labelled = texts.join(marks.hint("merge"), texts["doc_id"] == marks["_id"]).select("text", "quality")
    ratio, bad, good = log_ratios(labelled)
    if not bad or not good:
        return ("share", good / (bad + good) if bad + good else 0.5)
    sent = spark.sparkContext.broadcast(ratio)
    # the sample is stratified: half of it of the rarer label where there are as many; at most ``sample`` rows of 12 bytes
    half = [marks.where(F.col("quality") == q).distinct().orderBy(F.xxhash64("_id"), "_id").limit(sample // 2) for q in (0, 1)]
    chosen = half[0].union(half[1])
    picked = texts.join(F.broadcast(chosen), texts["doc_id"] == chosen["_id"]).select(F.xxhash64("doc_id", "text").alias("key"), "text", "quality")
    rows = picked.mapInArrow(_sample_rows, "key bigint, quality int, on binary").dropDuplicates(["key", "quality"])
    weights, a, b = pickle.loads(rows.groupBy().applyInArrow(_fit_task(sent), "model binary").first()["model"])
    sent.unpersist()
    return ("svm", ratio, weights, a, b)


def score(spark: SparkSession, docs: DataFrame, model: tuple, out: str = "quality_score") -> DataFrame:
    """``docs`` with a column ``out``."""
    if model[0] == "share":
        return docs.withColumn(out, F.lit(float(model[1])))
    prepare(spark)
    sent = spark.sparkContext.broadcast(model[1:])

    @F.arrow_udf("double")
    def judged(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ratio, weights, a, b = sent.value
        flat, square, bias = weights[:-1] * ratio, ratio * ratio, weights[-1]
        for column in texts:
            margin = []
            for part in slices(pa.RecordBatch.from_arrays([column], names=["text"])):
                for on in indicators(*buffers(part.column("text"))):
                    norm = np.sqrt(square[on].sum())
                    margin.append(bias + (flat[on].sum() / norm if norm else 0.0))
            yield pa.array(1 / (1 + np.exp(-np.clip(a * np.array(margin, dtype=float) + b, -500, 500))), pa.float64())

    return docs.withColumn(out, judged(F.col("text").cast("string")))


def quality(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = train(spark, docs, labels)
    out = score(spark, docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), F.col("quality_score").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
