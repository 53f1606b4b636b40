"""Language ID by a byte convolutional network, trained here in numpy.

A text is cut into windows of ``WINDOW`` bytes (A-Z lowered, the last one
padded with zeros). Filters of several widths slide over a window's bytes; a
filter's weights are a table by offset and byte value, so a convolution is a
sum of table rows. Max pooling keeps each filter's strongest place, a softmax
layer turns the pooled values into languages. All windows of a text are
scored; the text's logits are the means over its windows by bytes.

Training rows: the documents of the training folds with a language. Per
language the ``PER_CLASS`` rows with the least hash are taken, and of each at
most ``PER_TEXT`` windows spread over the whole text: documented bounds that
make the fit one small task. Prediction reads every byte of every text.

Defined results: ``und`` with score 0 for a null text, a text without any
letter, or where no language could be learned; with one learned language that
one, score 1; a null id is never a training row and not held out. Repeated
rows count once in training and are all scored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arrears.llm.store import free_name, prepare
from arrears.llm.text import LOWER, buffers, slices

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 12
PER_CLASS = 500
PER_TEXT = 6
MARGIN = 2                   # of PER_CLASS expected under it; fewer than PER_CLASS has a chance below 10**-50
MAX_CLASSES = 500
EPOCHS = 10
BATCH = 64
RATE = 0.01
SEED = 17
LETTER = r"\p{L}"
AT_ONCE = 2048               # windows scored at once: bounds memory


def fold(id_col: str = "doc_id"):
    """crc32 of the id as text, mod 4."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4))


def held_out(id_col: str = "doc_id"):
    return F.coalesce(fold(id_col) == 2, F.lit(False))


def plan(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first byte, bytes) of every window of every row."""
    size = np.diff(offsets)
    count = -(-size // WINDOW)
    row = np.repeat(np.arange(len(size)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return row, offsets[:-1][row] + nth * WINDOW, np.minimum(size[row] - nth * WINDOW, WINDOW)


def cut(raw: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The windows' bytes, lowered, with zeros after the end."""
    at = np.minimum(start[:, None] + np.arange(WINDOW), len(raw) - 1)
    return np.where(np.arange(WINDOW) < length[:, None], LOWER[raw[at]], 0).astype(np.uint8)


class ByteNet:
    """tables[width]: (width, 256, FILTERS); bias[width]: (FILTERS,); out: (features, classes)."""

    def __init__(self, classes: list[str], rng: np.random.Generator):
        self.classes = classes
        self.p = {f"t{w}": (rng.standard_normal((w, 256, FILTERS)) * 0.1).astype(np.float32) for w in WIDTHS}
        self.p |= {f"b{w}": np.zeros(FILTERS, np.float32) for w in WIDTHS}
        self.p["o"] = (rng.standard_normal((FILTERS * len(WIDTHS), len(classes))) * 0.1).astype(np.float32)
        self.p["c"] = np.zeros(len(classes), np.float32)

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        values, places = [], []
        for w in WIDTHS:
            t, span = self.p[f"t{w}"], WINDOW - w + 1
            z = t[0][x[:, :span]]
            for j in range(1, w):
                z = z + t[j][x[:, j:j + span]]
            at = z.argmax(axis=1)
            places.append(at)
            values.append(np.take_along_axis(z, at[:, None, :], 1)[:, 0] + self.p[f"b{w}"])
        return np.maximum(np.concatenate(values, axis=1), 0), places

    def step(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean cross entropy."""
        h, places = self.pooled(x)
        z = h @ self.p["o"] + self.p["c"]
        q = np.exp(z - z.max(axis=1, keepdims=True))
        q /= q.sum(axis=1, keepdims=True)
        q[np.arange(len(y)), y] -= 1
        q /= len(y)
        g = {"o": h.T @ q, "c": q.sum(axis=0)}
        back = (q @ self.p["o"].T) * (h > 0)
        rows = np.arange(len(y))[:, None]
        for i, w in enumerate(WIDTHS):
            d = back[:, i * FILTERS:(i + 1) * FILTERS]
            t = np.zeros_like(self.p[f"t{w}"])
            for j in range(w):
                np.add.at(t[j], (x[rows, places[i] + j], np.arange(FILTERS)[None, :]), d)
            g[f"t{w}"], g[f"b{w}"] = t, d.sum(axis=0)
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> "ByteNet":
        """Adam over shuffled batches."""
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(a) for k, a in self.p.items()}
        t = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(y))
            for lo in range(0, len(y), BATCH):
                t += 1
                part = order[lo:lo + BATCH]
                for k, g in self.step(x[part], y[part]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - (RATE * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v[k] / (1 - 0.999 ** t)) + 1e-8)).astype(np.float32)
        return self


class Scorer:
    """The trained net with its tables joined by byte pairs, which halves the look-ups."""

    def __init__(self, net: ByteNet):
        self.net, self.parts = net, []
        for w in WIDTHS:
            t, steps = net.p[f"t{w}"], []
            for j in range(0, w - 1, 2):
                steps.append((j, True, (t[j][:, None, :] + t[j + 1][None, :, :]).reshape(65536, FILTERS)))
            if w % 2:
                steps.append((w - 1, False, t[w - 1]))
            self.parts.append((w, steps))

    def logits(self, x: np.ndarray) -> np.ndarray:
        pair = (x[:, :-1].astype(np.int32) << 8) | x[:, 1:]
        h = []
        for w, steps in self.parts:
            z, span = None, WINDOW - w + 1
            for j, paired, table in steps:
                got = table.take((pair if paired else x)[:, j:j + span], axis=0)
                z = got if z is None else np.add(z, got, out=z)
            h.append(z.max(axis=1) + self.net.p[f"b{w}"])
        return np.maximum(np.concatenate(h, axis=1), 0) @ self.net.p["o"] + self.net.p["c"]

    def texts(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class number, probability) per row; -1 and 0 for a row without bytes."""
        n, k = len(offsets) - 1, len(self.net.classes)
        total, weight = np.zeros((n, k)), np.zeros(n)
        row, start, length = plan(offsets)
        for lo in range(0, len(row), AT_ONCE):
            part = slice(lo, lo + AT_ONCE)
            z = self.logits(cut(raw, start[part], length[part])) * length[part, None]
            np.add.at(total, row[part], z)
            np.add.at(weight, row[part], length[part])
        z = total / np.maximum(weight, 1)[:, None]
        q = np.exp(z - z.max(axis=1, keepdims=True))
        q /= q.sum(axis=1, keepdims=True)
        best = q.argmax(axis=1)
        return np.where(weight > 0, best, -1), np.where(weight > 0, q[np.arange(n), best], 0.0)


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """At most PER_TEXT windows of each sampled text, evenly over its length."""
    for batch in batches:
        for part in slices(batch):
            raw, offsets = buffers(part.column("text"))
            row, start, length = plan(offsets)
            keep = []
            for r in range(part.num_rows):
                a, b = np.searchsorted(row, [r, r + 1])
                keep += sorted(set(np.linspace(a, b - 1, min(PER_TEXT, b - a)).astype(int).tolist())) if b > a else []
            keep = np.array(keep, dtype=np.int64)
            take = row[keep].tolist()
            x = cut(raw, start[keep], length[keep])
            yield pa.RecordBatch.from_arrays([
                pa.array([part.column("key")[r].as_py() for r in take], pa.int64()), pa.array([part.column("lang")[r].as_py() for r in take], pa.string()),
                pa.array(np.arange(len(keep)) - np.searchsorted(row[keep], row[keep]), pa.int32()),
                pa.array([w.tobytes() for w in x], pa.binary())], names=["key", "lang", "nth", "window"])


def _train(table: pa.Table) -> pa.Table:
    rows = sorted(zip(table.column("key").to_pylist(), table.column("nth").to_pylist(), table.column("lang").to_pylist(), table.column("window").to_pylist()))
    classes = sorted({r[2] for r in rows})
    x = np.frombuffer(b"".join(r[3] for r in rows), np.uint8).reshape(-1, WINDOW)
    y = np.searchsorted(classes, [r[2] for r in rows])
    rng = np.random.default_rng(SEED)
    net = ByteNet(classes, rng).fit(x, y, rng)
    return pa.table({"model": pa.array([pickle.dumps(net)], pa.binary())})


def train(spark: SparkSession, docs: DataFrame, per_class: int = PER_CLASS) -> ByteNet | None:
    """The net fitted on the training folds of ``docs``; None if they have no language."""
    prepare(spark)
    rows = docs.where((fold() != 2) & F.col("lang").isNotNull() & F.col("text").rlike(LETTER)).select(
        F.xxhash64("doc_id", "text").alias("key"), "lang", "text")
    classes = rows.select("lang").distinct().limit(MAX_CLASSES + 1).count()
    if classes > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} languages to learn")
    if not classes:
        return None
    # only keys under a margin of each language's number come to its ranking: some
    # MARGIN * per_class of them, however many the language has
    keys = rows.select("lang", "key").distinct()
    number = keys.groupBy("lang").agg(F.count("*").alias("n"))
    share = F.shiftrightunsigned(F.col("key").bitwiseXOR(F.lit(-(1 << 63))), 11) / float(1 << 53)       # rises with the key
    near = keys.join(F.broadcast(number), "lang").where(share * F.col("n") <= MARGIN * per_class)           # at most MAX_CLASSES rows
    place = F.row_number().over(Window.partitionBy("lang").orderBy("key"))
    chosen = near.withColumn("at", place).where(F.col("at") <= per_class).select("lang", "key")
    # at most per_class * MAX_CLASSES rows of 8 bytes and a code
    picked = rows.join(F.broadcast(chosen), ["lang", "key"]).select("key", "lang", "text")
    windows = picked.mapInArrow(_spread, "key bigint, lang string, nth int, window binary").dropDuplicates(["key", "lang", "nth"])
    return pickle.loads(windows.groupBy().applyInArrow(_train, "model binary").first()["model"])


def predict(spark: SparkSession, docs: DataFrame, net: ByteNet | None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the language and its score under ``names``; other columns stay as they are."""
    has = F.coalesce(F.col("text").rlike(LETTER), F.lit(False))
    if net is None:
        return docs.withColumns({names[0]: F.lit("und"), names[1]: F.lit(0.0)})
    prepare(spark)
    sent = spark.sparkContext.broadcast(net)

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def judged(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(sent.value)
        names = np.array(scorer.net.classes + ["und"], dtype=object)
        for column in texts:
            best, score = [], []
            for part in slices(pa.RecordBatch.from_arrays([column], names=["text"])):
                b, p = scorer.texts(*buffers(part.column("text")))
                best.append(b)
                score.append(p)
            best = np.concatenate(best) if best else np.zeros(0, int)
            yield pa.StructArray.from_arrays([pa.array(names[best].tolist(), pa.string()), pa.array(np.concatenate(score) if score else [], pa.float64())],
                                             names=["lang_pred", "score"])

    both = free_name(docs, "_judged")
    out = docs.withColumn(both, judged(F.col("text").cast("string")))
    return out.withColumns({
        names[0]: F.when(has, F.col(f"{both}.lang_pred")).otherwise(F.lit("und")),
        names[1]: F.when(has, F.col(f"{both}.score")).otherwise(F.lit(0.0))}).drop(both)


def language_id(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    net = train(spark, docs)
    return predict(spark, docs.select("doc_id", "text"), net).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
