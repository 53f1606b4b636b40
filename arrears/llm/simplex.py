"""Centroid clustering whose candidates come from an n-simplex projection.

Distances of a vector to a few pivots are worked out once and turned into the
apex of a simplex over the pivots (Connor et al.): the pivots' own distances
give a base in as many dimensions as pivots less one, a vector's distances give
its foot in that base and its height above it. For two apexes the Euclidean
distance with the heights' difference is a lower bound of the vectors' distance,
and with the heights' sum an upper bound. In each round a centroid is compared
exactly, in integers, only if its lower bound is not above the least upper
bound; a margin far above the rounding of the bounds keeps them safe.

Vectors are integers: floor(scale * component). Sums and distances are 64-bit
integers, so the result does not depend on how rows are dealt.

Kept are vectors with exactly the asked number of components, none null, NaN or
infinite. Defined results: nothing kept gives an empty table; fewer kept vectors
than clusters make each a start; equal starts are told apart by number only;
repeated rows and null ids are vectors of their own (a null id starts last); a
scaled component beyond +-2**26 is an error, as squared distances may then pass
64 bits. Other columns are not read, so their names cannot clash.

What reaches the driver is bounded by clusters x components: the starts and each
round's sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arrears.llm.store import Scratch

SIZE = 64
SCALE = 256
CLUSTERS = 40
ROUNDS = 5
SEED = 2
PIVOTS = 16
LIMIT = 1 << 26
MARGIN = 1e-7


class Simplex:
    """Base over pivots (rows of integers); ``apex`` gives foot and height."""

    def __init__(self, points: np.ndarray, most: int = PIVOTS):
        pts = points.astype(float)
        chosen = [0]
        self._base(pts[chosen])
        while len(chosen) < min(most, len(pts)):
            height = self.apex(points)[:, -1]          # the point furthest from the base so far
            far = int(height.argmax())
            if height[far] <= 1e-3 * (1 + np.sqrt(((pts - pts[0]) ** 2).sum(1).max())):
                break
            chosen.append(far)
            self._base(pts[chosen])

    def _base(self, pivots: np.ndarray) -> None:
        self.pivots = pivots
        side = pivots[1:] - pivots[0]
        self.lower = np.linalg.cholesky(side @ side.T) if len(side) else np.zeros((0, 0))
        self.squared = (side ** 2).sum(1)

    def apex(self, v: np.ndarray) -> np.ndarray:
        """Foot coordinates and, last, the height, from the distances to the pivots."""
        v = v.astype(float)
        d = np.stack([((v - p) ** 2).sum(1) for p in self.pivots], axis=1)
        foot = np.linalg.solve(self.lower, ((d[:, :1] + self.squared - d[:, 1:]) / 2).T).T if len(self.squared) else np.zeros((len(v), 0))
        return np.column_stack([foot, np.sqrt(np.maximum(d[:, 0] - (foot ** 2).sum(1), 0))])


def bounds(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared lower and upper bounds between apexes ``a`` (rows) and ``b`` (columns)."""
    foot = ((a[:, None, :-1] - b[None, :, :-1]) ** 2).sum(2)
    return foot + (a[:, None, -1] - b[None, :, -1]) ** 2, foot + (a[:, None, -1] + b[None, :, -1]) ** 2


def nearest(v: np.ndarray, apex: np.ndarray, centroids: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per vector its nearest centroid (least number on ties), the squared
    distance, and how many centroids were compared exactly."""
    low, high = bounds(apex, heads)
    slack = MARGIN * (1 + (apex ** 2).sum(1)[:, None] + (heads ** 2).sum(1)[None, :])
    ask = low - slack <= (high + slack).min(1)[:, None]
    best, at = np.full(len(v), np.iinfo(np.int64).max), np.zeros(len(v), np.int32)
    for c in range(len(centroids)):
        rows = np.flatnonzero(ask[:, c])
        d = ((v[rows] - centroids[c]) ** 2).sum(1)
        less = d < best[rows]
        best[rows[less]], at[rows[less]] = d[less], c
    return at, best, ask.sum(1).astype(np.int32)


def _matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, width)


def _lists(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32)), pa.array(m.ravel()))


def kept(vectors: DataFrame, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): integer components of the vectors that are kept."""
    x = F.col("embedding").cast("array<double>")
    ok = (F.size(x) == size) & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == F.lit(float("inf"))))
    whole = F.transform("x", lambda e: F.floor(e * F.lit(float(scale))))
    return vectors.where(F.coalesce(ok, F.lit(False))).select("vec_id", x.alias("x")).where(
        F.when(F.exists("x", lambda e: F.abs(e * F.lit(float(scale))) > F.lit(float(LIMIT))),
               F.raise_error(F.lit(f"a scaled component is beyond +-{LIMIT}")).cast("boolean")).otherwise(F.lit(True))).select("vec_id", whole.alias("v"))


def assign(spark: SparkSession, table: DataFrame, simplex: Simplex, centroids: np.ndarray) -> DataFrame:
    """``table`` (vec_id, v, apex) -> vec_id, v, cluster, distance, n_compared."""
    width, points = centroids.shape[1], len(simplex.pivots)
    sent = spark.sparkContext.broadcast((centroids, simplex.apex(centroids)))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cents, heads = sent.value
        for b in batches:
            at, best, asked = nearest(_matrix(b.column("v"), width, np.int64), _matrix(b.column("apex"), points, float), cents, heads)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(at), pa.array(best), pa.array(asked)],
                                             names=["vec_id", "v", "cluster", "distance", "n_compared"])

    return table.mapInArrow(go, f"vec_id {table.schema['vec_id'].dataType.simpleString()}, v array<bigint>, cluster int, distance bigint, n_compared int")


def _sums(spark: SparkSession, table: DataFrame, simplex: Simplex, centroids: np.ndarray) -> list[tuple[int, int, list[int]]]:
    """(cluster, vectors, componentwise sums) of one assignment; a task sends a row per cluster."""
    width, points = centroids.shape[1], len(simplex.pivots)
    sent = spark.sparkContext.broadcast((centroids, simplex.apex(centroids)))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cents, heads = sent.value
        n, total = np.zeros(len(cents), np.int64), np.zeros(cents.shape, np.int64)
        for b in batches:
            v = _matrix(b.column("v"), width, np.int64)
            at, _, _ = nearest(v, _matrix(b.column("apex"), points, float), cents, heads)
            order = np.argsort(at, kind="stable")
            found, first = np.unique(at[order], return_index=True)
            if len(found):
                n[found] += np.diff(np.append(first, len(at)))
                total[found] += np.add.reduceat(v[order], first, axis=0)
        used = np.flatnonzero(n)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(n[used]), _lists(total[used])], names=["cluster", "n", "s"])

    part = table.select("v", "apex").mapInArrow(go, "cluster int, n bigint, s array<bigint>")
    got = part.groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(width))).collect()
    return [(r["cluster"], r["n"], [r[f"s{i}"] for i in range(width)]) for r in got]


def cluster(spark: SparkSession, vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, seed: int = SEED, pivots: int = PIVOTS) -> DataFrame:
    """``vectors`` (vec_id, embedding) -> per kept vector: vec_id, v, cluster,
    distance, n_compared, cluster_inertia, inertia, centroid_sha256."""
    s = Scratch(spark, "simplex")
    id_type = vectors.schema["vec_id"].dataType.simpleString()
    whole = s.write(kept(vectors, size, scale), "whole")
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    starts = whole.select(mark.alias("mark"), "v").orderBy(F.col("mark").asc_nulls_last(), "v").limit(clusters).collect()
    if not starts:
        return spark.createDataFrame([], f"vec_id {id_type}, v array<bigint>, cluster int, distance bigint, n_compared int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    centroids = np.array([r["v"] for r in starts], np.int64)
    simplex = Simplex(centroids, pivots)
    width = size

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), _lists(simplex.apex(_matrix(b.column("v"), width, np.int64)))], names=["vec_id", "v", "apex"])

    table = s.write(whole.mapInArrow(project, f"vec_id {id_type}, v array<bigint>, apex array<double>"), "table")
    s.drop("whole")
    for _ in range(rounds):
        for c, n, total in _sums(spark, table, simplex, centroids):
            centroids[c] = [t // n for t in total]
    final = s.write(assign(spark, table, simplex, centroids), "final")
    s.drop("table")
    per = {r["cluster"]: r["d"] for r in final.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    told = [(c, d, sum(per.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, d in sorted(per.items())]
    facts = spark.createDataFrame(told, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    # one row per cluster
    return final.join(F.broadcast(facts), "cluster").select("vec_id", "v", "cluster", "distance", "n_compared", "cluster_inertia", "inertia", "centroid_sha256")
