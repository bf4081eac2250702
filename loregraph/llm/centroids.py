"""k-means over integer vectors with an annulus search for the nearest centroid.

By the triangle inequality a centroid within a distance of u from a vector has a norm within u of
the vector's norm. Centroids are sorted by norm; each vector takes its distance
to a centroid that was near it at the start as its upper bound, finds the centroids of
its annulus by two binary searches, and is compared exactly with those alone. All distances
and sums are integers, so results hang neither on partitions nor on the order of rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loregraph.llm._scratch import stage

DIMENSIONS = 64
K = 8
ROUNDS = 10
SCALE = 1024
SEED = 3
#: Integers of vectors stay below this in size: 64 squares of differences then fit in a long.
LIMIT = 1 << 27
#: Vectors of a block within a task.
BLOCK = 4096


class Annulus:
    """Centroids (k, d), searched by their norms."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        norms = np.sqrt((centroids.astype(np.float64) ** 2).sum(axis=1))
        self.order = np.argsort(norms, kind="stable")
        self.norms = norms[self.order]

    def distances(self, x: np.ndarray, j: int) -> np.ndarray:
        d = x - self.centroids[j]
        return np.einsum("ij,ij->i", d, d)

    def search(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(nearest centroid, squared distance, candidates compared) of each row; of equal distances the smaller number.

        ``home`` names a centroid of each row, whose distance is the bound. The annulus is
        a little wider than the bound, so that rounding never shuts out a centroid on its rim.
        """
        best = home.copy()
        least = np.empty(len(x), dtype=np.int64)
        for j in np.unique(home).tolist():
            at = home == j
            least[at] = self.distances(x[at], j)
        norm = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
        bound = np.sqrt(least.astype(np.float64))
        slack = 1e-9 * (norm + bound) + 1e-6
        lo = np.searchsorted(self.norms, norm - bound - slack, side="left")
        hi = np.searchsorted(self.norms, norm + bound + slack, side="right")
        for rank in range(int(lo.min(initial=0)), int(hi.max(initial=0))):
            j = int(self.order[rank])
            at = np.flatnonzero((lo <= rank) & (rank < hi) & (home != j))
            d = self.distances(x[at], j)
            nearer = (d < least[at]) | ((d == least[at]) & (j < best[at]))
            least[at[nearer]], best[at[nearer]] = d[nearer], j
        return best, least, int((hi - lo).sum())


def _blocks(batch: pa.RecordBatch, dimensions: int) -> Iterator[tuple[int, np.ndarray]]:
    col = batch.column("v")
    x = np.asarray(col.flatten(), dtype=np.int64).reshape(len(col), dimensions)
    for lo in range(0, len(x), BLOCK):
        yield lo, x[lo : lo + BLOCK]


def _with_home(annulus: Annulus, dimensions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home = [annulus.search(x, np.zeros(len(x), dtype=np.int64))[0] for _, x in _blocks(batch, dimensions)]
            home = np.concatenate(home) if home else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(home.astype(np.int32))], names=["vec_id", "v", "home"])

    return run


def _sums(annulus: Annulus, dimensions: int):
    """For each cluster that a task meets: a row for each component with its sum; component -1 holds the count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(annulus.centroids)
        total, n = np.zeros((k, dimensions), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for batch in batches:
            home = np.asarray(batch.column("home"), dtype=np.int64)
            for lo, x in _blocks(batch, dimensions):
                own = annulus.search(x, home[lo : lo + BLOCK])[0]
                order = np.argsort(own, kind="stable")
                found, first = np.unique(own[order], return_index=True)
                total[found] += np.add.reduceat(x[order], first, axis=0)
                n += np.bincount(own, minlength=k)
        rows = np.flatnonzero(n)
        cols = [np.repeat(rows, dimensions + 1), np.tile(np.arange(-1, dimensions), len(rows)), np.column_stack([n[rows], total[rows]]).reshape(-1)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["cluster", "component", "s"])

    return run


def _assign(annulus: Annulus, dimensions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home = np.asarray(batch.column("home"), dtype=np.int64)
            found = [annulus.search(x, home[lo : lo + BLOCK])[:2] for lo, x in _blocks(batch, dimensions)]
            own, least = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(own.astype(np.int32)), pa.array(least)], names=["vec_id", "cluster", "distance"])

    return run


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v) of the vectors with ``dimensions`` finite components: floor(scale * x) of each component.

    Vectors of another length, null ones, and those with a component that is null, not
    finite or of LIMIT / ``scale`` or more in size, have no row.
    """
    x = F.transform(F.col(vector_col), lambda e: e.cast("double") * scale)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).where((F.size("x") == dimensions) & F.forall("x", lambda e: F.coalesce(F.abs(e) < LIMIT, F.lit(False))))
    return rows.select("vec_id", F.transform("x", lambda e: F.floor(e).cast("long")).alias("v"))


def first_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the least sha256 of ``seed:vec_id``; of equal ids the least vectors. A null id is the empty text."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r["v"] for r in rows.select(h.alias("h"), "v").orderBy("h", "v").limit(k).collect()], dtype=np.int64)


def fit(rows: DataFrame, centroids: np.ndarray, rounds: int) -> np.ndarray:
    """Lloyd's rounds over ``rows`` (vec_id, v, home); new components are floors of exact means, and empty clusters stay.

    k times d sums reach the driver in a round.
    """
    for _ in range(rounds):
        sums = rows.mapInArrow(_sums(Annulus(centroids), centroids.shape[1]), "cluster long, component long, s long").groupBy("cluster", "component").agg(F.sum("s").alias("s")).collect()
        n = {r["cluster"]: r["s"] for r in sums if r["component"] < 0}
        moved = centroids.copy()
        for r in sums:
            if r["component"] >= 0:
                moved[r["cluster"], r["component"]] = r["s"] // n[r["cluster"]]
        if (moved == centroids).all():  # the remaining rounds would change nothing
            break
        centroids = moved
    return centroids


def cluster_report(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED
) -> DataFrame:
    """Per kept vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Vectors are kept as :func:`integer_vectors` says; with fewer than ``k`` of them there are as
    many centroids, with none the result is empty. Rows that repeat an id are a vector
    each; other columns are not read. An inertia beyond a long is null.
    """
    out = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    rows = integer_vectors(vectors, id_col, vector_col, dimensions, scale)
    start = first_centroids(rows, k, seed)
    if not len(start):
        return vectors.sparkSession.createDataFrame([], out)
    rows = stage(rows.mapInArrow(_with_home(Annulus(start), dimensions), "vec_id long, v array<long>, home int"), "centroids-vectors")
    centroids = fit(rows, start, rounds)
    placed = stage(rows.mapInArrow(_assign(Annulus(centroids), dimensions), "vec_id long, cluster int, distance long"), "centroids-placed")
    own = {r["cluster"]: int(r["s"]) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}

    def held(value: int) -> int | None:
        return value if value < 1 << 63 else None

    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    of_cluster = vectors.sparkSession.createDataFrame([(j, held(own.get(j, 0)), held(sum(own.values())), digest[j]) for j in range(len(centroids))], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(of_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
