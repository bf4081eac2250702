"""A stored index of vectors: coarse cells, probes of the nearest ones, exact scores of what they hold.

Building it, every vector of unit length goes to the nearest of some centroids, and rows are stored in folders by cell, so
that a search reads the cells that it probes and no others. Each cell has a radius, the largest distance of
its vectors from its centroid. An exact search probes the nearest cells first; the last hit of each query then
bounds how near another vector has to be, and only cells that may reach into that ball are probed as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loregraph.operators.store import settled

#: Vectors that the centroids are fitted on, those of the least key hashes; all vectors are indexed.
SAMPLE = 50_000
MAX_CELLS = 4096
#: Vectors of a cell that one task scores at a time; a larger cell is dealt to several.
GROUP_ROWS = 100_000
#: Scores are compared to so many decimals; of equal ones the smaller key comes first.
DECIMALS = 9
#: How far rounding may move a distance.
SLACK = 1e-6
#: Probes are chosen so that a search of so many of the index's own vectors finds this share of their best hits.
RECALL, TUNING_QUERIES, TUNING_HITS = 0.95, 100, 10


def unit(vectors: DataFrame, key: str, vector: str, dimensions: int | None = None) -> DataFrame:
    """(key, v) of unit length. Vectors that are null, zero, not finite or of another length are similar to nothing and have no row."""
    rows = vectors.select(F.col(key).alias("key"), F.transform(F.col(vector), lambda x: x.cast("double")).alias("x"))
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, x: a + x * x))
    rows = rows.withColumn("norm", norm).where((F.col("norm") > 0) & (F.col("norm") < float("inf")))
    rows = rows.select("key", F.transform("x", lambda x: x / F.col("norm")).alias("v"))
    return rows.where(F.size("v") == dimensions) if dimensions else rows


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten(), dtype=np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _apart(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Distances of rows from centroids."""
    square = (x * x).sum(axis=1)[:, None] - 2 * x @ centroids.T + (centroids * centroids).sum(axis=1)
    return np.sqrt(np.maximum(square, 0))


def _to_cells(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("v"))
            far = _apart(x, centroids) if len(x) else np.zeros((0, len(centroids)))
            own = far.argmin(axis=1) if len(x) else np.zeros(0, np.int64)
            cols = [batch.column("key"), batch.column("v"), pa.array(far[np.arange(len(x)), own]), pa.array(own.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names=["key", "v", "far", "cell"])

    return run


def _probes(centroids: np.ndarray, radius: np.ndarray, cells: np.ndarray, n: int | None):
    """Cells that each query probes: the nearest ``n``; or all that may hold a vector within ``reach`` but those before ``n``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("v"))
            far = _apart(x, centroids) if len(x) else np.zeros((0, len(centroids)))
            nearest = np.argsort(far, axis=1, kind="stable")
            if "reach" not in batch.schema.names:
                found = [cells[row[:n]] for row in nearest]
            else:
                reach = np.asarray(batch.column("reach"), dtype=np.float64)
                found = [cells[[j for j in row[n:] if far[i, j] - radius[j] <= reach[i] + SLACK]] for i, row in enumerate(nearest)]
            yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("v"), pa.array([f.tolist() for f in found], pa.list_(pa.int32()))], names=["q", "v", "cells"])

    return run


def _scored(k: int | None):
    """For each query that probes a cell: its best ``k`` positive scores among the rows of this part of the cell."""

    def run(key: tuple, rows: pa.Table, queries: pa.Table) -> pa.Table:
        asked, own, scores = ([np.zeros(0, t)] for t in (np.int64, np.int64, np.float64))
        if rows.num_rows and queries.num_rows:
            x, q = _matrix(rows.column("v").combine_chunks()), _matrix(queries.column("v").combine_chunks())
            order = np.asarray(pc.rank(rows.column("key"), tiebreaker="first")).astype(np.int64)
            for i in range(len(q)):
                score = np.round(np.einsum("ij,j->i", x, q[i]), DECIMALS)
                at = np.flatnonzero(score > 0)
                if k is not None and len(at) > k:
                    at = at[score[at] >= -np.partition(-score[at], k - 1)[k - 1]]
                    at = at[np.lexsort((order[at], -score[at]))][:k]
                asked.append(np.full(len(at), i))
                own.append(at)
                scores.append(score[at])
        found = [queries.column("q").take(pa.array(np.concatenate(asked))), rows.column("key").take(pa.array(np.concatenate(own))), pa.array(np.concatenate(scores))]
        return pa.table(found, names=["q", "key", "score"])

    return run


class VectorIndex:
    """An index in the folder ``path``, which all executors share."""

    def __init__(self, spark: SparkSession, path: str, tuned: bool = True):
        self.spark, self.path = spark, path.rstrip("/")
        cells = spark.read.parquet(f"{self.path}/cells")
        self.cells = cells.orderBy("cell").collect()  # MAX_CELLS at most
        self.schema = T.StructType([cells.schema["key"], T.StructField("v", T.ArrayType(T.DoubleType())), T.StructField("far", T.DoubleType()), T.StructField("cell", T.IntegerType())])
        found = spark.read.schema("probes int, recall double").parquet(f"{self.path}/tuning").first() if tuned else None
        self.probes, self.recall = (found["probes"], found["recall"]) if found else (len(self.cells), 1.0)

    @classmethod
    def build(cls, vectors: DataFrame, path: str, key: str = "key", vector: str = "vector", dimensions: int | None = None, n_cells: int | None = None, sample: int = SAMPLE, seed: int = 1) -> VectorIndex:
        """Index all ``vectors`` (key, vector) that have a direction, by default of the length that most of them have."""
        spark, path = vectors.sparkSession, path.rstrip("/")
        rows = settled(unit(vectors, key, vector))
        if dimensions is None:
            most = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
            dimensions = most["d"] if most else 0
        rows = rows.where(F.size("v") == dimensions)
        n = rows.count()
        chosen = rows.withColumn("h", F.xxhash64("key")).orderBy("h").limit(sample).select(array_to_vector("v").alias("features"))
        k = max(1, min(MAX_CELLS, n_cells or round(n**0.5)))
        centroids = np.array(KMeans(k=k, seed=seed, maxIter=8, initSteps=2).fit(chosen).clusterCenters()) if n > 1 and k > 1 else np.zeros((1, max(dimensions, 1)))
        placed = T.StructType([rows.schema["key"], rows.schema["v"], T.StructField("far", T.DoubleType()), T.StructField("cell", T.IntegerType())])
        placed = rows.mapInArrow(_to_cells(centroids), placed)
        # a cell's rows are written by several tasks, however many of all it holds
        placed.repartition(F.col("cell"), F.pmod(F.xxhash64("key"), F.lit(8))).write.partitionBy("cell").parquet(f"{path}/rows")
        stored = spark.read.schema(placed.schema).parquet(f"{path}/rows")
        # an empty table has no folder that tells its types
        found = stored.groupBy("cell").agg(F.max("far").alias("radius"), F.count(F.lit(1)).alias("n"), F.min("key").alias("key"))
        where = spark.createDataFrame([(j, c) for j, c in enumerate(centroids.tolist())], "cell int, centroid array<double>")
        found.join(F.broadcast(where), "cell").coalesce(1).write.parquet(f"{path}/cells")  # MAX_CELLS rows
        probes, recall = cls(spark, path, tuned=False)._tune()
        spark.createDataFrame([(probes, recall)], "probes int, recall double").coalesce(1).write.parquet(f"{path}/tuning")
        return cls(spark, path)

    def _tune(self, recall: float = RECALL) -> tuple[int, float]:
        """(probes, recall): the fewest probes that reach ``recall``, measured against exact hits of a sample of the rows."""
        asked = self.rows().withColumn("h", F.xxhash64("key")).orderBy("h").limit(TUNING_QUERIES).select("key", "v")
        hits = self.search(asked, TUNING_HITS, probes=1, exact=True, vector="v").select("q", "key")
        found = hits.join(self.rows().select("key", "cell"), "key").join(asked.withColumnRenamed("key", "q"), "q").select("v", "cell").collect()  # TUNING_QUERIES * TUNING_HITS rows
        if not found:
            return len(self.cells), 1.0
        centroids, cells = np.array([r["centroid"] for r in self.cells]), np.array([r["cell"] for r in self.cells])
        nearest = cells[np.argsort(_apart(np.array([r["v"] for r in found]), centroids), axis=1, kind="stable")]
        needed = np.sort((nearest == np.array([r["cell"] for r in found])[:, None]).argmax(axis=1) + 1)
        probes = int(needed[int(np.ceil(recall * len(needed))) - 1])
        return probes, float((needed <= probes).mean())

    def rows(self) -> DataFrame:
        """key, v, far, cell of every vector in the index."""
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/rows")

    def _hits(self, probes: DataFrame, k: int | None) -> DataFrame:
        """(q, key, score) of queries (q, v, cells), best ``k`` of each part of a cell."""
        parts = {r["cell"]: -(-r["n"] // GROUP_ROWS) for r in self.cells}
        of_cell = F.create_map(*[F.lit(x) for pair in parts.items() for x in pair])
        asked = settled(probes.select("q", "v", F.explode("cells").alias("cell")))
        wanted = [r["cell"] for r in asked.select("cell").distinct().collect()]  # MAX_CELLS at most
        rows = self.rows().where(F.col("cell").isin(wanted))  # names the folders that are read
        rows = rows.withColumn("part", F.pmod(F.xxhash64("key"), of_cell[F.col("cell")]).cast("int")).select("cell", "part", "key", "v")
        asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), of_cell[F.col("cell")] - 1))).select("cell", "part", "q", "v")
        out = T.StructType([probes.schema["q"], rows.schema["key"], T.StructField("score", T.DoubleType())])
        return rows.groupBy("cell", "part").cogroup(asked.groupBy("cell", "part")).applyInArrow(_scored(k), out)

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = None, exact: bool = False, key: str = "key", vector: str = "vector") -> DataFrame:
        """(q, key, score, rank): the ``k`` best positive cosine similarities of each query (key, vector).

        Scores count to nine decimals, equal ones go by the smaller key. Without ``exact``, of what the
        ``probes`` nearest cells hold, by default so many as reached RECALL when the index was built.
        """
        probes = probes or (max(1, self.probes // 2) if exact else self.probes)
        if not self.cells:
            none = T.StructType([T.StructField("q", queries.schema[key].dataType), self.schema["key"], T.StructField("score", T.DoubleType()), T.StructField("rank", T.IntegerType())])
            return self.spark.createDataFrame([], none)
        centroids = np.array([r["centroid"] for r in self.cells])
        radius, cells = np.array([r["radius"] for r in self.cells]), np.array([r["cell"] for r in self.cells], dtype=np.int32)
        asked = settled(unit(queries, key, vector, centroids.shape[1]).withColumnRenamed("key", "q"))
        chosen = T.StructType([asked.schema["q"], asked.schema["v"], T.StructField("cells", T.ArrayType(T.IntegerType()))])
        best = self._best(self._hits(asked.mapInArrow(_probes(centroids, radius, cells, probes), chosen), k), k)
        if not exact or probes >= len(cells):
            return best
        best = settled(best)
        last = best.groupBy("q").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(0.0).alias("least"))
        # a score of s lies at a distance of sqrt(2 - 2 s); scores were rounded
        reach = F.sqrt(2 - 2 * (F.coalesce("least", F.lit(0.0)) - 2 * 10.0**-DECIMALS))
        again = asked.join(last, "q", "left").select("q", "v", F.least(reach, F.lit(2.0)).alias("reach"))
        more = self._hits(again.mapInArrow(_probes(centroids, radius, cells, probes), chosen), k)
        return self._best(best.drop("rank").unionByName(more), k)

    @staticmethod
    def _best(hits: DataFrame, k: int) -> DataFrame:
        # each part of a cell has k rows of a query at most
        from pyspark.sql import Window as W

        order = W.partitionBy("q").orderBy(F.desc("score"), "key")
        return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
