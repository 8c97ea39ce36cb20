"""An inverted-file index over vectors: rows stand in the list of their nearest centroid, and a search reads some lists only.

Centroids are fitted by k-means on a bounded sample; every vector with a direction is then put into a list and written, partitioned by list, so that a
search prunes all others at the scan.  Queries travel to the lists in blocks; what the driver and a broadcast hold is one block of
queries and the centroids (at most MOST_LISTS).  With all lists probed the result is that of `retrieval.dense_channel`; with fewer
it's a part of it, and ``tuned_probes`` finds how many lists a recall needs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.functions import vectors as V
from heddle.operators.graph import settled
from heddle.operators.retrieval import _unit_vectors, ranked

#: The sample that k-means is fitted on, and the one that probes are measured on; both are rows of smallest hash.
SAMPLE, SAMPLE_QUERIES = 20_000, 200
MOST_LISTS = 4096
#: Tasks that write one list, so that a list of many equal vectors isn't one task's.
SPREAD = 8
BLOCK_BYTES = 16 << 20


def directed(vectors: DataFrame) -> DataFrame:
    """(id, embedding as doubles) of the vectors that have a direction: not null, without nulls, not zero."""
    rows = vectors.select("id", F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.where("embedding is not null and not exists(embedding, x -> x is null) and exists(embedding, x -> x <> 0)")


class VectorIndex:
    """An index at a path: ``centroids`` (list, centroid) and ``rows`` (id, embedding, list), partitioned by list."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        found = sorted(spark.read.parquet(f"{path}/centroids").collect())
        self.centroids = np.array([r["centroid"] for r in found])
        self.id_type = spark.read.parquet(f"{path}/rows").schema["id"].dataType.simpleString()

    @classmethod
    def build(cls, vectors: DataFrame, path: str, lists: int | None = None) -> VectorIndex:
        """vectors (id, embedding) of one width; ``lists`` is by default the square root of their number."""
        rows = directed(vectors)
        n = rows.count()
        if not n:
            raise ValueError("there are no vectors with a direction")
        lists = max(1, min(lists or round(n**0.5), MOST_LISTS, n))
        sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select(array_to_vector(V.l2_normalize(F.col("embedding"))).alias("features"))
        model = KMeans(k=lists, seed=7, maxIter=12, distanceMeasure="cosine").fit(sample)
        centers = [(k, [float(x) for x in c]) for k, c in enumerate(model.clusterCenters())]
        vectors.sparkSession.createDataFrame(centers, "list int, centroid array<double>").coalesce(1).write.parquet(f"{path}/centroids")
        cls._write(rows, np.array([c for _, c in centers]), path)
        return cls(vectors.sparkSession, path)

    @staticmethod
    def _write(rows: DataFrame, centroids: np.ndarray, path: str) -> None:
        shared = rows.sparkSession.sparkContext.broadcast(centroids)

        def assign(batches):
            for batch in batches:
                at = np.zeros(batch.num_rows, dtype=np.int32)
                for where, unit in _unit_vectors(batch.column("embedding")).values():
                    at[where] = np.argmax(unit @ shared.value.T, axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], names=["id", "embedding", "list"])

        placed = rows.mapInArrow(assign, f"id {rows.schema['id'].dataType.simpleString()}, embedding array<double>, list int")
        placed.repartition("list", F.pmod(F.xxhash64("id"), F.lit(SPREAD))).write.mode("append").partitionBy("list").parquet(f"{path}/rows")
        shared.destroy()

    def add(self, vectors: DataFrame) -> None:
        """Puts more vectors into the lists that there are; an id that is in the index already would stand there twice."""
        self._write(directed(vectors), self.centroids, self.path)

    def _order(self, unit: np.ndarray) -> np.ndarray:
        return np.argsort(-(unit @ self.centroids.T), axis=1, kind="stable")

    def _wanted(self, unit: np.ndarray, probes: int) -> np.ndarray | None:
        """Who asks each list, a bit per list and query, since each Python process holds it; None: all ask all."""
        if probes == len(self.centroids):
            return None
        bits = np.zeros((len(self.centroids), -(-len(unit) // 8)), dtype=np.uint8)
        for low in range(0, len(unit), 1024):  # a multiple of eight, so that parts end with their bytes
            order = self._order(unit[low : low + 1024])[:, :probes]
            asks = np.zeros((len(self.centroids), len(order)), dtype=bool)
            asks[order, np.arange(len(order))[:, None]] = True
            packed = np.packbits(asks, axis=1)
            bits[:, low // 8 : low // 8 + packed.shape[1]] = packed
        return bits

    def search(self, queries: DataFrame, k: int, probes: int | None = None, with_list: bool = False) -> DataFrame:
        """queries (query, vector): query, id, score (nine digits) and rank of the k nearest in the ``probes`` nearest lists; None: in all lists, which is exact.

        Ties go to the smaller id.  Queries without a direction find nothing.
        """
        asked = queries.where("vector is not null").select("query", F.col("vector").cast("array<double>").alias("vector"))
        kind = asked.schema["query"].dataType.simpleString()
        size = asked.agg(F.coalesce(F.sum(F.size("vector") * 8), F.lit(0)).alias("n")).first()["n"]
        blocks = max(1, -(-size // BLOCK_BYTES))
        rows, near = self.spark.read.parquet(f"{self.path}/rows"), None
        probes = len(self.centroids) if probes is None else max(1, min(probes, len(self.centroids)))
        for n in range(blocks):
            part = asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == n).toArrow().combine_chunks()
            where, unit = _unit_vectors(part["vector"]).get(self.centroids.shape[1], (np.zeros(0, dtype=np.int64), np.zeros((0, self.centroids.shape[1]))))
            wanted = self._wanted(unit, probes)
            lists = list(range(len(self.centroids))) if wanted is None else np.flatnonzero(wanted.any(axis=1)).tolist()
            shared = self.spark.sparkContext.broadcast((part["query"].combine_chunks().take(pa.array(where)), unit, wanted))
            found = rows.where(F.col("list").isin(lists)).select("id", "embedding", "list").mapInArrow(_probe(shared, k), f"query {kind}, id {self.id_type}, list int, score double")
            if blocks > 1:  # a block's hits are written, so that its broadcast can go before the next comes
                found = settled(found)
                shared.destroy()
            near = found if near is None else near.unionByName(found)
        out = ranked(near, k)
        return out if with_list else out.drop("list")

    def tuned_probes(self, k: int, recall: float = 0.9, queries: DataFrame | None = None) -> int:
        """The least number of lists in which the share ``recall`` of the k nearest of SAMPLE_QUERIES queries stand, measured against all lists."""
        if queries is None:
            queries = self.spark.read.parquet(f"{self.path}/rows").select(F.col("id").alias("query"), F.col("embedding").alias("vector"))
        sample = queries.orderBy(F.xxhash64("query"), "query").limit(SAMPLE_QUERIES)
        held = sample.toArrow().combine_chunks()
        where, unit = next(iter(_unit_vectors(held["vector"]).values()))
        names = held["query"].take(pa.array(where)).to_pylist()
        place = {(q, int(at)): turn for q, order in zip(names, self._order(unit), strict=True) for turn, at in enumerate(order)}
        turns = np.array([place[r["query"], r["list"]] for r in self.search(sample, k, with_list=True).collect()])
        return int(np.searchsorted(np.cumsum(np.bincount(turns, minlength=len(self.centroids))), recall * len(turns))) + 1


def _probe(shared, k: int):
    """Over batches of (id, embedding, list): per query of the lists that it probes, what may be among its best k."""

    def run(batches):
        names, unit, wanted = shared.value
        best = np.full((len(unit), k), -(1 << 62), dtype=np.int64)
        for batch in batches:
            lists = batch.column("list").to_numpy(zero_copy_only=False)
            order = np.lexsort((np.argsort(np.argsort(batch.column("id").to_numpy(zero_copy_only=False), kind="stable")), lists))
            batch, lists = batch.take(pa.array(order)), lists[order]
            where, rows = _unit_vectors(batch.column("embedding")).get(unit.shape[1], (np.zeros(0, dtype=np.int64), None))
            for at in np.unique(lists[where]):
                own, asking = np.flatnonzero(lists[where] == at), np.arange(len(unit)) if wanted is None else np.flatnonzero(np.unpackbits(wanted[at], count=len(unit)))
                some = max(1, (1 << 22) // len(own))
                for low in range(0, len(asking), some):
                    q = asking[low : low + some]
                    scores = np.rint(unit[q] @ rows[own].T * 1e9).astype(np.int64)
                    # Keys are distinct: equal scores go to the smaller id.
                    keys = (scores << 24) - np.arange(len(own))
                    top = np.argpartition(keys, len(own) - k, axis=1)[:, -k:] if len(own) > k else np.broadcast_to(np.arange(len(own)), keys.shape)
                    score = np.take_along_axis(scores, top, axis=1)
                    n, c = np.nonzero(score >= best[q].min(axis=1)[:, None])
                    best[q] = np.sort(np.concatenate([best[q], score], axis=1), axis=1)[:, -k:]
                    if len(n):
                        ids = batch.column("id").take(pa.array(where[own[top[n, c]]]))
                        yield pa.RecordBatch.from_arrays([names.take(pa.array(q[n])), ids, pa.array(np.full(len(n), at, dtype=np.int32)), pa.array(score[n, c] / 1e9)], names=["query", "id", "list", "score"])

    return run
