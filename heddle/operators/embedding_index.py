"""Embeddings kept by content: a run embeds only what is new, once per content, and remembers how far it came.

At a path: ``vectors`` (content_hash, embedding) in a folder per identity (model and version), and ``runs``, one row per run with its high-water mark.  A run takes the chunks
behind the identity's mark in the order of their ids (a keyset, not an offset), so chunks that came later are never skipped and old ones never read again.
Vectors are written ahead of the run's row: after a loss the run starts again at the same mark, and finds the vectors that it had written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.operators.graph import settled

RUNS = "run int, model string, version string, after long, upto long, total long, reused long, computed long"
VECTORS = "content_hash string, embedding array<double>, model string, version string"


def _nth(ids: DataFrame, n: int) -> int | None:
    """The n-th smallest id, null if there are fewer.  Ids are dealt by ranges, so that a task sorts only those of the range that has it."""
    placed = settled(ids.repartitionByRange("id").withColumn("part", F.spark_partition_id()))
    for part, here in sorted(map(tuple, placed.groupBy("part").agg(F.count("*").alias("n")).collect())):
        if here >= n:
            return placed.where(F.col("part") == part).withColumn("k", F.expr("row_number() over (partition by part order by id)")).where(F.col("k") == n).first()["id"]
        n -= here
    return None


class EmbeddingIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        for name, schema in (("runs", RUNS), ("vectors", VECTORS)):  # so that both can be read before the first run
            spark.createDataFrame([], schema).write.mode("append").parquet(f"{path}/{name}/empty=0")

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{self.path}/{name}")

    def runs(self) -> DataFrame:
        return self._read("runs", RUNS)

    def vectors(self, model: str, version: str) -> DataFrame:
        """content_hash and embedding of one identity; vectors of other models aren't comparable and never mixed in."""
        return self._read("vectors", VECTORS).where((F.col("model") == model) & (F.col("version") == version)).select("content_hash", "embedding")

    def run(self, chunks: DataFrame, embed: Callable[[Column], Column], model: str, version: str, most: int | None = None) -> dict:
        """One run over chunks (id long, content; ids are distinct): at most ``most`` (from 1) behind the mark, null: all.  Gives the run's row.

        total counts the chunks, computed the contents that had to be embedded, reused the chunks whose content was known or stood in the run before.
        """
        done = self.runs().agg(F.max("run").alias("run"), F.max(F.when((F.col("model") == model) & (F.col("version") == version), F.col("upto"))).alias("upto")).first()
        rows = chunks.select("id", "content").where("content is not null")
        if done["upto"] is not None:
            rows = rows.where(F.col("id") > done["upto"])
        if most is not None:
            last = _nth(rows.select("id"), most)
            rows = rows if last is None else rows.where(F.col("id") <= last)
        rows = settled(rows.select("id", "content", F.sha2("content", 256).alias("content_hash")))
        fresh = rows.join(self.vectors(model, version).select("content_hash"), "content_hash", "left_anti").groupBy("content_hash").agg(F.first("content").alias("content"))
        fresh = settled(fresh.select("content_hash", embed(F.col("content")).alias("embedding"), F.lit(model).alias("model"), F.lit(version).alias("version")))
        fresh.write.mode("append").parquet(f"{self.path}/vectors")
        counts, computed = rows.agg(F.count("*").alias("total"), F.max("id").alias("upto")).first(), fresh.count()
        out = {"run": (done["run"] or 0) + 1, "model": model, "version": version, "after": done["upto"], "upto": counts["upto"] if counts["total"] else done["upto"], "total": counts["total"], "reused": counts["total"] - computed, "computed": computed}
        self.spark.createDataFrame([tuple(out.values())], RUNS).coalesce(1).write.mode("append").parquet(f"{self.path}/runs")
        return out

    def embedded(self, chunks: DataFrame, model: str, version: str) -> DataFrame:
        """chunks (id, content) that have a vector, with it."""
        return chunks.withColumn("content_hash", F.sha2("content", 256)).join(self.vectors(model, version), "content_hash").drop("content_hash")
