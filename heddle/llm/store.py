"""Written intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

BATCH_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; only where it is unset (tests, one machine) a folder of our own."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.heddle.scratch", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='heddle-')}"
        spark.conf.set("spark.heddle.scratch", folder)
    return folder.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Tables written once and read again: they cut lineage and outlive lost executors.

    ``keep(df)`` writes and rereads; ``drop(df)`` deletes a table that no later step reads.
    What is left goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.tables: list[str] = []
        self.n = 0
        atexit.register(self.close)

    @contextlib.contextmanager
    def _small_batches(self):
        """Whole texts in batches of 10000 take hundreds of MB on both sides of the pipe to Python."""
        name = "spark.sql.execution.arrow.maxRecordsPerBatch"
        before = self.spark.conf.get(name)
        self.spark.conf.set(name, str(min(int(before), BATCH_ROWS) if int(before) > 0 else BATCH_ROWS))
        try:
            yield
        finally:
            self.spark.conf.set(name, before)

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        with self._small_batches():
            df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._heddle_path = path
        return out

    def keep_by(self, df: DataFrame, key: str) -> DataFrame:
        """Like keep, a row per key and in buckets by it: joins on key read the table as it lies, without a shuffle."""
        self.n += 1
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        table = f"heddle_{uuid.uuid4().hex}"
        with self._small_batches():
            df.repartition(n, key).dropDuplicates([key]).write.bucketBy(n, key).sortBy(key).option("path", f"{self.root}/{self.n}").option("compression", "zstd").saveAsTable(table)
        self.tables.append(table)
        return self.spark.table(table)

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_heddle_path", None)
        if path:
            remove(self.spark, path)

    def clear(self, *kept: DataFrame) -> None:
        """Deletes all tables but those kept; what is read later must not depend on the others."""
        stay = {getattr(df, "_heddle_path", None) for df in kept}
        for table in self.tables:
            self.spark.sql(f"drop table if exists {table}")
        self.tables.clear()
        for k in range(1, self.n + 1):
            if f"{self.root}/{k}" not in stay:
                remove(self.spark, f"{self.root}/{k}")

    def close(self) -> None:
        with contextlib.suppress(Exception):
            for table in self.tables:
                self.spark.sql(f"drop table if exists {table}")
            remove(self.spark, self.root)
