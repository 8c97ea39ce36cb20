"""From documents to a training mixture: five stages, each written as Parquet and read again by the next.

Quality rules reject documents; line dedup deletes later copies of repeated line runs, and documents
of which nothing is left; near-dedup keeps one document of each group; decontamination rejects
documents that hold a benchmark item; mixing puts the rest in the order of the target weights.

All stages take empty tables, null in any column and columns of any name that does not start with two underscores; rows without a doc_id
are never copies of others.  Line dedup stands ahead of near-dedup, so of near copies mostly the lines that differ are left when near-dedup sees them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heddle.llm.decontaminate import decontaminate
from heddle.llm.line_dedup import dedup_lines
from heddle.llm.mixing import mix
from heddle.llm.near_dedup import near_duplicates
from heddle.llm.quality import quality_filter
from heddle.llm.store import Scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass; null and empty texts don't, repeated rows pass alike."""
    return quality_filter(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the later copies; a document that had lines and lost all goes, and n_chars follows the text.  Null texts stay null."""
    left = dedup_lines(docs).where((F.col("__n_removed") == 0) | (F.col("__n_removed") < F.col("__n_lines")))
    return left.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group; of rows with equal doc_id and text one.  Null and empty texts and rows without a doc_id stay."""
    gone = near_duplicates(docs, words=5, percent=80).where(~F.col("kept")).select("doc_id").distinct()
    known = docs.where("doc_id is not null").withColumn("__h", F.xxhash64("text")).join(gone.hint("merge"), "doc_id", "left_anti")
    others = [F.col(c).cast("string") for c in docs.columns if c not in ("doc_id", "text")]
    turn = F.row_number().over(Window.partitionBy("doc_id", "__h").orderBy(*(others or ["doc_id"])))
    return known.withColumn("__turn", turn).where("__turn = 1").select(*docs.columns).unionByName(docs.where("doc_id is null"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item; null and empty texts hold none."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixture, with mix_block, mix_slot and mix_offset; a null source counts as the empty one.

    Texts are shuffled twice: to their places within their source, and into the order of the mixture.
    """
    return mix(docs).orderBy("mix_slot", "mix_offset")


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing)]
#: The decontamination stage has no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = out if k == len(STAGES) - 1 else scratch.keep(out)
    return docs
