"""Change sets: what an operation does to the stored tables, as rows that can be applied, applied again and taken back.

A change set has rows (by, table, id, column, before, after): by names the operations that are the reason, values are strings.  The column CREATED stands for a whole row,
as JSON in after; taking it back deletes the row.  Applying is a join per table with its changes, one row per changed id, and the same set applied twice changes nothing more.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.operators.graph import remove, settled
from heddle.sources.files import overwrite_partitions

CREATED = "*"
TABLES = ("entities", "relationships", "entity_evidence", "relationship_evidence", "aliases")
SCHEMA = "by array<string>, table string, id string, column string, before string, after string"


@dataclass(frozen=True)
class Knowledge:
    """entities (id, name, normalized, entity_type, state, merged_into, superseded_by), relationships (id, source, target, type, state, superseded_by, inactive_reason),
    entity_evidence (id, entity_id, chunk_id), relationship_evidence (id, relationship_id, chunk_id), aliases (id, entity_id, alias, normalized, source); all strings."""

    entities: DataFrame
    relationships: DataFrame
    entity_evidence: DataFrame
    relationship_evidence: DataFrame
    aliases: DataFrame

    def after(self, changes: DataFrame, creating: tuple[str, ...] = TABLES) -> Knowledge:
        """creating: the tables that the changes may add rows to."""
        return replace(self, **{f.name: applied(getattr(self, f.name), f.name, changes, f.name in creating) for f in fields(self)})

    def kept(self) -> Knowledge:
        """All tables written, for operations that read them several times."""
        return replace(self, **{f.name: settled(getattr(self, f.name)) for f in fields(self)})


def change(by: Column, table: str, row: Column, column: str, before: Column | None, after: Column | None) -> list[Column]:
    text = lambda c: (F.lit(None) if c is None else c).cast("string")
    return [by.alias("by"), F.lit(table).alias("table"), row.alias("id"), F.lit(column).alias("column"), text(before).alias("before"), text(after).alias("after")]


def created(by: Column, table: str, **row: Column) -> list[Column]:
    return change(by, table, row["id"], CREATED, None, F.to_json(F.struct(*(c.alias(n) for n, c in row.items()))))


def inverse(changes: DataFrame) -> DataFrame:
    return changes.select("by", "table", "id", "column", F.col("after").alias("before"), F.col("before").alias("after"))


def applied(rows: DataFrame, table: str, changes: DataFrame, creating: bool = True) -> DataFrame:
    """rows of one table after the changes to it; a row is created only where its id is missing, and changes to ids that aren't there do nothing.

    If none is created, rows stay dealt as they are, so that rows and changes that are dealt by id meet without a shuffle, one change set after the other.
    """
    own = changes.where(F.col("table") == table)
    names, whole = [c for c in rows.columns if c != "id"], F.col("column") == CREATED
    # One row per changed id, so that both sides are dealt by id once.
    set_to = own.groupBy("id").agg(
        F.max(F.when(whole, F.col("after"))).alias("__made"), F.coalesce(F.bool_or(whole & F.col("after").isNull()), F.lit(False)).alias("__gone"),
        *(F.max(F.when(F.col("column") == c, F.struct("after"))).alias(f"__{c}") for c in names),
    )
    if not creating:
        out = rows.join(set_to.drop("__made"), "id", "left").where(~F.coalesce("__gone", F.lit(False)))
        return out.select(*(F.when(F.col(f"__{c}").isNotNull(), F.col(f"__{c}.after")).otherwise(F.col(c)).alias(c) if c != "id" else F.col("id") for c in rows.columns))
    out = rows.withColumn("__here", F.lit(True)).join(set_to, "id", "full").withColumn("__made", F.from_json("__made", rows.schema))
    out = out.where(F.when(F.col("__here"), ~F.coalesce("__gone", F.lit(False))).otherwise(F.col("__made").isNotNull()))
    was = lambda c: F.when(F.col("__here"), F.col(c)).otherwise(F.col(f"__made.{c}"))
    return out.select(*(F.when(F.col(f"__{c}").isNotNull(), F.col(f"__{c}.after")).otherwise(was(c)).alias(c) if c != "id" else F.col("id") for c in rows.columns))


class Store:
    """The tables at a path, dealt to parts by the hash of the id.  ``commit`` rewrites only the parts that a change set touches, and may run again after a loss."""

    def __init__(self, spark: SparkSession, path: str, parts: int = 32):
        self.spark, self.path, self.parts = spark, path, parts

    def _part(self) -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(self.parts)).cast("int").alias("part")

    def write(self, knowledge: Knowledge) -> None:
        for f in fields(Knowledge):
            overwrite_partitions(getattr(knowledge, f.name).select("*", self._part()).repartition("part"), f"{self.path}/{f.name}", "part")

    def read(self) -> Knowledge:
        return Knowledge(*(self.spark.read.parquet(f"{self.path}/{f.name}").drop("part") for f in fields(Knowledge)))

    def commit(self, changes: DataFrame) -> None:
        changes = settled(changes)
        for f in fields(Knowledge):
            touched = [r["part"] for r in changes.where(F.col("table") == f.name).select(self._part()).distinct().collect()]  # at most parts
            if touched:
                rows = self.spark.read.parquet(f"{self.path}/{f.name}").where(F.col("part").isin(touched)).drop("part")
                left = settled(applied(rows, f.name, changes).select("*", self._part()))
                overwrite_partitions(left.repartition("part"), f"{self.path}/{f.name}", "part")
                # An overwrite leaves alone the parts that have no rows any more.
                for part in set(touched) - {r["part"] for r in left.select("part").distinct().collect()}:
                    remove(self.spark, f"{self.path}/{f.name}/part={part}")


def rank(state: Column) -> Column:
    """Which of two equal relationships stays: a human's decision, then a rejection."""
    return F.when(state.isin("HUMAN_VERIFIED", "HUMAN_CORRECTED", "CORRECTED"), 3).when(state == "REJECTED", 2).otherwise(1)
