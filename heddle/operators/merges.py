"""Soft merges of entities with a log of what they moved, and their undoing by replay of the log.

All merges of a batch are one set of joins.  Each change of the log names the merges that are its reason, per column: an edge between two merged entities
gets back only the end whose merge is undone.  A cell that several batches changed gets back what it had before the first that is undone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heddle.operators.changes import TABLES, Knowledge, change, created, inverse, rank
from heddle.operators.graph import dealt, settled
from heddle.operators.resolve import pair_key


def refused(knowledge: Knowledge, merges: DataFrame) -> DataFrame:
    """merges (merged, survivor) that can't be applied, with the reason: both must be known and unmerged, and none may be both sides, or merged twice."""
    state = lambda c: knowledge.entities.select(F.col("id").alias(c), F.struct("merged_into").alias(f"{c}_state"))
    rows = merges.join(state("merged"), "merged", "left").join(state("survivor"), "survivor", "left")
    rows = rows.join(merges.select(F.col("survivor").alias("merged")).distinct().withColumn("both", F.lit(True)), "merged", "left").withColumn("n", F.count("*").over(Window.partitionBy("merged")))
    reason = (
        F.when(F.col("merged") == F.col("survivor"), "a merge needs two entities").when(F.col("merged_state").isNull() | F.col("survivor_state").isNull(), "unknown entity")
        .when(F.col("merged_state.merged_into").isNotNull() | F.col("survivor_state.merged_into").isNotNull(), "already merged").when(F.col("both"), "is a survivor of the same batch").when(F.col("n") > 1, "merged twice in one batch")
    )
    return rows.withColumn("reason", reason).where("reason is not null").select("merged", "survivor", "reason")


def _moved_evidence(evidence: DataFrame, to: DataFrame, table: str, column: str) -> DataFrame:
    """Changes that move the evidence of owners (owner, to, and by, else the owner is the reason) to other ones, but for chunks that the other has; of several with one chunk the first moves."""
    # What belongs to neither side of a move is in nobody's way.
    sides = to.withColumnRenamed("owner", column).unionByName(to.select(F.col("to").alias(column)).distinct(), allowMissingColumns=True)
    # Who moves is another one than where it goes, so both alone are dealt.
    rows = evidence.join(sides, column).withColumn("to", F.coalesce("to", column)).withColumn("moves", F.col("to") != F.col(column))
    first = F.row_number().over(Window.partitionBy("to", "chunk_id").orderBy("moves", column, "id"))
    by = F.col("by") if "by" in to.columns else F.array(column)
    return rows.withColumn("first", first).where("moves and first = 1").select(*change(by, table, F.col("id"), column, F.col(column), F.col("to")))


def merge_changes(knowledge: Knowledge, merges: DataFrame, tables: tuple[str, ...] = TABLES) -> DataFrame:
    """The change set of merges (merged, survivor), none of them refused: evidence, aliases, edges, twins and loops; ``tables``: of these alone.

    The merged entity's name becomes an alias of the survivor, unless it is one already.  A loop stays where it is, inactive.  Of equal edges the one of higher rank, then one that
    didn't move, then the smallest id stays; the others are superseded by it and pass on their evidence.
    """
    by = F.array("merged")
    entities = merges.select(*change(by, "entities", F.col("merged"), "merged_into", None, F.col("survivor")))
    evidence = _moved_evidence(knowledge.entity_evidence, merges.select(F.col("merged").alias("owner"), F.col("survivor").alias("to")), "entity_evidence", "entity_id")
    aliases = knowledge.aliases.join(merges.withColumnRenamed("merged", "entity_id"), "entity_id").select(*change(F.array("entity_id"), "aliases", F.col("id"), "entity_id", F.col("entity_id"), F.col("survivor")))
    name = lambda c: knowledge.entities.select(F.col("id").alias(c), F.col("name").alias(f"{c}_name"), F.col("normalized").alias(f"{c}_normalized"))
    named = merges.join(name("merged"), "merged").join(name("survivor"), "survivor").where("merged_normalized <> survivor_normalized")
    named = named.join(knowledge.aliases.select(F.col("normalized").alias("merged_normalized")), "merged_normalized", "left_anti")
    named = named.withColumn("first", F.row_number().over(Window.partitionBy("merged_normalized").orderBy("merged"))).where("first = 1")
    new_aliases = named.select(*created(by, "aliases", id=F.concat(F.lit("merge:"), "merged"), entity_id=F.col("survivor"), alias=F.col("merged_name"), normalized=F.col("merged_normalized"), source=F.lit("MERGE")))
    found = [x for table, x in (("entities", entities), ("entity_evidence", evidence), ("aliases", aliases), ("aliases", new_aliases)) if table in tables]
    if not {"relationships", "relationship_evidence"} & set(tables):
        return reduce(DataFrame.unionByName, found)
    # Edges, with both ends where they belong now; one with neither a merged end nor a survivor is nobody's twin.
    ends = merges.select("merged", "survivor").unionByName(merges.select(F.col("survivor").alias("merged")).distinct(), allowMissingColumns=True)
    end = lambda c: ends.select(F.col("merged").alias(c), F.struct("survivor").alias(f"new_{c}"))
    edges = knowledge.relationships.where("superseded_by is null").join(end("source"), "source", "left").join(end("target"), "target", "left").where("new_source is not null or new_target is not null")
    edges = edges.select("id", "source", "target", "type", "inactive_reason", rank(F.col("state")).alias("rank"), *(F.coalesce(f"new_{c}.survivor", c).alias(f"to_{c}") for c in ("source", "target")))
    # An end that moves is another one than where it goes, so both alone are dealt and written.
    left = lambda edge: F.array_distinct(F.array_compact(F.array(*(F.when(edge[c] != F.col(f"to_{c}"), edge[c]) for c in ("source", "target")))))
    whole = F.struct("id", "source", "target")
    edges = edges.withColumn("moved", (F.col("source") != F.col("to_source")) | (F.col("target") != F.col("to_target"))).withColumn("loop", F.col("moved") & (F.col("to_source") == F.col("to_target")))
    twins = Window.partitionBy("loop", "to_source", "to_target", "type").orderBy(F.desc("rank"), "moved", "id")
    edges = edges.withColumn("winner", F.first(whole).over(twins)).where("moved or winner.id <> id")
    edges = settled(edges.select("id", "source", "target", "to_source", "to_target", "moved", "loop", "winner", "inactive_reason")).withColumn("by", left(whole))
    loops = edges.where("loop").select(*change(F.col("by"), "relationships", F.col("id"), "inactive_reason", F.col("inactive_reason"), F.lit("endpoints merged")))
    losers = edges.where("not loop and winner.id <> id").withColumn("by", F.array_distinct(F.concat("by", left(F.col("winner"))))).where(F.size("by") > 0)
    lost = losers.select(*change(F.col("by"), "relationships", F.col("id"), "superseded_by", None, F.col("winner.id")))
    winners = edges.where("not loop and moved and winner.id = id")
    ends = [winners.where(f"to_{c} <> {c}").select(*change(F.array(c), "relationships", F.col("id"), c, F.col(c), F.col(f"to_{c}"))) for c in ("source", "target")]
    passed_on = _moved_evidence(knowledge.relationship_evidence, losers.select(F.col("id").alias("owner"), F.col("winner.id").alias("to"), "by"), "relationship_evidence", "relationship_id")
    found += [loops, lost, *ends] if "relationships" in tables else []
    found += [passed_on] if "relationship_evidence" in tables else []
    return reduce(DataFrame.unionByName, found)


def merge(knowledge: Knowledge, merges: DataFrame, batch: int, tables: tuple[str, ...] = TABLES) -> tuple[Knowledge, DataFrame]:
    """The tables after a batch of merges (merged, survivor), and its log: the change set with the batch's number.  Raises if a merge is refused.

    Who reads some tables alone names them: the others stay as they are, and the log has no changes to them.
    """
    merges = settled(merges.select("merged", "survivor").distinct())
    if wrong := refused(knowledge, merges).limit(1).collect():
        raise ValueError(f"{wrong[0]['merged']} can't be merged into {wrong[0]['survivor']}: {wrong[0]['reason']}")
    log = dealt(merge_changes(knowledge, merges, tables), "id")
    return knowledge.after(log, ("aliases",)), log.withColumn("batch", F.lit(batch))


def undo(knowledge: Knowledge, log: DataFrame, merged: DataFrame) -> tuple[Knowledge, DataFrame, DataFrame]:
    """The tables with the merges of ``merged`` (merged) taken back by the log (of all batches so far), the decisions that this leaves, and what is refused with the reason.

    Refused are entities that aren't merged (any more), and those whose survivor was merged again: that merge has to be undone first.
    A decision (pair_key, entity_a, entity_b, decision, decided_by) keeps the pair apart from now on.
    """
    state = knowledge.entities.select(F.col("id").alias("merged"), F.col("merged_into").alias("survivor"))
    asked = merged.select("merged").distinct().join(state, "merged", "left").join(state.select(F.col("merged").alias("survivor"), F.col("survivor").alias("further")), "survivor", "left")
    asked = settled(asked.withColumn("reason", F.when(F.col("survivor").isNull(), "not merged").when(F.col("further").isNotNull(), "the survivor was merged again")))
    taken = asked.where("reason is null").select("merged", "survivor")
    back = log.withColumn("merged", F.explode("by")).join(taken, "merged", "left_semi").repartition(int(log.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")
    back = back.groupBy("table", "id", "column").agg(F.min_by(F.struct("by", "before", "after"), "batch").alias("x"))
    changes = dealt(inverse(back.select("x.by", "table", "id", "column", "x.before", "x.after")), "id", placed=True)
    decisions = taken.select(pair_key(F.col("merged"), F.col("survivor")).alias("pair_key"), F.col("merged").alias("entity_a"), F.col("survivor").alias("entity_b"), F.lit("DIFFERENT").alias("decision"), F.lit("HUMAN").alias("decided_by"))
    return knowledge.after(changes, ()), decisions, asked.where("reason is not null").select("merged", "reason")

