"""Corrections of entities as one change set: the clone, its evidence, the aliases it takes over and the edges that are attached to it anew.

The original stays, superseded, with its edges, so that the audit trail is whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heddle.functions.text import normalize_name
from heddle.operators.changes import TABLES, Knowledge, change, created
from heddle.operators.graph import settled


def judged(knowledge: Knowledge, corrections: DataFrame) -> DataFrame:
    """corrections (id, name, entity_type, seq) with new_id, normalized and the reason why one is refused, or null.

    Refused are corrections of unknown or replaced entities, without a name, that change nothing, that name what a live entity is named already, and all but
    the first (by seq) of one entity, or (by id) to one name and type.
    """
    entities = knowledge.entities.select("id", F.col("name").alias("old_name"), F.col("normalized").alias("old_normalized"), F.col("entity_type").alias("old_type"), F.coalesce("merged_into", "superseded_by").alias("gone"), F.lit(True).alias("known"))
    rows = corrections.withColumn("name", F.trim("name")).withColumn("normalized", normalize_name(F.col("name"))).join(entities, "id", "left")
    live = knowledge.entities.where("merged_into is null and superseded_by is null").select("normalized", "entity_type").distinct().withColumn("taken", F.lit(True))
    rows = rows.join(live, ["normalized", "entity_type"], "left")
    rows = rows.withColumn("turn", F.row_number().over(Window.partitionBy("id").orderBy("seq"))).withColumn("same", F.row_number().over(Window.partitionBy("normalized", "entity_type").orderBy("id", "seq")))
    reason = (
        F.when(F.col("known").isNull(), "unknown entity").when(F.col("gone").isNotNull(), "the entity was replaced").when(F.coalesce("normalized", F.lit("")) == "", "no name")
        .when((F.col("normalized") == F.col("old_normalized")) & (F.col("entity_type") == F.col("old_type")), "changes nothing").when(F.col("taken"), "the name is taken")
        .when(F.col("turn") > 1, "corrected before").when(F.col("same") > 1, "the name is taken")
    )
    return rows.select("id", "seq", "name", "normalized", "entity_type", "old_name", "old_normalized", F.concat_ws("~", "id", F.col("seq").cast("string")).alias("new_id"), reason.alias("reason"))


def correction_changes(knowledge: Knowledge, corrections: DataFrame, tables: tuple[str, ...] = TABLES) -> DataFrame:
    """The change set of the corrections that aren't refused; ``tables``: of these alone.

    An edge that would be a loop stays with the original.  Where a live edge with the new ends and the type is there already, or another edge of the set
    comes to stand there first, the edge is superseded by that one; else by its clone, which has its evidence.
    """
    rows = settled(judged(knowledge, corrections).where("reason is null"))
    by = F.array("id")
    clones = rows.select(*created(by, "entities", id=F.col("new_id"), name=F.col("name"), normalized=F.col("normalized"), entity_type=F.col("entity_type"), state=F.lit("HUMAN_CORRECTED"), merged_into=F.lit(None).cast("string"), superseded_by=F.lit(None).cast("string")))
    before = rows.join(knowledge.entities.select("id", "state", "superseded_by"), "id")
    replaced = [before.select(*change(by, "entities", F.col("id"), c, F.col(c), after)) for c, after in (("state", F.lit("HUMAN_CORRECTED")), ("superseded_by", F.col("new_id")))]
    of = rows.select(F.col("id").alias("entity_id"), "seq", "new_id")
    mark = lambda c: F.concat_ws("~", c, F.col("seq").cast("string"))
    evidence = knowledge.entity_evidence.join(of, "entity_id").select(*created(F.array("entity_id"), "entity_evidence", id=mark("id"), entity_id=F.col("new_id"), chunk_id=F.col("chunk_id")))
    aliases = knowledge.aliases.join(of, "entity_id").select(*change(F.array("entity_id"), "aliases", F.col("id"), "entity_id", F.col("entity_id"), F.col("new_id")))
    old_names = rows.where("old_normalized <> normalized").join(knowledge.aliases.select(F.col("normalized").alias("old_normalized")), "old_normalized", "left_anti")
    old_names = old_names.withColumn("first", F.row_number().over(Window.partitionBy("old_normalized").orderBy("id"))).where("first = 1")
    new_aliases = old_names.select(*created(by, "aliases", id=F.concat(F.lit("human:"), "id"), entity_id=F.col("new_id"), alias=F.col("old_name"), normalized=F.col("old_normalized"), source=F.lit("HUMAN")))
    parts = [x for table, x in (("entities", clones), *(("entities", x) for x in replaced), ("entity_evidence", evidence), ("aliases", aliases), ("aliases", new_aliases)) if table in tables]
    if not {"relationships", "relationship_evidence"} & set(tables):
        return settled(reduce(DataFrame.unionByName, parts))
    # Edges: each end that is corrected becomes the clone.
    live = knowledge.relationships.where("superseded_by is null")
    end = lambda c: rows.select(F.col("id").alias(c), F.col("new_id").alias(f"new_{c}"), F.col("seq").alias(f"seq_{c}"))
    edges = live.join(end("source"), "source", "left").join(end("target"), "target", "left").where("new_source is not null or new_target is not null")
    edges = edges.withColumn("to_source", F.coalesce("new_source", "source")).withColumn("to_target", F.coalesce("new_target", "target")).where("to_source <> to_target")
    twin = live.groupBy(F.col("source").alias("to_source"), F.col("target").alias("to_target"), "type").agg(F.min("id").alias("twin"))
    edges = edges.join(twin, ["to_source", "to_target", "type"], "left").withColumn("clone", F.concat_ws("~", "id", F.coalesce("seq_source", "seq_target").cast("string")))
    first = F.first("clone").over(Window.partitionBy("to_source", "to_target", "type").orderBy("id"))
    edges = settled(edges.withColumn("stays", F.coalesce("twin", first)).withColumn("by", F.array_compact(F.array(F.when(F.col("new_source").isNotNull(), F.col("source")), F.when(F.col("new_target").isNotNull(), F.col("target"))))))
    superseded = edges.select(*change(F.col("by"), "relationships", F.col("id"), "superseded_by", None, F.col("stays")))
    cloned = edges.where("stays = clone")
    new_edges = cloned.select(*created(F.col("by"), "relationships", id=F.col("clone"), source=F.col("to_source"), target=F.col("to_target"), type=F.col("type"), state=F.col("state"), superseded_by=F.lit(None).cast("string"), inactive_reason=F.col("inactive_reason")))
    proof = knowledge.relationship_evidence.join(cloned.select(F.col("id").alias("relationship_id"), "clone", "by"), "relationship_id")
    new_proof = proof.select(*created(F.col("by"), "relationship_evidence", id=F.concat_ws("~", "id", "clone"), relationship_id=F.col("clone"), chunk_id=F.col("chunk_id")))
    parts += [superseded, new_edges] if "relationships" in tables else []
    parts += [new_proof] if "relationship_evidence" in tables else []
    return settled(reduce(DataFrame.unionByName, parts))
