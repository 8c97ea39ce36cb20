"""Potential inconsistencies as pure functions of the facts, and their lifecycle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.operators import facts
from heddle.operators.resolve import type_group

CONSUMING = ["REQUIRES", "USES", "CONSUMES", "DEPENDS_ON"]


def fingerprint(kind: Column | str, key: Column) -> Column:
    return F.sha2(F.concat_ws("|", kind if isinstance(kind, Column) else F.lit(kind), key), 256)


def draft(rows: DataFrame, kind: Column | str, severity: Column | str, key: Column, summary: Column, order: Column | int) -> DataFrame:
    kind, severity, order = (x if isinstance(x, Column) else F.lit(x) for x in (kind, severity, order))
    return rows.select(kind.alias("finding_type"), severity.alias("severity"), key.alias("key"), fingerprint(kind, key).alias("fingerprint"), summary.alias("summary"), order.alias("detector"))


def missing_providers(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    live = facts.active_relationships(relationships)
    provided = live.where("type = 'PROVIDES'").select(F.col("target").alias("id")).union(live.where("type = 'IMPLEMENTED_BY'").select("source")).distinct()
    open_ends = facts.active_entities(entities).where("entity_type = 'INTERFACE'").join(provided, "id", "left_anti").select("id", "name")
    # Only users of interfaces without a provider get their names; three are told, so no more are gathered.
    named = entities.select(F.col("id").alias("source"), F.col("name").alias("user"))
    users = live.where(F.col("type").isin(CONSUMING)).select(F.col("target").alias("id"), "source").join(open_ends.select("id"), "id", "left_semi").distinct()
    users = users.join(named, "source").select("id", "user").distinct()
    told = users.withColumn("k", F.expr("row_number() over (partition by id order by user)")).where("k <= 3")
    users = told.groupBy("id").agg(F.array_sort(F.collect_list("user")).alias("users"))
    open_ends = open_ends.join(users, "id", "left")
    used = F.size(F.coalesce("users", F.array().cast("array<string>"))) > 0
    summary = F.concat(F.lit("interface '"), F.col("name"), F.lit("' has no provider."), F.when(used, F.concat(F.lit(" It is used by "), F.array_join("users", ", "), F.lit("."))).otherwise(F.lit("")))
    return draft(open_ends, "MISSING_PROVIDER", F.when(used, "HIGH").otherwise("LOW"), F.col("id"), summary, 0)


def binding_problems(names: DataFrame, rejected: DataFrame) -> DataFrame:
    """names (name, state, n): how many ends of statements go by a name and are in a state; rejected (id): the statements with an end that is REJECTED."""
    counted = lambda state: names.where(F.col("state") == state).groupBy("name").agg(F.sum("n").alias("n"))
    missing, ambiguous = counted("MISSING"), counted("AMBIGUOUS")
    return (
        draft(missing, "MISSING_ENTITY_DEFINITION", "MEDIUM", F.col("name"), F.concat(F.lit("'"), F.col("name"), F.lit("' is referenced in "), F.col("n").cast("string"), F.lit(" statement(s) but not defined.")), 1)
        .unionByName(draft(ambiguous, "UNRESOLVED_ALIAS", "MEDIUM", F.concat(F.lit("ambiguous:"), F.col("name")), F.concat(F.lit("the name '"), F.col("name"), F.lit("' could refer to several entities.")), 1))
        .unionByName(draft(rejected, "DANGLING_RELATIONSHIP", "MEDIUM", F.concat(F.lit("candidate:"), F.col("id").cast("string")), F.lit("a statement refers to a rejected entity."), 1))
    )


def endpoint_findings(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """Relationships with a rejected end, and those whose ends' types don't go with their own: both from one look at each end."""
    rows = facts.active_relationships(relationships).select("id", "type", "source", "target")
    for s in ("source", "target"):
        end = F.struct("name", "entity_type", (F.col("state") == "REJECTED").alias("bad"))
        rows = rows.join(entities.select(F.col("id").alias(s), end.alias(f"{s}_end")), s, "left")
    bad = lambda s: F.when(F.col(f"{s}_end.bad"), F.col(f"{s}_end.name"))
    rejected = F.coalesce(bad("source"), bad("target"))
    problem = facts.rule_problem(F.col("type"), F.col("source_end.entity_type"), F.col("target_end.entity_type"))
    both = F.col("source_end").isNotNull() & F.col("target_end").isNotNull()
    told = F.concat(F.lit("a "), F.col("type"), F.lit(" relationship depends on the rejected entity '"), rejected, F.lit("'."))
    found = lambda order, summary: F.struct(F.lit(order).alias("detector"), summary.alias("summary"))
    wrong = F.concat_ws(" ", F.col("source_end.name"), "type", F.concat(F.col("target_end.name"), F.lit(":")), problem)
    drafts = F.array_compact(F.array(F.when(rejected.isNotNull(), found(2, told)), F.when(both & problem.isNotNull(), found(5, wrong))))
    rows = rows.select("id", F.explode(drafts).alias("x"))
    kind = F.when(F.col("x.detector") == 2, "DANGLING_RELATIONSHIP").otherwise("INCONSISTENT_RELATIONSHIP_TYPE")
    return draft(rows, kind, F.when(F.col("x.detector") == 2, "MEDIUM").otherwise("LOW"), F.concat(F.lit("relationship:"), F.col("id")), F.col("x.summary"), F.col("x.detector"))


def possible_duplicates(entities: DataFrame, decisions: DataFrame) -> DataFrame:
    """decisions (pair_key, a, b, decision)."""
    active = facts.active_entities(entities)
    rows = decisions.where("decision = 'UNSURE'")
    for s in "ab":
        rows = rows.join(active.select(F.col("id").alias(s), F.col("name").alias(f"name_{s}")), s)
    return draft(rows, "POSSIBLE_DUPLICATE", "LOW", F.col("pair_key"), F.concat(F.lit("'"), F.col("name_a"), F.lit("' and '"), F.col("name_b"), F.lit("' may be the same.")), 3)


def conflicting(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    kinds = facts.active_entities(entities).groupBy("normalized").agg(F.countDistinct(type_group(F.col("entity_type"))).alias("groups"), F.array_sort(F.collect_set("entity_type")).alias("kinds"), F.min_by("name", "created_rank").alias("name")).where("groups > 1")
    out = draft(kinds, "CONFLICTING_DECLARATION", "MEDIUM", F.concat(F.lit("types:"), F.col("normalized")), F.concat(F.lit("'"), F.col("name"), F.lit("' is declared as more than one kind of element ("), F.array_join("kinds", ", "), F.lit(").")), 4)
    # The stated types of each pair of ends together, so that a relationship is dealt once for all opposing types.
    told = sorted({t for pair in facts.OPPOSING for t in pair})
    stated = facts.active_relationships(relationships).where(F.col("type").isin(told) & F.col("source").isNotNull() & F.col("target").isNotNull())
    stated = stated.groupBy("source", "target").agg(*(F.max(F.col("type") == t).alias(t) for t in told))
    for a, b in facts.OPPOSING:
        key = F.concat_ws(":", F.lit("opposing"), "source", "target", F.lit(a), F.lit(b))
        out = out.unionByName(draft(stated.where(F.col(a) & F.col(b)), "CONFLICTING_DECLARATION", "MEDIUM", key, F.concat(F.lit("'"), F.col("source"), F.lit(f"' is stated to both {a} and {b} '"), F.col("target"), F.lit("'.")), 4))
    return out


def alias_conflicts(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """aliases (entity_id, alias, owner): stated for an entity though they belong to another."""
    rows = aliases.where("entity_id <> owner").join(facts.active_entities(entities).select(F.col("id").alias("entity_id"), "name"), "entity_id")
    return draft(rows, "UNRESOLVED_ALIAS", "LOW", F.concat_ws(":", F.lit("alias"), "entity_id", F.lower("alias")), F.concat(F.lit("the alias '"), F.col("alias"), F.lit("' stated for '"), F.col("name"), F.lit("' already belongs to a different entity.")), 6)


def distinct_drafts(drafts: list[DataFrame]) -> DataFrame:
    """One draft per fingerprint; that of the later detector stays."""
    # A fingerprint stands for kind and key; these are dealt, and it is made of those that stay.
    rows = reduce(DataFrame.unionByName, drafts)
    best = rows.groupBy("finding_type", "key").agg(F.max_by(F.struct("severity", "summary"), F.struct("detector", "summary")).alias("x"))
    return best.select(fingerprint(F.col("finding_type"), F.col("key")).alias("fingerprint"), "finding_type", "x.severity", "key", "x.summary")


def sync(existing: DataFrame, drafts: DataFrame) -> DataFrame:
    """existing (fingerprint, status) against drafts (fingerprint): the new status and what happened.

    New ones open, resolved ones open again, dismissed ones stay, open ones that are gone are resolved.
    """
    both = existing.select("fingerprint", F.col("status").alias("old")).join(drafts.select("fingerprint", F.lit(True).alias("seen")), "fingerprint", "full_outer")
    seen = F.coalesce("seen", F.lit(False))
    event = F.when(seen & F.col("old").isNull(), "OPENED").when(seen & (F.col("old") == "RESOLVED"), "REOPENED").when(~seen & (F.col("old") == "OPEN"), "RESOLVED").otherwise("UNCHANGED")
    status = F.when(event.isin("OPENED", "REOPENED"), "OPEN").when(event == "RESOLVED", "RESOLVED").otherwise(F.col("old"))
    return both.select("fingerprint", "old", status.alias("status"), event.alias("event"))


def reviewed(findings: DataFrame, actions: DataFrame) -> DataFrame:
    """findings (fingerprint, status) after actions (fingerprint, seq, action: dismiss or reopen, reason), in the order of seq.

    A dismissal needs a reason; reopening takes back a dismissal only, and leaves other states.  What doesn't hold changes nothing.
    """
    valid = actions.where((F.col("action") == "reopen") | ((F.col("action") == "dismiss") & (F.trim(F.coalesce("reason", F.lit(""))) != "")))
    folded = valid.groupBy("fingerprint").agg(F.max_by("action", "seq").alias("last"), F.count(F.when(F.col("action") == "dismiss", 1)).alias("dismissals"), F.max_by("reason", F.when(F.col("action") == "dismiss", F.col("seq"))).alias("reason"))
    status = F.when(F.col("last") == "dismiss", "DISMISSED").when((F.col("last") == "reopen") & ((F.col("dismissals") > 0) | (F.col("status") == "DISMISSED")), "OPEN").otherwise(F.col("status"))
    return findings.select("fingerprint", "status").join(folded, "fingerprint", "left").select("fingerprint", status.alias("status"), F.when(F.col("last") == "dismiss", F.trim("reason")).alias("reason"))
