"""Filters, joins and aggregates over entities, relationships and their evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Factors of the confidence rule.
INFERRED_FACTOR, OCR_FACTOR, CORROBORATION = "0.85", "0.95", "0.02"


def live_entities(entities: DataFrame) -> DataFrame:
    """Neither merged nor superseded."""
    return entities.where(F.col("merged_into").isNull() & F.col("superseded_by").isNull())


def active_entities(entities: DataFrame) -> DataFrame:
    return live_entities(entities).where(F.col("state") != "REJECTED")


def live_relationships(relationships: DataFrame) -> DataFrame:
    """Not superseded, and without an inactive reason."""
    return relationships.where(F.col("superseded_by").isNull() & ~F.col("inactive"))


def active_relationships(relationships: DataFrame) -> DataFrame:
    return live_relationships(relationships).where(F.col("state") != "REJECTED")


def confidence(raw: Column, extraction: Column, evidence: Column, ocr_only: Column | None = None) -> Column:
    """Derived from the evidence alone: inferred facts are discounted, repeated ones gain a little, half-even to three digits."""
    dec = lambda v: F.lit(v).cast("decimal(4,2)")
    value = raw.cast("decimal(10,6)") * F.when(extraction == "INFERRED", dec(INFERRED_FACTOR)).otherwise(dec("1"))
    if ocr_only is not None:
        value = value * F.when(ocr_only, dec(OCR_FACTOR)).otherwise(dec("1"))
    value = F.when(evidence == 0, dec("0")).when(evidence > 1, F.least(dec("1").cast("decimal(20,10)"), (value + dec(CORROBORATION)).cast("decimal(20,10)"))).otherwise(value.cast("decimal(20,10)"))
    return F.bround(value.cast("decimal(20,10)"), 3).cast("decimal(4,3)")


def list_entities(entities: DataFrame, aliases: DataFrame, entity_type: str | None = None, state: str | None = None, text: str | None = None, offset: int = 0, limit: int = 50) -> DataFrame:
    """Live entities by type, state and a text in their name or one of their aliases, with the total, in order of name and id."""
    rows = live_entities(entities)
    if entity_type:
        rows = rows.where(F.col("entity_type") == entity_type)
    if state:
        rows = rows.where(F.col("state") == state)
    if text:
        by_alias = aliases.where(F.col("alias").ilike(f"%{text}%")).select(F.col("entity_id").alias("id"))
        by_name = rows.where(F.col("name").ilike(f"%{text}%")).select("id")
        rows = rows.join(by_name.union(by_alias).distinct(), "id", "left_semi")
    return page(rows, ["name", "id"], offset, limit)


def page(rows: DataFrame, order: list, offset: int = 0, limit: int = 50) -> DataFrame:
    """A page in a total order, with the number of all rows as total; nothing runs until it is read."""
    total = rows.agg(F.count("*").alias("total"))  # one row, so the join is no product
    return rows.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))


def with_endpoints(relationships: DataFrame, entities: DataFrame) -> DataFrame:
    """Relationships whose two ends are in entities, with name and type of each."""
    side = lambda s: entities.select(F.col("id").alias(s), F.col("name").alias(f"{s}_name"), F.col("entity_type").alias(f"{s}_type"))
    return relationships.join(side("source"), "source").join(side("target"), "target")


# Fixed values, down to SPREAD: a relationship type, the entity types it may start at, and those it may end at; * is any.
RULES = {
    kind: tuple(None if ends == "*" else ends.split() for ends in (sources, targets))
    for kind, sources, targets in [
        ("PROVIDES", "COMPONENT SOFTWARE_COMPONENT PORT ECU", "INTERFACE SIGNAL DATA_ELEMENT FUNCTION"),
        ("REQUIRES", "COMPONENT SOFTWARE_COMPONENT FUNCTION RUNNABLE ECU PORT FUNCTIONAL_FLOW", "INTERFACE SIGNAL DATA_ELEMENT COMPONENT SOFTWARE_COMPONENT FUNCTION REQUIREMENT"),
        ("USES", "COMPONENT SOFTWARE_COMPONENT FUNCTION RUNNABLE ECU PORT", "INTERFACE SIGNAL DATA_ELEMENT DATA_TYPE COMPONENT SOFTWARE_COMPONENT FUNCTION"),
        ("CONSUMES", "COMPONENT SOFTWARE_COMPONENT FUNCTION RUNNABLE ECU PORT", "INTERFACE SIGNAL DATA_ELEMENT"),
        ("PRODUCES", "COMPONENT SOFTWARE_COMPONENT FUNCTION RUNNABLE ECU PORT", "INTERFACE SIGNAL DATA_ELEMENT"),
        ("CARRIES", "INTERFACE COMMUNICATION_CHANNEL PORT", "SIGNAL DATA_ELEMENT DATA_TYPE"),
        ("DEPENDS_ON", "*", "*"),
        ("CONNECTS_TO", "PORT COMPONENT SOFTWARE_COMPONENT ECU COMMUNICATION_CHANNEL", "PORT COMPONENT SOFTWARE_COMPONENT ECU COMMUNICATION_CHANNEL"),
        ("PART_OF", "*", "COMPONENT SOFTWARE_COMPONENT ECU INTERFACE FUNCTIONAL_FLOW REQUIREMENT COMMUNICATION_CHANNEL"),
        ("IMPLEMENTED_BY", "REQUIREMENT INTERFACE FUNCTIONAL_FLOW FUNCTION", "COMPONENT SOFTWARE_COMPONENT FUNCTION RUNNABLE ECU"),
        ("PRECEDES", "COMPONENT SOFTWARE_COMPONENT FUNCTION RUNNABLE ECU FUNCTIONAL_FLOW", "COMPONENT SOFTWARE_COMPONENT FUNCTION RUNNABLE ECU FUNCTIONAL_FLOW"),
        ("TRIGGERS", "COMPONENT SOFTWARE_COMPONENT FUNCTION RUNNABLE ECU FUNCTIONAL_FLOW SIGNAL", "COMPONENT SOFTWARE_COMPONENT FUNCTION RUNNABLE ECU FUNCTIONAL_FLOW"),
        ("SENDS_TO", "COMPONENT SOFTWARE_COMPONENT FUNCTION RUNNABLE ECU PORT", "COMPONENT SOFTWARE_COMPONENT FUNCTION RUNNABLE ECU PORT COMMUNICATION_CHANNEL"),
        ("VERIFIED_BY", "REQUIREMENT FUNCTION COMPONENT SOFTWARE_COMPONENT INTERFACE", "TEST_CASE"),
    ]
}
OPPOSING = [("PROVIDES", "CONSUMES"), ("PROVIDES", "REQUIRES")]
#: How a change spreads along a type: IN from an edge's target to its source, OUT the other way.
SPREAD = {
    "REQUIRES": "IN", "USES": "IN", "DEPENDS_ON": "IN", "CONSUMES": "IN", "PROVIDES": "IN OUT", "PRODUCES": "IN OUT", "CARRIES": "IN OUT", "CONNECTS_TO": "IN OUT", "PART_OF": "IN OUT",
    "IMPLEMENTED_BY": "IN OUT", "PRECEDES": "OUT", "TRIGGERS": "OUT", "SENDS_TO": "OUT", "VERIFIED_BY": "OUT",
}


def allowed_types(kind: Column, end: int) -> Column:
    """The entity types that a relationship type may have at its source (end 0) or target (1); null: any."""
    rows = [x for name, ends in RULES.items() if ends[end] is not None for x in (F.lit(name), F.array(*map(F.lit, ends[end])))]
    return F.create_map(*rows)[kind]


def rule_problem(kind: Column, source_type: Column, target_type: Column) -> Column:
    """What a relationship's ends violate, or null; the source is looked at first."""
    bad = lambda end, found: ~F.array_contains(allowed_types(kind, end), found)
    said = lambda verb, found: F.concat(kind, F.lit(f" is not expected to {verb} at a "), found, F.lit("."))
    return F.when(bad(0, source_type), said("start", source_type)).when(bad(1, target_type), said("end", target_type))


def component_report(entities: DataFrame, relationships: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per name of a live component: sorted targets per type, what requires or uses it, evidence and its first source.

    evidence: relationship id, chunk_id and an order of chunks.
    """
    live = live_entities(entities)
    edges = with_endpoints(active_relationships(relationships), live)
    outgoing = edges.where(F.col("source_type").isin("COMPONENT", "SOFTWARE_COMPONENT")).select("id", F.col("source_name").alias("component"), "type", F.col("target_name").alias("other"))
    listed = lambda kind: F.array_join(F.array_sort(F.collect_list(F.when(F.col("type") == kind, F.col("other")))), "; ").alias(kind.lower())
    pivot = outgoing.groupBy("component").agg(*map(listed, ("PROVIDES", "REQUIRES", "USES")), F.count("*").alias("n_relationships"))
    proof = outgoing.join(evidence, "id").groupBy("component").agg(F.count("*").alias("n_evidence"), F.min_by("chunk_id", "rank").alias("first_source"))
    names = live.where(F.col("entity_type").isin("COMPONENT", "SOFTWARE_COMPONENT")).select(F.col("name").alias("component")).distinct()
    report = names.join(pivot, "component", "left").join(proof, "component", "left")
    return report.select("component", *(F.coalesce(c, F.lit("")).alias(c) for c in ("provides", "requires", "uses")), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_relationships", "n_evidence")), "first_source")


def name_index(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """normalized name or alias -> entity, once per owner."""
    return entities.select("normalized", "id").union(aliases.select("normalized", F.col("entity_id").alias("id"))).where("normalized <> ''").distinct()


def owners_by_name(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """One row per name of live entities, with its usable owners per type: a name with many owners costs who asks no more than one with few."""
    live = live_entities(entities)
    owners = name_index(live, aliases).join(live.select("id", "state", "entity_type"), "id")
    usable = F.col("state") != "REJECTED"
    kinds = owners.groupBy("normalized", "entity_type").agg(F.count("*").alias("n"), F.count(F.when(usable, 1)).alias("usable"), F.min(F.when(usable, F.col("id"))).alias("first"))
    return kinds.groupBy("normalized").agg(F.sum("n").alias("n"), F.sum("usable").alias("usable"), F.min("first").alias("one"), F.collect_list(F.struct("entity_type", "usable", "first")).alias("kinds"))


def bind_side(rows: DataFrame, index: DataFrame, side: str, end: int) -> DataFrame:
    """rows (type, normalized_<side>) with <side>_state and <side>_id, by the index of owners_by_name; end is 0 for sources, 1 for targets."""
    found = rows.join(index.withColumnRenamed("normalized", f"normalized_{side}"), f"normalized_{side}", "left").withColumn("allowed", allowed_types(F.col("type"), end))
    fitting = F.filter("kinds", lambda k: F.col("allowed").isNull() | F.array_contains("allowed", k["entity_type"]))
    found = found.withColumn("fitting", fitting)
    plausible = F.aggregate("fitting", F.lit(0).cast("long"), lambda s, k: s + k["usable"])
    fit = F.array_min(F.transform("fitting", lambda k: k["first"]))
    state = F.when(F.col("n").isNull(), "MISSING").when(F.col("usable") == 0, "REJECTED").when((F.col("usable") == 1) | (plausible == 1), "OK").otherwise("AMBIGUOUS")
    bound = F.when(F.col("usable") == 1, F.col("one")).when((F.col("usable") > 1) & (plausible == 1), fit)
    return found.select(*rows.columns, state.alias(f"{side}_state"), bound.alias(f"{side}_id"))


def bind_endpoints(candidates: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """candidates (id, type, source_name, target_name; normalized_*) bound to live entities.

    Per side the owners of the name: none is MISSING, only rejected ones REJECTED, several AMBIGUOUS unless the type rules leave one.
    Adds source_state, source_id, target_state and target_id.
    """
    index = owners_by_name(entities, aliases)
    return bind_side(bind_side(candidates, index, "source", 0), index, "target", 1)
