"""The engine's tables, and their mapping from the supplied star schema.

Each view of ``Views`` is a lazy DataFrame; ``SQL`` has the same mapping as common table
expressions, so that oracles state it independently.  Ids are strings, confidences decimals of three digits,
decisions are states on the rows (PENDING, HUMAN_VERIFIED, REJECTED), and pointers (merged_into) keep
merged rows in place.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heddle.functions.text import normalize_name

S, L, I, B, D = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.DecimalType(4, 3)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


#: Fixed schemas of the stored tables; attributes are maps where their keys are open.
SCHEMAS = {
    "projects": _struct(project_id=S, name=S),
    "project_members": _struct(project_id=S, user_id=S, role=S),
    "documents": _struct(document_id=S, project_id=S, name=S, media_type=S, created_by=S),
    "document_versions": _struct(version_id=S, document_id=S, version_number=I, checksum=S, label=S, properties=T.MapType(S, S)),
    "sections": _struct(section_id=S, version_id=S, parent_id=S, ordinal=I, heading=S, level=I, depth=I, path=S, page_start=I, page_end=I),
    "chunks": _struct(chunk_id=S, section_id=S, version_id=S, ordinal=I, content=S, kind=S, token_count=I, content_hash=S, lexical_text=S, embedding=T.ArrayType(T.FloatType()), embedding_model=S, page_start=I, page_end=I),
    "ocr_cache": _struct(project_id=S, cache_key=S, text=S),
    "entities": _struct(id=S, project_id=S, name=S, normalized=S, entity_type=S, state=S, confidence=D, extraction=S, merged_into=S, superseded_by=S, created_rank=L),
    "entity_aliases": _struct(entity_id=S, alias=S, normalized=S),
    "relationships": _struct(id=S, source=S, target=S, type=S, state=S, confidence=D, extraction=S, superseded_by=S, attributes=T.MapType(S, S)),
    "relationship_candidates": _struct(id=S, chunk_id=S, source_name=S, target_name=S, type=S, confidence=D, extraction=S, excerpt=S),
    "entity_merges": _struct(id=S, merged_id=S, survivor_id=S, method=S, similarity=D, undone=B, created_at=T.TimestampType()),
    "merge_decisions": _struct(pair_key=S, entity_a=S, entity_b=S, decision=S, decided_by=S, reason=S, confidence=D, fingerprint=S),
    "findings": _struct(fingerprint=S, finding_type=S, severity=S, status=S, summary=S, entity_id=S, relationship_id=S, confidence=D),
    "entity_evidence": _struct(entity_id=S, chunk_id=S, excerpt=S, start=I, stop=I, classification=S),
    "relationship_evidence": _struct(relationship_id=S, chunk_id=S, excerpt=S, start=I, stop=I, classification=S),
    "validation_events": _struct(id=S, entity_id=S, relationship_id=S, from_state=S, to_state=S, actor=S, created_at=T.TimestampType()),
    "audit_events": _struct(id=S, actor=S, action=S, details=T.MapType(S, S), created_at=T.TimestampType()),
    "jobs": _struct(id=S, kind=S, state=S, idempotency_key=S, attempts=I, run_after=T.TimestampType(), lease_until=T.TimestampType(), next_job_id=S, created_at=T.TimestampType()),
    "comparisons": _struct(id=S, base_version=S, target_version=S, created_at=T.TimestampType()),
    "comparison_findings": _struct(comparison_id=S, scope=S, classification=S, severity=S, summary=S),
}


class Views:
    """The mapped views of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def entities(self) -> DataFrame:
        """id, name, normalized, entity_type, state, merged_into, superseded_by, confidence, created_rank."""
        sides = []
        for table, key, name, mark, kind in (("supplier", "s_suppkey", "s_name", "s", F.lit("COMPONENT")), ("customer", "c_custkey", "c_name", "c", F.lit("ECU")), ("part", "p_partkey", "p_name", "p", F.col("p_type"))):
            rows = self.table(table).select(F.col(key).alias("k"), F.col(name).alias("name"), kind.alias("kind"))
            sides.append(rows.select(F.concat(F.lit(mark), F.col("k").cast("string")).alias("id"), F.lit(mark).alias("mark"), "k", "name", "kind"))
        rows = sides[0].unionByName(sides[1]).unionByName(sides[2])
        word = F.substring_index("kind", " ", 1)
        kind = F.when(word.isin("ECONOMY", "STANDARD"), "INTERFACE").when(word.isin("SMALL", "MEDIUM"), "SIGNAL").when(word.isin("LARGE", "PROMO"), "DATA_ELEMENT").otherwise(F.col("kind"))
        rows = rows.select("id", "mark", "k", "name", normalize_name(F.col("name")).alias("normalized"), kind.alias("entity_type"))
        state = F.when(F.col("k") % 10 == 7, "REJECTED").when(F.col("k") % 3 == 0, "HUMAN_VERIFIED").otherwise("PENDING")
        low = F.expr("min(k) over (partition by mark, normalized, entity_type)")
        merged = F.when((F.col("mark") == "p") & (F.col("k") % 2 == 0) & (F.col("k") != F.col("low")), F.concat(F.lit("p"), F.col("low").cast("string")))
        rank = F.when(F.col("mark") == "s", 0).when(F.col("mark") == "c", 1).otherwise(2).cast("long") * 1_000_000_000_000 + F.col("k")
        return rows.withColumn("low", low).select("id", F.lit("p0").alias("project_id"), "name", "normalized", "entity_type", state.alias("state"), merged.alias("merged_into"), F.lit(None).cast("string").alias("superseded_by"), F.lit("0.900").cast(D).alias("confidence"), rank.alias("created_rank"))

    @cached_property
    def aliases(self) -> DataFrame:
        """entity_id, alias, normalized: a brand is an alias of its first part."""
        rows = self.table("part").groupBy("p_brand").agg(F.min("p_partkey").alias("k"))
        return rows.select(F.concat(F.lit("p"), F.col("k").cast("string")).alias("entity_id"), F.col("p_brand").alias("alias"), normalize_name(F.col("p_brand")).alias("normalized"))

    @cached_property
    def statements(self) -> DataFrame:
        """The evidence rows: source, target, type, confidence, explicit, chunk_id."""
        return self.statements_of(self.table("lineitem"))

    @staticmethod
    def statements_of(lines: DataFrame) -> DataFrame:
        kind = F.when(F.col("l_returnflag") == "A", "PROVIDES").when(F.col("l_returnflag") == "N", "REQUIRES").otherwise("USES")
        chunk = F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
        return lines.select(
            F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("source"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("target"), kind.alias("type"),
            F.round(1 - F.col("l_discount"), 3).cast(D).alias("confidence"), (F.col("l_linestatus") == "F").alias("explicit"), chunk.alias("chunk_id"), "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_shipdate",
        )

    @cached_property
    def relationships(self) -> DataFrame:
        """id, source, target, type, state, raw, extraction, evidence, inactive, superseded_by."""
        return self.relationships_of(self.related)

    @cached_property
    def related(self) -> DataFrame:
        """A row per relationship with its keys; ends are told from these, so the keys alone are dealt."""
        return self.statements.groupBy("l_suppkey", "l_partkey", "type").agg(F.max("confidence").alias("raw"), F.bool_or("explicit").alias("explicit"), F.count("*").alias("evidence"), F.max("l_quantity").alias("quantity"))

    @staticmethod
    def relationships_of(rows: DataFrame) -> DataFrame:
        """rows as of ``related``."""
        rows = rows.withColumns({"source": F.concat(F.lit("s"), F.col("l_suppkey").cast("string")), "target": F.concat(F.lit("p"), F.col("l_partkey").cast("string"))})
        total = F.col("l_suppkey") + F.col("l_partkey")
        state = F.when(total % 11 == 0, "REJECTED").when(total % 5 == 0, "HUMAN_VERIFIED").otherwise("PENDING")
        return rows.select(
            F.concat_ws("|", "source", "target", "type").alias("id"), "source", "target", "type", state.alias("state"), "raw", F.when(F.col("explicit"), "EXPLICIT").otherwise("INFERRED").alias("extraction"), "evidence",
            (F.col("l_partkey") % 17 == 0).alias("inactive"), F.lit(None).cast("string").alias("superseded_by"), "quantity",
        )

    @cached_property
    def versions(self) -> DataFrame:
        """doc_id, document (source/lang), version_number, checksum, status, text."""
        labels = self.table("labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("quality").alias("quality"))
        state = F.when(F.col("toxic") == 1, "REJECTED").when(F.col("quality") == 1, "HUMAN_VERIFIED").otherwise("PENDING")
        rows = self.table("documents").join(labels, "doc_id", "left")
        number = F.expr("row_number() over (partition by source, lang order by doc_id)")
        return rows.select("doc_id", F.concat_ws("/", "source", "lang").alias("document"), "source", "lang", number.alias("version_number"), F.sha2("text", 256).alias("checksum"), state.alias("state"), "text")

    @cached_property
    def chunks(self) -> DataFrame:
        """doc_id, pos, content, document: the lines with a word, as chunks of one section per document."""
        rows = self.table("documents").select("doc_id", F.concat_ws("/", "source", "lang").alias("document"), F.posexplode(F.split("text", "\n")).alias("pos", "content"))
        return rows.where(F.col("content").rlike(r"\S"))


#: The same mapping in SQL.
SQL = r"""
e0 AS (SELECT 's' AS mark, s_suppkey AS k, s_name AS name, 'COMPONENT' AS entity_type FROM supplier UNION ALL SELECT 'c', c_custkey, c_name, 'ECU' FROM customer UNION ALL
  SELECT 'p', p_partkey, p_name, CASE split_part(p_type, ' ', 1) WHEN 'ECONOMY' THEN 'INTERFACE' WHEN 'STANDARD' THEN 'INTERFACE' WHEN 'SMALL' THEN 'SIGNAL' WHEN 'MEDIUM' THEN 'SIGNAL' WHEN 'LARGE' THEN 'DATA_ELEMENT' WHEN 'PROMO' THEN 'DATA_ELEMENT' ELSE p_type END FROM part),
e1 AS (SELECT *, regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') AS normalized FROM e0),
e2 AS (SELECT *, min(k) OVER (PARTITION BY mark, normalized, entity_type) AS low FROM e1),
entities AS (SELECT mark || k AS id, name, normalized, entity_type, CASE WHEN k % 10 = 7 THEN 'REJECTED' WHEN k % 3 = 0 THEN 'HUMAN_VERIFIED' ELSE 'PENDING' END AS state,
  CASE WHEN mark = 'p' AND k % 2 = 0 AND k <> low THEN 'p' || low END AS merged_into, NULL::VARCHAR AS superseded_by, CASE mark WHEN 's' THEN 0 WHEN 'c' THEN 1 ELSE 2 END * 1000000000000 + k AS created_rank FROM e2),
aliases AS (SELECT 'p' || min(p_partkey) AS entity_id, p_brand AS alias, regexp_replace(lower(p_brand), '[^a-z0-9]+', '', 'g') AS normalized FROM part GROUP BY p_brand),
statements AS (SELECT 's' || l_suppkey AS source, 'p' || l_partkey AS target, CASE l_returnflag WHEN 'A' THEN 'PROVIDES' WHEN 'N' THEN 'REQUIRES' ELSE 'USES' END AS type,
  round(1 - l_discount, 3)::DECIMAL(4,3) AS confidence, l_linestatus = 'F' AS explicit, l_orderkey || ':' || l_linenumber AS chunk_id, * FROM lineitem),
relationships AS (SELECT source || '|' || target || '|' || type AS id, source, target, type, CASE WHEN (l_suppkey + l_partkey) % 11 = 0 THEN 'REJECTED' WHEN (l_suppkey + l_partkey) % 5 = 0 THEN 'HUMAN_VERIFIED' ELSE 'PENDING' END AS state,
  max(confidence) AS raw, CASE WHEN bool_or(explicit) THEN 'EXPLICIT' ELSE 'INFERRED' END AS extraction, count(*) AS evidence, l_partkey % 17 = 0 AS inactive, max(l_quantity) AS quantity FROM statements GROUP BY source, target, type, l_suppkey, l_partkey),
versions AS (SELECT d.doc_id, source || '/' || lang AS document, source, lang, row_number() OVER (PARTITION BY source, lang ORDER BY d.doc_id) AS version_number, sha256(text) AS checksum,
  CASE WHEN toxic = 1 THEN 'REJECTED' WHEN quality = 1 THEN 'HUMAN_VERIFIED' ELSE 'PENDING' END AS state, text FROM documents d LEFT JOIN (SELECT doc_id, max(toxic) AS toxic, max(quality) AS quality FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id),
chunks AS (SELECT * FROM (SELECT doc_id, source || '/' || lang AS document, unnest(range(len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS content FROM documents) WHERE regexp_matches(content, '\S')),
live AS (SELECT * FROM entities WHERE merged_into IS NULL AND superseded_by IS NULL),
active AS (SELECT * FROM live WHERE state <> 'REJECTED'),
liverel AS (SELECT * FROM relationships WHERE NOT inactive),
activerel AS (SELECT * FROM liverel WHERE state <> 'REJECTED')
"""
