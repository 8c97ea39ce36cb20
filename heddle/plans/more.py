"""Further operators of the inventory: answers, derived views, display and small scalar rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.functions import text as X
from heddle.operators import answers, compare, facts, graph, retrieval
from heddle.operators.embedding_index import EmbeddingIndex
from heddle.operators.graph import kept_folder
from heddle.plans.analytics import ASKED, EDGES, FUSED, HITS, JACCARD, MISSING, VERSIONED, WALK, dense, edges, fused, hits, missing_provider, roots, token_jaccard, version_edges, walk
from heddle.plans.base import query
from heddle.plans.readmodels import CONF, conf
from heddle.sources import files
from heddle.tables import Views


def pos(name: str = "pos") -> F.Column:
    return F.col(name).cast("long").alias(name)


@query("j10_fact_assembly", EDGES + """, s AS (SELECT source || '|' || target || '|' || type AS id, chunk_id, row_number() OVER (PARTITION BY source, target, type ORDER BY l_orderkey, l_linenumber, chunk_id) AS n FROM statements)
SELECT g.id, a.name || ' ' || g.type || ' ' || b.name AS fact, string_agg(s.chunk_id, ';' ORDER BY n) AS citations FROM g JOIN entities a ON a.id = g.source JOIN entities b ON b.id = g.target JOIN s ON s.id = g.id AND n <= 2 GROUP BY ALL""")
def fact_assembly(v: Views) -> DataFrame:
    evidence = v.statements.select(F.concat_ws("|", "source", "target", "type").alias("id"), "chunk_id", F.struct("l_orderkey", "l_linenumber").alias("rank"))
    return answers.assembled_facts(edges(v), evidence)


@query("t6_path_views", EDGES + "SELECT 's2' AS root, g.id, a.name || ' > ' || b.name AS names FROM g JOIN entities a ON a.id = 's2' JOIN entities b ON b.id = g.target WHERE g.source = 's2'")
def path_views(v: Views) -> DataFrame:
    return answers.path_views(graph.traverse(edges(v), roots(v, "s2"), 1, None, []), v.entities)


@query("w4_shortest_paths", WALK + ", f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY depth, path, node) AS n FROM walk) SELECT id, node, array_to_string(path, ',') AS path FROM f WHERE n = 1")
def shortest_paths(v: Views) -> DataFrame:
    return graph.shortest_per_edge(walk(v)).select("id", "node", F.array_join("path", ",").alias("path"))


@query("w6_ordinals", "SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS ordinal FROM chunks")
def ordinals(v: Views) -> DataFrame:
    return v.chunks.select("doc_id", pos(), F.expr("row_number() over (partition by doc_id order by pos)").cast("long").alias("ordinal"))


@query("w9_judge_budget", JACCARD + ", p AS (SELECT sha256(p_name || '|' || other) AS pair_key, jaccard FROM tj) SELECT pair_key, CASE WHEN row_number() OVER (ORDER BY jaccard DESC, pair_key) <= 200 THEN 'JUDGED' ELSE 'DEFERRED' END AS turn FROM p")
def judge_budget(v: Views) -> DataFrame:
    pairs = token_jaccard(v).select(F.sha2(F.concat_ws("|", "p_name", "other"), 256).alias("pair_key"), F.col("jaccard").alias("similarity"))
    return answers.budgeted(pairs, 200)


@query("w12_table_headers", ", l AS (SELECT n_regionkey AS doc, n_nationkey AS n, CASE WHEN n_nationkey % 7 = 0 THEN 'text' ELSE '| ' || n_name || ' |' END AS line FROM nation), r AS (SELECT *, line LIKE '|%' AS isrow, coalesce(lag(line LIKE '|%') OVER (PARTITION BY doc ORDER BY n), false) AS prev FROM l), s AS (SELECT *, sum(CASE WHEN isrow AND NOT prev THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY n) AS run FROM r), h AS (SELECT *, first_value(line) OVER (PARTITION BY doc, run ORDER BY n) AS header FROM s WHERE isrow) SELECT doc, n, line, header FROM h WHERE prev")
def table_headers(v: Views) -> DataFrame:
    line = F.when(F.col("n_nationkey") % 7 == 0, "text").otherwise(F.concat(F.lit("| "), "n_name", F.lit(" |")))
    return answers.table_rows(v.table("nation").select(F.col("n_regionkey").alias("doc"), F.col("n_nationkey").alias("n"), line.alias("line")))


@query("l5_facts_cap", EDGES + "SELECT id FROM g ORDER BY id LIMIT 40")
def facts_cap(v: Views) -> DataFrame:
    return edges(v).select("id").orderBy("id").limit(answers.MAX_FACTS)


@query("l6_severity_order", MISSING + " SELECT key, severity FROM m ORDER BY severity, key LIMIT 10")
def severity_order(v: Views) -> DataFrame:
    """Of the interfaces without a provider, in the order of the words."""
    return missing_provider(v).select("key", "severity").orderBy("severity", "key").limit(10)


@query("l7_comparison_order", VERSIONED + ", d AS (SELECT id, 'REMOVED' AS change FROM ba WHERE id NOT IN (SELECT id FROM nw) UNION ALL SELECT id, 'ADDED' FROM nw WHERE id NOT IN (SELECT id FROM ba)) SELECT row_number() OVER (ORDER BY CASE change WHEN 'REMOVED' THEN 0 ELSE 1 END, id) AS place, id FROM d ORDER BY place LIMIT 100")
def comparison_order(v: Views) -> DataFrame:
    old, new = version_edges(v)
    rows = old.join(new.select("id"), "id", "left_anti").select("id", F.lit(0).alias("o")).unionByName(new.join(old.select("id"), "id", "left_anti").select("id", F.lit(1).alias("o")))
    first = rows.orderBy("o", "id").limit(100)
    return first.select(F.expr("row_number() over (order by o, id)").cast("long").alias("place"), "id")


@query("l8_node_limit", WALK + ", d AS (SELECT node, min(depth) AS depth FROM walk WHERE node <> 's1' GROUP BY node) SELECT node, (SELECT count(*) FROM d) > 20 AS truncated FROM d ORDER BY depth, node LIMIT 20")
def node_limit(v: Views) -> DataFrame:
    depths = graph.node_depths(walk(v))
    return graph.limited(depths, ["depth", "node"], 20).select("node", "truncated")


@query("u5_shared_names", "SELECT DISTINCT a.id FROM live a JOIN aliases b ON b.normalized = a.normalized OR b.entity_id = a.id")
def shared_names(v: Views) -> DataFrame:
    live, alias = facts.live_entities(v.entities), v.aliases
    by_name = live.join(alias.select(F.col("normalized")), "normalized", "left_semi").select("id")
    return by_name.union(live.join(alias.select(F.col("entity_id").alias("id")), "id", "left_semi").select("id")).distinct()


@query("u7_block_roles", HITS + """, b AS (SELECT c.doc_id || ':' || c.pos AS id, CASE WHEN c.pos = h.pos THEN 0 ELSE 2 END AS turn FROM hits h JOIN chunks c ON c.doc_id = h.doc_id AND c.pos BETWEEN h.pos - 1 AND h.pos + 1 UNION ALL SELECT doc_id || ':' || min(pos), 1 FROM chunks GROUP BY doc_id)
SELECT id, CASE min(turn) WHEN 0 THEN 'HIT' WHEN 1 THEN 'PARENT_LEAD' ELSE 'NEIGHBOR' END AS role FROM b GROUP BY id""")
def block_roles(v: Views) -> DataFrame:
    """The longest line of each document with its neighbours, and the document's first line."""
    block = F.concat_ws(":", F.col("doc_id").cast("string"), F.col("pos").cast("string")).alias("id")
    around = retrieval.context_blocks(hits(v).withColumn("query", F.lit("q")), v.chunks).select(block, "role")
    leads = v.chunks.groupBy("doc_id").agg(F.min("pos").alias("pos")).select(block, F.lit("PARENT_LEAD").alias("role"))
    return answers.merged_blocks(around.unionByName(leads))


@query("a15_page_ranges", "SELECT doc_id, min(CASE WHEN pos % 3 > 0 THEN pos END) AS first, max(CASE WHEN pos % 3 > 0 THEN pos END) AS last FROM chunks GROUP BY doc_id")
def page_ranges(v: Views) -> DataFrame:
    page = F.when(F.col("pos") % 3 > 0, F.col("pos").cast("long"))
    return v.chunks.groupBy("doc_id").agg(F.min(page).alias("first"), F.max(page).alias("last"))


@query("a16_body_size", "SELECT document, arg_max(size, w * 1000 - size) AS size FROM (SELECT document, length(content) % 4 AS size, sum(length(content)) AS w FROM chunks GROUP BY ALL) GROUP BY document")
def body_size(v: Views) -> DataFrame:
    sizes = v.chunks.groupBy("document", (F.length("content") % 4).cast("long").alias("size")).agg(F.sum(F.length("content")).alias("w"))
    return sizes.groupBy("document").agg(F.max_by("size", F.struct("w", (-F.col("size")).alias("s"))).alias("size"))


@query("a18_indexing_counters", "SELECT count(*) AS total, count(*) - count(DISTINCT text) AS reused, count(DISTINCT text) AS computed FROM documents WHERE text IS NOT NULL")
def indexing_counters(v: Views) -> DataFrame:
    """One run over all documents: equal texts are embedded once."""
    index = EmbeddingIndex(v.spark, kept_folder(v.spark, "embeddings"))
    index.run(v.table("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content")), lambda c: F.array(F.length(c).cast("double")), "length", "1")
    return index.runs().select("total", "reused", "computed")


@query("x7_opposite_qualifiers", "SELECT user_id, user_id % 3 = 0 AS opposite FROM (SELECT DISTINCT user_id FROM events)")
def opposite_qualifiers(v: Views) -> DataFrame:
    a = F.when(F.col("user_id") % 3 == 0, "WheelSpeed_FL").otherwise("WheelSpeed_Raw")
    return v.table("events").select("user_id").distinct().select("user_id", X.opposite_qualifier(a, F.lit("WheelSpeed_FR")).alias("opposite"))


@query("x8_identifiers", r"SELECT DISTINCT w AS word, contains(w, '_') OR (regexp_matches(w, '[0-9]') AND regexp_matches(w, '[A-Za-z]')) OR regexp_matches(w, '[a-z][A-Z]') OR regexp_matches(w, '[A-Z][A-Z]+[a-z]') AS identifier FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS w FROM documents)")
def identifiers(v: Views) -> DataFrame:
    words = v.table("documents").select(F.explode(X.tokens(F.col("text"))).alias("word")).distinct()
    return words.select("word", X.is_identifier_like(F.col("word")).alias("identifier"))


@query("x17_list_items", r"SELECT doc_id, pos, regexp_matches(content, '^\s*(?:[-*•▪●–—]|\(?[0-9a-zA-Z]{1,3}[.)])\s+') AS item FROM chunks")
def list_items(v: Views) -> DataFrame:
    return v.chunks.select("doc_id", pos(), F.col("content").rlike(X.LIST_ITEM).alias("item"))


@query("x18_leading_lines", r", t AS (SELECT doc_id, pos, content, len(regexp_extract_all(content, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents)), s AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY pos) AS used FROM t), k AS (SELECT *, max(CASE WHEN (used > 150 AND pos > 0) OR used - n >= 150 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS over FROM s) SELECT doc_id, sha256(string_agg(content, chr(10) ORDER BY pos)) AS digest FROM k WHERE over = 0 GROUP BY doc_id")
def leading_lines(v: Views) -> DataFrame:
    return v.table("documents").select("doc_id", F.sha2(answers.excerpt_of(F.col("text"), 150), 256).alias("digest"))


@query("x19_heading_numbers", "SELECT p_partkey, (p_size % 9 + 1) || '.' || (p_partkey % 7) AS number, p_name AS title, 2 AS depth FROM part")
def heading_numbers(v: Views) -> DataFrame:
    line = F.concat((F.col("p_size") % 9 + 1).cast("string"), F.lit("."), (F.col("p_partkey") % 7).cast("string"), F.lit(" "), "p_name")
    rows = v.table("part").select("p_partkey", X.split_number(line).alias("x"))
    return rows.select("p_partkey", "x.number", "x.title", X.number_depth(F.col("x.number")).alias("depth"))


@query("x23_statement_counts", r"""SELECT doc_id, sum(n)::BIGINT AS n FROM (SELECT doc_id, len(list_filter(string_split(regexp_replace(trim(content, chr(32) || chr(9) || chr(13)), '([.!?])\s+([A-Z0-9`"''(\[])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x) <> '')) AS n FROM chunks WHERE NOT starts_with(trim(content), '|') UNION ALL SELECT doc_id, CASE WHEN regexp_matches(trim(content), '^[|\s:-]+$') THEN 0 ELSE 1 END FROM chunks WHERE starts_with(trim(content), '|')) GROUP BY doc_id""")
def statement_counts(v: Views) -> DataFrame:
    rows = v.chunks.select("doc_id", F.size(X.statements(F.col("content"))).alias("n"))
    return rows.groupBy("doc_id").agg(F.sum("n").cast("long").alias("n"))


@query("x25_citations", "SELECT s_suppkey, 'chunk:' || lpad(s_suppkey::VARCHAR, 8, '0') || '-0000-4000-8000-' || lpad(s_nationkey::VARCHAR, 12, '0') AS ids FROM supplier")
def citations(v: Views) -> DataFrame:
    uuid = F.concat(F.lpad(F.col("s_suppkey").cast("string"), 8, "0"), F.lit("-0000-4000-8000-"), F.lpad(F.col("s_nationkey").cast("string"), 12, "0"))
    return v.table("supplier").select("s_suppkey", F.array_join(X.citation_ids(F.concat(F.lit("see [Chunk:"), F.upper(uuid), F.lit("] and "), uuid)), ",").alias("ids"))


@query("x30_section_keys", "SELECT n_nationkey, lower(r_name) || ' > ' || lower(n_name) AS key FROM nation JOIN region ON r_regionkey = n_regionkey")
def section_keys(v: Views) -> DataFrame:
    path = F.concat(F.lit("1 "), "r_name", F.lit(" > 1."), F.col("n_nationkey").cast("string"), F.lit(" "), "n_name")
    return v.table("nation").join(v.table("region"), F.col("r_regionkey") == F.col("n_regionkey")).select("n_nationkey", X.section_key(path).alias("key"))


@query("x31_status_texts", f"SELECT id, 'Confidence ' || printf('%.2f', floor({CONF} * 100 + 0.5) / 100) || ' · ' || extraction || ' · ' || state AS status FROM relationships")
def status_texts(v: Views) -> DataFrame:
    return v.relationships.select("id", answers.display(conf(), F.col("extraction"), F.col("state")).alias("status"))


@query("m11_groundedness", ", c AS (SELECT user_id AS question, event_type <> 'error' AS supported, 0.5 + (event_id % 5) / 10.0 AS support FROM events) SELECT question, count(*) FILTER (supported) AS kept, count(*) FILTER (NOT supported) AS dropped, round(coalesce(count(*) FILTER (supported) / count(*)::DOUBLE * (avg(support::DOUBLE) FILTER (supported)), 0), 2) AS groundedness, CASE WHEN count(*) FILTER (supported) = 0 THEN 'INSUFFICIENT_EVIDENCE' ELSE 'ANSWERED' END AS status FROM c GROUP BY question")
def groundedness(v: Views) -> DataFrame:
    return answers.answer(v.table("events").select(F.col("user_id").alias("question"), (F.col("event_type") != "error").alias("supported"), (0.5 + F.col("event_id") % 5 / 10).alias("support")))


@query("q3_fused_ranks", FUSED + " SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY round(fused, 9) DESC, id) AS place FROM fu")
def fused_ranks(v: Views) -> DataFrame:
    rows = fused(v).withColumn("fused", F.round("fused", 9))
    return rows.select("query", "id", F.expr("row_number() over (partition by query order by fused desc, id)").cast("long").alias("place"))


@query("l2_nearest", ASKED + " SELECT query, id FROM dr WHERE rank <= 5")
def nearest(v: Views) -> DataFrame:
    return dense(v, 5).select("query", "id")


@query("q17_embedding_widths", "SELECT vec_id, len(embedding)::INTEGER AS width FROM embeddings")
def embedding_widths(v: Views) -> DataFrame:
    return v.table("embeddings").select("vec_id", F.size(retrieval.checked_embedding(F.col("embedding"), 64)).alias("width"))


@query("q9_dropped_claims", "SELECT event_type AS question, count(*) FILTER (value >= 20) AS kept, count(*) FILTER (NOT value >= 20) AS dropped FROM events GROUP BY 1")
def dropped_claims(v: Views) -> DataFrame:
    return answers.answer(v.table("events").select(F.col("event_type").alias("question"), (F.col("value") >= 20).alias("supported"), F.lit(1.0).alias("support"))).select("question", "kept", "dropped")


@query("r8_legacy_resolution")
def legacy_resolution(v: Views) -> DataFrame:
    """Each part's name and brand, as it is and without its last letter, against all live entities and their aliases, within its kind."""
    live = facts.live_entities(v.entities).select("id", "normalized", F.col("entity_type").alias("kind"))
    parts = v.entities.where("id like 'p%'").select(F.col("entity_type").alias("kind"), F.substring("id", 2, 20).cast("long").alias("p_partkey"), "name").join(v.table("part").select("p_partkey", "p_brand"), "p_partkey")
    spelled = F.explode(F.array("name", "p_brand", F.expr("left(name, length(name) - 1)"), F.expr("left(p_brand, length(p_brand) - 1)")))
    mentions = parts.select("kind", spelled.alias("mention")).distinct().withColumn("normalized", X.normalize_name(F.col("mention")))
    return answers.legacy_resolution(mentions, live, v.aliases.select(F.col("entity_id").alias("id"), "normalized"))


@query("r10_validation", f"SELECT id, CASE WHEN state <> 'PENDING' THEN state WHEN tt NOT IN ('INTERFACE', 'SIGNAL', 'DATA_ELEMENT') OR {CONF} <= 0 THEN 'REJECTED' ELSE 'PENDING' END AS outcome FROM relationships JOIN (SELECT id AS tid, entity_type AS tt FROM entities) ON tid = target")
def validation(v: Views) -> DataFrame:
    edges = facts.with_endpoints(v.relationships, v.entities)
    holds = facts.rule_problem(F.col("type"), F.col("source_type"), F.col("target_type")).isNull()
    return edges.select("id", answers.validation_outcome(F.col("state"), conf(), F.col("evidence"), holds).alias("outcome"))


@query("t11_undone_merges", "SELECT id AS merged, merged_into AS survivor, CASE WHEN created_rank % 3 = 0 THEN 'DIFFERENT' ELSE 'MERGED' END AS decision FROM entities WHERE merged_into IS NOT NULL")
def undone_merges(v: Views) -> DataFrame:
    merges = v.entities.where("merged_into is not null").select(F.col("id").alias("merged"), F.col("merged_into").alias("survivor"), "created_rank")
    return answers.undone(merges.select("merged", "survivor"), merges.where("created_rank % 3 = 0").select("merged"))


@query("d1_section_pairs", ", s AS (SELECT v.document, v.version_number AS n, c.pos AS ordinal, c.content AS key FROM chunks c JOIN versions v ON v.doc_id = c.doc_id), o AS (SELECT *, row_number() OVER (PARTITION BY document, n, key ORDER BY ordinal) AS k FROM s) SELECT o.document || '#' || o.n AS pair, o.ordinal AS old, w.ordinal AS new FROM o JOIN o w ON w.document = o.document AND w.n = o.n + 1 AND w.key = o.key AND w.k = o.k")
def section_pairs(v: Views) -> DataFrame:
    """Lines stand in for sections, the whole line for the key; every version against its successor."""
    rows = v.chunks.join(v.versions.select("doc_id", "version_number"), "doc_id").select("document", "version_number", F.col("pos").cast("long").alias("ordinal"), F.col("content").alias("key"))
    pair = lambda shift: F.concat_ws("#", "document", (F.col("version_number") - shift).cast("string")).alias("pair")
    paired = compare.pair_sections_by_key(rows.select(pair(0), "ordinal", "key"), rows.select(pair(1), "ordinal", "key"))
    return paired.where("how = 'SAME_PATH'").select("pair", "old", "new")


@query("d1_all_passes")
def all_passes(v: Views) -> DataFrame:
    """Lines stand in for sections: a line's first two words for the parent, the next four for the heading; every version against its successor."""
    words = F.filter(F.split(F.lower("content"), r"[^a-z0-9]+"), lambda w: w != "")
    key = F.concat_ws(" > ", F.array_join(F.slice(words, 1, 2), " "), F.nullif(F.array_join(F.slice(words, 3, 4), " "), F.lit("")))
    rows = v.chunks.join(v.versions.select("doc_id", "version_number"), "doc_id").select("document", "version_number", F.col("pos").cast("long").alias("ordinal"), key.alias("key"))
    rows = graph.settled(rows)  # both sides of the pairs are read from it
    pair = lambda shift: F.concat_ws("#", "document", (F.col("version_number") - shift).cast("string")).alias("pair")
    return compare.pair_sections(rows.select(pair(0), "ordinal", "key"), rows.select(pair(1), "ordinal", "key"))


@query("d10_change_groups", VERSIONED + ", d AS (SELECT source AS scope, 'REMOVED' AS change FROM ba WHERE id NOT IN (SELECT id FROM nw) UNION ALL SELECT source, 'ADDED' FROM nw WHERE id NOT IN (SELECT id FROM ba)) SELECT scope || ':' || change AS grp, count(*) AS n FROM d GROUP BY 1")
def change_groups(v: Views) -> DataFrame:
    old, new = version_edges(v)
    part = lambda a, b, change: a.join(b.select("id"), "id", "left_anti").select(F.concat_ws(":", "source", F.lit(change)).alias("grp"))
    return part(old, new, "REMOVED").union(part(new, old, "ADDED")).groupBy("grp").agg(F.count("*").alias("n"))


@query("e2_classification", "SELECT doc_id, pos, CASE WHEN doc_id % 4 = 0 THEN 'OCR_TEXT' ELSE 'NATIVE_TEXT' END AS classification FROM chunks")
def classification(v: Views) -> DataFrame:
    kind = F.when(F.col("doc_id") % 4 == 0, "OCR_TEXT").otherwise("TEXT")
    return v.chunks.select("doc_id", pos(), F.when(kind == "OCR_TEXT", "OCR_TEXT").otherwise("NATIVE_TEXT").alias("classification"))


@query("f8_version_scope", "SELECT c.doc_id, count(*) AS n FROM chunks c WHERE c.doc_id IN (SELECT doc_id FROM versions WHERE version_number = 1) GROUP BY c.doc_id")
def version_scope(v: Views) -> DataFrame:
    first = v.versions.where("version_number = 1").select("doc_id")
    return v.chunks.join(first, "doc_id", "left_semi").groupBy("doc_id").agg(F.count("*").alias("n"))


@query("s1_upload_checks", "SELECT page_id, CASE WHEN html IS NULL OR octet_length(encode(html)) = 0 THEN 'empty file' WHEN page_id % 3 = 0 THEN 'not a PDF file' WHEN page_id % 3 = 1 THEN 'media type does not match the extension' END AS problem FROM pages")
def upload_checks(v: Views) -> DataFrame:
    name = F.concat(F.col("page_id").cast("string"), F.when(F.col("page_id") % 3 == 0, ".pdf").otherwise(".md"))
    media = F.when(F.col("page_id") % 3 == 0, "application/pdf").when(F.col("page_id") % 3 == 1, "image/png").otherwise("text/plain; charset=utf-8")
    return v.table("pages").select("page_id", files.upload_problem(name, media, F.col("html").cast("binary")).alias("problem"))


@query("s10_ocr_cache", ", k AS (SELECT DISTINCT 'p:m:1:' || sha256(html) AS cache_key, page_id % 2 = 0 AS hit FROM pages) SELECT hit, count(*) AS n FROM k GROUP BY hit")
def ocr_cache(v: Views) -> DataFrame:
    asked = v.table("pages").select(F.concat(F.lit("p:m:1:"), F.sha2("html", 256)).alias("cache_key"), "page_id").dropDuplicates(["cache_key"])
    cache = asked.where("page_id % 2 = 0").select("cache_key", F.lit(True).alias("hit"))
    return asked.join(cache, "cache_key", "left").groupBy(F.coalesce("hit", F.lit(False)).alias("hit")).agg(F.count("*").alias("n"))


@query("s13_json_rows", "SELECT n_nationkey, '{\"id\":\"n' || n_nationkey || '\",\"name\":\"' || n_name || '\"}' AS json FROM nation")
def json_rows(v: Views) -> DataFrame:
    return v.table("nation").select("n_nationkey", F.to_json(F.struct(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("name"))).alias("json"))


@query("z1_enqueue_once", "SELECT user_id || ':' || event_type AS key, min(event_id) AS job FROM events GROUP BY 1")
def enqueue_once(v: Views) -> DataFrame:
    return v.table("events").groupBy(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("key")).agg(F.min("event_id").alias("job"))


@query("z3_expired_leases", """, j AS (SELECT user_id || ':' || strftime(ts, '%Y-%m-%d') AS job, count(*) FILTER (event_type = 'view') AS attempts, arg_max(event_type, event_id) AS last, max(ts) AS ts FROM events GROUP BY ALL)
SELECT job, CASE WHEN attempts >= 3 THEN 'FAILED' ELSE 'PENDING' END AS state FROM j WHERE last = 'view' AND ts + INTERVAL 1 HOUR < (SELECT max(ts) FROM events)""")
def expired_leases(v: Views) -> DataFrame:
    """The events of a user on a day are a job; a view claims it for an hour, and the latest event of all tells the time."""
    from heddle.streaming.events import expired_leases as expire

    events = v.table("events")
    job = F.concat_ws(":", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("job")
    jobs = events.groupBy(job).agg(F.count(F.when(F.col("event_type") == "view", 1)).alias("attempts"), F.max_by("event_type", "event_id").alias("last"), F.max("ts").alias("ts"))
    jobs = jobs.select("job", "attempts", F.when(F.col("last") == "view", "RUNNING").otherwise("PENDING").alias("state"), (F.col("ts") + F.expr("interval 1 hour")).alias("lease_until"))
    return expire(jobs.crossJoin(events.agg(F.max("ts").alias("now"))), F.col("now")).select("job", "state")
