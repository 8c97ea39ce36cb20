"""Queries of single operators that others are built of: readers, lexical forms, channels, jobs, claims, comparison and evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.functions import text as X
from heddle.operators import answers, compare, facts, findings, graph, ingest, resolve, retrieval, review
from heddle.plans.analytics import ASKED, BOTH_WAYS, EDGES, FUSED, IDENTIFIER, LEX, PARTS, SPREADING, STOPS, VERSIONED, WALK, asked, dense, edges, fused, lexical, sided, stem_sql, version_edges, walk
from heddle.plans.base import query
from heddle.plans.readmodels import BINDING, candidates
from heddle.sources import files, markup
from heddle.tables import Views


def evidence(v: Views) -> DataFrame:
    return v.statements.select(F.concat_ws("|", "source", "target", "type").alias("id"), "chunk_id", F.struct("l_orderkey", "l_linenumber").alias("rank"))


# Readers: a file per region about its nations.

NATIONS = ", n AS (SELECT r_regionkey AS k, r_name, n_nationkey AS nk, n_name, row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) AS i FROM region JOIN nation ON n_regionkey = r_regionkey)"


def by_region(v: Views) -> DataFrame:
    """k, r_name and the region's nations in order (nk, n_name)."""
    rows = v.table("region").join(v.table("nation"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy(F.col("r_regionkey").alias("k"), "r_name").agg(F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").alias("nk"), "n_name"))).alias("nations"))


def as_file(name: str, content: Column) -> tuple[Column, Column]:
    return F.concat(F.lit("/"), F.col("k").cast("string"), F.lit(f".{name}")).alias("path"), content.alias("content")


def lines_of(line) -> Column:
    return F.array_join(F.transform("nations", line), "\n")


@query("s4_markdown_blocks", NATIONS + r""", b AS (SELECT k, 0 AS n, 'HEADING' AS kind, r_name AS text, 1 AS level FROM n UNION SELECT k, 1, 'TEXT', 'Its nations are listed below.', NULL FROM n
UNION ALL SELECT k, 2, 'TEXT', string_agg('- ' || n_name, chr(10) ORDER BY i), NULL FROM n GROUP BY k UNION ALL SELECT k, 3, 'TABLE', '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || nk || ' | ' || n_name || ' |', chr(10) ORDER BY i), NULL FROM n GROUP BY k)
SELECT '/' || k || '.md' AS path, n, kind, text, level FROM b""")
def markdown_blocks(v: Views) -> DataFrame:
    parts = [F.concat(F.lit("# "), "r_name"), F.lit("Its nations\nare listed below."), lines_of(lambda x: F.concat(F.lit("- "), x["n_name"])), F.concat(F.lit("| key | name |\n|---|---|\n"), lines_of(lambda x: F.concat(F.lit("| "), x["nk"].cast("string"), F.lit(" | "), x["n_name"], F.lit(" |"))))]
    docs = by_region(v).select(*as_file("md", F.concat_ws("\n\n", *parts).cast("binary")))
    return files.read_blocks(docs).select("path", "n", "kind", "text", "level")


@query("s5_csv_blocks", NATIONS + r" SELECT '/' || k || '.csv' AS path, 'TABLE' AS kind, '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || nk || ' | ' || n_name || ', of ' || r_name || ' |', chr(10) ORDER BY i) AS text FROM n GROUP BY k")
def csv_blocks(v: Views) -> DataFrame:
    rows = F.concat(F.lit("﻿key,name\n\n"), lines_of(lambda x: F.concat(x["nk"].cast("string"), F.lit(',"'), x["n_name"], F.lit(", of "), "r_name", F.lit('"'))))
    return files.read_blocks(by_region(v).select(*as_file("csv", rows.cast("binary")))).select("path", "kind", "text")


@query("s15_xlsx_round_trip", NATIONS + r" SELECT '/' || k || '.xlsx' AS path, 0 AS n, 'HEADING' AS kind, r_name AS text FROM n UNION SELECT '/' || k || '.xlsx', 1, 'TABLE', '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || nk || ' | ' || n_name || ' |', chr(10) ORDER BY i) FROM n GROUP BY k")
def xlsx_round_trip(v: Views) -> DataFrame:
    """A workbook per region, written and read again."""
    import pandas as pd

    def write(batches):
        for part in batches:
            yield pd.DataFrame({"path": part["path"], "content": [markup.write_xlsx({sheet: [["key", "name"], *([str(r["nk"]), r["n_name"]] for r in rows)]}) for sheet, rows in zip(part["r_name"], part["nations"], strict=True)]})

    books = by_region(v).select(F.concat(F.lit("/"), F.col("k").cast("string"), F.lit(".xlsx")).alias("path"), "r_name", "nations").mapInPandas(write, "path string, content binary")
    return files.read_blocks(books).select("path", "n", "kind", "text")


@query("t13_section_paths", NATIONS + """ SELECT 'r' || k AS doc, 1 AS section, NULL::INTEGER AS parent, r_name AS path, 'Its nations.' AS content FROM n UNION SELECT 'r' || k, i + 1, 1, r_name || ' > ' || n_name, 'Nation ' || nk || '.' FROM n""")
def section_paths(v: Views) -> DataFrame:
    """Declared headings of two levels."""
    block = lambda n, kind, text, level: F.struct(n.cast("int").alias("n"), F.lit(kind).alias("kind"), text.alias("text"), F.lit(level).cast("int").alias("level"), F.lit("markdown").alias("source"))
    below = F.flatten(F.transform("nations", lambda x, i: F.array(block(2 * i + 2, "HEADING", x["n_name"], 2), block(2 * i + 3, "TEXT", F.concat(F.lit("Nation "), x["nk"].cast("string"), F.lit(".")), None))))
    docs = by_region(v).select(F.concat(F.lit("r"), F.col("k").cast("string")).alias("doc"), F.concat(F.array(block(F.lit(0), "HEADING", F.col("r_name"), 1), block(F.lit(1), "TEXT", F.lit("Its nations."), None)), below).alias("blocks"))
    return ingest.chunk_listed(docs).select("doc", "section", "parent", "path", "content")


@query("t14_numbered_sections", NATIONS + """, m AS (SELECT *, CASE WHEN i = 3 THEN 9 ELSE i END AS said FROM n) SELECT 'r' || k AS doc, r_name AS path, 'All of it.' AS content FROM m UNION SELECT 'r' || k, r_name || ' > Nation ' || n_name, 'Body of ' || nk || '.' || CASE WHEN i = 2 THEN ' 1.9 Nation ' || (SELECT o.n_name FROM m o WHERE o.k = m.k AND o.i = 3) || ' Body of ' || (SELECT o.nk FROM m o WHERE o.k = m.k AND o.i = 3) || '.' ELSE '' END FROM m WHERE i <> 3""")
def numbered_sections(v: Views) -> DataFrame:
    """Numbered lines of a text; the third skips to 1.9, so it is no heading."""
    number = lambda i: F.when(i == 2, "9").otherwise((i + 1).cast("string"))
    body = F.array_join(F.transform("nations", lambda x, i: F.concat(F.lit("1."), number(i), F.lit(" Nation "), x["n_name"], F.lit("\nBody of "), x["nk"].cast("string"), F.lit("."))), "\n")
    block = F.struct(F.lit(0).alias("n"), F.lit("TEXT").alias("kind"), F.concat(F.lit("1 "), "r_name", F.lit("\nAll of it.\n"), body).alias("text"), F.lit(None).cast("int").alias("level"), F.lit("none").alias("source"))
    docs = by_region(v).select(F.concat(F.lit("r"), F.col("k").cast("string")).alias("doc"), F.array(block).alias("blocks"))
    return ingest.chunk_listed(docs).select("doc", "path", "content")


@query("s8a_running_lines", r""", l AS (SELECT doc_id, pos // 3 + 1 AS page, pos, content, pos % 3 AS y, regexp_replace(regexp_replace(regexp_replace(lower(content), '\d+', '#', 'g'), '\s+', ' ', 'g'), '^ | $', '', 'g') AS key FROM chunks),
p AS (SELECT doc_id, count(DISTINCT page) AS pages FROM l GROUP BY 1), o AS (SELECT l.doc_id, key FROM l JOIN p ON p.doc_id = l.doc_id GROUP BY l.doc_id, key, pages HAVING count(DISTINCT page) >= greatest(2, ceil(pages / 2.0)))
SELECT l.doc_id AS doc, l.pos AS n FROM l LEFT JOIN o ON o.doc_id = l.doc_id AND o.key = l.key WHERE o.key IS NULL AND NOT regexp_matches(content, '\.{4,}\s*\d+\s*$') AND NOT (y <> 1 AND regexp_matches(content, '(?i)^\s*(?:page\s+)?\d+(?:\s*(?:/|of)\s*\d+)?\s*$'))""")
def running_lines(v: Views) -> DataFrame:
    """Three lines a page, the first and last of them at the edges."""
    page = F.floor(F.col("pos") / 3) + 1
    lines = v.chunks.select(F.col("doc_id").alias("doc"), page.alias("page"), (F.col("pos") % 3 * 45 + 5).cast("double").alias("y"), F.lit(100.0).alias("page_height"), F.col("content").alias("text"), F.col("pos").cast("long").alias("n"))
    return files.running_lines(lines).select("doc", "n")


@query("s8b_font_headings", r""", l AS (SELECT doc_id, pos, content, CASE WHEN length(content) < 40 THEN 14 WHEN length(content) < 60 THEN 12 ELSE 10 END AS size FROM chunks), w AS (SELECT doc_id, size, sum(length(content)) AS w FROM l GROUP BY 1, 2), b AS (SELECT doc_id, arg_max(size, w * 100 - size) AS body FROM w GROUP BY 1),
g AS (SELECT l.*, dense_rank() OVER (PARTITION BY l.doc_id ORDER BY size DESC) AS rank FROM l JOIN b ON b.doc_id = l.doc_id WHERE size >= body + 1),
m AS (SELECT *, regexp_extract(content, '^(\d+(?:\.\d+)*)\.?\s+\S', 1) AS number FROM g)
SELECT doc_id AS doc, pos AS n, CASE WHEN number <> '' THEN len(string_split(number, '.')) ELSE rank END::INTEGER AS level FROM m""")
def font_headings(v: Views) -> DataFrame:
    size = F.when(F.length("content") < 40, 14.0).when(F.length("content") < 60, 12.0).otherwise(10.0)
    lines = v.chunks.select(F.col("doc_id").alias("doc"), F.col("pos").cast("long").alias("n"), size.alias("size"), F.lit(False).alias("bold"), F.col("content").alias("text"))
    return files.font_headings(lines).select("doc", "n", "level")


# Lexical forms.


@query("x9_identifier_parts", rf"SELECT word, array_to_string({PARTS}, '-') AS parts FROM (SELECT DISTINCT w AS word, w FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS w FROM documents UNION ALL SELECT name FROM entities))")
def identifier_parts(v: Views) -> DataFrame:
    words = v.table("documents").select(F.explode(X.tokens(F.col("text"))).alias("word")).union(v.entities.select("name")).distinct()
    return words.select("word", F.array_join(X.split_identifier(F.col("word")), "-").alias("parts"))


TURN_TERMS = rf""", t AS (SELECT conv_id, turn, w, i, CASE WHEN {IDENTIFIER} THEN {PARTS} ELSE [] END AS parts, regexp_matches(w, '[A-Z]') AND NOT regexp_matches(w, '[a-z]') AND length(w) >= 2 AS up
  FROM (SELECT conv_id, turn, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS w, generate_subscripts(regexp_extract_all(text, '[A-Za-z0-9_]+'), 1) AS i FROM conversations WHERE role = 'user')),
j AS (SELECT *, CASE WHEN len(parts) > 0 THEN array_to_string(parts, '') ELSE replace(lower(w), '_', '') END AS joined FROM t),
k AS (SELECT conv_id, turn, joined, min(i) AS i, arg_min(parts, i) AS parts FROM j WHERE joined <> '' AND (len(parts) > 0 OR ((up OR joined NOT IN {STOPS}) AND length(joined) >= 2)) GROUP BY ALL),
term AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) AS n FROM k) WHERE n <= 32)"""


@query("x12_search_expressions", TURN_TERMS + " SELECT conv_id, turn, string_agg(CASE WHEN len(parts) > 1 THEN '(' || joined || ' | (' || array_to_string(parts, ' <-> ') || '))' ELSE joined END, ' | ' ORDER BY i) AS expression FROM term GROUP BY ALL")
def search_expressions(v: Views) -> DataFrame:
    rows = v.table("conversations").where("role = 'user'").select("conv_id", "turn", X.search_expression(X.query_terms(F.col("text"))).alias("expression"))
    return rows.where("expression is not null")


@query("x13_matched_terms", TURN_TERMS + ", lex AS (SELECT DISTINCT conv_id, turn - 1 AS turn, w, stem FROM " + stem_sql("SELECT conv_id, turn, lower(unnest(regexp_extract_all(text, '[A-Za-z0-9_]+'))) AS w FROM conversations") + "), ts AS (SELECT conv_id, turn, i, joined, parts, stem FROM " + stem_sql("SELECT conv_id, turn, i, joined, parts, joined AS w FROM term") + """),
hit AS (SELECT conv_id, turn, i, CASE WHEN len(parts) > 1 THEN EXISTS (SELECT 1 FROM lex l WHERE l.conv_id = ts.conv_id AND l.turn = ts.turn AND l.w = joined) OR (SELECT count(DISTINCT l.w) FROM lex l WHERE l.conv_id = ts.conv_id AND l.turn = ts.turn AND list_contains(ts.parts, l.w)) = len(list_distinct(parts))
  ELSE EXISTS (SELECT 1 FROM lex l WHERE l.conv_id = ts.conv_id AND l.turn = ts.turn AND (l.w = joined OR l.stem = ts.stem)) END AS found FROM ts)
SELECT conv_id, turn, round(count(*) FILTER (found) / count(*)::DOUBLE, 6) AS ratio FROM hit GROUP BY ALL""")
def matched_terms(v: Views) -> DataFrame:
    """Of the terms of a user's turn, those that the next turn has."""
    turns = v.table("conversations")
    nxt = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.array_join(F.transform(X.tokens(F.col("text")), F.lower), " ").alias("lexical"))
    rows = turns.where("role = 'user'").select("conv_id", "turn", X.query_terms(F.col("text")).alias("terms")).where(F.size("terms") > 0).join(nxt, ["conv_id", "turn"], "left")
    return rows.select("conv_id", "turn", F.round(X.matched_term_ratio(F.col("terms"), F.coalesce("lexical", F.lit(""))), 6).alias("ratio"))


@query("x20_table_markdown", NATIONS + r" SELECT k, '| key | name |  |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || nk || ' | ' || n_name || ' | ' || CASE WHEN i = 1 THEN 'the first' ELSE '' END || ' |', chr(10) ORDER BY i) AS text FROM n GROUP BY k")
def table_markdown(v: Views) -> DataFrame:
    """Rows of unequal length, an empty one, and cells with line breaks."""
    rows = F.transform("nations", lambda x, i: F.when(i == 0, F.array(x["nk"].cast("string"), x["n_name"], F.lit(" the\nfirst "))).otherwise(F.array(x["nk"].cast("string"), x["n_name"])))
    return by_region(v).select("k", X.table_markdown(F.concat(F.array(F.array(F.lit("key"), F.lit("name")), F.array(F.lit(""), F.lit(""))), rows)).alias("text"))


@query("x24_statement_units", r""", r AS (SELECT doc_id, pos, trim(content, chr(32)) AS line, starts_with(trim(content, chr(32)), '|') AS isrow FROM chunks), p AS (SELECT *, coalesce(lag(isrow) OVER (PARTITION BY doc_id ORDER BY pos), false) AS prev FROM r),
s AS (SELECT doc_id, pos, len(list_filter(string_split(regexp_replace(trim(line, chr(32) || chr(9) || chr(13)), '([.!?])\s+([A-Z0-9`"''(\[])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x) <> '')) AS n FROM r WHERE NOT isrow UNION ALL SELECT doc_id, pos, 1 FROM p WHERE isrow AND prev AND NOT regexp_matches(line, '^[\s|:-]+$'))
SELECT doc_id AS doc, sum(n)::BIGINT AS units FROM s GROUP BY 1""")
def statement_units(v: Views) -> DataFrame:
    lines = v.chunks.select(F.col("doc_id").alias("doc"), F.col("pos").alias("n"), F.col("content").alias("line"))
    return answers.statement_units(lines).groupBy("doc").agg(F.count("*").alias("units"))


@query("x29_layout_keys", r"""SELECT doc_id, pos, regexp_replace(regexp_replace(lower(trim(content)), '\s+', ' ', 'g'), '\d+', '#', 'g') AS running, regexp_replace(lower(CASE WHEN regexp_matches(trim(content), '^(?:[1-9]\d{0,2}(?:\.\d{1,3}){0,5}|[A-Z](?:\.\d{1,3}){1,5})\.?[ \t]+\S') THEN regexp_extract(trim(content), '^(?:[1-9]\d{0,2}(?:\.\d{1,3}){0,5}|[A-Z](?:\.\d{1,3}){1,5})\.?[ \t]+(\S.*)$', 1) ELSE content END), '[^a-z0-9]+', '', 'g') AS title FROM chunks""")
def layout_keys(v: Views) -> DataFrame:
    return v.chunks.select("doc_id", F.col("pos").cast("long").alias("pos"), X.running_key(F.col("content")).alias("running"), X.title_key(F.col("content")).alias("title"))


@query("x29_pdf_dates", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders")
def pdf_dates(v: Views) -> DataFrame:
    k = F.col("o_orderkey") % 3
    said = F.concat(F.lit("D:"), F.when(k == 0, F.date_format("o_orderdate", "yyyy")).when(k == 1, F.date_format("o_orderdate", "yyyyMM")).otherwise(F.date_format("o_orderdate", "yyyyMMddHHmmss")))
    return v.table("orders").select("o_orderkey", X.pdf_date(said).alias("day"))


# Channels and their parts.


@query("m9_cover_density", LEX + " SELECT query, id, round(score, 6) AS score FROM lh")
def cover_density(v: Views) -> DataFrame:
    terms_and_hits = lexical(v, 1 << 30)
    return terms_and_hits.select("query", "id", F.round("score", 6).alias("score"))


@query("l3_lexical_top", LEX + " SELECT query, id FROM lr WHERE rank <= 5")
def lexical_top(v: Views) -> DataFrame:
    return lexical(v, 5).select("query", "id")


@query("w1_channel_ranks", ASKED + LEX + " SELECT 'dense' AS channel, query, id, rank FROM dr WHERE rank <= 3 UNION ALL SELECT 'lexical', query, id, rank FROM lr WHERE rank <= 3")
def channel_ranks(v: Views) -> DataFrame:
    named = lambda rows, name: rows.select(F.lit(name).alias("channel"), "query", "id", F.col("rank").cast("long").alias("rank"))
    return named(dense(v, 3), "dense").unionByName(named(lexical(v, 3), "lexical"))


@query("j16_vector_pairs", ASKED + " SELECT query, count(*) AS n, round(min(score), 9) AS least, round(max(score), 9) AS most FROM dr GROUP BY query")
def vector_pairs(v: Views) -> DataFrame:
    """All queries against all vectors."""
    return retrieval.score_ranges(v.table("embeddings").select(F.col("vec_id").alias("id"), "embedding"), asked(v)).select("query", "n", "least", "most")


@query("q4_section_caps", FUSED + """, s AS (SELECT fu.*, label, row_number() OVER (PARTITION BY query, label ORDER BY round(fused, 9) DESC, id) > 2 AS filler FROM fu JOIN embeddings ON vec_id = id),
p AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY filler, round(fused, 9) DESC, id) AS place FROM s) SELECT query, label AS section, count(*) FILTER (NOT filler) AS own, count(*) FILTER (filler) AS fillers FROM p WHERE place <= 8 GROUP BY ALL""")
def section_caps(v: Views) -> DataFrame:
    rows = fused(v).withColumn("fused", F.round("fused", 9)).join(v.table("embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("section")), "id")
    filler = F.col("filler")
    return retrieval.diverse(rows).groupBy("query", "section").agg(F.count(F.when(~filler, 1)).alias("own"), F.count(F.when(filler, 1)).alias("fillers"))


@query("q11_bounded_rounds", ASKED + " SELECT query, id, CASE WHEN rank <= 8 THEN 1 WHEN rank <= 12 THEN 2 ELSE 3 END AS round FROM dr WHERE rank <= 16")
def bounded_rounds(v: Views) -> DataFrame:
    return retrieval.rounds(dense(v, 30)).select("query", "id", "round")


@query("q15_evaluation", LEX + """, ex AS (SELECT b.item_id AS query, d.doc_id AS id FROM benchmark b JOIN documents d ON strpos(d.text, b.text) > 0 WHERE b.item_id % 20 = 0),
e AS (SELECT q.item_id AS query, q.item_id IN (SELECT query FROM ex) AS answerable, (SELECT min(rank) FROM lr JOIN ex ON ex.query = lr.query AND ex.id = lr.id WHERE lr.query = q.item_id AND rank <= 30) AS rank FROM benchmark q WHERE q.item_id % 20 = 0)
SELECT count(*) AS questions, round(count(*) FILTER (answerable AND rank <= 8) / nullif(count(*) FILTER (answerable), 0)::DOUBLE, 4) AS recall_at_k, round(sum(coalesce(1.0::DOUBLE / rank, 0)) FILTER (answerable) / nullif(count(*) FILTER (answerable), 0), 4) AS mrr FROM e""")
def evaluation(v: Views) -> DataFrame:
    """The lexical channel on the benchmark items: a document that has the item's text is the expected hit."""
    items = v.table("benchmark").where("item_id % 20 = 0")
    found = retrieval.find_excerpts(v.table("documents").select("doc_id", "text"), items.select("item_id", F.col("text").alias("excerpt"))).where("exact").select(F.col("item_id").alias("query"), F.col("doc_id").alias("id"))
    asked = items.select(F.col("item_id").alias("query")).join(found.select("query").distinct().withColumn("answerable", F.lit(True)), "query", "left").na.fill(False, ["answerable"])
    rows = retrieval.evaluated(asked, lexical(v, 30), found)
    rows = rows.select("answerable", "refused", "rank", "in_context", F.lit(True).alias("citations_valid"), F.lit(0).alias("claims"), F.lit(0).alias("dropped"), F.lit(0.0).alias("latency"))
    return retrieval.retrieval_metrics(rows).select("questions", "recall_at_k", "mrr")


# Graph and resolution.


@query("j9_recursive_walk", WALK + "SELECT depth, count(DISTINCT id) AS n FROM walk GROUP BY depth")
def recursive_walk(v: Views) -> DataFrame:
    return walk(v).groupBy("depth").agg(F.countDistinct("id").alias("n"))


@query("u1_both_directions", EDGES + BOTH_WAYS + " SELECT a AS node, count(*) AS steps, count(DISTINCT b) AS neighbours FROM st GROUP BY a")
def both_directions(v: Views) -> DataFrame:
    return graph.steps(edges(v)).groupBy(F.col("at").alias("node")).agg(F.count("*").alias("steps"), F.countDistinct("to").alias("neighbours"))


@query("u2_review_sizes", "SELECT 'entity' AS kind, count(*) AS n FROM live WHERE state = 'PENDING' UNION ALL SELECT 'relationship', count(*) FROM liverel r JOIN live a ON a.id = r.source JOIN live b ON b.id = r.target WHERE r.state = 'PENDING'")
def review_sizes(v: Views) -> DataFrame:
    live = facts.live_entities(v.entities)
    waiting = facts.with_endpoints(facts.live_relationships(v.relationships).where("state = 'PENDING'"), live)
    return live.where("state = 'PENDING'").select(F.lit("entity").alias("kind")).union(waiting.select(F.lit("relationship"))).groupBy("kind").agg(F.count("*").alias("n"))


@query("u8_last_drafts", """, d AS (SELECT sha256('ALIAS|' || p_brand) AS fingerprint, 'part ' || min(p_partkey) AS summary, 1 AS detector FROM part GROUP BY p_brand UNION ALL SELECT sha256('ALIAS|' || p_brand), 'size ' || max(p_size), 2 FROM part WHERE p_size > 40 GROUP BY p_brand)
SELECT fingerprint, arg_max(summary, detector) AS summary FROM d GROUP BY fingerprint""")
def last_drafts(v: Views) -> DataFrame:
    """Two detectors with one key: the later one's draft stays."""
    by_brand = v.table("part").groupBy("p_brand")
    one = findings.draft(by_brand.agg(F.min("p_partkey").alias("x")), "ALIAS", "LOW", F.col("p_brand"), F.concat(F.lit("part "), F.col("x").cast("string")), 1)
    two = findings.draft(v.table("part").where("p_size > 40").groupBy("p_brand").agg(F.max("p_size").alias("x")), "ALIAS", "HIGH", F.col("p_brand"), F.concat(F.lit("size "), F.col("x").cast("string")), 2)
    return findings.distinct_drafts([one, two]).select("fingerprint", "summary")


@query("r2_type_groups", "SELECT entity_type, CASE WHEN entity_type = 'SOFTWARE_COMPONENT' THEN 'COMPONENT' ELSE entity_type END AS grp, count(*) AS n FROM (SELECT CASE WHEN id LIKE '%0' AND entity_type = 'COMPONENT' THEN 'SOFTWARE_COMPONENT' ELSE entity_type END AS entity_type FROM entities) GROUP BY 1, 2")
def type_groups(v: Views) -> DataFrame:
    kind = F.when(F.col("id").endswith("0") & (F.col("entity_type") == "COMPONENT"), "SOFTWARE_COMPONENT").otherwise(F.col("entity_type"))
    return v.entities.select(kind.alias("entity_type")).select("entity_type", resolve.type_group(F.col("entity_type")).alias("grp")).groupBy("entity_type", "grp").agg(F.count("*").alias("n"))


@query("r1_skipped_blocks", r""", tk AS (SELECT id, entity_type, regexp_extract_all(lower(name), '[a-z]+') AS t FROM active), b AS (SELECT id, entity_type || '|n:' || normalized AS key FROM active UNION SELECT id, entity_type || '|t:' || array_to_string(list_sort(t), '-') FROM tk WHERE len(t) > 0
UNION SELECT id, entity_type || '|w:' || w FROM (SELECT id, entity_type, unnest(t) AS w FROM tk) WHERE length(w) >= 4 UNION SELECT id, entity_type || '|a:' || array_to_string(list_transform(t, lambda x: x[1]), '') FROM tk WHERE len(t) >= 2) SELECT key, count(*) AS n FROM b GROUP BY key HAVING count(*) > 40""")
def skipped_blocks(v: Views) -> DataFrame:
    return resolve.skipped_blocks(facts.active_entities(v.entities).select("id", "name", "entity_type"))


TWINS = """, tw AS (SELECT a.id AS a, c.id AS b, a.created_rank AS ra, c.created_rank AS rb, sha256(least(a.id, c.id) || '|' || greatest(a.id, c.id)) AS pair_key, sha256(a.name || '|' || c.name) AS fingerprint FROM active a JOIN active c ON a.normalized = c.normalized AND a.entity_type = c.entity_type AND a.id < c.id
  JOIN (SELECT normalized, entity_type FROM active GROUP BY ALL HAVING count(*) BETWEEN 2 AND 40) s ON s.normalized = a.normalized AND s.entity_type = a.entity_type)"""


@query("r6_decision_cache", TWINS + """, kn AS (SELECT pair_key, CASE WHEN ra % 4 = 0 THEN 'stale' ELSE fingerprint END AS seen, CASE WHEN rb % 2 = 0 THEN 'SAME' ELSE 'DIFFERENT' END AS decision, CASE WHEN rb % 3 = 0 THEN 0.8 ELSE 0.9 END AS confidence FROM tw WHERE ra % 2 = 0),
f AS (SELECT tw.pair_key, CASE WHEN seen = fingerprint THEN CASE WHEN decision = 'SAME' AND confidence < 0.85 THEN 'UNSURE' ELSE decision END END AS known FROM tw LEFT JOIN kn ON kn.pair_key = tw.pair_key)
SELECT pair_key, coalesce(known, CASE WHEN row_number() OVER (PARTITION BY known IS NULL ORDER BY pair_key) <= 200 THEN 'JUDGE' ELSE 'DEFERRED' END) AS outcome FROM f""")
def decision_cache(v: Views) -> DataFrame:
    """Pairs with one normalized name; every second has a known decision, half of those for another fingerprint."""
    pairs = resolve.candidate_pairs(facts.active_entities(v.entities).select("id", "name", "entity_type")).select("a", "b")
    ranks = lambda c: v.entities.select(F.col("id").alias(c), F.col("created_rank").alias(f"r{c}"))
    pairs = sided(v, pairs).where("normalized_a = normalized_b").join(ranks("a"), "a").join(ranks("b"), "b")
    keyed = pairs.select(resolve.pair_key(F.col("a"), F.col("b")).alias("pair_key"), F.sha2(F.concat_ws("|", "name_a", "name_b"), 256).alias("fingerprint"), F.lit(1.0).alias("similarity"), "ra", "rb")
    known = keyed.where("ra % 2 = 0").select("pair_key", F.when(F.col("ra") % 4 == 0, "stale").otherwise(F.col("fingerprint")).alias("fingerprint"), F.when(F.col("rb") % 2 == 0, "SAME").otherwise("DIFFERENT").alias("decision"), F.when(F.col("rb") % 3 == 0, 0.8).otherwise(0.9).alias("confidence"))
    return resolve.from_cache(keyed.select("pair_key", "fingerprint", "similarity"), known)


@query("m7_vector_scores", TWINS + ", e AS (SELECT 'p' || vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings) SELECT tw.a, tw.b, round(CASE WHEN x.v IS NULL OR y.v IS NULL THEN 0.75 ELSE (0.75 + list_cosine_similarity(x.v, y.v)) / 2 END, 6) AS score FROM tw LEFT JOIN e x ON x.id = tw.a LEFT JOIN e y ON y.id = tw.b")
def vector_scores(v: Views) -> DataFrame:
    """Pairs with one normalized name, as if their lexical similarity were 0.75; parts have the vectors of their numbers."""
    pairs = resolve.candidate_pairs(facts.active_entities(v.entities).select("id", "name", "entity_type")).select("a", "b")
    rated = sided(v, pairs).where("normalized_a = normalized_b").select("a", "b", F.lit(0.75).alias("similarity"), F.lit(None).cast("string").alias("decisive"))
    vectors = v.table("embeddings").select(F.concat(F.lit("p"), F.col("vec_id").cast("string")).alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return resolve.with_vectors(rated, vectors).select("a", "b", F.round("similarity", 6).alias("score"))


@query("r9_binding_counters", BINDING + "SELECT 'source' AS side, source_state AS state, count(*) AS n FROM b GROUP BY 2 UNION ALL SELECT 'target', target_state, count(*) FROM b GROUP BY 2")
def binding_counters(v: Views) -> DataFrame:
    bound = graph.settled(facts.bind_endpoints(candidates(v), v.entities, v.aliases).select("source_state", "target_state"))
    return reduce(DataFrame.unionByName, (bound.groupBy(F.col(f"{s}_state").alias("state")).agg(F.count("*").alias("n")).select(F.lit(s).alias("side"), "state", "n") for s in ("source", "target")))


@query("r13_reviewed_findings", """, f AS (SELECT DISTINCT user_id, CASE user_id % 3 WHEN 0 THEN 'OPEN' WHEN 1 THEN 'RESOLVED' ELSE 'DISMISSED' END AS status FROM events), a AS (SELECT user_id, event_id, CASE event_type WHEN 'click' THEN 'dismiss' ELSE 'reopen' END AS action FROM events WHERE event_type = 'purchase' OR (event_type = 'click' AND value >= 50)),
l AS (SELECT user_id, arg_max(action, event_id) AS last, count(*) FILTER (action = 'dismiss') AS d FROM a GROUP BY 1)
SELECT f.user_id AS fingerprint, CASE WHEN last = 'dismiss' THEN 'DISMISSED' WHEN last = 'reopen' AND (d > 0 OR status = 'DISMISSED') THEN 'OPEN' ELSE status END AS status, CASE WHEN last = 'dismiss' THEN 'seen' END AS reason FROM f LEFT JOIN l ON l.user_id = f.user_id""")
def reviewed_findings(v: Views) -> DataFrame:
    """Clicks dismiss, with a reason if their value is 50 or more; purchases reopen."""
    events = v.table("events")
    status = F.when(F.col("user_id") % 3 == 0, "OPEN").when(F.col("user_id") % 3 == 1, "RESOLVED").otherwise("DISMISSED")
    known = events.select("user_id").distinct().select(F.col("user_id").alias("fingerprint"), status.alias("status"))
    action = F.when(F.col("event_type") == "click", "dismiss").when(F.col("event_type") == "purchase", "reopen")
    acts = events.select(F.col("user_id").alias("fingerprint"), F.col("event_id").alias("seq"), action.alias("action"), F.when(F.col("value") >= 50, " seen ").otherwise(" ").alias("reason")).where("action is not null")
    return findings.reviewed(known, acts)


@query("r14_hard_merge", """, m AS (SELECT d.id, d.merged_into AS survivor FROM entities d JOIN entities s ON s.id = d.merged_into AND s.entity_type = d.entity_type)
SELECT r.id, coalesce(a.survivor, r.source) AS source, coalesce(b.survivor, r.target) AS target, r.type FROM relationships r LEFT JOIN m a ON a.id = r.source LEFT JOIN m b ON b.id = r.target""")
def hard_merge(v: Views) -> DataFrame:
    same = v.entities.select(F.col("id").alias("survivor"), "entity_type")
    merges = v.entities.where("merged_into is not null").select("id", F.col("merged_into").alias("survivor"), "entity_type", F.col("name").alias("alias"), "normalized").join(same, ["survivor", "entity_type"])
    return graph.hard_merge(v.relationships.select("id", "source", "target", "type"), merges.select("id", "survivor", "alias", "normalized"), v.aliases)[0]


@query("r14_merge_aliases", ", m AS (SELECT normalized, min(merged_into) AS entity_id FROM entities WHERE merged_into IS NOT NULL AND normalized <> '' GROUP BY normalized) SELECT entity_id, normalized FROM m WHERE normalized NOT IN (SELECT normalized FROM aliases)")
def merge_aliases(v: Views) -> DataFrame:
    merges = v.entities.where("merged_into is not null").select("id", F.col("merged_into").alias("survivor"), F.col("name").alias("alias"), "normalized")
    return graph.hard_merge(v.relationships.select("id", "source", "target", "type"), merges, v.aliases)[1].select("entity_id", "normalized")


# Answers.

FIRST_EVIDENCE = ", s AS (SELECT source || '|' || target || '|' || type AS id, chunk_id, row_number() OVER (PARTITION BY source, target, type ORDER BY l_orderkey, l_linenumber, chunk_id) AS n FROM statements)"


@query("t7_graph_facts", EDGES + BOTH_WAYS + FIRST_EVIDENCE + """, x AS (SELECT turn, root, st.id, st.type, row_number() OVER (PARTITION BY turn ORDER BY st.type, st.id) AS n FROM (VALUES (1, 's3'), (2, 's1'), (3, 's2')) r(turn, root) JOIN st ON st.a = r.root),
o AS (SELECT id, min(turn) AS turn, arg_min(root, turn) AS root, any_value(type) AS type FROM x WHERE n <= 60 GROUP BY id)
SELECT root, o.id, 1 AS depth, o.type, chunk_id AS citation FROM o JOIN s ON s.id = o.id AND s.n = 1 ORDER BY turn, o.type, o.id LIMIT 40""")
def graph_facts(v: Views) -> DataFrame:
    turns = v.spark.createDataFrame([(1, "s3"), (2, "s1"), (3, "s2")], "turn int, root string")
    arrivals = graph.reach(edges(v), turns.select("root"), 1).join(turns, "root")
    return answers.graph_facts(arrivals, evidence(v))


@query("q10_fact_claims", WALK + FIRST_EVIDENCE + """, f AS (SELECT id, min(depth) AS depth, row_number() OVER (ORDER BY min(depth), any_value(type), id) AS place FROM walk GROUP BY id)
SELECT 's1' AS root, f.id, a.name || ' ' || g.type || ' ' || b.name || CASE WHEN f.depth > 1 THEN ' (' || f.depth || ' hops from the question''s entity)' ELSE '' END AS claim, chunk_id, g.extraction FROM f JOIN g ON g.id = f.id JOIN entities a ON a.id = g.source JOIN entities b ON b.id = g.target JOIN s ON s.id = f.id AND n = 1 WHERE place <= 15 AND g.evidence % 2 = 1""")
def fact_claims(v: Views) -> DataFrame:
    """The passage of a fact with an odd number of statements names both ends, others the source alone."""
    near = walk(v).groupBy("root", "id", "type").agg(F.min("depth").alias("depth")).orderBy("depth", "type", "id").limit(answers.FACT_CLAIMS)
    near = near.withColumn("place", F.expr("row_number() over (partition by root order by depth, type, id)"))
    rows = near.join(edges(v).select("id", "source_name", "target_name", "extraction", F.col("evidence").alias("n")), "id")
    first = evidence(v).join(near.select("id"), "id", "left_semi").groupBy("id").agg(F.min_by("chunk_id", F.struct("rank", "chunk_id")).alias("chunk_id"))
    said = F.when(F.col("n") % 2 == 1, F.concat_ws(" and ", "source_name", "target_name")).otherwise(F.col("source_name"))
    sources = rows.join(first, "id").select("id", "chunk_id", said.alias("text"))
    return answers.fact_claims(rows.drop("n"), sources)


@query("q12_answers", """, c AS (SELECT user_id AS question, event_type <> 'error' AND value >= 40 AS supported, 0.5 + (event_id % 5) / 10.0::DOUBLE AS support, event_type = 'click' AS inferred, event_type = 'signup' AS around FROM events),
k AS (SELECT question, count(*) FILTER (supported) AS kept, count(*) FILTER (NOT supported) AS dropped, avg(support) FILTER (supported) AS mean, bool_or(supported AND inferred) AS inferred, bool_or(supported AND around) AS around FROM c GROUP BY question)
SELECT question, CASE WHEN kept > 0 THEN 'GROUNDED' ELSE 'INSUFFICIENT_EVIDENCE' END AS status, CASE WHEN question % 4 = 0 THEN 'GRAPH' WHEN question % 3 > 0 THEN 'HYBRID' ELSE 'SOURCE' END AS mode, CASE WHEN kept > 0 THEN round(kept / (kept + dropped)::DOUBLE * mean, 2) ELSE 0.0 END AS groundedness,
CASE WHEN kept > 0 THEN 'retrieved passages only' || CASE WHEN dropped > 0 THEN '; ' || dropped || ' statement(s) removed' ELSE '' END || CASE WHEN inferred THEN '; inferred statements need review' ELSE '' END || CASE WHEN question % 2 = 1 THEN '; rephrased queries' ELSE '' END || CASE WHEN around THEN '; parent or neighbouring context' ELSE '' END
  WHEN question % 4 = 0 THEN 'no facts about a named entity' ELSE 'nothing relevant was retrieved' END AS limitations FROM k""")
def composed_answers(v: Views) -> DataFrame:
    """A user is a question and an event a claim: its value and type say whether the cited text supports it."""
    events = v.table("events")
    claims = events.select(F.col("user_id").alias("question"), ((F.col("event_type") != "error") & (F.col("value") >= 40)).alias("supported"), (0.5 + F.col("event_id") % 5 / 10).alias("support"), (F.col("event_type") == "click").alias("inferred"), F.when(F.col("event_type") == "signup", "NEIGHBOR").otherwise("HIT").alias("role"))
    asked = events.select(F.col("user_id").alias("question")).distinct()
    asked = asked.select("question", (F.col("question") % 3).alias("n_facts"), (F.col("question") % 4 == 0).alias("graph_only"), (F.col("question") % 2 + 1).alias("rounds"))
    return answers.composed(claims, asked)


# Comparison.


@query("d4_section_findings", """, vl AS (SELECT c.document, v.version_number AS n, c.content AS line FROM chunks c JOIN versions v ON v.doc_id = c.doc_id), top AS (SELECT document, max(version_number) AS last FROM versions GROUP BY document),
o AS (SELECT vl.document || '#' || n AS pair, line, count(*) AS k FROM vl JOIN top ON top.document = vl.document AND n < last GROUP BY ALL), w AS (SELECT document || '#' || (n - 1) AS pair, line, count(*) AS k FROM vl WHERE n > 1 GROUP BY ALL),
d AS (SELECT coalesce(o.pair, w.pair) AS pair, coalesce(o.k, 0) - coalesce(w.k, 0) AS n FROM o FULL JOIN w ON o.pair = w.pair AND o.line = w.line WHERE coalesce(o.k, 0) <> coalesce(w.k, 0)),
c AS (SELECT pair, coalesce(sum(n) FILTER (n > 0), 0)::BIGINT AS removed, coalesce(-sum(n) FILTER (n < 0), 0)::BIGINT AS added FROM d GROUP BY pair)
SELECT pair, CASE WHEN removed > 0 THEN 'MEDIUM' ELSE 'LOW' END AS severity, concat_ws(', ', CASE WHEN removed > 0 THEN removed || ' statement(s) removed' END, CASE WHEN added > 0 THEN added || ' statement(s) added' END) AS summary FROM c""")
def section_findings(v: Views) -> DataFrame:
    """Every version against its successor, a line for a statement."""
    from heddle.plans.analytics import line_changes

    return compare.section_findings(line_changes(v).select("pair", "change", "n")).select("pair", "severity", "summary")


@query("d8_analysed_impacts", EDGES + SPREADING + VERSIONED + """, r AS (SELECT id, target, 'HIGH' AS severity FROM ba WHERE id NOT IN (SELECT id FROM nw) UNION ALL SELECT id, target, 'INFO' FROM nw WHERE id NOT IN (SELECT id FROM ba)),
i AS (SELECT r.id AS summary, severity, (SELECT count(DISTINCT b) FROM st WHERE st.a = r.target) AS n_impacts FROM r), f AS (SELECT *, row_number() OVER (ORDER BY CASE severity WHEN 'HIGH' THEN 0 ELSE 3 END, summary) AS attempt FROM i),
b AS (SELECT *, coalesce(sum(CASE WHEN n_impacts > 0 THEN 1 ELSE 0 END) OVER (ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f WHERE attempt <= 40) SELECT attempt, severity, summary, n_impacts FROM b WHERE before < 10""")
def analysed_impacts(v: Views) -> DataFrame:
    """Removed and added relationships between two spans of time; a change of a part's edge touches what its part affects at once."""
    old, new = version_edges(v)
    changed = old.join(new.select("id"), "id", "left_anti").withColumn("severity", F.lit("HIGH")).unionByName(new.join(old.select("id"), "id", "left_anti").withColumn("severity", F.lit("INFO")))
    touched = graph.steps(edges(v), *graph.spread_directions()).groupBy(F.col("at").alias("target")).agg(F.countDistinct("to").alias("n_impacts"))
    rows = changed.join(touched, "target", "left").select(F.lit("RELATIONSHIP").alias("scope"), "severity", F.col("id").alias("summary"), F.coalesce("n_impacts", F.lit(0)).alias("n_impacts"))
    return compare.analysed(rows).select(F.col("attempt").cast("long").alias("attempt"), "severity", "summary", "n_impacts")


# Jobs.


@query("z2_claimed_jobs", """, j AS (SELECT event_id, ts, row_number() OVER (ORDER BY ts, event_id) AS turn FROM events WHERE event_type = 'signup' AND (event_id % 2 = 0 OR ts <= TIMESTAMP '2024-01-10')), w AS (SELECT n_name AS worker, row_number() OVER (ORDER BY n_name) AS turn FROM nation)
SELECT event_id AS id, worker, (event_id % 3 + 1)::BIGINT AS attempts FROM j JOIN w ON w.turn = j.turn""")
def claimed_jobs(v: Views) -> DataFrame:
    """Signups are jobs, of which odd ones wait for their time; nations are workers."""
    jobs = v.table("events").select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "signup", "PENDING").otherwise("SUCCEEDED").alias("state"), F.when(F.col("event_id") % 2 == 1, F.col("ts")).alias("run_after"), F.col("ts").alias("created_at"), (F.col("event_id") % 3).alias("attempts"))
    return review.claimed(jobs, v.table("nation").select(F.col("n_name").alias("worker")), F.expr("timestamp_ntz '2024-01-10'")).select("id", "worker", "attempts")


@query("z5_cancelled_jobs", """, j AS (SELECT event_id AS id, CASE event_type WHEN 'signup' THEN 'PENDING' WHEN 'view' THEN 'RUNNING' ELSE 'SUCCEEDED' END AS state, value >= 50 AS asked, event_id % 2 = 0 AS stops FROM events)
SELECT id, CASE WHEN asked AND (state = 'PENDING' OR (state = 'RUNNING' AND stops)) THEN 'CANCELLED' ELSE state END AS state, asked AND state = 'RUNNING' AND NOT stops AS cancel_requested FROM j""")
def cancelled_jobs(v: Views) -> DataFrame:
    events = v.table("events").withColumnRenamed("event_id", "id")
    jobs = events.select("id", F.when(F.col("event_type") == "signup", "PENDING").when(F.col("event_type") == "view", "RUNNING").otherwise("SUCCEEDED").alias("state"))
    return review.cancelled(jobs, events.where("value >= 50").select("id"), events.where("id % 2 = 0").select("id"))


@query("z6_next_jobs", """, d AS (SELECT 'GRAPH_EXTRACTION' AS kind, 'extraction:' || source || ':' || d.doc_id AS idempotency_key FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE quality = 1 UNION SELECT 'EMBEDDING', 'embedding:' || source || ':' || d.doc_id FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE quality = 0)
SELECT kind, idempotency_key FROM d WHERE idempotency_key NOT IN (SELECT 'embedding:' || source || ':' || doc_id FROM documents WHERE lang = 'de')""")
def next_jobs(v: Views) -> DataFrame:
    """Labelled documents have been embedded or, with quality 0, ingested; German ones have an embedding job already."""
    docs = v.table("documents").select("doc_id", "source", "lang")
    done = docs.join(v.table("labels").where("quality is not null"), "doc_id").select(F.when(F.col("quality") == 1, "EMBEDDING").otherwise("DOCUMENT_INGESTION").alias("kind"), F.col("source").alias("project"), F.col("doc_id").alias("version"))
    return review.next_jobs(done, docs.where("lang = 'de'").select(F.concat_ws(":", F.lit("embedding"), "source", F.col("doc_id").cast("string")).alias("idempotency_key")))
