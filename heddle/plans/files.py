"""Queries over stored source files, written and read by the Python Data Source."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.operators import ingest, retrieval
from heddle.operators.graph import kept_folder
from heddle.plans.base import query
from heddle.sources import datasource, markup
from heddle.tables import Views


def stored(v: Views, files: DataFrame) -> str:
    """files (path, content) written to a new store; its path."""
    datasource.register(v.spark)
    path = kept_folder(v.spark, "files")
    files.write.format(datasource.FORMAT).mode("append").save(path)
    return path


def read(v: Views, path: str, **options: str) -> DataFrame:
    return v.spark.read.format(datasource.FORMAT).options(**options).load(path)


@query("s16_stored_sources", "SELECT doc_id || '.md' AS path, left(sha256(text), 32) || '.md' AS key, strlen(text)::INT AS n_bytes FROM documents WHERE text IS NOT NULL")
def stored_sources(v: Views) -> DataFrame:
    docs = v.table("documents").where("text is not null").select(F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.col("text").cast("binary").alias("content"))
    return read(v, stored(v, docs)).select("path", "key", F.octet_length("content").alias("n_bytes"))


#: How many files of a batch are Python objects at a time.
FILES_AT_ONCE = 64

BRANDS = """, g AS (SELECT p_brand, p_partkey // 1000 AS k, p_partkey, p_name FROM part), f AS (SELECT p_brand || '-' || k || '.docx' AS path, * FROM g)
SELECT DISTINCT path, 0::INT AS n, 'HEADING' AS kind, p_brand AS text, 1::INT AS level FROM f UNION ALL SELECT path, 1, 'TEXT', string_agg('- ' || p_name, chr(10) ORDER BY p_partkey), NULL FROM f GROUP BY path
UNION ALL SELECT path, 2, 'TABLE', '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || p_partkey || ' | ' || p_name || ' |', chr(10) ORDER BY p_partkey), NULL FROM f GROUP BY path"""


@query("s7_docx_blocks", BRANDS)
def docx_blocks(v: Views) -> DataFrame:
    """A Word document per brand and thousand of keys: a heading, a list of names and a table."""

    def write(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, FILES_AT_ONCE):
                part = batch.slice(low, FILES_AT_ONCE).to_pydict()
                made = [markup.write_docx([("Heading1", brand), *(("ListParagraph", r["p_name"]) for r in rows), ("table", [["key", "name"], *([str(r["p_partkey"]), r["p_name"]] for r in rows)])]) for brand, rows in zip(part["p_brand"], part["rows"], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(part["path"], pa.string()), pa.array(made, pa.binary())], names=["path", "content"])

    parts = v.table("part").groupBy("p_brand", F.floor(F.col("p_partkey") / 1000).alias("k")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))).alias("rows"))
    files = parts.select(F.concat("p_brand", F.lit("-"), F.col("k").cast("string"), F.lit(".docx")).alias("path"), "p_brand", "rows").mapInArrow(write, "path string, content binary")
    return read(v, stored(v, files), **{"as": "blocks"}).select("path", "n", "kind", "text", "level")


@query("s19_labelled_questions", "SELECT item_id::VARCHAR AS id, 'kind ' || item_id % 4 AS category, text AS question, item_id % 5 <> 0 AS answerable, array_to_string(list_slice(string_split(text, ' '), 1, 3), '|') AS terms FROM benchmark")
def labelled_questions(v: Views) -> DataFrame:
    """A JSON file per item, either an object with questions or a plain array; a question without the flag is answerable."""
    item = F.col("item_id")
    row = F.struct(item.cast("string").alias("id"), F.concat(F.lit("kind "), (item % 4).cast("string")).alias("category"), F.col("text").alias("question"), F.when(item % 5 == 0, False).alias("answerable"), F.slice(F.split("text", " "), 1, 3).alias("expected_terms"))
    files = v.table("benchmark").select(F.concat(item.cast("string"), F.lit(".json")).alias("path"), F.when(item % 2 == 0, F.to_json(F.array(row))).otherwise(F.to_json(F.struct(F.array(row).alias("questions")))).cast("binary").alias("content"))
    rows = retrieval.question_rows(read(v, stored(v, files)))
    return rows.select("id", "category", "question", "answerable", F.array_join("expected_terms", "|").alias("terms"))


#: A customer's orders as a table; what the columns are called goes by the customer's nation, and every fifth nation's isn't a revision table.
HEADERS = [("Version", "Date", "Description", "Author"), ("Revision no.", "Date of issue", "Changes", "Owner"), ("Rev", "date", "By", "Summary of change"), ("Number", "Date", "Comment", "Author"), (" REVISION ", "Dated", "Text", "Author")]


@query("x27_revisions", """, t AS (SELECT c_custkey AS doc, c_nationkey % 5 AS h, o_orderkey::VARCHAR AS version, o_orderdate::VARCHAR AS date, o_orderpriority AS third, o_orderstatus AS fourth, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) AS k FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey % 5 <> 3)
SELECT doc, k::INT AS k, version, date, CASE h WHEN 0 THEN third WHEN 1 THEN third WHEN 2 THEN fourth END AS description, CASE h WHEN 2 THEN third ELSE fourth END AS author FROM t WHERE k <= 100""")
def revisions(v: Views) -> DataFrame:
    text = lambda c: F.col(c).cast("string")
    cells = v.table("orders").select(F.col("o_custkey").alias("c_custkey"), F.struct("o_orderkey", F.array(text("o_orderkey"), text("o_orderdate"), text("o_orderpriority"), text("o_orderstatus")).alias("row")).alias("r"))
    listed = cells.groupBy("c_custkey").agg(F.array_sort(F.collect_list("r"))["row"].alias("rows")).join(v.table("customer").select("c_custkey", "c_nationkey"), "c_custkey")
    header = F.get(F.array(*(F.array(*map(F.lit, h)) for h in HEADERS)), (F.col("c_nationkey") % 5).cast("int"))
    return ingest.revisions(listed.select(F.col("c_custkey").alias("doc"), F.lit(1).alias("n"), F.concat(F.array(header), "rows").alias("rows")))
