"""Queries over kept indexes: vectors by list, postings with positions, spellings, embeddings by content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.functions import text as X
from heddle.functions import vectors as V
from heddle.operators.embedding_index import EmbeddingIndex
from heddle.operators.graph import kept_folder, settled
from heddle.operators.lexical_index import LexicalIndex
from heddle.operators.vector_index import VectorIndex
from heddle.plans.analytics import ASKED, asked, lexical_sql
from heddle.plans.base import query
from heddle.tables import Views


def vector_index(v: Views) -> VectorIndex:
    return VectorIndex.build(v.table("embeddings").select(F.col("vec_id").alias("id"), "embedding"), kept_folder(v.spark, "vectors"))


@query("l2_index_exact", ASKED + " SELECT query, id, rank, round(score, 9) AS score FROM dr WHERE rank <= 10")
def index_exact(v: Views) -> DataFrame:
    """The index with all lists probed."""
    return vector_index(v).search(asked(v), 10).select("query", "id", F.col("rank").cast("long").alias("rank"), "score")


@query("l2_index_recall", ASKED + " SELECT query, round(score, 9) AS tenth, true AS recall_reached FROM dr WHERE rank = 10")
def index_recall(v: Views) -> DataFrame:
    """Per query the exact tenth score, and whether the index finds nine tenths of all exact neighbours in the lists that it was tuned to."""
    index = vector_index(v)
    exact = settled(index.search(asked(v), 10))  # read for the recall and for the rows
    near = index.search(asked(v), 10, index.tuned_probes(10, 0.95)).select("query", "id", F.lit(1).alias("found"))
    recall = exact.join(near, ["query", "id"], "left").agg(F.avg(F.coalesce("found", F.lit(0)))).first()[0]
    return exact.where("rank = 10").select("query", F.col("score").alias("tenth"), F.lit(recall is not None and recall >= 0.9).alias("recall_reached"))


#: Identifiers of three words of an item each, as a question would spell them.
CAMEL = """SELECT item_id AS query, string_agg(name, ' ' ORDER BY g) AS text FROM (SELECT item_id, (i - 1) // 3 AS g, string_agg(upper(left(w, 1)) || lower(substr(w, 2)), '' ORDER BY i) AS name
  FROM (SELECT item_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w, generate_subscripts(regexp_extract_all(text, '[A-Za-z]+'), 1) AS i FROM benchmark) GROUP BY item_id, g) GROUP BY item_id"""


@query("q2_phrase_search", lexical_sql(CAMEL) + " SELECT query, id, rank, n_covers, n_phrases, round(score, 6) AS score FROM lr WHERE rank <= 30")
def phrase_search(v: Views) -> DataFrame:
    """Questions whose identifiers are spelled from the items' words, against a kept index: nearly all covers are phrases."""
    words = F.transform(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substring(w, 2, 1 << 30))))
    items = v.table("benchmark").select(F.col("item_id").alias("query"), words.alias("w")).where("size(w) > 0")
    names = F.transform(F.sequence(F.lit(1), F.size("w"), F.lit(3)), lambda i: F.array_join(F.slice("w", i, 3), ""))
    index = LexicalIndex.build(v.table("documents").select(F.col("doc_id").alias("id"), "text"), kept_folder(v.spark, "postings"))
    found = index.search(items.select("query", F.array_join(names, " ").alias("text")))
    return found.select("query", "id", F.col("rank").cast("long").alias("rank"), "n_covers", "n_phrases", F.round("score", 6).alias("score"))


GROWN = ", ck AS (SELECT doc_id * 1000000 + pos AS id, content FROM chunks), half AS (SELECT max(doc_id) // 2 AS d FROM chunks), a AS (SELECT content FROM ck, half WHERE id < (d + 1) * 1000000), b AS (SELECT content FROM ck, half WHERE id >= (d + 1) * 1000000)"


@query("q14_incremental_runs", GROWN + """ SELECT 1::INT AS run, count(*) AS total, count(*) - count(DISTINCT content) AS reused, count(DISTINCT content) AS computed FROM a
UNION ALL SELECT 2, (SELECT count(*) FROM b), (SELECT count(*) FROM b) - n, n FROM (SELECT count(DISTINCT content) AS n FROM b WHERE content NOT IN (SELECT content FROM a)) UNION ALL SELECT 3, 0, 0, 0""")
def incremental_runs(v: Views) -> DataFrame:
    """Lines of the first half of the documents, then of all, then nothing new: later runs embed only what is new."""
    lines = v.chunks.select((F.col("doc_id") * 1_000_000 + F.col("pos")).alias("id"), "doc_id", "content")
    half = lines.agg(F.floor(F.max("doc_id") / 2)).first()[0]
    index = EmbeddingIndex(v.spark, kept_folder(v.spark, "embeddings"))
    embed = lambda c: V.hashed_embedding(F.transform(X.tokens(c), F.lower), 16)
    for rows in (lines.where(F.col("doc_id") <= half), lines, lines):
        index.run(rows, embed, "hashed", "16")
    return index.runs().select("run", "total", "reused", "computed")


@query("s17_keyset_pages", "SELECT doc_id AS id, ((row_number() OVER (ORDER BY doc_id) - 1) // ceil(count(*) OVER () / 4.0)::BIGINT + 1)::INT AS run FROM documents WHERE text IS NOT NULL")
def keyset_pages(v: Views) -> DataFrame:
    """Runs of at most a quarter of the documents, each behind the id that the one before ended with, until nothing is pending."""
    rows = v.table("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    index, most = EmbeddingIndex(v.spark, kept_folder(v.spark, "embeddings")), -(-rows.where("content is not null").count() // 4)
    while index.run(rows, lambda c: F.array(F.length(c).cast("double")), "length", "1", most)["total"]:
        pass
    pages = index.runs().where("total > 0").select("run", F.coalesce("after", F.lit(-1)).alias("after"), "upto")
    return rows.where("content is not null").join(F.broadcast(pages), (F.col("id") > F.col("after")) & (F.col("id") <= F.col("upto"))).select("id", "run")
