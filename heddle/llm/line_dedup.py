"""Line dedup with a suffix array over line IDs, by distributed prefix doubling.

Documents are sequences of their lines with a word.  Doubling round j ranks the suffixes
by their first 2**j lines: the ranks of the halves make a pair, pairs are sorted over
all executors, and the row number that follows the sort is the new rank.  Suffixes whose prefix stands
nowhere else leave the array, so a round costs what is still repeated.

A line is deleted if it lies in a run of consecutive lines with at least ``min_words``
words in all that also starts earlier, in the order of doc_id and line.  Every such run is
a union of minimal ones (that reach min_words from their first line on, or back from their last line), and
these have at most min_words lines, so ranks up to that depth tell them
apart: a run of n lines is named by the ranks of the two prefixes of 2**a <= n lines that
cover it.  Suffixes of one name are an interval of the array with that longest common
prefix; all but its earliest member are later copies.

DataFrame functions only.  No group is collected: the array is sorted by range, names
are aggregated before they are shuffled and written before they are joined, so that a very common line or run is
a skewed join, which Spark splits, and no group; frames stay within one document.  Texts are shuffled once, at any size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.store import Scratch

WORD = r"[^\x20\x09-\x0D]"


def _ranked(rows: DataFrame, keys: list[str], rank: str, scratch: Scratch) -> DataFrame:
    """keys that occur twice or more, with their place in sorted order."""
    repeated = rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys)
    return scratch.keep(repeated.orderBy(*keys).withColumn(rank, F.monotonically_increasing_id()))


def _lines(docs: DataFrame) -> DataFrame:
    parts = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("pos"), x.alias("line")))
    full = F.filter(parts, lambda x: x["line"].rlike(WORD))
    exploded = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("h"), F.posexplode(full).alias("p", "x"))
    return exploded.select("doc_id", "h", "p", "x.pos", F.unhex(F.md5(F.col("x.line"))).alias("line"), F.regexp_count(F.col("x.line"), F.lit(WORD + "+")).alias("w"))


def repeated_lines(docs: DataFrame, min_words: int, scratch: Scratch) -> DataFrame:
    """doc_id, h (hash of the text), gone (positions of the lines to delete, from 0), for documents that have any."""
    lines = _lines(docs)
    ranks = _ranked(lines, ["line"], "r0", scratch)
    # Rows that repeat a doc_id and its text are one document.
    rows = scratch.keep(lines.join(ranks, "line").drop("line").dropDuplicates(["doc_id", "h", "p"]))
    levels = 1
    while 2**levels <= min_words:
        k, old, new = 2 ** (levels - 1), f"r{levels - 1}", f"r{levels}"
        ahead = F.expr(f"first({old}) over (partition by doc_id, h order by p range between {k} following and {k} following)")
        paired = scratch.keep(rows.withColumn("other", F.when(F.col(old).isNotNull(), ahead)))
        whole = paired.where("other is not null")
        ranks = _ranked(whole, [old, "other"], new, scratch)
        joined = paired.join(ranks, [old, "other"], "left").drop("other")
        rows = scratch.keep(joined)
        scratch.drop(paired)
        levels += 1
    frame = f"over (partition by doc_id, h order by p rows between current row and {min_words - 1} following)"
    item = ", ".join(["p", "w", *(f"r{j}" for j in range(levels))])
    ahead = rows.select("doc_id", "h", "p", "pos", F.expr(f"collect_list(struct({item})) {frame}").alias("run"))
    # Every window of n lines from here that is minimal from one of its ends.
    total = lambda a, b: F.aggregate(F.slice("run", a, b), F.lit(0), lambda s, x: s + x["w"])
    lengths = F.filter(F.sequence(F.lit(1), F.size("run")), lambda n: (F.element_at("run", n)["p"] == F.col("p") + n - 1) & (total(F.lit(1), n) >= min_words) & ((total(F.lit(1), n - 1) < min_words) | (total(F.lit(2), n - 1) < min_words)))
    windows = ahead.select("doc_id", "h", "p", "run", F.explode(lengths).alias("n"))
    left, right = F.lit(None).cast("long"), F.lit(None).cast("long")
    for j in range(levels):
        fits = (F.col("n") >= 2**j) & (F.col("n") < 2 ** (j + 1))
        left = F.when(fits, F.element_at("run", 1)[f"r{j}"]).otherwise(left)
        right = F.when(fits, F.element_at("run", F.greatest(F.col("n") - 2**j + 1, F.lit(1)))[f"r{j}"]).otherwise(right)
    windows = windows.select("doc_id", "h", "p", "n", left.alias("left"), right.alias("right"), F.transform(F.slice("run", 1, F.col("n")), lambda x: x["p"]).alias("covered"))
    windows = scratch.keep(windows.where("left is not null and right is not null"))
    first = scratch.keep(windows.groupBy("n", "left", "right").agg(F.min(F.struct("doc_id", "h", "p")).alias("first"), F.count("*").alias("times")).where("times > 1").drop("times"))
    later = windows.join(first, ["n", "left", "right"]).where(F.struct("doc_id", "h", "p") != F.col("first"))
    covered = later.select("doc_id", "h", F.explode("covered").alias("p")).distinct()
    gone = covered.join(rows.select("doc_id", "h", "p", "pos"), ["doc_id", "h", "p"])
    gone = scratch.keep(gone.groupBy("doc_id", "h").agg(F.collect_list("pos").alias("gone")))
    scratch.clear(gone)
    return gone


def dedup_lines(docs: DataFrame, min_words: int = 10) -> DataFrame:
    """docs with text changed, and __n_lines (lines with a word), __n_removed.

    Null and empty texts stay as they are; lines without a word are neither counted
    nor deleted.  Rows with a null doc_id stay unchanged, and their lines count as no copies.
    Rows that repeat doc_id and text are one document and change alike; of one doc_id with several
    texts, the order of text hashes decides which is earlier.
    Other columns may have any name that does not start with two underscores.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    gone = repeated_lines(docs.select("doc_id", "text").where("doc_id is not null"), min_words, scratch)
    gone = gone.select(F.col("doc_id").alias("__doc_id"), F.col("h").alias("__h"), F.col("gone").alias("__gone"))
    found = docs.withColumn("__key", F.xxhash64("text")).join(gone.hint("merge"), (F.col("doc_id") == F.col("__doc_id")) & (F.col("__key") == F.col("__h")), "left")
    found = found.select(*(F.split("text", "\n", -1).alias("__parts") if c == "text" else c for c in docs.columns), "__gone")
    left = F.array_except(F.sequence(F.lit(0), F.size("__parts") - 1), F.col("__gone"))
    text = F.when(F.col("__gone").isNull(), F.array_join("__parts", "\n")).otherwise(F.array_join(F.transform(left, lambda i: F.get("__parts", i)), "\n"))
    n_lines = F.coalesce(F.size(F.filter("__parts", lambda x: x.rlike(WORD))), F.lit(0))
    n_lines = F.when(F.col("__parts").isNull(), F.lit(0)).otherwise(n_lines)
    return found.select(*(text.alias("text") if c == "text" else c for c in docs.columns), n_lines.cast("long").alias("__n_lines"), F.when(F.col("__gone").isNull(), F.lit(0)).otherwise(F.size("__gone")).cast("long").alias("__n_removed"))


def op9_suffix_line_dedup(spark, sf_dir: str) -> DataFrame:
    rows = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return rows.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"), "text")


ORACLE = r"""
WITH parts AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, pos, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS p, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM parts WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
c AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY p) AS s FROM l),
v AS (SELECT a.doc_id, a.p, b.p AS q FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.p BETWEEN a.p AND a.p + 9
  WHERE b.s - a.s + a.w >= 10 AND (b.s - b.w - a.s + a.w < 10 OR b.s - a.s < 10)),
t AS (SELECT v.doc_id, v.p, v.q, md5(string_agg(c.line, chr(10) ORDER BY c.p)) AS name FROM v JOIN c ON c.doc_id = v.doc_id AND c.p BETWEEN v.p AND v.q GROUP BY 1, 2, 3),
f AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY doc_id, p) AS turn FROM t),
g AS (SELECT DISTINCT c.doc_id, c.pos FROM f JOIN c ON c.doc_id = f.doc_id AND c.p BETWEEN f.p AND f.q WHERE turn > 1),
k AS (SELECT parts.doc_id, string_agg(line, chr(10) ORDER BY parts.pos) FILTER (g.pos IS NULL) AS text, count(g.pos) AS n_removed FROM parts LEFT JOIN g ON g.doc_id = parts.doc_id AND g.pos = parts.pos GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_lines, coalesce(k.n_removed, 0)::BIGINT AS n_removed, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id LEFT JOIN (SELECT doc_id, count(*) AS n FROM l GROUP BY 1) n ON n.doc_id = d.doc_id
"""
