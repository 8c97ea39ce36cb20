"""Importance resampling toward a target distribution, in DataFrame functions.

Features are hashed to a fixed number of buckets.  Buckets are counted over all source and all target texts, which
gives a gain per bucket; a document's weight is the sum of its features' gains, and a Gumbel key on top of it
makes the highest scores a draw without replacement in proportion to the weights.

Scale.  Counts are aggregated before they are shuffled: a row per bucket and task.  The gain table is the one thing
broadcast and has at most ``buckets`` rows.  Texts aren't shuffled; what is shuffled
is one row of five numbers per document, once for its sum and once for the sort.  Ranks are a row's place in its partition of
the sorted table plus the rows of the partitions before it, so no window holds all documents; the sort ends with the
row's own number, so repeated documents don't share a partition by force.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.llm.licenses import LOWER, SEPARATORS, UPPER
from heddle.llm.store import Scratch

#: monotonically_increasing_id has a row's place in its partition in its low bits.
PLACE_BITS = 33


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS, -1), "")


def ngrams(words: Column, least: int, most: int) -> Column:
    """All runs of least to most words, joined by one space."""

    def runs(n: int) -> Column:
        listed = F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))
        return F.when(F.size(words) >= n, listed).otherwise(F.array().cast("array<string>"))

    return F.concat(*(words if n == 1 else runs(n) for n in range(least, most + 1)))


def bucket_counts(source: DataFrame, target: DataFrame, buckets: int, least: int, most: int) -> DataFrame:
    """(bucket, s, t): how many features of all source and of all target texts fall into each bucket; at most ``buckets`` rows."""
    texts = source.select("text", F.lit(1).alias("s"), F.lit(0).alias("t")).unionByName(target.select("text", F.lit(0).alias("s"), F.lit(1).alias("t")))
    found = texts.select(F.explode(ngrams(words_of(F.col("text")), least, most)).alias("g"), "s", "t")
    return found.select(F.pmod(F.crc32("g"), F.lit(buckets)).alias("bucket"), "s", "t").groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))


def gain_table(counts: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain): a thousand log ratios of the smoothed shares, rounded down."""
    whole = counts.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first()
    ratio = (F.col("t") + 1).cast("double") * F.lit(float(whole["s"] + buckets)) / ((F.col("s") + 1).cast("double") * F.lit(float(whole["t"] + buckets)))
    return counts.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def gumbel(seed: int, doc_id: Column) -> Column:
    """A thousand standard Gumbel deviates from the hash of seed and id, rounded down."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, buckets: int = 10000, least: int = 1, most: int = 1, seed: int = 2024, percent: int = 10, min_words: int = 20) -> DataFrame:
    """Per row of docs: doc_id, n_features, weight, score and rank, all long; rank is null for rows that aren't drawn.

    Of the N rows with at least ``min_words`` words floor(percent * N / 100) are drawn: the highest scores, ties to the smaller
    doc_id, then to fewer features.  Null and empty texts have no features, weight 0 and
    a score, and are never drawn while min_words > 0.  Each repeated row is a row of its own.  A null doc_id is hashed as the empty string and comes
    after others in ties.  An empty target leaves the smoothed counts alone to decide; an
    empty source gives no rows.  Only doc_id and text are read, so other columns may have any name.
    """
    scratch = Scratch(docs.sparkSession, "resample")
    gains = gain_table(scratch.keep(bucket_counts(docs, target, buckets, least, most)), buckets)
    rows = docs.select("doc_id", words_of(F.col("text")).alias("words")).withColumn("row", F.monotonically_increasing_id())
    rows = rows.select("row", "doc_id", F.size("words").alias("n_words"), ngrams(F.col("words"), least, most).alias("grams"))
    rows = rows.select("row", "doc_id", "n_words", F.size("grams").cast("long").alias("n_features"), F.explode_outer("grams").alias("g"))
    valued = rows.withColumn("bucket", F.pmod(F.crc32("g"), F.lit(buckets))).join(F.broadcast(gains), "bucket", "left")
    summed = valued.groupBy("row", "doc_id", "n_words", "n_features").agg(F.coalesce(F.sum("gain"), F.lit(0)).cast("long").alias("weight"))
    scored = scratch.keep(summed.select("row", "doc_id", "n_features", "weight", (F.col("weight") + gumbel(seed, F.col("doc_id"))).cast("long").alias("score"), (F.col("n_words") >= min_words).alias("open")))
    order = [F.desc("open"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("row")]
    placed = scratch.keep(scored.orderBy(*order).withColumn("place", F.monotonically_increasing_id()).withColumn("part", F.shiftright("place", PLACE_BITS)))
    scratch.drop(scored)
    # One row per partition of the sort.
    parts = placed.groupBy("part").agg(F.count("*").alias("n"), F.count_if("open").alias("n_open"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = scratch.keep(parts.select("part", "n_open", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")))
    drawn = percent * (parts.agg(F.sum("n_open")).first()[0] or 0) // 100
    place = F.col("before") + F.col("place").bitwiseAND((1 << PLACE_BITS) - 1) + 1
    out = placed.join(F.broadcast(parts.select("part", "before")), "part").withColumn("rank", F.when(F.col("open") & (place <= drawn), place).cast("long"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op11_importance_resampling(spark, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = r"""
WITH crc AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM (SELECT unnest(range(256)) AS i)),
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS g FROM benchmark),
f AS (SELECT doc_id, unnest(ws) AS g FROM w),
v AS (SELECT g, hex(g) AS x FROM (SELECT g FROM f UNION SELECT g FROM b)),
k AS (SELECT g, xor(list_reduce(list_concat([4294967295], list_transform(range(len(x) // 2), lambda i: ('0x' || substr(x, (2 * i + 1)::INT, 2))::BIGINT)),
    lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295) % 10000 AS bucket FROM v, crc),
s AS (SELECT bucket, count(*) AS s FROM f JOIN k USING (g) GROUP BY 1),
t AS (SELECT bucket, count(*) AS t FROM b JOIN k USING (g) GROUP BY 1),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM f) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT count(*) FROM b) + 10000)::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
d AS (SELECT f.doc_id, sum(gain)::BIGINT AS weight FROM f JOIN k USING (g) JOIN gain USING (bucket) GROUP BY 1),
h AS (SELECT w.doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, ('0x' || left(sha256('2024:' || w.doc_id), 8))::BIGINT::DOUBLE AS h FROM w LEFT JOIN d USING (doc_id)),
r AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score, n_features >= 20 AS able FROM h),
p AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY able) AS n FROM r)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= 10 * n // 100 THEN place END AS rank FROM p
"""
