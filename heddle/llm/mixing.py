"""Mixing sources to target weights by Pfair scheduling.

Weights are whole numbers; nothing is rounded.  Of sources with weights w that sum to W, block j (from 1) of one has
the release time floor((j - 1) W / w) and the deadline ceil(j W / w), in slots of one block.  Earliest
deadline first among released blocks meets all deadlines, as the shares sum to
one, so after any number of slots each source is less than one block away from
its share t w / W, for as long as all have blocks left.  The schedule repeats after W / gcd(weights)
slots: one period, or as much of it as there are blocks, is worked out from the table of sources, and every
document finds its slot by arithmetic.  A source that ends leaves its later slots
empty, so the others go on in their proportions; no document is dropped or repeated.

Scale.  Places within a source come from counts of hash ranges of about
``range_docs`` documents, so no task holds a whole source, however hot.
Earliest deadline first is sequential: one task works out min(period, slots of the corpus) slots, in
time proportional to that times the sources (some microseconds a slot for 20 sources).  By default the weights are ``shares`` whole shares, so the period is
short at any size; weights with a long period cost time, not exactness.  The period's table is joined without a hint: Spark broadcasts it below its own limit.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.store import Scratch

#: Slots whose picks are gathered in one array before it joins the others.
STRETCH = 256


def source_weights(counts: DataFrame, shares: int, weights: dict[str, int] | None = None) -> DataFrame:
    """__source, n, units (the weight) and period (the weights' sum), both without their greatest common divisor.

    weights: whole numbers from 1 per source, taken as they are; sources without one weigh 1.  By default ``shares`` shares (four per source, if
    that is more) are dealt in proportion to the square root of the document counts, at least one each, by largest remainder; these are the target weights then.
    """
    if weights is None:
        whole = counts.select("__source", "n", F.floor(1000 * F.sqrt("n")).cast("long").alias("w")).select("*", F.expr("sum(w) over ()").alias("all"), F.expr("count(*) over ()").alias("sources"))
        whole = whole.withColumn("shares", F.greatest(F.lit(shares).cast("long"), 4 * F.col("sources")))
        rest = (F.col("shares") - F.col("sources")) * F.col("w") % F.col("all")
        dealt = whole.select("*", F.expr("(shares - sources) * w div all").alias("dealt"), rest.alias("rest"))
        dealt = dealt.select("*", F.expr("shares - sources - sum(dealt) over ()").alias("left"), F.expr("row_number() over (order by rest desc, __source)").alias("turn"))
        given = dealt.select("__source", "n", (1 + F.col("dealt") + (F.col("turn") <= F.col("left")).cast("long")).alias("w"))
    else:
        if any(v < 1 or v != int(v) for v in weights.values()):
            raise ValueError("weights are whole numbers from 1")
        weight = F.coalesce(*(F.when(F.col("__source") == k, F.lit(int(v))) for k, v in weights.items()), F.lit(1))
        given = counts.select("__source", "n", weight.cast("long").alias("w"))
    # Euclid's algorithm ends within 92 steps for whole numbers of 64 bits.
    divisor = """aggregate(collect_list(w) over (), 0L, (g, w) -> aggregate(sequence(1, 92), named_struct('a', w, 'b', g),
        (x, k) -> if(x.b = 0, x, named_struct('a', x.b, 'b', x.a % x.b)), x -> x.a))"""
    given = given.select("*", F.expr(divisor).alias("g"), F.expr("sum(w) over ()").alias("all"))
    return given.select("__source", "n", F.expr("w div g").alias("units"), F.expr("all div g").alias("period"))


def schedule(units: DataFrame, block_docs: int) -> DataFrame:
    """__source, nth (from 0) and slot of the blocks of one period, or of those slots of it that the corpus needs, by earliest deadline first."""
    needed = F.max(F.expr(f"((n + {block_docs - 1}) div {block_docs} * period + units - 1) div units"))
    row = units.agg(F.array_sort(F.collect_list(F.struct("__source", "units"))).alias("s"), F.first("period").alias("period"), F.least(F.first("period"), needed).alias("slots")).where("slots > 0")
    steps = row.selectExpr("s", f"""flatten(aggregate(sequence(0L, slots - 1, {STRETCH}L),
        named_struct('picked', cast(array() as array<array<int>>), 'done', transform(s, x -> 0L)),
        (whole, from) -> transform(array(aggregate(sequence(from, least(from + {STRETCH}, slots) - 1),
            named_struct('picked', cast(array() as array<int>), 'done', whole.done),
            (a, t) -> transform(array(array_min(transform(s, (x, i) -> if(a.done[i] * period div x.units <= t,
                    named_struct('deadline', ((a.done[i] + 1) * period + x.units - 1) div x.units, 'i', i), null))).i),
                p -> named_struct('picked', concat(a.picked, array(p)), 'done', transform(a.done, (d, i) -> d + if(i = p, 1L, 0L))))[0])),
            part -> named_struct('picked', concat(whole.picked, array(part.picked)), 'done', part.done))[0],
        whole -> whole.picked)) as picked""")
    slots = steps.select("s", F.posexplode("picked").alias("slot", "p")).select(F.col("s")[F.col("p")]["__source"].alias("__source"), F.col("slot").cast("long").alias("slot"))
    return slots.withColumn("nth", F.expr("row_number() over (partition by __source order by slot) - 1").cast("long"))


def mix(docs: DataFrame, weights: dict[str, int] | None = None, block_docs: int = 32, shares: int = 1000, range_docs: int = 4_000) -> DataFrame:
    """docs with mix_block (block of its source), mix_slot and mix_offset (place in the block); their order is the mixture.

    Within a source the order is that of md5(doc_id).  A null source counts as the empty one; rows with a null doc_id are
    spread over their source; rows that repeat a doc_id stand in any order among
    themselves.  Columns of docs named like those added are replaced; others may
    have any name that does not start with two underscores.  Texts aren't read.  An empty table gives an empty one.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    docs = docs.drop("mix_block", "mix_slot", "mix_offset")
    columns = docs.columns
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("row "), F.monotonically_increasing_id().cast("string")))
    named = docs.select("*", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("__source"), F.md5(key).alias("__order"))
    units = scratch.keep(source_weights(named.groupBy("__source").agg(F.count("*").alias("n")), shares, weights).coalesce(1))
    slots = scratch.keep(schedule(units, block_docs).coalesce(1)).select(F.col("__source").alias("__of"), "nth", "slot")
    ranges = F.ceil(F.col("n") / range_docs).cast("long")
    bucket = F.shiftright(F.conv(F.substring("__order", 1, 8), 16, 10).cast("long") * ranges, 32)
    ranged = named.join(units, "__source").withColumn("__range", bucket)
    sizes = ranged.groupBy("__source", "__range").agg(F.count("*").alias("__size"))
    before = sizes.select("__source", "__range", F.expr("coalesce(sum(__size) over (partition by __source order by __range rows between unbounded preceding and 1 preceding), 0)").alias("__before"))
    placed = ranged.join(before, ["__source", "__range"]).withColumn("__place", F.col("__before") + F.expr("row_number() over (partition by __source, __range order by __order)") - 1)
    placed = placed.withColumn("mix_block", F.expr(f"__place div {block_docs}")).withColumn("mix_offset", F.col("__place") % block_docs)
    placed = placed.join(slots, (F.col("__source") == F.col("__of")) & (F.col("nth") == F.col("mix_block") % F.col("units")))
    placed = placed.withColumn("mix_slot", F.expr("mix_block div units * period + slot"))
    return placed.select(*columns, "mix_block", "mix_slot", "mix_offset")


def op5_pfair_mixing(spark, sf_dir: str) -> DataFrame:
    rows = mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source"))
    return rows.select("doc_id", "source", "mix_block", "mix_slot", "mix_offset").orderBy("mix_slot", "mix_offset")


ORACLE = r"""
WITH RECURSIVE n AS (SELECT coalesce(source, '') AS s, count(*) AS n, floor(1000 * sqrt(count(*)))::BIGINT AS w FROM documents GROUP BY 1),
a AS (SELECT s, w, sum(w) OVER ()::BIGINT AS total, count(*) OVER () AS c, greatest(1000, 4 * count(*) OVER ()) AS l FROM n),
b AS (SELECT *, ((l - c) * w) // total AS dealt, ((l - c) * w) % total AS rest FROM a),
u AS (SELECT s, l, 1 + dealt + CASE WHEN row_number() OVER (ORDER BY rest DESC, s) <= l - c - sum(dealt) OVER () THEN 1 ELSE 0 END AS k FROM b),
e AS (SELECT 0::BIGINT AS t, s, k, l, 0::BIGINT AS done, false AS picked FROM u
  UNION ALL SELECT t + 1, s, k, l, done + CASE WHEN best THEN 1 ELSE 0 END, best FROM (SELECT *, row_number() OVER (ORDER BY CASE WHEN done < k AND done * l // k <= t THEN 0 ELSE 1 END, ((done + 1) * l + k - 1) // k, s) = 1 AS best FROM e WHERE t < l)),
z AS (SELECT s, k, l, t - 1 AS slot, done - 1 AS nth FROM e WHERE picked),
p AS (SELECT doc_id, source, coalesce(source, '') AS s, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY md5(doc_id::VARCHAR)) - 1 AS place FROM documents)
SELECT doc_id, source, place // 32 AS mix_block, ((place // 32) // z.k * z.l + z.slot)::BIGINT AS mix_slot, place % 32 AS mix_offset
FROM p JOIN z ON z.s = p.s AND z.nth = (place // 32) % z.k
"""
