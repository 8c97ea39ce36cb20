"""Exact Jaccard join of word n-gram sets by a partition of the universe of shingles.

Sizes fall into bands whose largest is at most 100 / percent times their smallest, so a set can only be linked to smaller ones of its own band
and of the band below.  Two linked sets whose smaller is in a band differ by at most H shingles, H fixed for the band; its shingles are hashed
into H + 1 segments.  Among any H + 1 units of evidence one must hold: a segment in which the two sets are equal is one unit, a segment
in which they differ by one shingle at most is two.  Each set is indexed in its own band by the subset in every segment and, in one reserve segment of
RESERVE, by the subset's one-deletion neighbours too; it asks its own band and the one below in the same way.

Allocation.  At first each segment is one unit.  Once the sizes of all buckets are known, a set skips the segments with its largest buckets (empty subsets, subsets of frequent
shingles) and takes as many reserve segments at two units instead, cheapest first, as long as that lowers its cost; the units stay H + 1, so no link is lost.

Scale.  Signatures are 0.2 of a set's size per band asked and are shuffled once, by bucket; buckets of one set end there.  Equal sets are one class, so copies cost a row
each.  Members of a bucket are held against a hub, the asking one with most company, on their full sets, not against each other; links become components, and what is still open
between components is settled exactly: pairs that share a shingle of at most RARE open sets meet there with a bound on their overlap, all others
can only share frequent shingles, and members without enough of those for their size drop out before their bucket is listed.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heddle.llm import textcore as tc
from heddle.llm.components import connected_components
from heddle.llm.near_dedup import _full_sets, shingle_sets
from heddle.llm.store import Scratch

#: One segment of so many has one-deletion neighbours, the first always.
RESERVE = 32
HUB_ROUNDS = 2
RARE = 32
#: Bits of a row's tag: the segment, the number of reserve segments, then whether it is a neighbour and whether it asks the band below.
_BITS = 28
_U64 = np.uint64


_starts: dict[int, list[int]] = {}


def band_of(size: int, percent: int) -> int:
    """The band of a size; ``band_end`` is its largest."""
    starts = _starts.setdefault(percent, [1])
    while starts[-1] <= size:
        starts.append(starts[-1] * 100 // percent + 1)
    return bisect.bisect_right(starts, size) - 1


def band_end(band: int, percent: int) -> int:
    """At most 100 / percent times the band's smallest size; of bands up to one that ``band_of`` has given."""
    return _starts[percent][band] * 100 // percent


def segments_of(largest: int, percent: int) -> int:
    """One more than the shingles in which a linked pair can differ, whose smaller set has at most ``largest``."""
    return largest * (100 - percent) // percent + 1


def signatures(shingles: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket keys, tags) of one set, for its own band and for the band below."""
    band = band_of(len(shingles), percent)
    value = tc.splitmix(shingles ^ _U64(0x5D))
    for below in range(min(band, 1) + 1):
        m = segments_of(band_end(band - below, percent), percent)
        if m < 2:
            continue
        number = _U64(band - below)
        segment = (((tc.splitmix(shingles + number) >> _U64(32)) * _U64(m)) >> _U64(32)).astype(np.int64)
        order = np.argsort(segment, kind="stable")
        total = np.zeros(len(order) + 1, dtype=_U64)
        np.cumsum(value[order], out=total[1:], dtype=_U64)
        cut = np.searchsorted(segment[order], np.arange(m + 1))
        subset = total[cut[1:]] - total[cut[:-1]]
        place = tc.splitmix((number << _U64(32)) + np.arange(m, dtype=_U64))
        flags = (-(-m // RESERVE) << _BITS) | (below << (2 * _BITS + 1))
        yield tc.splitmix(subset + place), np.arange(m, dtype=np.int64) | flags
        near = np.flatnonzero(segment % RESERVE == 0)
        at = segment[near]
        yield tc.splitmix(subset[at] - value[near] + place[at]), at | flags | (1 << 2 * _BITS)


def _sums(words: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64())])

    def run(batches):
        for batch in batches:
            for a, b, data, offsets in tc.pieces(batch.column(1)):
                rows = [(len(s), s.sum(dtype=_U64), tc.splitmix(s).sum(dtype=_U64)) for s in shingle_sets(data, offsets, words)]
                size, set_a, set_b = (np.array([r[k] for r in rows], dtype=_U64).view(np.int64) for k in range(3))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(size), pa.array(set_a), pa.array(set_b)], schema=schema)

    return run


def _signed(words: int, percent: int):
    """Rows (key, name, tag) of all sets; equal sets of a task once."""
    schema = pa.schema([("key", pa.int64()), ("name", pa.int64()), ("tag", pa.int64())])

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for _, _, data, offsets in tc.pieces(batch.column(0)):
                keys, tags, names, sizes = [], [], [], []
                for s in shingle_sets(data, offsets, words):
                    name = int(s.sum(dtype=_U64).view(np.int64))
                    if len(s) == 0 or name in seen:
                        continue
                    seen.add(name)
                    for key, tag in signatures(s, percent):
                        keys.append(key)
                        tags.append(tag)
                        names.append(name)
                        sizes.append(len(key))
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.repeat(np.array(names, dtype=np.int64), sizes)), pa.array(np.concatenate(tags))], schema=schema)

    return run


def allocated(n: np.ndarray, key: np.ndarray, tag: np.ndarray) -> np.ndarray:
    """Which of one set's rows ask; n is the number of sets in the row's bucket.

    The i-th largest bucket of an ordinary segment is skipped if the i-th cheapest reserve segment costs less; a reserve segment
    none of whose neighbours met anyone costs nothing.
    """
    mask = (1 << _BITS) - 1
    segment, near, below = tag & mask, tag >> 2 * _BITS & 1 == 1, tag >> 2 * _BITS + 1 & 1
    asks = ~near
    for b in (0, 1):
        plain = np.flatnonzero((below == b) & ~near & (segment % RESERVE != 0))
        if not len(plain):
            continue
        dearest = plain[np.lexsort((key[plain], n[plain]))[::-1]]
        own = np.flatnonzero((below == b) & near)
        reserve, at = np.unique(segment[own], return_inverse=True)
        price = np.bincount(at, weights=n[own] - 1, minlength=len(reserve)).astype(np.int64)
        by_price = np.argsort(price, kind="stable")
        free = int(tag[plain[0]] >> _BITS & mask) - len(reserve)
        prices = np.concatenate([np.zeros(free, dtype=np.int64), price[by_price]])
        turns = min(len(dearest), len(prices))
        swaps = int((n[dearest[:turns]] - 1 > prices[:turns]).sum())
        asks[dearest[:swaps]] = False
        asks[own[np.isin(segment[own], reserve[by_price[: max(0, swaps - free)]])]] = True
    return asks


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("key", T.LongType()), T.StructField("asks", T.BooleanType()), T.StructField("indexed", T.BooleanType())])))
def _asking(rows: pa.Array) -> pa.Array:
    """Of lists of (n, key, tag), one per set, lists of (key, asks, indexed)."""
    first = np.asarray(rows.offsets).astype(np.int64)
    n, key, tag = (rows.values.field(k).to_numpy(zero_copy_only=False) for k in range(3))
    asks = np.concatenate([np.zeros(first[0], dtype=bool), *(allocated(n[a:b], key[a:b], tag[a:b]) for a, b in zip(first[:-1], first[1:], strict=True))])
    indexed = tag[: first[-1]] >> 2 * _BITS + 1 & 1 == 0
    return pa.ListArray.from_arrays(rows.offsets, pa.StructArray.from_arrays([pa.array(key[: first[-1]]), pa.array(asks), pa.array(indexed)], names=["key", "asks", "indexed"]))


def _reaches(overlap: Column, percent: int) -> Column:
    """Whether an overlap reaches percent of the union of sets of n_a and n_b."""
    return (100 + percent) * overlap >= percent * (F.col("n_a") + F.col("n_b"))


def _sizes_fit(percent: int) -> Column:
    return 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Of pairs (a, n_a, b, n_b) those whose full sets reach percent.  ``sets`` lies in buckets by id, for a; b's are written anew, so that a hub can be split."""
    pairs = scratch.keep(pairs.where((F.col("a") != F.col("b")) & _sizes_fit(percent)).distinct())
    held = scratch.keep(sets.join(pairs.select(F.col("b").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("b"), F.col("shingles").alias("s_b")))
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("s_a")), "a").join(held, "b")
    out = scratch.keep(both.where(_reaches(F.size(F.array_intersect("s_a", "s_b")), percent)).select("a", "b"))
    scratch.drop(held)
    return out


def _open_pairs(rows: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs of different components that share a bucket and may reach percent; rows (key, id, n, asks, indexed, component)."""
    ids = scratch.keep(rows.select("id", "n", "component").distinct())
    tokens = sets.join(ids.select("id"), "id", "left_semi").select("id", F.explode("shingles").alias("g"))
    shared = scratch.keep(tokens.groupBy("g").agg(F.count("*").alias("df")).where("df > 1"))
    known = scratch.keep(tokens.join(shared, "g"))
    frequent = known.where(F.col("df") > RARE).groupBy("id").agg(F.count("*").alias("f"))
    sized = scratch.keep(ids.join(frequent, "id", "left").withColumn("f", F.coalesce("f", F.lit(0))))
    apart = (F.col("component_a") != F.col("component_b")) & _sizes_fit(percent)
    columns = ("id", "n", "f", "component")
    side = lambda c, *more: [F.col(x).alias(f"{x}_{c}") for x in (*columns, *more)]
    # A rare shingle's sets are at most RARE and stand in its row.
    rare = known.where(F.col("df") <= RARE).join(sized, "id").groupBy("g").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("m"))
    rare = rare.where(F.size(F.array_distinct(F.col("m.component"))) > 1)
    met = rare.select("m", F.posexplode("m").alias("k", "x")).select("x", F.explode(F.slice("m", F.col("k") + 2, RARE)).alias("y"))
    met = met.select(*(F.col(f"{v}.{x}").alias(f"{x}_{c}") for v, c in (("x", "a"), ("y", "b")) for x in columns)).where(apart)
    met = met.groupBy("id_a", "id_b", "n_a", "n_b", "f_a", "f_b").agg(F.count("*").alias("rare"))
    pair = [F.col("id_a").alias("a"), "n_a", F.col("id_b").alias("b"), "n_b"]
    by_rare = met.where(_reaches(F.least("f_a", "f_b") + F.col("rare"), percent)).select(*pair)
    # All others share frequent shingles only, and each needs enough of them for the smallest of its bucket.
    full = scratch.keep(rows.select("key", "id", "asks", "indexed").join(sized, "id"))
    least = full.groupBy("key").agg(F.min("n").alias("least"))
    able = full.join(scratch.keep(least), "key").where((100 + percent) * F.col("f") >= percent * (F.col("n") + F.greatest(F.col("least"), F.ceil(percent * F.col("n") / 100))))
    able = scratch.keep(able.drop("least"))
    keys = able.groupBy("key").agg(F.min("component").alias("one"), F.max("component").alias("other")).where("one <> other").select("key")
    able = scratch.keep(able.join(scratch.keep(keys), "key"))
    asking, indexed = able.where("asks").select("key", *side("a")), able.where("indexed").select("key", *side("b"))
    by_frequent = asking.join(indexed, "key").where(apart & _reaches(F.least("f_a", "f_b"), percent)).select(*pair)
    return by_rare.unionByName(by_frequent)


def join_components(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Per row of docs: doc_id, n_shingles and component_id, the smallest doc_id reachable over links, itself included.

    Linked are documents with 100 * intersection >= percent * union of their sets of distinct ``words``-word shingles
    (A-Z folded; of fewer words the whole sequence is one), with 50 < percent < 100.  Null, empty and blank texts have no shingles
    and are linked with nothing.  A doc_id that occurs twice is one node and has a row per occurrence; of its texts the one whose
    set has the smallest sums stands for it.  Rows without a doc_id come back with a null component_id and are linked with nothing.  Only doc_id and text
    are read, so other columns may have any name.
    """
    scratch = Scratch(docs.sparkSession, "join")
    docs = docs.select("doc_id", "text")
    every = scratch.keep(docs.mapInArrow(_sums(words), "doc_id long, n_shingles long, set_a long, set_b long"))
    known = every.where("n_shingles > 0 and doc_id is not null")
    chosen = scratch.keep(known.groupBy("doc_id").agg(F.min(F.struct("set_a", "set_b", "n_shingles")).alias("x")).select("doc_id", "x.*"))
    named = scratch.keep(chosen.groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("id")))
    member = chosen.join(named, ["set_a", "set_b", "n_shingles"]).select("doc_id", "id")
    # Buckets: one shuffle by key, in which equal sets of different tasks meet too.
    signed = docs.where("doc_id is not null").select("text").mapInArrow(_signed(words, percent), "key long, name long, tag long")
    signed = signed.repartition("key").groupBy("key", "name").agg(F.min("tag").alias("tag"))
    met = scratch.keep(signed.withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1"))
    # Two sets of one 64-bit name are both joined, and told apart when they are verified.
    ids = named.select(F.col("set_a").alias("name"), "set_a", "id", F.col("n_shingles").alias("n_set"))
    own = met.repartition("name").groupBy("name").agg(F.collect_list(F.struct("n", "key", "tag")).alias("x"))
    company = F.aggregate("x", F.lit(0).cast("long"), lambda a, r: a + r["n"])
    asked = own.select("name", company.alias("company"), _asking("x").alias("x"))
    rows = asked.join(ids, "name").select("id", F.col("n_set").alias("n"), "set_a", "company", F.explode("x").alias("r"))
    rows = scratch.keep(rows.select("id", "n", "set_a", "company", "r.key", "r.asks", "r.indexed").where("r.asks or r.indexed"))
    scratch.drop(met)
    live = rows.groupBy("key").agg(F.bool_or("asks").alias("asks"), F.bool_or("indexed").alias("indexed"), F.min("id").alias("one"), F.max("id").alias("other"))
    rows = scratch.keep(rows.join(scratch.keep(live.where("asks and indexed and one <> other").select("key")), "key"))
    wanted = scratch.keep(rows.select(F.col("id").alias("doc_id"), "set_a").distinct())
    rows = rows.drop("set_a")
    near = docs.join(wanted.hint("merge"), "doc_id")
    sets = scratch.keep_by(near.select("doc_id", "text", "set_a").mapInArrow(_full_sets(words), "id long, shingles array<long>"), "id")
    links, component = None, None

    def mixed() -> DataFrame:
        """Rows of the buckets that hold several components, and one that asks."""
        now = rows.withColumn("component", F.col("id")) if component is None else rows.join(component, "id", "left").withColumn("component", F.coalesce("component", "id"))
        now = scratch.keep(now)
        keys = now.groupBy("key").agg(F.min("component").alias("one"), F.max("component").alias("other"), F.bool_or("asks").alias("asks")).where("one <> other and asks").select("key")
        return scratch.keep(now.join(scratch.keep(keys), "key"))

    def linked(pairs: DataFrame) -> None:
        nonlocal links, component
        more = _verified(pairs, sets, percent, scratch)
        if links is not None and not more.limit(1).count():
            return
        links = more if links is None else links.unionByName(more)
        component = connected_components(links, scratch)

    for turn in range(HUB_ROUNDS):
        now = mixed()
        rank = F.struct("company", (-F.col("id")).alias("o"))
        hub_of = lambda frame: scratch.keep(frame.where("asks").groupBy("key").agg(F.max_by(F.struct("id", "n", "component"), rank).alias("hub")))
        hubs = hub_of(now)
        if turn:  # the one with most company outside the component of the one with most
            hubs = hub_of(now.join(hubs, "key").where("component <> hub.component").drop("hub"))
        met = now.join(hubs, "key", "left")
        linked(met.where("component <> hub.component").select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("hub.id").alias("b"), F.col("hub.n").alias("n_b")))
        # The hub has met all of its bucket, so it leaves it; a bucket of two ends here.
        rows = scratch.keep(met.where("hub is null or id <> hub.id").select(*rows.columns))
    linked(_open_pairs(mixed(), sets, percent, scratch))
    smallest = member.join(component, "id", "left").select("doc_id", F.coalesce("component", "id").alias("component"))
    out = every.select("doc_id", "n_shingles").join(smallest, "doc_id", "left")
    out = scratch.keep(out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id")))
    scratch.clear(out)
    return out


def op12_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return join_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=4, percent=85)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(list_slice(ws, i, i + 3), ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS node FROM documents UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.m AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(node) AS m FROM r GROUP BY id) c ON c.id = d.doc_id
"""
