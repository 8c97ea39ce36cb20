"""MinHash near-dedup with SetSketch registers.

A document's set of word shingles is summed up in registers
``1 - floor(log_b(min over the set of exponential hashes))``, kept in 16 bits.  They are mergeable
(elementwise maximum) and two sets share a register with a probability
close to their Jaccard similarity.  Slices of registers are band keys;
pairs that share a key are estimated jointly by likelihood from the registers and the known
set sizes, and those that may reach the threshold are verified on the
full sets of 64-bit shingle hashes.

Scale.  Counts and hubs of buckets are written before the rows of their buckets are joined to them, and so are the sets of
the hubs: a hot bucket or hub is then a skewed join, which Spark splits.  Texts are shuffled once, at any size.
Documents with equal sets are one class from the start, so a
group of exact copies costs a row each.  In a bucket all classes are held
against its hub, the member with most company in all its buckets, never all pairs; links join classes to
components, and only pairs of different components in one bucket are still open.  The last step is exact for
them without listing them: shingles are split into rare ones (in at most RARE open classes)
and frequent ones.  Pairs that share rare shingles meet on those, with an exact bound on their
overlap; all others share frequent shingles alone, so both must have enough of these for their sizes,
which members that hang on a hub by more edits than the threshold allows have not.
Recall: a pair at the threshold 0.8 misses all 32 bands of four registers with
probability (1 - 0.8**4)**32 = 5e-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.llm import textcore as tc
from heddle.llm.components import connected_components
from heddle.llm.store import Scratch

#: b and a of the sketch: registers count powers of b; a is the rate of the exponentials.
SKETCH_BASE, SKETCH_RATE, REGISTERS, ROWS_PER_BAND = 1.001, 20.0, 128, 4
#: Pairs whose likelihood has its maximum below threshold - SLACK aren't verified: over five standard deviations.
SLACK = 0.2
HUB_ROUNDS = 2
#: A shingle in more open classes is frequent.
RARE = 32


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """Per document the sorted distinct hashes of its n-word shingles; of fewer words, one for the whole sequence."""
    words = tc.Words(data, offsets, tc.NOT_SPACE)
    hashes = words.hashes(tc.FOLDED)
    grams = tc.ngrams(hashes, n)
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        if b - a >= n:
            yield np.unique(grams[a : b - n + 1])
        elif b > a:
            yield tc.ngrams(hashes[a:b], int(b - a))
        else:
            yield np.zeros(0, dtype=np.uint64)


_MULTIPLIERS = (tc.splitmix(np.arange(REGISTERS, dtype=np.uint64) + np.uint64(5)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def registers(shingles: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set of hashes, 16 bits each."""
    low = np.full(REGISTERS, 0xFFFFFFFF, dtype=np.uint32)
    half = (shingles >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(half), 2048):
        x = half[k : k + 2048, None] * _MULTIPLIERS[None, :]
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        x ^= x >> np.uint32(13)
        np.minimum(low, x.min(axis=0), out=low)
    smallest = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**32) / SKETCH_RATE
    return np.clip(np.floor(1 - np.log(smallest) / np.log(SKETCH_BASE)), 0, 65535).astype(np.uint16)


SKETCH_SCHEMA = "doc_id long, n_shingles long, set_a long, set_b long, registers array<smallint>, bands array<long>"


def _sketch(n: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("registers", pa.list_(pa.int16())), ("bands", pa.list_(pa.int64()))])
    slices = tc.splitmix(np.arange(REGISTERS // ROWS_PER_BAND, dtype=np.uint64))

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for a, b, data, offsets in tc.pieces(batch.column(1)):
                size = np.zeros(b - a, dtype=np.int64)
                sums = np.zeros((b - a, 2), dtype=np.uint64)
                regs = np.zeros((b - a, REGISTERS), dtype=np.uint16)
                for k, s in enumerate(shingle_sets(data, offsets, n)):
                    size[k] = len(s)
                    if len(s):
                        sums[k] = s.sum(dtype=np.uint64), tc.splitmix(s).sum(dtype=np.uint64)
                        regs[k] = registers(s)
                keys = tc.splitmix(regs.reshape(-1, ROWS_PER_BAND).copy().view(np.uint64).reshape(b - a, -1) ^ slices)
                full = size > 0
                ends = np.concatenate([[0], np.cumsum(full)]).astype(np.int32)
                listed = [pa.ListArray.from_arrays(pa.array(ends * w), pa.array(v[full].reshape(-1))) for v, w in (((regs.astype(np.int32) - 32768).astype(np.int16), REGISTERS), (keys.view(np.int64), keys.shape[1]))]
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(size), pa.array(sums[:, 0].view(np.int64)), pa.array(sums[:, 1].view(np.int64)), *listed], schema=schema)

    return run


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, set size, two sums that name the set, registers and band keys (both empty for an empty set)."""
    return docs.select("doc_id", "text").mapInArrow(_sketch(words), SKETCH_SCHEMA)


def _full_sets(n: int):
    """Of rows (id, text, sum of the set that stands for id) the sets of those that have that sum."""
    schema = pa.schema([("id", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for a, b, data, offsets in tc.pieces(batch.column(1)):
                want = batch.column(2).slice(a, b - a).to_numpy(zero_copy_only=False).view(np.uint64)
                sets = [(k, s) for k, s in enumerate(shingle_sets(data, offsets, n)) if s.sum(dtype=np.uint64) == want[k]]
                if sets:
                    ends = np.concatenate([[0], np.cumsum([len(s) for _, s in sets])]).astype(np.int32)
                    own = ids.slice(a, b - a).take(pa.array([k for k, _ in sets]))
                    yield pa.RecordBatch.from_arrays([own, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([s for _, s in sets]).view(np.int64)))], schema=schema)

    return run


def likely(size_a: Column, size_b: Column, above: Column, below: Column, least: float) -> Column:
    """Whether the joint likelihood of the register comparisons has its maximum at ``least`` or above.

    above and below count the registers in which a's or b's is larger.
    With u and v the shares of a and b in the summed sizes, their logarithm has the
    probabilities u - v J, v - u J and J (base near 1); it is concave in J,
    so its slope at ``least`` decides.
    """
    u, v = size_a / (size_a + size_b), size_b / (size_a + size_b)
    same = F.lit(REGISTERS) - above - below
    slope = same / F.lit(least) - v * above / F.greatest(u - v * least, F.lit(1e-9)) - u * below / F.greatest(v - u * least, F.lit(1e-9))
    return slope >= 0


def _verified(pairs: DataFrame, classes: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Of candidate pairs (a, b), once or repeated, those whose full sets reach percent.  b may be in any number of pairs (a hub)."""
    pairs = scratch.keep(pairs.where(F.col("a") != F.col("b")).select("a", "b").distinct())
    hubs = scratch.keep(pairs.select(F.col("b").alias("id")).distinct())
    # The tables lie in buckets by id, which suits a; b's rows are written anew, without buckets, so that the join can split a hub.
    side = lambda table, v, c: (table if c == "a" else scratch.keep(table.join(hubs, "id", "left_semi"))).select(F.col("id").alias(c), *(F.col(x).alias(f"{y}_{c}") for x, y in v.items()))
    for c in "ab":
        pairs = pairs.join(side(classes, {"n_shingles": "n", "registers": "r"}, c), c)
    sign = F.zip_with("r_a", "r_b", lambda x, y: F.when(x > y, 1).when(x < y, -1).otherwise(0))
    count = lambda k: F.size(F.filter("signs", lambda x: x == k))
    close = pairs.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")).select("a", "b", "n_a", "n_b", sign.alias("signs"))
    close = scratch.keep(close.where(likely(F.col("n_a"), F.col("n_b"), count(1), count(-1), percent / 100 - SLACK)).select("a", "b", "n_a", "n_b"))
    for c in "ab":
        close = close.join(side(sets, {"shingles": "s"}, c), c)
    shared = F.size(F.array_intersect("s_a", "s_b"))
    return scratch.keep(close.withColumn("shared", shared).where(100 * F.col("shared") >= percent * (F.col("n_a") + F.col("n_b") - F.col("shared"))).select("a", "b"))


def _open_pairs(rows: DataFrame, classes: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of different components that may reach percent, among rows that share a bucket."""
    open_ids = scratch.keep(rows.select("id", "component").distinct())
    tokens = sets.join(open_ids.select("id"), "id", "left_semi").select("id", F.explode("shingles").alias("g"))
    often = scratch.keep(tokens.groupBy("g").agg(F.count("*").alias("df")).where("df > 1"))
    known = scratch.keep(tokens.join(often, "g"))
    frequent = known.where(F.col("df") > RARE).groupBy("id").agg(F.count("*").alias("frequent"))
    sized = open_ids.join(classes.select("id", "n_shingles"), "id").join(frequent, "id", "left")
    sized = scratch.keep(sized.select("id", "component", F.col("n_shingles").alias("n"), F.coalesce("frequent", F.lit(0)).alias("f")))
    side = lambda frame, c: frame.select(*(F.col(x).alias(f"{x}_{c}") if x in ("id", "component", "n", "f", "bands") else F.col(x) for x in frame.columns))
    # An overlap o reaches percent if 100 o >= percent (n_a + n_b - o).
    reaches = lambda o: (100 + percent) * o >= percent * (F.col("n_a") + F.col("n_b"))
    apart = (F.col("component_a") != F.col("component_b")) & (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    # A rare shingle's classes are at most RARE, so they are listed in its row.
    rare = known.where(F.col("df") <= RARE).join(sized, "id").groupBy("g").agg(F.array_sort(F.collect_list(F.struct("id", "component", "n", "f"))).alias("m"))
    rare = rare.where(F.size(F.array_distinct(F.col("m.component"))) > 1)
    inner = rare.select("m", F.posexplode("m").alias("k", "x")).select("x", F.explode(F.slice("m", F.col("k") + 2, RARE)).alias("y"))
    met = inner.select(*(F.col(f"{v}.{x}").alias(f"{x}_{c}") for v, c in (("x", "a"), ("y", "b")) for x in ("id", "component", "n", "f"))).where(apart)
    met = met.groupBy("id_a", "id_b").agg(F.count("*").alias("rare"), *(F.first(f"{x}_{c}").alias(f"{x}_{c}") for c in "ab" for x in ("n", "f")))
    by_rare = met.where(reaches(F.least("f_a", "f_b") + F.col("rare"))).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    # The rest share frequent shingles only, so each needs enough of them for the smallest partner of its bucket.
    full = rows.drop("component").join(sized, "id")
    full = scratch.keep(full)
    smallest = scratch.keep(full.groupBy("band", "key").agg(F.min("n").alias("least")))
    able = full.join(smallest, ["band", "key"]).where((100 + percent) * F.col("f") >= percent * (F.col("n") + F.greatest(F.col("least"), percent * F.col("n") / 100)))
    able = scratch.keep(able)
    keys = scratch.keep(able.groupBy("band", "key").agg(F.min("component").alias("one"), F.max("component").alias("other")).where("one <> other").select("band", "key"))
    able = scratch.keep(able.drop("least").join(keys, ["band", "key"]).join(classes.select("id", "bands"), "id"))
    # A pair that reaches is able in each bucket that it shares, so it is listed in the first of them alone.
    first = F.array_position(F.zip_with("bands_a", "bands_b", lambda x, y: x == y), True) == F.col("band") + 1
    by_frequent = side(able, "a").join(side(able, "b"), ["band", "key"]).where(apart & (F.col("id_a") < F.col("id_b")) & reaches(F.least("f_a", "f_b")) & first).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    return by_rare.unionByName(by_frequent)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept.

    Linked are documents with 100 * intersection >= percent * union of their sets of distinct
    ``words``-word shingles (A-Z folded; a text of fewer words is one shingle).
    Null, empty and blank texts have no shingles and are linked with
    nothing.  Of each component the smallest doc_id is kept.  A doc_id that
    occurs twice is one node and has a row per occurrence; of its texts the one whose set has the smallest sums
    stands for it.  Rows without a doc_id come
    back unlinked, with null component_id, and are kept.  Only doc_id and text are read, so
    other columns may have any name.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    docs = docs.select("doc_id", "text")
    every = scratch.keep(sketches(docs, words))
    known = every.where("n_shingles > 0 and doc_id is not null")
    chosen = known.groupBy("doc_id").agg(F.min(F.struct("set_a", "set_b", "n_shingles")).alias("x")).select("doc_id", "x.*")
    chosen = scratch.keep(chosen)
    named = scratch.keep(chosen.groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("id")))
    member = scratch.keep(chosen.join(named, ["set_a", "set_b", "n_shingles"]).select("doc_id", "id"))
    own = known.join(named.select(F.col("id").alias("doc_id"), "set_a", "set_b"), ["doc_id", "set_a", "set_b"], "left_semi")
    classes = scratch.keep_by(own.select(F.col("doc_id").alias("id"), "set_a", "n_shingles", "registers", "bands"), "id")
    bands = classes.select("id", F.posexplode("bands").alias("band", "key"))
    # Only keys that two classes share stay.
    shared = scratch.keep(bands.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1"))
    open_bands = scratch.keep(bands.join(shared, ["band", "key"]))
    company = open_bands.groupBy("id").agg(F.sum("n").alias("company"))
    open_bands = scratch.keep(open_bands.join(company, "id").select("band", "key", "id", F.struct(F.col("company"), (-F.col("id")).alias("o")).alias("rank")))
    links, component = None, None
    # Of the texts, those of classes that share a bucket are read once more; this is the one shuffle of texts.
    ids = classes.join(open_bands.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("doc_id"), "set_a")
    near = docs.join(scratch.keep(ids).hint("merge"), "doc_id")
    sets = scratch.keep_by(near.select("doc_id", "text", "set_a").mapInArrow(_full_sets(words), "id long, shingles array<long>"), "id")

    def mixed() -> DataFrame:
        """Rows of buckets that still hold several components."""
        if component is None:
            return open_bands.withColumn("component", F.col("id"))
        rows = open_bands.join(component, "id", "left").withColumn("component", F.coalesce("component", "id"))
        rows = scratch.keep(rows)
        keys = rows.groupBy("band", "key").agg(F.min("component").alias("one"), F.max("component").alias("other")).where("one <> other").select("band", "key")
        return rows.join(scratch.keep(keys), ["band", "key"])

    def linked(pairs: DataFrame) -> None:
        nonlocal links, component
        more = _verified(pairs, classes, sets, percent, scratch)
        if links is not None and not more.limit(1).count():
            return
        links = more if links is None else links.unionByName(more)
        component = connected_components(links, scratch)

    for turn in range(HUB_ROUNDS):
        rows = scratch.keep(mixed()) if turn else mixed()
        hubs = scratch.keep(rows.groupBy("band", "key").agg(F.max_by(F.struct("id", "component"), "rank").alias("hub")))
        if turn:  # the first hub has met all; the next is the one outside its component with most company
            others = scratch.keep(rows.join(hubs, ["band", "key"]).where("component <> hub.component").drop("hub"))
            hubs = scratch.keep(others.groupBy("band", "key").agg(F.max_by(F.struct("id", "component"), "rank").alias("hub")))
        linked(rows.join(hubs, ["band", "key"]).where("component <> hub.component").select(F.col("id").alias("a"), F.col("hub.id").alias("b")))
    linked(_open_pairs(scratch.keep(mixed().select("band", "key", "id", "component")), classes, sets, percent, scratch))
    smallest = member.join(component, "id", "left").select("doc_id", F.coalesce("component", "id").alias("component")).distinct()
    out = every.select("doc_id", "n_shingles").join(smallest, "doc_id", "left")
    named = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    out = scratch.keep(out.select("doc_id", "n_shingles", F.coalesce(named, "doc_id").alias("component_id")))
    scratch.clear(out)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op7_setsketch_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=4, percent=80)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(list_slice(ws, i, i + 3), ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS node FROM documents UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.m AS component_id, d.doc_id = c.m AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(node) AS m FROM r GROUP BY id) c ON c.id = d.doc_id
"""
