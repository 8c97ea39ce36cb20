"""Ranked lexical search over a segmented index of compressed postings, document at a time.

Index.  Each task cuts its documents into segments of bounded bytes.  In a segment documents are numbered
by ascending doc_id, and every term of it has a row with its postings: blocks of at most BLOCK of them, each the variable-length
bytes of gaps between documents and of term frequencies.  A head row holds the segment's doc_ids and lengths.  Texts aren't
shuffled, and every document and term is indexed.

Search.  A term's rows are joined to the terms asked for, and brought together by segment.  There a heap holds the cursors of an
item's terms, least end of the loaded block first: up to that end all postings of all cursors are at hand, so these documents
are final; they are merged in order, summed up and offered to a heap of the best k, keyed by score, then doc_id.  One loaded block per
cursor is all that is open.  The segments' best are merged in two steps: by item and a slice of the segments, then by item.

Items are asked in blocks of at most ITEM_TERMS terms: what is broadcast and gathered at the driver is one block's terms, items
and document frequencies, and each block's broadcast is destroyed once its hits are written.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heddle.llm import textcore as tc
from heddle.llm.importance import words_of
from heddle.llm.store import Scratch

SEGMENT_BYTES, BLOCK, ITEM_TERMS, SLICES = 8 << 20, 1024, 200_000, 64
INDEX_SCHEMA = "segment long, term string, df long, blocks array<binary>, ids array<long>, sizes array<long>"
_ARROW = pa.schema([("segment", pa.int64()), ("term", pa.string()), ("df", pa.int64()), ("blocks", pa.list_(pa.binary())), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64()))])


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Variable-length bytes of whole numbers, seven bits a byte and the eighth set on all but a number's last; and where each begins, then the end."""
    size = 1 + sum((values >= 1 << 7 * k).astype(np.int64) for k in range(1, 9))
    begin = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(begin[-1], dtype=np.uint8)
    for k in range(int(size.max(initial=0))):
        of = np.flatnonzero(size > k)
        out[begin[of] + k] = ((values[of] >> 7 * k) & 127) | ((size[of] > k + 1) << 7)
    return out, begin


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, dtype=np.uint8)
    begin = np.concatenate([[0], np.flatnonzero(raw < 128)[:-1] + 1])
    shift = np.arange(len(raw)) - np.repeat(begin, np.diff(np.append(begin, len(raw))))
    return np.add.reduceat((raw & 127).astype(np.int64) << 7 * shift, begin)


class _Segment:
    """Documents of one task until they have SEGMENT_BYTES; memory is that of a segment's distinct (term, document) pairs and of one piece of text."""

    def __init__(self):
        self.ids, self.sizes, self.pairs, self.terms, self.n, self.bytes = [], [], [], [], 0, 0

    def add(self, ids: pa.Array, data: np.ndarray, offsets: np.ndarray) -> None:
        words = tc.Words(data, offsets, tc.ALNUM)
        term = words.hashes(tc.FOLDED)
        size = np.diff(words.first)
        doc = np.repeat(np.arange(len(size)), size)
        order = np.argsort(term, kind="stable")
        term, doc = term[order], doc[order]
        new_term = np.ones(len(term), dtype=bool)
        new_term[1:] = term[1:] != term[:-1]
        new = new_term.copy()
        new[1:] |= doc[1:] != doc[:-1]
        at = np.flatnonzero(new)
        self.pairs.append((term[at], doc[at] + self.n, np.diff(np.append(at, len(term)))))
        lowered = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8).tobytes()
        shown = order[new_term]
        names = np.empty(len(shown), dtype=object)
        names[:] = [lowered[a:b] for a, b in zip(words.start[shown].tolist(), words.end[shown].tolist(), strict=True)]
        self.terms.append((term[new_term], names))
        self.ids.append(ids)
        self.sizes.append(size)
        self.n += len(size)
        self.bytes += len(data)

    def rows(self, segment: int) -> Iterator[pa.RecordBatch]:
        ids = pa.concat_arrays(self.ids)
        known = np.asarray(ids.is_valid())
        by_id = np.lexsort((ids.fill_null(0).to_numpy(zero_copy_only=False), ~known))
        number = np.empty(self.n, dtype=np.int64)
        number[by_id] = np.arange(self.n)
        one = pa.array([0, self.n], pa.int32())
        none = lambda kind, n: pa.nulls(n, kind)
        sizes = np.concatenate(self.sizes)[by_id].astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([segment]), none(pa.string(), 1), none(pa.int64(), 1), none(pa.list_(pa.binary()), 1), pa.ListArray.from_arrays(one, ids.take(pa.array(by_id))), pa.ListArray.from_arrays(one, pa.array(sizes))], schema=_ARROW)
        term, doc, tf = (np.concatenate([p[k] for p in self.pairs]) for k in range(3))
        if not len(term):
            return
        doc = number[doc]
        order = np.lexsort((doc, term))
        term, doc, tf = term[order], doc[order], tf[order]
        first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
        df = np.diff(np.append(first, len(term)))
        place = np.arange(len(term)) - np.repeat(first, df)
        gap = doc.copy()
        gap[1:] -= doc[:-1]
        opens = place % BLOCK == 0
        gap[opens] = doc[opens]
        data, begin = pack(np.stack([gap, tf], axis=1).reshape(-1))
        cuts = np.append(begin[:-1:2][opens], begin[-1]).astype(np.int32)
        blocks = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(data.tobytes())])
        per_term = np.concatenate([[0], np.cumsum(-(-df // BLOCK))]).astype(np.int32)
        hashes, names = (np.concatenate([t[k] for t in self.terms]) for k in range(2))
        names = names[np.unique(hashes, return_index=True)[1]]
        table = pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(df), segment)), pa.array(names, pa.binary()).cast(pa.string()), pa.array(df), pa.ListArray.from_arrays(pa.array(per_term), blocks), none(pa.list_(pa.int64()), len(df)), none(pa.list_(pa.int64()), len(df))], schema=_ARROW,
        )
        for k in range(0, len(df), 10_000):
            yield table.slice(k, 10_000)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    segment, open_one = TaskContext.get().partitionId() << 32, _Segment()
    for batch in batches:
        for a, b, data, offsets in tc.pieces(batch.column(1)):
            open_one.add(batch.column(0).slice(a, b - a), data, offsets)
            if open_one.bytes >= SEGMENT_BYTES:
                yield from open_one.rows(segment)
                segment, open_one = segment + 1, _Segment()
    if open_one.n:
        yield from open_one.rows(segment)


def build_index(docs: DataFrame) -> DataFrame:
    """Rows (segment, term, df, blocks, ids, sizes): one per segment and term, and a head per segment whose term is null.

    Write it before it is searched, so that segments keep their numbers.  Within a segment terms are told apart by hashes of 64 bits.
    """
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_index, INDEX_SCHEMA)


class Cursor:
    """A term's postings in one segment, a decoded block at a time."""

    def __init__(self, blocks: list, weight: int, decode):
        self.blocks, self.weight, self.decode, self.next = blocks, weight, decode, 0
        self.load()

    def load(self) -> None:
        self.docs, self.gains = self.decode(self.blocks[self.next])
        self.next, self.at = self.next + 1, 0

    @property
    def more(self) -> bool:
        return self.next < len(self.blocks)

    def up_to(self, limit: int) -> tuple[np.ndarray, np.ndarray]:
        to = int(np.searchsorted(self.docs, limit, side="right")) if limit < int(self.docs[-1]) else len(self.docs)
        docs, gains = self.docs[self.at : to], self.gains[self.at : to] * self.weight
        self.at = to
        return docs, gains


def best(cursors: list[Cursor], k: int) -> list[tuple[int, int]]:
    """The k best (score, document) over the cursors: higher scores first, then smaller documents."""
    ends = [(int(c.docs[-1]), i) for i, c in enumerate(cursors) if c.more]
    heapq.heapify(ends)
    top: list[tuple[int, int]] = []
    live = list(cursors)
    while live:
        limit = ends[0][0] if ends else np.iinfo(np.int64).max
        docs, gains = (np.concatenate(x) for x in zip(*(c.up_to(limit) for c in live), strict=True))
        order = np.argsort(docs, kind="stable")
        docs, gains = docs[order], gains[order]
        first = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]]))
        docs, score = docs[first], np.add.reduceat(gains, first)
        # Later documents lose ties, so only higher scores can enter a full heap.
        able = np.flatnonzero(score > (top[0][0] if len(top) == k else 0))
        if len(able) > k:
            able = able[np.lexsort((docs[able], -score[able]))[:k]]
        for entry in zip(score[able].tolist(), (-docs[able]).tolist(), strict=True):
            if len(top) < k:
                heapq.heappush(top, entry)
            elif entry > top[0]:
                heapq.heapreplace(top, entry)
        while ends and ends[0][0] <= limit:
            i = heapq.heappop(ends)[1]
            cursors[i].load()
            if cursors[i].more:
                heapq.heappush(ends, (int(cursors[i].docs[-1]), i))
        live = [c for c in live if c.at < len(c.docs)]
    return [(s, -d) for s, d in sorted(top, reverse=True)]


def _search(shared, n_docs: int, n_terms: int, k: int):
    """Of one segment's head and matched terms the k best documents of each item."""
    schema = pa.schema([("item", pa.int64()), ("segment", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        items, weights = shared.value
        rows = table.to_pylist()
        head = next(r for r in rows if r["no"] is None)
        terms = {r["no"]: r["blocks"] for r in rows if r["no"] is not None}
        m = 100 - 25 + 25 * np.array(head["sizes"], dtype=np.int64) * n_docs // max(n_terms, 1)
        known: dict[bytes, tuple] = {}

        def decode(block: bytes) -> tuple[np.ndarray, np.ndarray]:
            # Items share terms, so a decoded block stays: all of them are those of one segment.
            if block not in known:
                values = unpack(block)
                docs, tf = np.cumsum(values[0::2]), values[1::2]
                known[block] = docs, 1_000_000_000 * tf // (1000 * tf + 12 * m[docs])
            return known[block]

        out = []
        for item, asked in items:
            cursors = [Cursor(terms[no], weights[no] * count, decode) for no, count in asked if no in terms and weights[no] > 0]
            out += [(item, head["segment"], head["ids"][doc], score) for score, doc in best(cursors, k)]
        return pa.Table.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(4)], schema=schema)

    return run


def _blocks(items: DataFrame) -> Iterator[list]:
    """Blocks of items (item_id, [(term, count)]) with ITEM_TERMS terms, or of one item with more."""
    words = items.select("item_id", F.explode(words_of(F.col("text"))).alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("n"))
    asked = words.groupBy("item_id").agg(F.collect_list(F.struct("term", "n")).alias("terms"))
    block, size = [], 0
    for row in asked.toLocalIterator():
        if block and size + len(row["terms"]) > ITEM_TERMS:
            yield block
            block, size = [], 0
        block.append((row["item_id"], [(t["term"], t["n"]) for t in row["terms"]]))
        size += len(row["terms"])
    if block:
        yield block


def search(index: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank (int, from 1), doc_id and score (long): the k highest scores above 0 of each item, ties by ascending doc_id, null last.

    The score is a sum of whole numbers over the item's terms, repeats included: floor(1000 ln((2 N + 2) / (2 df + 1))) times the saturated term frequency.
    Items of equal item_id, null among them, are one item with the terms of all; null and empty texts ask for nothing and have no rows.  ``index`` is a written
    index; repeated documents in it are documents of their own, those without a doc_id have a null doc_id, and an empty one gives no rows.
    """
    spark = index.sparkSession
    scratch = Scratch(spark, "lexical")
    heads = index.where("term is null").select("segment", "ids", "sizes")
    whole = heads.agg(F.sum(F.size(F.filter("sizes", lambda x: x > 0))).alias("n"), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("l")).first()
    n_docs, n_terms = whole["n"] or 0, whole["l"] or 0
    schema = items.select(F.col("item_id"), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).schema
    found = []
    for block in _blocks(items):
        number = {t: no for no, t in enumerate(dict.fromkeys(t for _, terms in block for t, _ in terms))}
        vocabulary = spark.createDataFrame(list(number.items()), "term string, no long")
        matched = scratch.keep(index.where("term is not null").join(F.broadcast(vocabulary), "term").select("segment", "no", "df", "blocks"))
        held = {r["no"]: r["df"] for r in matched.groupBy("no").agg(F.sum("df").alias("df")).collect()}
        weights = {no: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for no, df in held.items()}
        shared = spark.sparkContext.broadcast(([(i, [(number[t], n) for t, n in terms if number[t] in weights]) for i, (_, terms) in enumerate(block)], weights))
        rows = matched.select("segment", "no", "blocks", F.lit(None).cast("array<long>").alias("ids"), F.lit(None).cast("array<long>").alias("sizes"))
        rows = rows.unionByName(heads.join(matched.select("segment").distinct(), "segment", "left_semi").select("segment", F.lit(None).cast("long").alias("no"), F.lit(None).cast("array<binary>").alias("blocks"), "ids", "sizes"))
        hits = rows.groupBy("segment").applyInArrow(_search(shared, n_docs, n_terms, k), "item long, segment long, doc_id long, score long")
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        for by in (["item", F.pmod(F.hash("segment"), F.lit(SLICES))], ["item"]):
            hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(block)], f"item long, item_id {items.schema['item_id'].dataType.simpleString()}")
        found.append(scratch.keep(hits.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int"), "doc_id", "score")))
        shared.destroy()
        scratch.drop(matched)
    if not found:
        return spark.createDataFrame([], schema)
    return spark.read.schema(found[0].schema).parquet(*(f._heddle_path for f in found))


def op13_ranked_search(spark, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "postings")
    index = scratch.keep(build_index(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    out = search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    scratch.clear()
    return out


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
d AS (SELECT doc_id, len(ws)::BIGINT AS n FROM w WHERE len(ws) > 0),
s AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM d),
q AS (SELECT item_id, term, count(*) AS reps FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY 1, 2),
t AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(ws) AS term FROM w) GROUP BY 1, 2),
f AS (SELECT term, floor(1000 * ln((2 * any_value(big_n) + 2) / (2 * count(*) + 1)))::BIGINT AS wt FROM t, s GROUP BY 1),
p AS (SELECT item_id, t.doc_id, sum(reps * wt * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // big_l))))::BIGINT AS score
  FROM q JOIN t USING (term) JOIN f USING (term) JOIN d USING (doc_id), s GROUP BY 1, 2),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM p WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20
"""
