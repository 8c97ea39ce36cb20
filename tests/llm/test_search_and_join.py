"""Importance resampling, the Jaccard join and ranked search against brute force and on the edge cases of their docstrings."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from heddle.llm import importance, jaccard_join, lexical, textcore
from tests.llm.test_operators import DOCS, brute_components, corpus, prose, shingles


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def fold(text: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(text))


# ---- importance resampling


def brute_resample(rows, target, buckets, least, most, percent, min_words):
    def features(text):
        w = words(text)
        return [" ".join(w[i : i + n]) for n in range(least, most + 1) for i in range(len(w) - n + 1)]

    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = Counter(bucket(g) for _, x in rows for g in features(x)), Counter(bucket(g) for x in target for g in features(x))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    out = []
    for doc_id, text in rows:
        f = features(text)
        weight = sum(gain(bucket(g)) for g in f)
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text)) >= min_words])
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    drawn = percent * len(able) // 100
    rank = {}
    for k, r in enumerate(able[:drawn]):
        rank.setdefault(tuple(r), []).append(k + 1)
    return sorted(((*r[:4], rank[tuple(r)].pop() if rank.get(tuple(r)) else None) for r in out), key=str)


@pytest.mark.parametrize(("buckets", "least", "most", "percent", "min_words"), [(10000, 1, 1, 10, 20), (500, 1, 2, 30, 1), (64, 2, 3, 50, 0)])
def test_resampling_equals_brute_force(spark, docs, buckets, least, most, percent, min_words):
    target = [prose(random.Random(k), 30) for k in range(5)] + [None, "", "ß É ü"]
    got = importance.resample(docs.repartition(5), spark.createDataFrame([(t,) for t in target], "text string"), buckets, least, most, percent=percent, min_words=min_words)
    assert sorted(map(tuple, got.collect()), key=str) == brute_resample([r[:2] for r in corpus()], target, buckets, least, most, percent, min_words)


def test_resampling_edge_rows(spark, docs, empty):
    none = spark.createDataFrame([], "text string")
    assert importance.resample(empty, docs).count() == 0
    rows = [(None, "a b c"), (None, "a b c"), (4, "x y z"), (4, "x y z"), (4, "x"), (5, None)]
    got = importance.resample(spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, rank int, row int"), none, percent=100, min_words=1).collect()
    assert sorted(map(tuple, got), key=str) == brute_resample(rows, [], 10000, 1, 1, 100, 1)
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3, 4, 5]


def test_ranks_run_through_many_partitions(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("a b"), F.col("id") % 7).alias("text"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = importance.resample(rows, rows.limit(10), percent=50, min_words=1).where("rank is not null").orderBy("rank").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert [r["rank"] for r in got] == list(range(1, 1501))
    assert all((a["score"], -a["doc_id"]) > (b["score"], -b["doc_id"]) for a, b in zip(got, got[1:], strict=False))


# ---- Jaccard join


def joined(spark, rows, n, percent):
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int")
    return {r[0]: (r[1], r[2]) for r in jaccard_join.join_components(frame, n, percent).collect()}


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_join_equals_brute_force(spark, n, percent):
    rows = [r[:2] for r in corpus()]
    assert joined(spark, rows, n, percent) == {i: v[:2] for i, v in brute_components(rows, n, percent).items()}


def test_join_at_the_threshold_equals_brute_force(spark):
    """Variants of some texts by a few edits, so that many pairs stand just above or below the threshold; sizes cross bands."""
    rng = random.Random(11)
    rows = []
    for b in range(14):
        base = [f"b{b}w{k}" for k in range(rng.choice([6, 9, 14, 40, 90, 200]))]
        for _ in range(22):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + max(2, len(w) // 22))):
                at = rng.randrange(len(w))
                w[at : at + rng.randrange(0, 2)] = rng.choice([[], [f"x{rng.random()}"], ["common"]])
            rows.append((len(rows), " ".join(w)))
    for percent in (85, 60):
        assert joined(spark, rows, 4, percent) == {i: v[:2] for i, v in brute_components(rows, 4, percent).items()}


def test_join_of_one_base(spark):
    """A base and copies that are near to it, mostly not to each other, some near to none."""
    rng = random.Random(3)
    base = [f"w{k}" for k in range(150)]
    rows = [(500, " ".join(base))]
    for k in range(150):
        w = list(base)
        for at in rng.sample(range(150), rng.randrange(1, 9)):
            w[at] = f"x{k}.{at}"
        rows.append((k, " ".join(w)))
    assert joined(spark, rows, 4, 85) == {i: v[:2] for i, v in brute_components(rows, 4, 85).items()}


def test_signatures_meet_for_all_linked_pairs():
    """The pigeonhole itself: sets that differ by as much as a link allows share a bucket that one indexes and the larger asks."""
    rng = np.random.default_rng(5)
    bits = jaccard_join._BITS
    for percent in (80, 85, 90):
        for size in [*range(5, 40), 77, 200, 611]:
            for _ in range(4):
                gone = int(rng.integers(0, size * (100 - percent) // 100 + 1))
                base = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
                more = int((size - gone) * 100 / percent - size)
                other = np.unique(np.concatenate([base[gone:], rng.integers(0, 2**63, max(more, 0), dtype=np.uint64)]))
                small, large = sorted((base, other), key=len)
                both = len(np.intersect1d(small, large))
                if 100 * both < percent * (len(small) + len(large) - both) or both == len(large):
                    continue
                at = lambda s, below: {int(k) for keys, tags in jaccard_join.signatures(s, percent) for k, t in zip(keys, tags, strict=True) if (t >> 2 * bits) & 1 == 0 and (t >> 2 * bits + 1) & 1 in below}
                assert at(small, (0,)) & at(large, (0, 1)), (percent, size)


def test_allocation_keeps_the_units():
    """Skipped segments and reserve segments taken at two units are as many, and a dearer bucket is only skipped for cheaper ones."""
    bits, rng = jaccard_join._BITS, random.Random(2)
    for n_reserve in (1, 2, 4):
        for _ in range(40):
            rows = [(rng.choice([2, 2, 3, 50, 900]), 1000 + j, j | n_reserve << bits) for j in range(n_reserve * 32) if rng.random() < 0.3]
            rows += [(rng.choice([2, 5, 60]), 5000 + 10 * j + d, 32 * j | n_reserve << bits | 1 << 2 * bits) for j in range(n_reserve) for d in range(rng.randrange(0, 3))]
            got = dict(zip([r[1] for r in rows], jaccard_join.allocated(*np.array(rows, dtype=np.int64).reshape(-1, 3).T).tolist(), strict=True))
            price = {j: sum(n - 1 for n, key, tag in rows if tag >> 2 * bits & 1 and (tag & (1 << bits) - 1) == 32 * j) for j in range(n_reserve)}
            plain = sorted(((n - 1, key) for n, key, tag in rows if not tag >> 2 * bits & 1 and (tag & (1 << bits) - 1) % 32), reverse=True)
            skipped = {key for cost, (n, key) in zip(sorted(price.values()), plain, strict=False) if n > cost}
            assert {key for _, key in plain if not got[key]} == skipped
            taken = sum(all(got[key] for _, key, tag in rows if tag >> 2 * bits & 1 and (tag & (1 << bits) - 1) == 32 * j) for j in range(n_reserve))
            assert taken >= len(skipped)


def test_join_edge_rows(spark, empty):
    assert jaccard_join.join_components(empty).count() == 0
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(None, text), (None, None), (1, text), (1, text), (2, text + " w40"), (3, None), (4, ""), (5, " \n"), (6, "one"), (7, "ONE"), (8, "w " * 30000)]
    got = jaccard_join.join_components(spark.createDataFrame([(*r, "x", 3) for r in rows], "doc_id long, text string, name string, tag int")).collect()
    want = [(None, 36, None), (None, 0, None), (1, 36, 1), (1, 36, 1), (2, 37, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 1, 6), (7, 1, 6), (8, 1, 8)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    two = spark.createDataFrame([(1, text), (1, "quite another text of ten words or so it is"), (2, text), (3, "quite another text of ten words or so it is")], "doc_id long, text string")
    got = {(r[0], r[2]) for r in jaccard_join.join_components(two).collect()}
    assert got in ({(1, 1), (2, 1), (3, 3)}, {(1, 1), (3, 1), (2, 2)})  # one of the texts of 1 stands for it


# ---- ranked search


def brute_search(rows, items, k=20):
    tf = [Counter(words(t)) for _, t in rows]
    n = [sum(c.values()) for c in tf]
    big_n, big_l = sum(x > 0 for x in n), sum(n)
    df = Counter(t for c in tf for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, Counter()).update(words(text))
    out = []
    for item, terms in asked.items():
        scored = []
        for i, (doc_id, _) in enumerate(rows):
            score = sum(reps * math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * (10**9 * tf[i][t] // (1000 * tf[i][t] + 12 * (75 + 25 * n[i] * big_n // big_l))) for t, reps in terms.items() if tf[i][t])
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(lexical, "ITEM_TERMS", 25)


def found(spark, rows, items, parts=3, k=20):
    index = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, df int").repartition(parts)
    index = lexical.Scratch(spark, "test").keep(lexical.build_index(index))
    return sorted(map(tuple, lexical.search(index, spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, rank int"), k).collect()), key=str)


def test_search_equals_brute_force(spark, small_blocks):
    rng = random.Random(4)
    rows = [r[:2] for r in corpus()] + [(1000 + k, prose(rng, rng.choice([1, 5, 40, 400]))) for k in range(300)]
    items = [(k, prose(rng, rng.choice([1, 3, 12, 30]))) for k in range(12)] + [(3, "again konmi"), (90, None), (91, ""), (92, "nowhere"), (None, "zulto the")]
    assert found(spark, rows, items) == brute_search(rows, items)
    assert found(spark, rows, items, parts=1, k=3) == brute_search(rows, items, 3)


def test_search_edge_rows(spark):
    ties = [(k, "a b") for k in (9, 3, 7, 3)] + [(None, "a b"), (None, None), (5, ""), (6, "c " * 50000)]
    assert found(spark, ties, [(1, "A b"), (2, "c")]) == brute_search(ties, [(1, "A b"), (2, "c")])
    assert found(spark, [], [(1, "a")]) == []
    assert found(spark, ties, []) == []


def test_merge_of_many_blocks_equals_sums():
    """Cursors over several blocks each: every document is final when it is offered."""
    rng = np.random.default_rng(7)
    for _ in range(30):
        lists = [np.unique(rng.integers(0, 400, rng.integers(1, 300))) for _ in range(rng.integers(1, 9))]
        weights = [int(rng.integers(1, 5)) for _ in lists]
        total = Counter()
        for docs, w in zip(lists, weights, strict=True):
            for d in docs.tolist():
                total[d] += w * (d % 7 + 1)
        cursors = [lexical.Cursor([docs[k : k + 16] for k in range(0, len(docs), 16)], w, lambda d: (d, d % 7 + 1)) for docs, w in zip(lists, weights, strict=True)]
        assert lexical.best(cursors, 10) == sorted(((s, d) for d, s in total.items()), key=lambda x: (-x[0], x[1]))[:10]


def test_postings_round_trip():
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**31, 5, 2**40], dtype=np.int64)
    data, begin = lexical.pack(values)
    assert (lexical.unpack(data.tobytes()) == values).all()
    assert begin.tolist() == [0, 1, 2, 3, 5, 7, 10, 15, 16, 22]


def test_segments_hold_all_terms(spark, monkeypatch):
    texts = [r[1] for r in corpus()]
    segment = lexical._Segment()
    segment.add(pa.array(range(len(texts)), pa.int64()), *textcore.text_bytes(pa.array(texts)))
    rows = pa.Table.from_batches(segment.rows(3)).to_pylist()
    head, terms = rows[0], {r["term"]: r for r in rows[1:]}
    assert head["sizes"] == [len(words(t)) for t in texts] and head["ids"] == list(range(len(texts)))
    want = Counter(t for x in texts for t in set(words(x)))
    assert {t: r["df"] for t, r in terms.items()} == dict(want)
    assert shingles("a b", 4) and len(head["ids"]) == len(texts)
