"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

Texts are words (runs of letters, digits and non-ASCII characters, A-Z folded).  The
Chakraborty-Goldenberg-Koucky walk reads a window: at each step it puts out the word under its
pointer, and a random bit of that word and step says whether the pointer moves on.  Two windows with few
edits between them agree at most steps, so edit distance becomes Hamming distance.  A
round has random bits of its own, an anchor inside the item from which its walks begin, and a random sample of four steps,
as far from the anchor as the item's length allows (``REACH``); an item and a window whose sampled outputs are equal are candidates.  Samples are taken in
order and windows that no item can match any more are left at once.  The number of rounds follows from ``recall``: for each class of lengths, rounds
are added until they find that share of simulated items with the most edits allowed, at random places.
Items of up to SHORT words leave too few anchors for that, so they have an exact way besides: of the allowed
edits plus one parts of an item one is untouched in any match, so its words stand together in the text.
Candidates are verified by the exact edit
distance (in words) between the item and the best part of the window widened by the allowed edits.

Texts stay where they are: the items travel, in blocks of at most ``block_bytes``, each in a pass of its own, so a task holds one block's index.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heddle.llm import textcore as tc
from heddle.llm.store import Scratch

#: Classes of lengths: the least number of words, and the steps from which a round's samples are drawn.  A pointer moves on at half of the steps, so a walk reads about half as many words.
REACH = [(26, 13), (14, 9), (5, 5)]
SAMPLED = 4
SHORT = 13
MOST_ROUNDS = 96
TRIALS = 400


def item_words(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and byte lengths of the words of a text."""
    data = np.frombuffer((text or "").encode(), dtype=np.uint8)
    words = tc.Words(data, np.array([0, len(data)]), tc.ALNUM)
    return words.hashes(tc.FOLDED), words.end - words.start


def _random(*parts: int) -> int:
    """A 64-bit number that hangs on parts alone."""
    x = np.uint64(0)
    for part in parts:
        x = tc.splitmix(np.array([x ^ np.uint64(part)], dtype=np.uint64))[0]
    return int(x)


def _bit(step: int, turn: int) -> np.uint64:
    return np.uint64(_random(1, turn, step) % 64)


def sample(turn: int, reach: int) -> tuple[int, ...]:
    """A round's sampled steps: the anchor's and three of the others, at random."""
    others = sorted(range(1, reach), key=lambda step: _random(2, turn, reach, step))
    return (0, *sorted(others[: SAMPLED - 1]))


def walk(words: np.ndarray, at: np.ndarray, end: np.ndarray, steps: tuple[int, ...], turn: int, live) -> tuple[np.ndarray, np.ndarray]:
    """Of the windows that begin at ``at`` (and whose texts end at ``end``), those still live after the last sample, and their keys.

    live(k, keys) says after sample k which keys may still match.
    """
    index = np.arange(len(at))
    here, keys = at.copy(), np.zeros(len(at), dtype=np.uint64)
    for step in range(steps[-1] + 1):
        symbol = np.where(here < end[index], words[np.minimum(here, len(words) - 1)], np.uint64(0))
        if step in steps:
            keys = (keys ^ symbol) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(step + 1)
            ok = live(steps.index(step), keys)
            index, here, keys, symbol = index[ok], here[ok], keys[ok], symbol[ok]
        here = here + ((symbol >> _bit(step, turn)) & np.uint64(1)).astype(np.int64)
    return index, keys


def anchor(lengths: np.ndarray, turn: int, reach: int) -> int:
    """Where a round's walk begins in an item: the longest of up to four words behind a place that moves evenly over the item from round to round."""
    last = max(0, len(lengths) - reach // 2 - 1)
    near = int((turn * 0.6180339887498949) % 1 * (last + 1))
    return near + int(np.argmax(lengths[near : min(near + 4, last + 1)])) if last >= 8 else near


def rounds_for(n_words: int, reach: int, edit_share: float, recall: float) -> int | None:
    """Rounds that find the share recall of TRIALS simulated items of n_words words with the most edits allowed; None if MOST_ROUNDS don't."""
    rng = np.random.default_rng(n_words)
    allowed = int(edit_share * n_words)
    item = rng.integers(1, 2**63, n_words, dtype=np.uint64)
    texts = []
    for _ in range(TRIALS):
        edited = list(item)
        for at in sorted(rng.choice(n_words, allowed, replace=False), reverse=True):
            kind = rng.integers(3)
            edited[at : at + (kind != 2)] = [] if kind == 1 else [np.uint64(rng.integers(1, 2**63))]
        texts.append(np.array(edited, dtype=np.uint64))
    words, sizes = np.concatenate(texts), np.array([len(t) for t in texts])
    trial = np.repeat(np.arange(TRIALS), sizes)
    end = np.cumsum(sizes)[trial]
    found = np.zeros(TRIALS, dtype=bool)
    everything = lambda _, keys: np.ones(len(keys), dtype=bool)
    for turn in range(MOST_ROUNDS):
        steps, start = sample(turn, reach), anchor(np.ones(n_words), turn, reach)
        _, key = walk(item, np.array([start]), np.array([n_words]), steps, turn, everything)
        index, keys = walk(words, np.arange(len(words)), end, steps, turn, everything)
        found[trial[index[keys == key[0]]]] = True
        if found.mean() >= recall:
            return turn + 1
    return None


def parts(n_words: int, allowed: int) -> list[tuple[int, int]]:
    """(start, stop) of allowed + 1 parts of about equal length; any match with at most so many edits leaves one as it is."""
    cuts = [n_words * k // (allowed + 1) for k in range(allowed + 2)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


@dataclass
class Index:
    """Items of one block, with the keys of their walks per (round, sampled steps), and the parts of those that go through parts: short ones, and classes that walks can't bring to the recall."""

    ids: list[int]
    words: list[np.ndarray]
    rounds: list[tuple]  # turn, steps, first-symbol table, keys after each sample (sorted), item and anchor of each last key
    exact: list[tuple]  # part length, first-symbol table, keys (sorted), item and start of each key

    @classmethod
    def build(cls, items: list[tuple[int, str]], edit_share: float, recall: float) -> Index:
        split = [(i, *item_words(t)) for i, t in items]
        split = [x for x in split if len(x[1])]
        rounds, by_parts = [], {n for n, x in enumerate(split) if len(x[1]) <= SHORT}
        for k, (least, reach) in enumerate(REACH):
            most = REACH[k - 1][0] if k else 1 << 60
            own = [n for n, x in enumerate(split) if least <= len(x[1]) < most]
            if not own:
                continue
            # Of the class's first ten lengths, the one at which the allowed edits are the largest share.
            hardest = max(range(least, least + 10), key=lambda n: int(edit_share * n) / n)
            turns = rounds_for(hardest, reach, edit_share, recall)
            if turns is None:  # walks would miss too much at this edit share, so these items go through exact parts
                by_parts.update(own)
                continue
            for turn in range(turns):
                steps = sample(turn, reach)
                starts = [anchor(split[n][2], turn, reach) for n in own]
                levels: list[list[int]] = [[] for _ in steps]
                for n, s in zip(own, starts, strict=True):
                    walk(split[n][1], np.array([s]), np.array([len(split[n][1])]), steps, turn, lambda j, keys, to=levels: to[j].append(int(keys[0])) or np.ones(1, dtype=bool))
                table = _table([split[n][1][s] for n, s in zip(own, starts, strict=True)])
                order = np.argsort(np.array(levels[-1], dtype=np.uint64), kind="stable")
                rounds.append((turn, steps, table, [np.unique(np.array(x, dtype=np.uint64)) for x in levels], np.array(levels[-1], dtype=np.uint64)[order], np.array(own)[order], np.array(starts)[order]))
        by_length: dict[int, list[tuple]] = {}
        for n, (_, words, _) in enumerate(split):
            if n in by_parts:
                for a, b in parts(len(words), int(edit_share * len(words))):
                    by_length.setdefault(b - a, []).append((tc.ngrams(words[a:b], b - a)[0], n, a, words[a]))
        exact = []
        for length, rows in by_length.items():
            rows.sort(key=lambda r: r[:3])
            exact.append((length, _table([r[3] for r in rows]), np.array([r[0] for r in rows], dtype=np.uint64), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])))
        return cls([x[0] for x in split], [x[1] for x in split], rounds, exact)


def _table(symbols: list[np.uint64]) -> np.ndarray:
    """By a word's first 16 bits, whether it may begin a match."""
    table = np.zeros(1 << 16, dtype=bool)
    table[[int(x >> np.uint64(48)) for x in symbols]] = True
    return table


def _among(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return sorted_keys[np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)] == keys


def fitting_distance(item: np.ndarray, regions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per region the least edit distance between item and any part of it, and the smallest end of such a part."""
    step = np.arange(regions.shape[1] + 1, dtype=np.int32)
    row = np.zeros((len(regions), regions.shape[1] + 1), dtype=np.int32)
    for i, word in enumerate(item):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        new[:, 1:] = np.minimum(row[:, :-1] + (regions != word), row[:, 1:] + 1)
        row = np.minimum.accumulate(new - step, axis=1) + step
    end = row.argmin(axis=1)
    return row[np.arange(len(row)), end], end


def search(index: Index, data: np.ndarray, offsets: np.ndarray, edit_share: float) -> list[tuple[int, int, int, int]]:
    """(document, item, edits, end) of every item found in the documents of a piece, once per pair."""
    words = tc.Words(data, offsets, tc.ALNUM)
    hashes = words.hashes(tc.FOLDED)
    if not len(hashes):
        return []
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(words.first))
    end_of = words.first[1:]
    top = (hashes >> np.uint64(48)).astype(np.uint16)
    found: dict[int, list[np.ndarray]] = {}

    def meet(at: np.ndarray, keys: np.ndarray, last: np.ndarray, items: np.ndarray, starts: np.ndarray) -> None:
        """Notes the items whose keys are those of the windows at ``at``."""
        low, high = np.searchsorted(last, keys, side="left"), np.searchsorted(last, keys, side="right")
        for extra in range(int((high - low).max(initial=0))):
            some = low + extra < high
            slot = (low + extra)[some]
            for n in np.unique(items[slot]):
                own = items[slot] == n
                found.setdefault(int(n), []).append(np.stack([doc[at[some][own]], at[some][own] - starts[slot[own]]], axis=1))

    for turn, steps, table, levels, last, items, starts in index.rounds:
        at = np.flatnonzero(table[top])
        kept, keys = walk(hashes, at, end_of[doc[at]], steps, turn, lambda j, k, levels=levels: _among(levels[j], k))
        meet(at[kept], keys, last, items, starts)
    for length, table, keys, items, starts in index.exact:
        grams = tc.ngrams(hashes, length)
        at = np.flatnonzero(table[top[: len(grams)]])
        at = at[doc[at] == doc[at + length - 1]]
        at = at[_among(keys, grams[at])]
        meet(at, grams[at], keys, items, starts)
    out = []
    for n, places in found.items():
        item = index.words[n]
        allowed = int(edit_share * len(item))
        # Starts of one match differ by its insertions and deletions; a region around the first holds those near it.
        spots = np.unique(np.concatenate(places), axis=0)
        group = np.concatenate([[True], (np.diff(spots[:, 0]) != 0) | (np.diff(spots[:, 1] // (2 * allowed + 1)) != 0)])
        spots = spots[group]
        best: dict[int, tuple[int, int]] = {}
        width = len(item) + 6 * allowed + 2
        for k in range(0, len(spots), 1024):
            docs, begin = spots[k : k + 1024].T
            low = words.first[docs]
            left = np.maximum(begin - 2 * allowed, low)
            place = left[:, None] + np.arange(width)
            regions = np.where(place < end_of[docs][:, None], hashes[np.minimum(place, len(hashes) - 1)], np.uint64(0))
            edits, end = fitting_distance(item, regions)
            for d, e, stop in zip(docs, edits, left - low + end, strict=True):
                if e <= allowed:
                    best[int(d)] = min(best.get(int(d), (1 << 30, 0)), (int(e), int(stop)))
        out += [(d, n, e, stop) for d, (e, stop) in best.items()]
    return sorted(out)


HIT = T.ArrayType(T.StructType([T.StructField(f, T.LongType()) for f in ("item_id", "n_item_words", "n_edits", "end_word")]))


def _finder(broadcast, edit_share: float):
    @F.arrow_udf(HIT)
    def find(text: pa.Array) -> pa.Array:
        index = broadcast.value
        rows = []
        for first, _, data, offsets in tc.pieces(text):
            rows += [(first + d, index.ids[n], len(index.words[n]), e, stop) for d, n, e, stop in search(index, data, offsets, edit_share)]
        table = np.array(rows, dtype=np.int64).reshape(-1, 5)
        ends = np.searchsorted(table[:, 0], np.arange(len(text) + 1)).astype(np.int32)
        values = pa.StructArray.from_arrays([pa.array(table[:, k + 1]) for k in range(4)], names=["item_id", "n_item_words", "n_edits", "end_word"])
        return pa.ListArray.from_arrays(pa.array(ends), values)

    return find


def blocks(docs: DataFrame, items: DataFrame, edit_share: float = 0.2, recall: float = 0.995, block_bytes: int = 16 << 20) -> Iterator[tuple[Column, Broadcast]]:
    """Per block of items a column for docs, array of (item_id, n_item_words, n_edits, end_word) of the block's items that the text holds; and the broadcast that it reads.

    An item is held if a part of the text is at most ``edit_share`` of the item's words away from it in edits of words
    (none, for fewer than five words); n_edits is the least at the candidate places and end_word the end of the first best part.  Items without a word, null and empty
    ones are never held; equal items are each reported.  The item table may have any size: it is read in blocks of
    hashed ids with at most about block_bytes of text.  The driver holds one block at a time if the caller destroys the broadcast once the column is written.
    """
    spark = docs.sparkSession
    known = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = known.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    n = max(1, -(-size // block_bytes))
    for k in range(n):
        rows = sorted(tuple(r) for r in known.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).collect())
        index = spark.sparkContext.broadcast(Index.build(rows, edit_share, recall))
        yield _finder(index, edit_share)(F.col("text")), index


def contaminated(docs: DataFrame, items: DataFrame, **parameters) -> DataFrame:
    """doc_id, item_id, n_item_words, n_edits, similarity, end_word: a row per pair of a row of docs and an item that it holds.

    Null and empty texts hold nothing.  Repeated rows each give their pairs; a null doc_id is
    kept.  Only doc_id and text are read, so other columns may have any name.  An empty table gives no pairs.  Each block's pairs are written before the next block is read.
    """
    scratch, written = Scratch(docs.sparkSession, "contaminated"), []
    for found, index in blocks(docs, items, **parameters):
        written.append(scratch.keep(docs.select("doc_id", F.explode(found).alias("x")).select("doc_id", "x.*")))
        index.destroy()
    pairs = reduce(DataFrame.unionByName, written)
    return pairs.select("doc_id", "item_id", "n_item_words", "n_edits", (1 - F.col("n_edits") / F.col("n_item_words")).alias("similarity"), "end_word")


def decontaminate(docs: DataFrame, items: DataFrame, **parameters) -> DataFrame:
    """The rows of docs that hold no item, with their columns; a null or empty text holds none, repeated rows stay or go alike, an empty table gives an empty one.

    With more than one block of items, the rows that hold none of a block are written and the next block reads them.
    """
    scratch, left, waiting = Scratch(docs.sparkSession, "decontaminate"), docs, None
    for found, index in blocks(docs, items, **parameters):
        if waiting is not None:
            before, left = left, scratch.keep(left.where(F.size(waiting[0]) == 0))
            scratch.drop(before)
            waiting[1].destroy()
        waiting = found, index
    return left.where(F.size(waiting[0]) == 0)


def op4_cgk_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
