"""Character ratios that no SQL function has: Arrow batches through Python's difflib or many pairs at a time, after equi-blocking only."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.arrow_udf(T.DoubleType())
def sequence_ratio(a: pa.Array, b: pa.Array) -> pa.Array:
    """Ratcliff/Obershelp ratio of a and b in this order; null if one is null."""
    return pa.array([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())


#: From this length on difflib takes no frequent character of the second text for a match's start.
AUTOJUNK = 200
#: Words of 64 places that the second texts' letters have at a time.
WORDS = 1 << 22
#: Characters of first texts that are looked at together, so that a step's arrays stay near the processor.
ROWS = 1 << 17
#: Pairs whose common subsequences are looked for together.
TOGETHER = 1 << 12
#: Below so many pairs, times the words that a second text takes, they are looked at one by one.
FEW = 32


def sequence_ratios(left: list[str], right: list[str], x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Ratio of left[x[k]] and right[y[k]] as difflib has it, for each k where it is ``least`` at least; elsewhere less than that.

    Matched characters are a common subsequence, so the longest one's length, told first by a step per character for many pairs together, bounds them.
    """
    sizes = [np.array([len(t) for t in side], dtype=np.int64) for side in (left, right)]
    total, matched, matcher = sizes[0][x] + sizes[1][y], np.zeros(len(x), dtype=np.int64), SequenceMatcher(None)
    letters, codes = np.unique(np.frombuffer("".join([*left, *right]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), return_inverse=True)
    codes, first = codes.astype(np.int64), np.cumsum([0, *sizes[0]])
    ends = np.cumsum([first[-1], *sizes[1]])
    words = -(-sizes[1] // 64)
    order = np.argsort(words[y], kind="stable")
    for wide in np.unique(words[y]).tolist() if len(letters) else ():
        mine = np.flatnonzero(words == wide)
        some = max(1, WORDS // max(1, len(letters) * wide))
        alike = order[slice(*np.searchsorted(words[y[order]], [wide, wide + 1]))]
        for n in range(0, len(mine) if wide else 0, some):
            texts = mine[n : n + some]
            pairs = alike[(y[alike] >= texts[0]) & (y[alike] <= texts[-1])]
            if not len(pairs):
                continue
            number, size = np.zeros(len(right), dtype=np.int64), sizes[1][texts]
            number[texts] = np.arange(len(texts)) * len(letters)
            places = np.zeros((wide, len(texts) * len(letters)), dtype=np.uint64)
            at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            np.add.at(places, (at >> 6, np.repeat(number[texts], size) + codes[np.repeat(ends[texts], size) + at]), np.uint64(1) << (at & 63).astype(np.uint64))
            told = lambda k: (codes, first[x[k]], sizes[0][x[k]], number[y[k]], sizes[1][y[k]], places)
            pairs = pairs[np.argsort(-sizes[0][x[pairs]], kind="stable")]
            common = lambda k: _common(*told(k)) if len(k) >= FEW * wide else _common_of_few(left, right, x[k], y[k])
            pairs = np.concatenate([k[2.0 * common(k) >= least * total[k]] for k in np.split(pairs, np.arange(TOGETHER, len(pairs), TOGETHER))])
            far = sizes[1][y[pairs]] >= AUTOJUNK
            last = -1
            for k in pairs[far][np.argsort(y[pairs[far]], kind="stable")]:
                if y[k] != last:
                    last = y[k]
                    matcher.set_seq2(right[last])
                matcher.set_seq1(left[x[k]])
                matched[k] = _matched_far(matcher, sizes[0][x[k]], sizes[1][last], least * total[k])
            pairs = np.sort(pairs[~far])
            reach = np.cumsum(sizes[0][x[pairs]])
            for k in np.split(pairs, np.searchsorted(reach, np.arange(ROWS, reach[-1], ROWS))) if len(pairs) else ():
                matched[k] = _matched(*told(k), least * total[k])
    return np.where(total > 0, 2.0 * matched / np.maximum(total, 1), 1.0)


def _common(codes: np.ndarray, first: np.ndarray, size: np.ndarray, row: np.ndarray, width: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Lengths of longest common subsequences, arguments as of _matched; sizes fall.  A bit that is off is a place of the second text where the length grows."""
    words = len(places)
    state = np.full((words, len(first)), ~np.uint64(0))
    active = len(first) - np.searchsorted(size[::-1], np.arange(size[0] if len(size) else 0), "right")
    for k, n in enumerate(active.tolist()):
        here, carry = row[:n] + codes[first[:n] + k], None
        for word in range(words):
            before, mask = state[word, :n], places[word][here]
            both = before & mask
            total = before + both
            if word < words - 1 or carry is not None:
                over = total < before
                if carry is not None:
                    total += carry
                    over |= total < carry
                carry = over.astype(np.uint64)
            state[word, :n] = total | (before & ~mask)
    inside = np.clip(width - np.arange(words)[:, None] * 64, 0, 64)
    bits = np.where(inside >= 64, ~np.uint64(0), (np.uint64(1) << np.minimum(inside, 63).astype(np.uint64)) - np.uint64(1))
    return np.bitwise_count(~state & bits).sum(axis=0, dtype=np.int64)


def _common_of_few(left: list[str], right: list[str], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """_common of left[x[k]] and right[y[k]], one pair after the other."""
    out, last, places = np.zeros(len(x), dtype=np.int64), -1, {}
    for k in np.argsort(y, kind="stable").tolist():
        if y[k] != last:
            last, places = y[k], {}
            for n, c in enumerate(right[last]):
                places[c] = places.get(c, 0) | 1 << n
        state = whole = (1 << len(right[last])) - 1
        for c in left[x[k]]:
            both = state & places.get(c, 0)
            state = (state + both) | (state - both)
        out[k] = (~state & whole).bit_count()
    return out


def _matched_far(matcher: SequenceMatcher, high: int, wide: int, needed: float) -> int:
    """Characters that the matcher matches of texts of these lengths; less than it does where twice the characters can't come to ``needed`` any more."""
    found, open_, parts = 0, min(high, wide), [(0, high, 0, wide)]
    while parts and 2.0 * (found + open_) >= needed:
        start, stop, low, up = parts.pop()
        i, j, size = matcher.find_longest_match(start, stop, low, up)
        open_ -= min(stop - start, up - low)
        if size:
            found += size
            rest = [part for part in ((start, i, low, j), (i + size, stop, j + size, up)) if part[0] < part[1] and part[2] < part[3]]
            open_ += sum(min(part[1] - part[0], part[3] - part[2]) for part in rest)
            parts += rest
    return found


def _matched(codes: np.ndarray, first: np.ndarray, size: np.ndarray, row: np.ndarray, width: np.ndarray, places: np.ndarray, needed: np.ndarray) -> np.ndarray:
    """Characters that difflib matches of codes[first : first + size] and a second text of ``width``, whose letters' places are bits of the rows of places from row on.

    All pairs are split at their longest common runs together, a level at a time; one of which twice the characters can't come to ``needed`` any more stays behind.
    """
    words, found = len(places), np.zeros(len(first), dtype=np.int64)
    parts = np.stack([np.arange(len(first)), first, first + size, np.zeros(len(first), dtype=np.int64), width])
    reaches = lambda pair, most: (2.0 * (found + np.bincount(pair, most, len(found))) >= needed)[pair]
    while True:
        high, wide = parts[2] - parts[1], parts[4] - parts[3]
        parts = parts[:, (high > 0) & (wide > 0) & reaches(parts[0], np.minimum(high, wide))]
        if not parts.shape[1]:
            return found
        pair, start, stop, low, up = parts
        # A row per character of the first text, with the places where the second has it: those are ends of runs of one.
        part = np.repeat(np.arange(len(pair)), stop - start)
        at = np.arange(len(part)) + np.repeat(stop - np.cumsum(stop - start), stop - start)
        here, base = row[pair][part] + codes[at], np.arange(words)[:, None] * 64
        below = lambda n: np.where(n >= 64, ~np.uint64(0), (np.uint64(1) << np.clip(n, 0, 63).astype(np.uint64)) - np.uint64(1))
        ones = places[:, here] & (below(up - base) & ~below(low - base))[:, part]
        live = np.flatnonzero(ones.any(axis=0))
        live = live[reaches(pair, np.minimum(np.bincount(part[live], minlength=len(pair)), up - low))[part[live]]]
        runs, length, size, i, j = ones[:, live], 1, *np.zeros((3, len(pair)), dtype=np.int64)
        while len(live):
            # The first longest run of a part ends at its first row that is left, at the lowest place.
            lead = np.flatnonzero(np.diff(part[live], prepend=-1))
            to = part[live[lead]]
            size[to], i[to] = length, at[live[lead]] + 1 - length
            for n in reversed(range(words)):
                bits = runs[n, lead]
                j[to] = np.where(bits > 0, 64 * n + np.bitwise_count((bits & -bits) - np.uint64(1)).astype(np.int64) + 1 - length, j[to])
            # A run goes on from a row to the next, one place up.
            on = np.flatnonzero((np.diff(live) == 1) & (np.diff(part[live]) == 0))
            live, runs = live[on + 1], runs[:, on]
            carried = np.concatenate([np.zeros((1, len(on)), dtype=np.uint64), runs[:-1] >> np.uint64(63)])
            runs = ((runs << np.uint64(1)) | carried) & ones[:, live]
            more = runs.any(axis=0)
            live, runs, length = live[more], runs[:, more], length + 1
        found += np.bincount(pair, size, len(found)).astype(np.int64)
        cut = size > 0
        pair, start, stop, low, up, size, i, j = (c[cut] for c in (pair, start, stop, low, up, size, i, j))
        parts = np.concatenate([np.stack([pair, start, i, low, j]), np.stack([pair, i + size, stop, j + size, up])], axis=1)


#: Characters that a loose search skips besides white space.
MARKUP = frozenset("*_`#|")


def loose_find(text: str, excerpt: str) -> tuple[int, int] | None:
    """Where excerpt stands in text if white space, case and markup don't count, in text's own characters."""
    kept = [(i, c) for i, ch in enumerate(text) if not ch.isspace() and ch not in MARKUP for c in ch.casefold()]
    wanted = "".join(c for ch in excerpt if not ch.isspace() and ch not in MARKUP for c in ch.casefold())
    at = "".join(c for _, c in kept).find(wanted) if wanted else -1
    return None if at < 0 else (kept[at][0], kept[at + len(wanted) - 1][0] + 1)


@F.arrow_udf(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType()), T.StructField("exact", T.BooleanType())]))
def excerpt_offsets(text: pa.Array, excerpt: pa.Array) -> pa.Array:
    rows = []
    for t, e in zip(text.to_pylist(), excerpt.to_pylist(), strict=True):
        at = (t or "").find(e) if e else -1
        loose = loose_find(t or "", e) if e and at < 0 else None
        rows.append({"start": at, "stop": at + len(e), "exact": True} if at >= 0 else {"start": loose[0], "stop": loose[1], "exact": False} if loose else None)
    return pa.array(rows, pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("exact", pa.bool_())]))
