"""Words and their hashes, for whole Arrow batches at a time.

All of it works on the UTF-8 bytes of a string column.  A batch is cut into
pieces of about a MB at document borders, so memory doesn't follow the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20
U64 = np.uint64


def splitmix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finalizer, a bijection of 64-bit words."""
    x = x + U64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BASE = 0x9D39247E33776D41
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, PIECE_BYTES + 4096), base, dtype=U64)
        have[0] = 1
        _powers[base] = np.cumprod(have, dtype=U64)
    return _powers[base][:n]


def byte_table(fold: bool) -> np.ndarray:
    """A random 64-bit value per byte; with fold, A-Z have those of a-z."""
    table = splitmix(np.arange(256, dtype=U64) + U64(77))
    if fold:
        table[65:91] = table[97:123]
    return table


FOLDED, EXACT = byte_table(True), byte_table(False)

_BYTES = np.arange(256)
#: [^\x20\x09-\x0D]+
NOT_SPACE = ~((_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13)))
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ once A-Z are lower-cased
ALNUM = ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 97) & (_BYTES <= 122)) | ((_BYTES >= 65) & (_BYTES <= 90)) | (_BYTES >= 128)


class Words:
    """The words of a piece: ``start`` and ``end`` byte positions, and ``first[i]:first[i + 1]`` those of document i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray):
        self.data, self.offsets = data, offsets
        n = len(data)
        if n == 0:
            self.start = self.end = np.zeros(0, dtype=np.int64)
            self.first = np.zeros(len(offsets), dtype=np.int64)
            return
        word = inside[data]
        before = np.empty(n, dtype=bool)
        before[0], before[1:] = False, word[:-1]
        before[offsets[:-1][offsets[:-1] < n]] = False
        after = np.empty(n, dtype=bool)
        after[-1], after[:-1] = False, word[1:]
        after[offsets[1:][offsets[1:] > 0] - 1] = False
        self.start = np.flatnonzero(word & ~before)
        self.end = np.flatnonzero(word & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)

    def sums(self, table: np.ndarray) -> np.ndarray:
        """Prefix sums of a polynomial over the bytes, modulo 2**64; ``span`` turns differences into hashes."""
        out = np.zeros(len(self.data) + 1, dtype=U64)
        np.cumsum(table[self.data] * _power(_BASE, len(self.data)), out=out[1:], dtype=U64)
        return out

    @staticmethod
    def span(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the byte strings [start, end), wherever they stand."""
        if len(start) == 0:
            return np.zeros(0, dtype=U64)
        at = _power(_BASE_INVERSE, int(start.max()) + 1)[start]
        return splitmix((sums[end] - sums[start]) * at)

    def hashes(self, table: np.ndarray) -> np.ndarray:
        return self.span(self.sums(table), self.start, self.end)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(column: pa.Array | pa.ChunkedArray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row behind the last, bytes, offsets) of runs of documents with at most ``limit`` bytes, or of one longer document."""
    data, offsets = text_bytes(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        yield row, to, data[offsets[row] : offsets[to]], offsets[row : to + 1] - offsets[row]
        row = to


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """A hash for the n words from each place; the last n - 1 places have none."""
    if len(words) < n:
        return np.zeros(0, dtype=U64)
    multipliers = splitmix(np.arange(n, dtype=U64) + U64(1000 + n)) | U64(1)
    count = len(words) - n + 1
    out = np.zeros(count, dtype=U64)
    for k in range(n):
        out += words[k : k + count] * multipliers[k]
    return splitmix(out)
