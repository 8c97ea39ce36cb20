"""Vector functions over array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null where a vector is zero."""
    return 1 - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def bound(value: Column, use) -> Column:
    """use(value) with value evaluated once, however often use has it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def l2_normalize(a: Column) -> Column:
    """The vector over its length; a zero vector stays."""
    return bound(a, lambda v: bound(F.sqrt(dot(v, v)), lambda n: F.when(n == 0, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double") / n))))


def hashed_embedding(words: Column, dim: int) -> Column:
    """Counts of words in md5(word) mod dim buckets, normalized.  The 128-bit remainder is folded by eight digits at a time; each word and its bucket is made once."""
    part = lambda h, k: F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("long")

    def bucket(h: Column) -> Column:
        out = part(h, 0) % dim
        for k in (1, 2, 3):
            out = (out * (1 << 32) + part(h, k)) % dim
        return out

    at = F.transform(words, lambda w: bound(F.md5(w.cast("binary")), bucket))
    counts = bound(at, lambda found: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda b: F.size(F.filter(found, lambda x: x == b)).cast("double")))
    return l2_normalize(counts)


def trigrams(text: Column) -> Column:
    """Distinct three-letter sequences of the lower-case words, each padded with two spaces ahead and one behind."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    of = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))
    return F.array_distinct(F.flatten(F.transform(words, of)))


def trigram_similarity(a: Column, b: Column) -> Column:
    ta, tb = trigrams(a), trigrams(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(ta, tb)).cast("double"), F.size(F.array_union(ta, tb))), F.lit(0.0))
