"""Quality rules with thresholds from mergeable quantile sketches per language and source.

The sketch of a measure is its histogram over integer buckets that keep the seven leading
binary digits (relative error below 1/64).  Histograms of any two sets of documents
merge by adding counts, exactly and in any order, so the result doesn't depend on
partitions.  A level's fences for a measure lie ``spread`` quartile distances outside its quartiles.  A
language's fences are drawn toward those of all documents, and a source's toward its language's, as if ``prior`` documents had
the fences of the level above: no group is too small for fences of its own, and none hangs on few documents.

A measure is a share a / b, so a document is beyond a fence only if a is farther from b times the fence than
``spread`` standard deviations of a count of that size (plus one), in units that repeats come in.  So one
symbol or repeated line in a short text is no reason to reject it even where most texts have none.
Documents beyond a fence are rejected, as are those that fail the base rules.

Each text is read and measured once; the measures are written beside the columns that are asked for, and sketches and verdicts read that table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heddle.llm import textcore as tc
from heddle.llm.store import Scratch

FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_chars"]
_STRUCT = T.StructType([T.StructField(f, T.LongType()) for f in FIELDS])
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", dtype=np.uint8))
_HEAD = (np.arange(256) & 0xC0) != 0x80
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)

#: The adaptive rules' measures: numerator, denominator, unit of the numerator (a window that occurs twice repeats six words), and whether there is a lower fence too.
MEASURES = {
    "symbol_share": ("n_symbols", "n_words", 1, False), "upper_share": ("n_upper", "n_chars", 1, True), "dup_line_share": ("n_dup_lines", "n_lines", 1, False),
    "repeat_share": ("n_repeat_words", "n_words", 6, False), "word_length": ("word_chars", "n_words", 1, True),
}


def _by_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def measure(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FIELDS per document of a piece."""
    n_docs = len(offsets) - 1
    out = np.zeros((n_docs, len(FIELDS)), dtype=np.int64)
    words = tc.Words(data, offsets, tc.NOT_SPACE)
    out[:, 0] = np.diff(words.first)
    head = _HEAD[data]
    out[:, 1] = _by_doc(head & tc.NOT_SPACE[data], offsets)
    out[:, 2] = _by_doc(_SYMBOL[data], offsets)
    out[:, 6] = _by_doc(_UPPER[data], offsets)
    out[:, 7] = _by_doc(head, offsets)
    if len(words.start) == 0:
        return out
    sums = words.sums(tc.EXACT)
    doc_key = tc.splitmix(np.arange(n_docs, dtype=np.uint64))

    breaks = np.flatnonzero(data == 10)
    starts = np.union1d(breaks + 1, offsets[:-1])
    starts = starts[starts < len(data)]
    doc = np.searchsorted(offsets, starts, side="right") - 1
    end = np.minimum(np.append(breaks, len(data))[np.searchsorted(breaks, starts)], offsets[doc + 1])
    full = np.searchsorted(words.start, end) > np.searchsorted(words.start, starts)
    starts, end, doc = starts[full], end[full], doc[full]
    lines = tc.Words.span(sums, starts, end) ^ doc_key[doc]
    _, first = np.unique(lines, return_index=True)
    out[:, 5] = np.bincount(doc, minlength=n_docs)
    out[:, 3] = out[:, 5] - np.bincount(doc[first], minlength=n_docs)

    hashes = tc.Words.span(sums, words.start, words.end)
    if len(hashes) >= 3:
        windows = tc.ngrams(hashes, 3)
        doc = np.repeat(np.arange(n_docs), np.diff(words.first))
        at = np.flatnonzero(doc[:-2] == doc[2:])
        _, inverse, counts = np.unique(windows[at] ^ doc_key[doc[at]], return_inverse=True, return_counts=True)
        again = np.zeros(len(hashes) + 2, dtype=bool)
        again[at[counts[inverse] > 1]] = True
        covered = again[:-2].copy()
        covered[1:] |= again[:-3]
        covered[2:] |= again[:-4]
        out[:, 4] = _by_doc(covered, words.first)
    return out


@F.arrow_udf(_STRUCT)
def measures(text: pa.Array) -> pa.Array:
    rows = [measure(data, offsets) for _, _, data, offsets in tc.pieces(text)]
    table = np.concatenate(rows) if rows else np.zeros((0, len(FIELDS)), dtype=np.int64)
    return pa.StructArray.from_arrays([pa.array(table[:, k]) for k in range(len(FIELDS))], names=FIELDS)


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def shares(m: Column) -> dict[str, Column]:
    """The measures in thousandths."""
    return {k: F.floor(1000 * m[a] / F.greatest(m[b], F.lit(1))).cast("long") for k, (a, b, _, _) in MEASURES.items()}


def bucket(value: Column) -> Column:
    """The largest number not above value that has seven binary digits and then zeros."""
    cut = F.greatest(F.length(F.bin(value)) - 7, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, cut), cut)


def sketches(measured: DataFrame) -> DataFrame:
    """lang, source, measure, bucket, n: mergeable by adding n.  measured: __lang, __source and __m of each document."""
    listed = F.explode(F.array(*(F.struct(F.lit(name).alias("measure"), bucket(c).alias("bucket")) for name, c in shares(F.col("__m")).items())))
    return measured.where(~base_failed(F.col("__m"))).select("__lang", "__source", listed.alias("x")).groupBy("__lang", "__source", "x.measure", "x.bucket").agg(F.count("*").alias("n"))


def fences(sketch: DataFrame, prior: float, spread: float) -> DataFrame:
    """__lang, __source and per measure its fences (<measure>_low, <measure>_high), in thousandths."""
    found = sketch.select("__lang", "__source").distinct()
    for level, keys in {"all": [], "lang": ["__lang"], "own": ["__lang", "__source"]}.items():
        merged = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
        names = ", ".join([*keys, "measure"])
        ranked = merged.select(*keys, "measure", "bucket", F.expr(f"sum(n) over (partition by {names} order by bucket)").alias("up_to"), F.expr(f"sum(n) over (partition by {names})").alias("total"))
        quartile = lambda p: F.min(F.when(F.col("up_to") * 100 >= F.col("total") * p, F.col("bucket")))
        at = ranked.groupBy(*keys, "measure").agg(quartile(25).alias("q25"), quartile(75).alias("q75"), F.first("total").alias("docs"))
        gap = F.lit(spread) * (F.col("q75") - F.col("q25"))
        at = at.select(*keys, "measure", "docs", (F.col("q25") - gap).alias("low"), (F.col("q75") + gap).alias("high"))
        ends = [F.max(F.when(F.col("measure") == k, F.col(e))).alias(f"{k}_{e}_{level}") for k in MEASURES for e in ("low", "high")]
        at = at.groupBy(*(F.col(k).alias(f"k{k}") for k in keys)).agg(F.first("docs").alias(f"docs_{level}"), *ends)
        # The languages and groups of a corpus are few; all documents are one row, so its join is no product.
        match = [F.col(k).eqNullSafe(F.col(f"k{k}")) for k in keys]
        found = (found.join(at, match, "left") if keys else found.crossJoin(F.broadcast(at))).drop(*(f"k{k}" for k in keys))
    drawn = lambda level, above, e: (F.col(f"docs_{level}") * F.col(f"{e}_{level}") + prior * above) / (F.col(f"docs_{level}") + prior)
    ends = [f"{k}_{e}" for k in MEASURES for e in ("low", "high")]
    return found.select(F.col("__lang").alias("__for_lang"), F.col("__source").alias("__for_source"), *(drawn("own", drawn("lang", F.col(f"{e}_all"), e), e).alias(f"__{e}") for e in ends))


def judged(docs: DataFrame, columns: list[str] | None = None, prior: float = 10.0, spread: float = 6.0) -> DataFrame:
    """columns of docs (all by default) with __m (the measures), __base_failed and __kept.

    Null and empty texts have no words, so they fail the base rules.  Null languages and
    sources are groups of their own.  Repeated rows are judged one by one and alike.  An empty table gives an empty one.
    Other columns may have any name that does not start with two underscores.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    have = docs.columns if columns is None else columns
    measured = scratch.keep(docs.select(*have, measures("text").alias("__m"), F.col("lang").alias("__lang"), F.col("source").alias("__source")))
    fence = scratch.keep(fences(scratch.keep(sketches(measured.select("__lang", "__source", "__m"))), prior, spread).coalesce(1))
    match = F.col("__lang").eqNullSafe(F.col("__for_lang")) & F.col("__source").eqNullSafe(F.col("__for_source"))
    beyond = F.lit(False)
    for k, (a, b, unit, lower) in MEASURES.items():
        a, b = F.col("__m")[a], F.greatest(F.col("__m")[b], F.lit(1))
        noise = lambda at, unit=unit: spread * unit * F.sqrt(at / unit + 1)
        high = b * F.col(f"__{k}_high") / 1000
        beyond = beyond | F.coalesce(a > high + noise(high), F.lit(False))
        if lower:
            low = F.greatest(b * F.col(f"__{k}_low") / 1000, F.lit(0.0))
            beyond = beyond | F.coalesce(a < low - noise(low), F.lit(False))
    # Documents of a group without a sketch have failed the base rules, so they need no fence.
    failed = base_failed(F.col("__m"))
    return measured.join(fence, match, "left").select(*have, "__m", failed.alias("__base_failed"), (~failed & ~beyond).alias("__kept"))


def quality_filter(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of docs that pass, with their columns; null and empty texts don't pass, repeated rows pass alike, an empty table gives an empty one."""
    return judged(docs, **parameters).where("__kept").select(*docs.columns)


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    rows = judged(spark.read.parquet(f"{sf_dir}/documents.parquet"), columns=["doc_id"])
    return rows.select("doc_id", *(F.col("__m")[f].alias(f) for f in FIELDS[:5]), F.col("__base_failed").alias("base_failed"), F.col("__kept").alias("kept"))


def _oracle() -> str:
    listed = " UNION ALL ".join(f"SELECT doc_id, lang, source, '{k}' AS measure, {a} AS a, greatest({b}, 1) AS b, {unit} AS unit, {lower} AS lower, (1000 * {a}) // greatest({b}, 1) AS v FROM m WHERE NOT base_failed" for k, (a, b, unit, lower) in MEASURES.items())
    level = lambda name, keys: f"""{name} AS (SELECT {keys} measure, docs, q25 - 6.0 * (q75 - q25) AS low, q75 + 6.0 * (q75 - q25) AS high
  FROM (SELECT {keys} measure, max(total)::DOUBLE AS docs, (min(bucket) FILTER (up_to * 100 >= total * 25))::DOUBLE AS q25, (min(bucket) FILTER (up_to * 100 >= total * 75))::DOUBLE AS q75
  FROM (SELECT {keys} measure, bucket, sum(count(*)) OVER (PARTITION BY {keys} measure ORDER BY bucket) AS up_to, sum(count(*)) OVER (PARTITION BY {keys} measure) AS total FROM b GROUP BY {keys} measure, bucket) GROUP BY {keys} measure))"""  # noqa: E731
    drawn = lambda e: f"(own.docs * own.{e} + 10.0::DOUBLE * ((per.docs * per.{e} + 10.0::DOUBLE * total.{e}) / (per.docs + 10.0::DOUBLE))) / (own.docs + 10.0::DOUBLE)"
    return rf"""
WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
g AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 2), ' ') AS x FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS c FROM g), (SELECT unnest([0, 1, 2]) AS k) WHERE c > 1 GROUP BY doc_id),
m AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM (
  SELECT w.doc_id, lang, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, length(text) AS n_chars
  FROM w LEFT JOIN r ON r.doc_id = w.doc_id)),
v AS ({listed}),
b AS (SELECT doc_id, lang, source, measure, a, b, unit, lower, (v >> greatest(length(bin(v)) - 7, 0)) << greatest(length(bin(v)) - 7, 0) AS bucket FROM v),
{level("own", "lang, source,")}, {level("per", "lang,")}, {level("total", "")},
e AS (SELECT b.doc_id, a, unit, lower, b * {drawn("high")} / 1000 AS high, greatest(b * {drawn("low")} / 1000, 0.0::DOUBLE) AS low
  FROM b JOIN own ON own.lang IS NOT DISTINCT FROM b.lang AND own.source IS NOT DISTINCT FROM b.source AND own.measure = b.measure JOIN per ON per.lang IS NOT DISTINCT FROM b.lang AND per.measure = b.measure JOIN total ON total.measure = b.measure),
j AS (SELECT doc_id, bool_or(a > high + 6.0::DOUBLE * unit * sqrt(high / unit + 1) OR lower AND a < low - 6.0::DOUBLE * unit * sqrt(low / unit + 1)) AS beyond FROM e GROUP BY doc_id)
SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(beyond, false) AS kept FROM m LEFT JOIN j ON j.doc_id = m.doc_id
"""


ORACLE = _oracle()
