"""Toxicity with a linear-chain conditional random field.

Tokens carry one of two states.  Emissions are sums of weights of hashed features (the word and its first three to
six bytes), transitions are four numbers.  Forward and backward messages of the two states are kept as
ratios; a step of either recursion is a Moebius map of the ratio, so a piece of text with
all its documents is one chain that is cut into rows, composed row by row and
evaluated exactly with array operations, however long a document is.

No token labels are supplied: labels exist per document, so token labels are drawn from them first: a token of a toxic document is
labelled 1 if one of its features is tied to toxic documents by a
likelihood-ratio test.  The field is then fitted to these token labels by Adagrad, and a logistic curve over the expected and
the largest token marginal turns marginals into document scores.

Fitting uses at most ``max_train`` labelled documents (those with the smallest hashes of doc_id); scoring
is one projection over all texts, without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heddle.llm import textcore as tc

BUCKET_BITS = 18
PREFIXES = (3, 4, 5, 6)
ROW = 64


def features(words: tc.Words) -> np.ndarray:
    """Buckets of each token's features, one column per kind."""
    sums = words.sums(tc.FOLDED)
    columns = [tc.Words.span(sums, words.start, words.end)]
    for k in PREFIXES:
        # A shorter word has its whole in place of the prefix, marked by its length, so equal words stay equal.
        end = np.minimum(words.start + k, words.end)
        columns.append(tc.splitmix(tc.Words.span(sums, words.start, end) + np.uint64(k)))
    return (np.stack(columns, axis=1) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)


def _chain(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """r[t] = (a[t] r[t-1] + b[t]) / (c[t] r[t-1] + d[t]) from r[-1] = 1, all t at once."""
    n = len(a)
    rows = max(1, -(-n // ROW))
    pad = rows * ROW - n
    grid = [np.concatenate([x, np.full(pad, v)]).reshape(rows, ROW).T.copy() for x, v in ((a, 1.0), (b, 0.0), (c, 0.0), (d, 1.0))]
    one, zero = np.ones(rows), np.zeros(rows)
    p, q, r, s = one, zero, zero.copy(), one.copy()
    for k in range(ROW):
        ak, bk, ck, dk = (g[k] for g in grid)
        p, q, r, s = ak * p + bk * r, ak * q + bk * s, ck * p + dk * r, ck * q + dk * s
        top = np.maximum(np.maximum(p, q), np.maximum(r, s))
        p, q, r, s = p / top, q / top, r / top, s / top
    start = np.empty(rows)
    x = 1.0
    for k, (pk, qk, rk, sk) in enumerate(zip(p.tolist(), q.tolist(), r.tolist(), s.tolist(), strict=True)):
        start[k] = x
        x = (pk * x + qk) / (rk * x + sk)
    out = np.empty((ROW, rows))
    x = start
    for k in range(ROW):
        x = (grid[0][k] * x + grid[1][k]) / (grid[2][k] * x + grid[3][k])
        out[k] = x
    return out.T.reshape(-1)[:n]


@dataclass
class Field:
    weights: np.ndarray  # per bucket
    bias: float
    step: np.ndarray  # transition scores [from, to]
    first: float  # extra score of state 1 at a document's first token
    curve: np.ndarray  # of the document score: constant, log expected tokens, log largest marginal

    def emissions(self, buckets: np.ndarray) -> np.ndarray:
        return np.clip(self.weights[buckets].sum(axis=1, dtype=np.float64) + self.bias, -30, 30)

    def messages(self, emission: np.ndarray, opens: np.ndarray, closes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ratios of state 1 to state 0 of the forward and the backward messages."""
        e, t = np.exp(emission), np.exp(self.step)
        forward = _chain(np.where(opens, 0, e * t[1, 1]), np.where(opens, e * np.exp(self.first), e * t[0, 1]), np.where(opens, 0, t[1, 0]), np.where(opens, 1, t[0, 0]))
        after = np.append(e[1:], 1.0)
        back = [np.where(closes, x, y)[::-1] for x, y in ((0, after * t[1, 1]), (1, t[1, 0]), (0, after * t[0, 1]), (1, t[0, 0]))]
        return forward, _chain(*back)[::-1]

    def marginals(self, emission: np.ndarray, opens: np.ndarray, closes: np.ndarray) -> np.ndarray:
        forward, backward = self.messages(emission, opens, closes)
        odds = forward * backward
        return odds / (1 + odds)

    def doc_inputs(self, marginal: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Constant, log expected number of toxic tokens, log largest marginal; of an empty document as if no token were toxic."""
        total = np.concatenate([[0.0], np.cumsum(marginal)])
        expected = np.maximum(total[first[1:]] - total[first[:-1]], 0)
        largest = np.zeros(len(first) - 1)
        full = first[1:] > first[:-1]
        if full.any():
            largest[full] = np.maximum.reduceat(marginal, first[:-1][full])
        return np.stack([np.ones(len(expected)), np.log(expected + 0.01), np.log(largest + 0.01)], axis=1)

    def doc_scores(self, marginal: np.ndarray, first: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.doc_inputs(marginal, first) @ self.curve, -30, 30)))


def _borders(words: tc.Words) -> tuple[np.ndarray, np.ndarray]:
    opens, closes = np.zeros(len(words.start), dtype=bool), np.zeros(len(words.start), dtype=bool)
    full = words.first[1:] > words.first[:-1]
    opens[words.first[:-1][full]] = True
    closes[words.first[1:][full] - 1] = True
    return opens, closes


def token_labels(pieces: list[tuple[tc.Words, np.ndarray, np.ndarray]], least_ratio: float = 20.0, least_g: float = 24.0) -> list[np.ndarray]:
    """Per piece (words, buckets, document labels) the labels of its tokens."""
    df = np.zeros((2, 1 << BUCKET_BITS))
    n = np.zeros(2)
    for words, buckets, toxic in pieces:
        doc = np.repeat(np.arange(len(toxic)), np.diff(words.first))
        for k in range(buckets.shape[1]):
            once = np.unique(doc.astype(np.int64) << BUCKET_BITS | buckets[:, k])
            for label in (0, 1):
                own = once[toxic[once >> BUCKET_BITS] == label]
                df[label] += np.bincount(own & ((1 << BUCKET_BITS) - 1), minlength=1 << BUCKET_BITS)
        n += np.bincount(toxic, minlength=2)
    share = n[1] / max(n.sum(), 1)
    seen = np.maximum(df.sum(axis=0), 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * (np.where(df[1] > 0, df[1] * np.log(df[1] / (seen * share)), 0) + np.where(df[0] > 0, df[0] * np.log(df[0] / (seen * (1 - share))), 0))
    strong = (df[1] / max(n[1], 1) >= least_ratio * (df[0] + 0.5) / max(n[0], 1)) & (g >= least_g)
    return [np.where(toxic[np.repeat(np.arange(len(toxic)), np.diff(words.first))] == 1, strong[buckets].any(axis=1), False) for words, buckets, toxic in pieces]


def fit(texts: list[str], toxic: np.ndarray, epochs: int = 6, rate: float = 0.3) -> Field:
    """A field from whole texts and their 0/1 labels.  Without any toxic one, all scores are low."""
    field = Field(np.zeros(1 << BUCKET_BITS, dtype=np.float32), -2.0, np.zeros((2, 2)), 0.0, np.array([-4.0, 0.0, 0.0]))
    pieces = []
    for a, b, data, offsets in tc.pieces(pa.array(texts, pa.large_string()), 1 << 20):
        words = tc.Words(data, offsets, tc.ALNUM)
        if len(words.start):
            pieces.append((words, features(words), toxic[a:b]))
    if not pieces or not toxic.any() or toxic.all():
        return field
    labels = token_labels(pieces)
    squares = np.full(1 << BUCKET_BITS, 1e-6, dtype=np.float32)
    other = np.full(5, 1e-6)
    for _ in range(epochs):
        for (words, buckets, _), y in zip(pieces, labels, strict=True):
            opens, closes = _borders(words)
            emission = field.emissions(buckets)
            forward, backward = field.messages(emission, opens, closes)
            p = forward * backward / (1 + forward * backward)
            slope = y - p
            weight = np.bincount(buckets.ravel(), weights=np.repeat(slope, buckets.shape[1]), minlength=1 << BUCKET_BITS) / np.sqrt(len(y))
            squares += weight.astype(np.float32) ** 2
            field.weights += (rate * weight / np.sqrt(squares)).astype(np.float32)
            inner = np.flatnonzero(~opens)
            before, e = forward[inner - 1], np.exp(emission[inner]) * backward[inner]
            t = np.exp(field.step)
            joint = np.stack([np.full(len(inner), t[0, 0]), t[0, 1] * e, before * t[1, 0], before * t[1, 1] * e])
            expected = (joint / joint.sum(axis=0)).sum(axis=1)
            kind = 2 * y[inner - 1] + y[inner]
            rest = np.array([*(np.bincount(kind, minlength=4) - expected)[1:], (y - p)[opens].sum(), slope.sum()]) / np.sqrt(len(y))
            other += rest**2
            move = rate * rest / np.sqrt(other)
            field.step += np.array([[0, move[0]], [move[1], move[2]]])
            field.first += move[3]
            field.bias += move[4]
    inputs = np.concatenate([field.doc_inputs(field.marginals(field.emissions(buckets), *_borders(words)), words.first) for words, buckets, _ in pieces])
    known = np.concatenate([t for _, _, t in pieces])
    curve = np.zeros(3)
    for _ in range(30):  # Newton steps, with a small ridge
        p = 1 / (1 + np.exp(-np.clip(inputs @ curve, -30, 30)))
        hessian = (inputs * (p * (1 - p))[:, None]).T @ inputs + 0.05 * np.eye(3)
        curve = curve + np.linalg.solve(hessian, inputs.T @ (known - p) - 0.05 * curve)
    field.curve = curve
    return field


RESULT = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())])))])


def _scorer(broadcast):
    @F.arrow_udf(RESULT)
    def score(text: pa.Array) -> pa.Array:
        field = broadcast.value
        scores, counts, begins, stops = [np.zeros(0)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for _, _, data, offsets in tc.pieces(text):
            words = tc.Words(data, offsets, tc.ALNUM)
            marginal = field.marginals(field.emissions(features(words)), *_borders(words)) if len(words.start) else np.zeros(0)
            scores.append(field.doc_scores(marginal, words.first))
            hit = np.flatnonzero(marginal >= 0.5)
            doc = np.searchsorted(words.first, hit, side="right") - 1
            chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            counts.append(np.bincount(doc, minlength=len(offsets) - 1))
            begins.append(chars[words.start[hit]] - chars[offsets[doc]])
            stops.append(chars[words.end[hit]] - chars[offsets[doc]])
        ends = np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int32)
        spans = pa.StructArray.from_arrays([pa.array(np.concatenate(begins).astype(np.int64)), pa.array(np.concatenate(stops).astype(np.int64))], names=["start", "stop"])
        return pa.StructArray.from_arrays([pa.array(np.concatenate(scores)), pa.ListArray.from_arrays(pa.array(ends), spans)], names=["score", "spans"])

    return score


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, max_train: int = 5000, max_bytes: int = 64 << 20) -> DataFrame:
    """doc_id, held_out, score, predicted and spans (start, stop: characters of toxic tokens), a row per row of docs.

    Learns from at most max_train rows of labels (doc_id, toxic) that aren't held out, by text alone, and of these from whole texts with at most max_bytes in all.  Null labels
    and ids teach nothing; of a doc_id with several labels the largest counts, of one with several texts that of the smallest hash.  Null and empty
    texts are scored like a text without a toxic token.  Scores have nine digits (the last bits hang on what else is in a batch), so repeated rows are scored alike.
    Of docs only doc_id and text are read.  Without labels of both kinds all scores are low.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out(F.col("doc_id")))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    texts = docs.join(F.broadcast(chosen), "doc_id")
    # At most max_train rows; a text that doesn't fit any more is left out, and shorter ones behind it may still fit.
    fitting, room = [], max_bytes
    for r in texts.groupBy("doc_id").agg(F.max(F.octet_length(F.coalesce("text", F.lit("")))).alias("n"), F.first("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").collect():
        if r["n"] <= room:
            fitting.append((r["doc_id"], r["toxic"]))
            room -= r["n"]
    fitting = spark.createDataFrame(fitting, texts.select("doc_id", "toxic").schema)
    train = docs.join(F.broadcast(fitting), "doc_id").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("toxic").alias("toxic")).collect()
    train = sorted(train, key=lambda r: r["doc_id"])
    field = fit([r["text"] or "" for r in train], np.array([int(r["toxic"] > 0) for r in train], dtype=np.int64))
    scored = docs.select("doc_id", _scorer(spark.sparkContext.broadcast(field))(F.col("text")).alias("x"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.round("x.score", 9).alias("score"), (F.round("x.score", 9) >= 0.5).cast("int").alias("predicted"), F.col("x.spans").alias("spans"))


def op1_crf_toxicity(spark, sf_dir: str) -> DataFrame:
    rows = toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return rows.select("doc_id", "held_out", "score", "predicted", F.size("spans").cast("long").alias("n_spans"), F.to_json("spans").alias("spans"))
