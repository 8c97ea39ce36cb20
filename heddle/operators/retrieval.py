"""Hybrid retrieval: dense and lexical channels, rank fusion, diversity, context and claim checks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.functions import text as X
from heddle.operators.graph import settled

# Defaults of the retrieval settings.
DENSE_K = LEXICAL_K = 30
RRF_K, TOP_K, PER_SECTION = 60, 8, 2
MIN_DENSE, MIN_LEXICAL = 0.5, 0.34
CONTEXT_TOKENS, SUPPORT = 3500, 0.6


def dense_channel(chunks: DataFrame, queries: DataFrame, k: int = DENSE_K, block_bytes: int = 16 << 20) -> DataFrame:
    """queries (query, vector) against chunks (id, embedding): the k nearest per query by cosine similarity to nine digits, then id.

    Neither side has a limit: the queries travel to the chunks as matrices, in blocks of hashed queries with at most about block_bytes
    of vectors and one pass over the chunks per block.  A task passes on only what may be among the best k of its part.
    """
    return ranked(_by_blocks(chunks, queries, block_bytes, lambda shared: _nearest(shared, k), f"id {chunks.schema['id'].dataType.simpleString()}, score double"), k)


def score_ranges(chunks: DataFrame, queries: DataFrame, block_bytes: int = 16 << 20) -> DataFrame:
    """Per query over all chunks of its width: n, and the least and the most of their cosine similarities to nine digits.  A task passes on a row per query."""
    parts = _by_blocks(chunks, queries, block_bytes, _ranges, "n long, least double, most double")
    return parts.groupBy("query").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))


def _by_blocks(chunks: DataFrame, queries: DataFrame, block_bytes: int, run, columns: str) -> DataFrame:
    """Rows (query and columns) that run(broadcast table of queries) makes of the chunks' batches."""
    spark = chunks.sparkSession
    asked = queries.where("vector is not null").select("query", F.col("vector").cast("array<double>").alias("vector"))
    size = asked.agg(F.coalesce(F.sum(F.size("vector") * 8), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-size // block_bytes))
    rows = chunks.where("embedding is not null").select("id", F.col("embedding").cast("array<double>").alias("embedding"))
    near = None
    for n in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == n).toArrow().combine_chunks()
        shared = spark.sparkContext.broadcast(part)
        found = rows.mapInArrow(run(shared), f"query {asked.schema['query'].dataType.simpleString()}, {columns}")
        if blocks > 1:  # a block's hits are written, so that its broadcast can go before the next comes
            found = settled(found)
            shared.destroy()
        near = found if near is None else near.unionByName(found)
    return near


def _unit_vectors(vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per width the rows and unit vectors of a column of lists; those that are zero or have nulls have no direction and are left out."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    widths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    out = {}
    for width in np.unique(widths[widths > 0]):
        at = np.flatnonzero(widths == width)
        matrix = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, int(width))
        length = np.sqrt((matrix * matrix).sum(axis=1))
        good = length > 0
        out[int(width)] = at[good], matrix[good] / length[good, None]
    return out


def _nearest(broadcast, k: int):
    """Over batches of (id, embedding): per query of the broadcast table the best k of each batch, without those below the best k so far."""

    def run(batches):
        names = broadcast.value["query"]
        names = names.combine_chunks() if isinstance(names, pa.ChunkedArray) else names
        asked = _unit_vectors(broadcast.value["vector"])
        best = {w: np.full((len(at), k), -(1 << 62), dtype=np.int64) for w, (at, _) in asked.items()}
        for batch in batches:
            batch = batch.take(pc.sort_indices(batch.column("id")))
            for width, (at, unit) in _unit_vectors(batch.column("embedding")).items():
                if width not in asked or not len(at):
                    continue
                rows, vectors = asked[width]
                some = max(1, (1 << 22) // len(at))
                for low in range(0, len(rows), some):
                    # Nine digits of the score, then the place by id: keys are distinct, so equal scores need no further care.
                    scores = np.rint(vectors[low : low + some] @ unit.T * 1e9).astype(np.int64)
                    keys = (scores << 24) - np.arange(len(at))
                    top = np.argpartition(keys, len(at) - k, axis=1)[:, -k:] if len(at) > k else np.broadcast_to(np.arange(len(at)), keys.shape)
                    score = np.take_along_axis(scores, top, axis=1)
                    kept = best[width][low : low + some]
                    q, c = np.nonzero(score >= kept.min(axis=1)[:, None])
                    kept[:] = np.sort(np.concatenate([kept, score], axis=1), axis=1)[:, -k:]
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(rows[low + q])), batch.column("id").take(pa.array(at[top[q, c]])), pa.array(score[q, c] / 1e9)], names=["query", "id", "score"])

    return run


def _ranges(broadcast):
    """Over batches of (id, embedding): per query of the broadcast table how many scores there are, the least and the most."""

    def run(batches):
        names = broadcast.value["query"]
        names = names.combine_chunks() if isinstance(names, pa.ChunkedArray) else names
        asked = _unit_vectors(broadcast.value["vector"])
        n, least, most = np.zeros(len(names), dtype=np.int64), np.full(len(names), np.inf), np.full(len(names), -np.inf)
        for batch in batches:
            for width, (at, unit) in _unit_vectors(batch.column("embedding")).items():
                if width not in asked or not len(at):
                    continue
                rows, vectors = asked[width]
                some = max(1, (1 << 22) // len(at))
                for low in range(0, len(rows), some):
                    scores, here = vectors[low : low + some] @ unit.T, rows[low : low + some]
                    n[here] += len(at)
                    least[here], most[here] = np.minimum(least[here], scores.min(axis=1)), np.maximum(most[here], scores.max(axis=1))
        met = np.flatnonzero(n)
        digits = lambda x: pa.array(np.rint(x[met] * 1e9) / 1e9)
        yield pa.RecordBatch.from_arrays([names.take(pa.array(met)), pa.array(n[met]), digits(least), digits(most)], names=["query", "n", "least", "most"])

    return run


def ranked(scores: DataFrame, k: int, key: str = "id") -> DataFrame:
    """(query, key, score) with rank, the best k per query; ties by key."""
    rank = F.expr(f"row_number() over (partition by query order by score desc, {key})")
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)


def fuse(channels: dict[str, DataFrame], weights: dict[str, float] | None = None, k: int = RRF_K, key: str = "id") -> DataFrame:
    """Reciprocal rank fusion of channels (query, key, rank)."""
    out = None
    for name, rows in channels.items():
        part = rows.select("query", key, (F.lit((weights or {}).get(name, 1.0)) / (k + F.col("rank"))).alias("part"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("query", key).agg(F.sum("part").alias("fused"))


def diverse(rows: DataFrame, top_k: int = TOP_K, per_section: int = PER_SECTION, key: str = "id") -> DataFrame:
    """rows (query, key, section, fused): the best top_k, those beyond per_section of a section only as fillers."""
    turn = F.expr(f"row_number() over (partition by query, section order by fused desc, {key})")
    rows = rows.withColumn("filler", turn > per_section)
    return rows.withColumn("place", F.expr(f"row_number() over (partition by query order by filler, fused desc, {key})")).where(F.col("place") <= top_k)


def relevant(dense: Column, lexical_rank: Column, ratio: Column, min_dense: float = MIN_DENSE, min_lexical: float = MIN_LEXICAL) -> Column:
    return F.coalesce(dense >= min_dense, F.lit(False)) | (lexical_rank.isNotNull() & F.coalesce(ratio >= min_lexical, F.lit(False)))


def within_budget(rows: DataFrame, group: list[str], order: str, content: str, budget: int = CONTEXT_TOKENS) -> DataFrame:
    """Per group the leading rows whose token counts sum up to the budget; it stops at the first that overflows."""
    names = ", ".join(group)
    out = rows.withColumn("used", F.expr("0") + X.estimate_tokens(F.col(content)))
    out = out.withColumn("used", F.expr(f"sum(used) over (partition by {names} order by {order})"))
    over = F.max((F.col("used") > budget).cast("int"))
    from pyspark.sql import Window

    return out.withColumn("over", over.over(Window.partitionBy(*group).orderBy(order))).where("over = 0").drop("over")


def context_blocks(hits: DataFrame, chunks: DataFrame, neighbours: int = 1) -> DataFrame:
    """hits (query, doc_id, pos) with their neighbours of the same section: query, doc_id, pos, role; a hit's role wins."""
    around = hits.select("query", "doc_id", "pos", F.explode(F.sequence(F.col("pos") - neighbours, F.col("pos") + neighbours)).alias("near"))
    near = around.join(chunks.select("doc_id", F.col("pos").alias("near")), ["doc_id", "near"])
    role = F.when(F.col("near") == F.col("pos"), "HIT").otherwise("NEIGHBOR")
    return near.groupBy("query", "doc_id", F.col("near").alias("pos")).agg(F.min(role).alias("role"))


def claim_support(claims: DataFrame) -> DataFrame:
    """claims (id, claim, cited): whether one statement of the cited text backs the claim.

    Identifiers, numbers and capitals of the claim must all stand in one statement, and the share of its other salient
    stems in that statement is its support.
    """
    tokens = X.tokens(F.col("claim"))
    must = F.filter(tokens, lambda t: X.is_identifier_like(t) | t.rlike(r"^\d+$") | t.rlike("^[A-Z]{3,}$"))
    must = F.array_distinct(F.transform(must, lambda t: F.when(X.is_identifier_like(t), F.array_join(X.split_identifier(t), "")).otherwise(F.lower(t))))
    plain = F.filter(tokens, lambda t: ~X.is_identifier_like(t) & ~t.rlike(r"^\d+$") & ~t.rlike("^[A-Z]{3,}$") & (F.length(t) >= 4) & ~F.lower(t).isin(X.STOPWORDS))
    stems = F.array_distinct(F.transform(plain, X.stem))
    rows = claims.select("id", must.alias("must"), stems.alias("stems"), F.explode_outer(X.statements(F.col("cited"))).alias("statement"))
    words = F.split(X.lexical_text(F.coalesce("statement", F.lit(""))), " ")
    rows = rows.select("id", "must", "stems", words.alias("words"), F.transform(words, X.stem).alias("have"))
    together = F.size(F.array_except("must", "words")) == 0
    share = F.coalesce(F.try_divide(F.size(F.array_intersect("stems", "have")).cast("double"), F.size("stems")), F.lit(1.0))
    best = rows.groupBy("id").agg(F.max(F.when(together, share)).alias("support"))
    return best.select("id", F.coalesce("support", F.lit(0.0)).alias("support"), F.coalesce(F.col("support") >= SUPPORT, F.lit(False)).alias("supported"))


def retrieval_metrics(results: DataFrame, k: int = TOP_K) -> DataFrame:
    """results (answerable, refused, rank, in_context, citations_valid, claims, dropped, latency): one row of rates."""
    share = lambda hit, of: F.round(F.try_divide(F.count(F.when(hit & of, 1)).cast("double"), F.count(F.when(of, 1))), 4)
    able, true = F.col("answerable"), F.lit(True)
    found = F.coalesce(F.col("rank") <= k, F.lit(False))
    sorted_latency = F.array_sort(F.collect_list("latency"))
    return results.agg(
        F.count("*").alias("questions"), share(found, able).alias("recall_at_k"), F.round(F.try_divide(F.sum(F.when(able, F.coalesce(1 / F.col("rank"), F.lit(0.0)))), F.count(F.when(able, 1))), 4).alias("mrr"),
        share(F.col("in_context"), able).alias("context_recall"), share(F.col("citations_valid"), ~F.col("refused")).alias("citation_validity"), share(F.col("refused"), ~able).alias("refusal_accuracy"),
        share(F.col("refused"), able).alias("false_refusal"), F.round(F.try_divide(F.sum("dropped").cast("double"), F.sum(F.col("claims") + F.col("dropped"))), 4).alias("dropped_claim_rate"),
        F.round(F.avg("latency"), 1).alias("latency_mean"), F.element_at(sorted_latency, F.floor(0.95 * (F.size(sorted_latency) - 1)).cast("int") + 1).alias("latency_p95"), true.alias("ok"),
    ).drop("ok")


def extractive_answers(hits: DataFrame) -> DataFrame:
    """hits (query, question, id, content): the sentence of each hit's best line that shares most stems with the question."""
    terms = F.transform(X.query_terms(F.col("question")), lambda t: X.stem(t["joined"]))
    overlap = lambda part: F.size(F.array_intersect(F.col("terms"), F.array_distinct(F.transform(F.split(X.lexical_text(part), " "), X.stem))))
    lines = hits.select("query", "id", terms.alias("terms"), F.posexplode(F.filter(F.transform(F.split("content", "\n"), F.trim), lambda x: x != "")).alias("n", "line"))
    best = lines.groupBy("query", "id").agg(F.max_by(F.struct("terms", "line"), F.struct(overlap(F.col("line")).alias("o"), (-F.col("n")).alias("n"))).alias("x"))
    parts = best.select("query", "id", F.col("x.terms").alias("terms"), F.posexplode(F.split("x.line", r"(?<=[.!?])\s+")).alias("n", "part"))
    return parts.groupBy("query", "id").agg(F.max_by("part", F.struct(overlap(F.col("part")).alias("o"), (-F.col("n")).alias("n"))).alias("sentence"))


def reuse_embeddings(chunks: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """chunks (id, content_hash) with vectors of known (content_hash, embedding); and the distinct hashes still to embed."""
    once = known.dropDuplicates(["content_hash"])
    have = chunks.join(once, "content_hash", "left")
    return have, chunks.select("content_hash").distinct().join(once, "content_hash", "left_anti")


def checked_embedding(embedding: Column, dimensions: int) -> Column:
    """The embedding, or an error if its width is another."""
    return F.when(F.size(embedding) == dimensions, embedding).otherwise(F.raise_error(F.concat(F.lit(f"embedding width is not {dimensions}: "), F.size(embedding).cast("string"))))


def find_excerpts(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs (doc_id, text) that hold an item (item_id, excerpt): doc_id, item_id, start, exact, as locate_excerpt has them.

    Of an item's words between its first and last, which stand whole in any text that holds it, the one in fewest texts narrows the
    join; items without such a word meet every text.  A text's words are found once, and the places to look at are written, so that texts needn't move to few of them.
    """
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    items = items.where("excerpt is not null").select("item_id", "excerpt", words(F.col("excerpt")).alias("w"))
    inner = items.where(F.size("w") > 2).select("item_id", "excerpt", F.explode(F.array_distinct(F.slice("w", F.lit(2), F.size("w") - 2))).alias("word"))
    inside = settled(docs.select("doc_id", F.explode(F.array_distinct(words(F.col("text")))).alias("word")).join(inner.select("word").distinct(), "word", "left_semi"))
    rare = inner.join(inside.groupBy("word").agg(F.count("*").alias("n")), "word", "left").groupBy("item_id", "excerpt").agg(F.min_by("word", F.struct(F.coalesce("n", F.lit(0)), "word")).alias("word"))
    near = settled(inside.join(rare, "word").select("doc_id", "item_id", "excerpt").distinct()).join(docs.select("doc_id", "text"), "doc_id")
    near = near.unionByName(docs.select("doc_id", "text").crossJoin(F.broadcast(items.where(F.size("w") <= 2).select("item_id", "excerpt"))).select("doc_id", "item_id", "excerpt", "text"))
    return near.select("doc_id", "item_id", X.locate_excerpt(F.col("text"), F.col("excerpt")).alias("x")).where("x is not null").select("doc_id", "item_id", F.col("x.start").cast("long").alias("start"), F.col("x.exact").alias("exact"))


def rounds(hits: DataFrame, most: int = 3, top_k: int = TOP_K, wider: int = 4) -> DataFrame:
    """hits (query, id, rank) of bounded rounds: the first takes top_k, each further one ``wider`` more; round is the first that brings a hit.

    A query ends with the first round that brings nothing new.
    """
    n = F.greatest(F.lit(1), F.ceil((F.col("rank") - top_k) / wider) + 1).cast("int")
    rows = hits.withColumn("round", n).where(F.col("round") <= most)
    have = rows.groupBy("query").agg(F.collect_set("round").alias("have"))
    whole = F.size(F.array_except(F.sequence(F.lit(1), F.col("round")), F.col("have"))) == 0
    return rows.join(have, "query").where(whole).select("query", "id", "rank", "round")


def evaluated(questions: DataFrame, ranked_hits: DataFrame, expected: DataFrame, k: int = TOP_K) -> DataFrame:
    """Per question (query, answerable): rank of the first expected hit, whether one is among the first k, and whether the question is refused (no hit at all).

    ranked_hits (query, id, rank), expected (query, id).  The rows are those that retrieval_metrics sums up.
    """
    first = ranked_hits.join(expected.distinct(), ["query", "id"]).groupBy("query").agg(F.min("rank").alias("rank"))
    asked = ranked_hits.groupBy("query").agg(F.count("*").alias("hits"))
    rows = questions.join(first, "query", "left").join(asked, "query", "left")
    return rows.select("query", "answerable", "rank", F.coalesce(F.col("rank") <= k, F.lit(False)).alias("in_context"), F.col("hits").isNull().alias("refused"))


def question_rows(files: DataFrame) -> DataFrame:
    """Labelled questions from JSON files (path, content: an object with questions, or an array of them), a row each: id, category, question, answerable, expected_sections, expected_terms."""
    kind = "array<struct<id: string, category: string, question: string, answerable: boolean, expected_sections: array<string>, expected_terms: array<string>>>"
    text = F.trim(F.decode("content", "UTF-8"))
    rows = F.when(text.startswith("["), F.from_json(text, kind)).otherwise(F.from_json(text, f"questions {kind}")["questions"])
    x = files.select(F.explode(rows).alias("x")).select("x.*")
    none = F.array().cast("array<string>")
    return x.select("id", "category", "question", F.coalesce("answerable", F.lit(True)).alias("answerable"), F.coalesce("expected_sections", none).alias("expected_sections"), F.coalesce("expected_terms", none).alias("expected_terms"))
