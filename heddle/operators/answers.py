"""From retrieved facts and claims to an answer; and derived views of facts, merges and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.functions import text as X
from heddle.operators import compare

# Most facts, roots, edges per root, claims from facts.
MAX_FACTS, MAX_ROOTS, EDGES_PER_ROOT, FACT_CLAIMS = 40, 3, 60, 15


def assembled_facts(edges: DataFrame, evidence: DataFrame, per_fact: int = 2) -> DataFrame:
    """edges (id, source_name, type, target_name) with their first citations (id, chunk_id, rank); facts without one are left out."""
    cited = evidence.withColumn("n", F.expr("row_number() over (partition by id order by rank, chunk_id)")).where(F.col("n") <= per_fact)
    listed = cited.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "chunk_id"))), lambda x: x["chunk_id"]), ";").alias("citations"))
    return edges.join(listed, "id").select("id", F.concat_ws(" ", "source_name", "type", "target_name").alias("fact"), "citations")


def path_views(paths: DataFrame, entities: DataFrame) -> DataFrame:
    """paths (root, id, nodes) with the names along each path."""
    steps = paths.select("root", "id", F.posexplode("nodes").alias("k", "node")).join(entities.select(F.col("id").alias("node"), "name"), "node")
    return steps.groupBy("root", "id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "name"))), lambda x: x["name"]), " > ").alias("names"))


def budgeted(pairs: DataFrame, budget: int) -> DataFrame:
    """Ambiguous pairs by falling similarity and pair_key: the first of them judged, the rest deferred.  Reads one row per pair."""
    kept = pairs.orderBy(F.desc("similarity"), "pair_key").limit(budget).select("pair_key", F.lit(True).alias("k"))
    return pairs.join(kept, "pair_key", "left").select("pair_key", F.when(F.col("k"), "JUDGED").otherwise("DEFERRED").alias("turn"))


def merged_blocks(blocks: DataFrame) -> DataFrame:
    """Context blocks (id, role) once each: a hit counts before a parent's lead, and that before a neighbour."""
    order = F.when(F.col("role") == "HIT", 0).when(F.col("role") == "PARENT_LEAD", 1).otherwise(2)
    return blocks.groupBy("id").agg(F.min_by("role", order).alias("role"))


def answer(claims: DataFrame) -> DataFrame:
    """claims (question, supported, support): per question kept and dropped claims, groundedness and status."""
    kept = F.count(F.when(F.col("supported"), 1))
    total = F.count("*")
    mean = F.avg(F.when(F.col("supported"), F.col("support")))
    grounded = F.round(F.coalesce(kept / total * mean, F.lit(0.0)) * 100) / 100
    return claims.groupBy("question").agg(kept.alias("kept"), (total - kept).alias("dropped"), grounded.alias("groundedness"), F.when(kept == 0, "INSUFFICIENT_EVIDENCE").otherwise("ANSWERED").alias("status"))


def table_rows(lines: DataFrame) -> DataFrame:
    """lines (doc, n, line): table rows with the header of their table; the first row of a run of rows is its header."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc").orderBy("n")
    row = F.trim("line").startswith("|")
    start = row & ~F.coalesce(F.lag(row).over(w), F.lit(False))
    rows = lines.withColumn("row", row).withColumn("start", start).withColumn("run", F.sum(F.col("start").cast("int")).over(w)).where("row")
    header = F.first(F.trim("line")).over(Window.partitionBy("doc", "run").orderBy("n"))
    return rows.withColumn("header", header).where(~F.col("start") & ~F.col("line").rlike(r"^[\s|:-]+$")).select("doc", "n", F.trim("line").alias("line"), "header")


# The ratio at which the older resolver merges, the one at which a candidate is in the way, and the letters that block.
MERGES_AT, NEAR_AT, BLOCK = 0.96, 0.80, 4


def legacy_resolution(mentions: DataFrame, candidates: DataFrame, aliases: DataFrame) -> DataFrame:
    """mentions (mention, normalized, kind), candidates (id, normalized, kind), aliases (id, normalized): mention, state, id, n_near and similarity, as the older resolver decides.

    Within a kind: EXACT if one candidate has the name; else ALIAS if one has it for an alias; else, of those that share the first four letters, MERGED if the best
    ratio is MERGES_AT and no other reaches NEAR_AT; AMBIGUOUS if there is one at all, and UNRESOLVED if not.  similarity is null below NEAR_AT, which needs no ratio.
    """
    rows = mentions.select("mention", "normalized", "kind").distinct()
    candidates = candidates.select("id", "normalized", "kind").distinct()
    found = lambda frame: rows.join(frame, ["normalized", "kind"]).groupBy("mention", "kind").agg(F.countDistinct("id").alias("n"), F.min("id").alias("id")).where("n = 1").drop("n")
    exact = found(candidates)
    alias = found(aliases.select("id", "normalized").join(candidates.select("id", "kind"), "id").distinct()).join(exact, ["mention", "kind"], "left_anti")
    rest = rows.join(exact.unionByName(alias), ["mention", "kind"], "left_anti").withColumn("block", F.left("normalized", F.lit(BLOCK)))
    blocks = candidates.withColumn("block", F.left("normalized", F.lit(BLOCK)))
    named = lambda df: df.select(F.struct("kind", "block").alias("kind"), F.col("normalized").alias("name"))
    near = compare.similar_names(named(rest), named(blocks), NEAR_AT).select("kind.kind", F.col("a").alias("normalized"), "b", "ratio")
    close = rest.join(near, ["kind", "normalized"]).join(candidates.select("id", F.col("normalized").alias("b"), "kind"), ["b", "kind"])
    best = close.groupBy("mention", "kind").agg(F.count("*").alias("n_near"), F.max(F.struct("ratio", "id")).alias("x"))
    known = rest.join(blocks.select("kind", "block").distinct().withColumn("blocked", F.lit(True)), ["kind", "block"], "left").join(best, ["mention", "kind"], "left")
    merges = (F.col("x.ratio") >= MERGES_AT) & (F.col("n_near") == 1)
    state = F.when(merges, "MERGED").when(F.col("blocked"), "AMBIGUOUS").otherwise("UNRESOLVED")
    told = lambda df, name: df.select("mention", "kind", F.lit(name).alias("state"), "id", F.lit(1).cast("long").alias("n_near"), F.lit(1.0).alias("similarity"))
    others = known.select("mention", "kind", state.alias("state"), F.when(merges, F.col("x.id")).alias("id"), F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.col("x.ratio").alias("similarity"))
    return told(exact, "EXACT").unionByName(told(alias, "ALIAS")).unionByName(others)


def undone(merges: DataFrame, undo: DataFrame) -> DataFrame:
    """merges (merged, survivor) without those undone (merged), and the decision that each undo leaves."""
    kept = merges.join(undo.select("merged"), "merged", "left_anti").select("merged", "survivor", F.lit("MERGED").alias("decision"))
    return kept.unionByName(merges.join(undo.select("merged"), "merged", "left_semi").select("merged", "survivor", F.lit("DIFFERENT").alias("decision")))


def validation_outcome(state: Column, confidence: Column, evidence: Column, known_type: Column) -> Column:
    """What the build does with a pending fact: it rejects unknown types and facts without evidence, and keeps the rest pending."""
    return F.when(state != "PENDING", state).when(~known_type | (evidence == 0) | (confidence <= 0), "REJECTED").otherwise("PENDING")


def display(confidence: Column, extraction: Column, state: Column) -> Column:
    """The confidence (double) has two digits; halves of the double, not of its three digits, go up."""
    return F.concat_ws(" · ", F.concat(F.lit("Confidence "), F.format_number(F.floor(confidence * 100 + 0.5) / 100, 2)), extraction, state)


def excerpt_of(text: Column, tokens: int) -> Column:
    """Leading lines of a text up to a number of tokens, at least one."""
    lines = F.split(text, "\n")
    cost = F.transform(lines, X.estimate_tokens)
    keep = F.aggregate(cost, F.struct(F.lit(0).alias("n"), F.lit(0).alias("used"), F.lit(False).alias("full")), lambda a, c: F.when(a["full"] | ((a["n"] > 0) & (a["used"] + c > tokens)), F.struct(a["n"].alias("n"), a["used"].alias("used"), F.lit(True).alias("full"))).otherwise(F.struct((a["n"] + 1).alias("n"), (a["used"] + c).alias("used"), (a["used"] + c >= tokens).alias("full"))), lambda a: a["n"])
    return F.array_join(F.slice(lines, 1, keep), "\n")


def graph_facts(arrivals: DataFrame, evidence: DataFrame, most: int = MAX_FACTS, per_root: int = EDGES_PER_ROOT) -> DataFrame:
    """arrivals of graph.reach (with turn: the order of the roots) to facts: the first per_root edges of each root by depth, type and id; an edge counts for its first root.

    evidence (id, chunk_id, rank): facts without a citation are left out.  Of the rest the first ``most``: root, id, depth, type, citation.
    """
    once = arrivals.groupBy("turn", "root", "id", "type").agg(F.min("depth").alias("depth"))
    near = once.withColumn("n", F.expr("row_number() over (partition by turn, root order by depth, type, id)")).where(F.col("n") <= per_root)
    own = near.groupBy("id").agg(F.min(F.struct("turn", "root", "depth", "type")).alias("x")).select("id", "x.*")
    cited = evidence.join(own.select("id"), "id", "left_semi").groupBy("id").agg(F.min_by("chunk_id", F.struct("rank", "chunk_id")).alias("citation"))
    return own.join(cited, "id").orderBy("turn", "depth", "type", "id").limit(most).select("root", "id", "depth", "type", "citation")


def fact_claims(facts: DataFrame, sources: DataFrame, most: int = FACT_CLAIMS) -> DataFrame:
    """facts (root, place, id, source_name, type, target_name, depth, extraction) with the passage that each cites (sources: id, chunk_id, text), as claims.

    Of each root the first ``most``; a claim stands only if its passage names both ends.
    """
    first = facts.where(F.col("place") <= most).join(sources, "id")
    names = lambda c: F.contains(X.normalize_name(F.col("text")), X.normalize_name(F.col(c)))
    hop = F.when(F.col("depth") > 1, F.concat(F.lit(" ("), F.col("depth").cast("string"), F.lit(" hops from the question's entity)"))).otherwise(F.lit(""))
    said = F.concat(F.concat_ws(" ", "source_name", "type", "target_name"), hop)
    return first.where(names("source_name") & names("target_name")).select("root", "id", said.alias("claim"), "chunk_id", F.when(F.col("extraction") == "EXPLICIT", "EXPLICIT").otherwise("INFERRED").alias("extraction"))


def composed(claims: DataFrame, questions: DataFrame) -> DataFrame:
    """questions (question, n_facts, graph_only, rounds) with claims (question, supported, support, inferred, role) as answers: status, mode, groundedness, limitations.

    A question without a supported claim has no answer and a groundedness of 0.
    """
    supported = F.col("supported")
    counts = claims.groupBy("question").agg(
        F.count(F.when(supported, 1)).alias("kept"), F.count(F.when(~supported, 1)).alias("dropped"), F.avg(F.when(supported, F.col("support"))).alias("mean"),
        F.coalesce(F.bool_or(supported & F.col("inferred")), F.lit(False)).alias("inferred"), F.coalesce(F.bool_or(supported & F.col("role").isin("PARENT_LEAD", "NEIGHBOR")), F.lit(False)).alias("around"),
    )
    rows = questions.join(counts, "question", "left").na.fill(0, ["kept", "dropped"])
    able = F.col("kept") > 0
    mode = F.when(F.col("graph_only"), "GRAPH").when(F.col("n_facts") > 0, "HYBRID").otherwise("SOURCE")
    limits = F.array_compact(F.array(
        F.lit("retrieved passages only"), F.when(F.col("dropped") > 0, F.concat(F.col("dropped").cast("string"), F.lit(" statement(s) removed"))), F.when(F.col("inferred"), "inferred statements need review"),
        F.when(F.col("rounds") > 1, "rephrased queries"), F.when(F.col("around"), "parent or neighbouring context"),
    ))
    none = F.when(F.col("graph_only"), "no facts about a named entity").otherwise("nothing relevant was retrieved")
    # Whole hundredths of the double itself: a round to two places would first write it in decimals, and so lift 0.285, which is less than that, to 0.29.
    grounded = F.round(F.col("kept") / (F.col("kept") + F.col("dropped")) * F.col("mean") * 100) / 100
    return rows.select("question", F.when(able, "GROUNDED").otherwise("INSUFFICIENT_EVIDENCE").alias("status"), mode.alias("mode"), F.when(able, grounded).otherwise(F.lit(0.0)).alias("groundedness"), F.array_join(F.when(able, limits).otherwise(F.array(none)), "; ").alias("limitations"))


def statement_units(lines: DataFrame) -> DataFrame:
    """lines (doc, n, line) as single statements (doc, n, k, statement, context): sentences, list items, and table rows with their header as context; headers and separators are none."""
    rows = table_rows(lines).select("doc", "n", F.lit(1).alias("k"), F.col("line").alias("statement"), F.col("header").alias("context"))
    said = X.sentences(F.col("line"))
    prose = lines.where(~F.trim("line").startswith("|") & (F.trim("line") != "")).select("doc", "n", F.posexplode(F.when(F.size(said) > 0, said).otherwise(F.array(F.trim("line")))).alias("k", "statement"))
    return rows.unionByName(prose.select("doc", "n", (F.col("k") + 1).alias("k"), "statement", F.lit("").alias("context")))
