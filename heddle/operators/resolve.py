"""Entity resolution: blocking, guards, scores and constrained clustering."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.functions import fuzzy
from heddle.functions import text as X
from heddle.functions.vectors import cosine_distance
from heddle.operators.graph import settled


def type_group(entity_type: Column) -> Column:
    return F.when(entity_type == "SOFTWARE_COMPONENT", "COMPONENT").otherwise(entity_type)


def blocking_keys(name: Column, entity_type: Column) -> Column:
    core = X.core_tokens(name)
    normalized, initials = X.normalize_name(name), X.acronym(name)
    marked = lambda mark, c, when: F.when(when, F.concat(F.lit(mark), c))
    words = F.transform(F.filter(core, lambda t: F.length(t) >= 4), lambda t: F.concat(F.lit("w:"), t))
    single = F.array_compact(F.array(marked("n:", normalized, normalized != ""), marked("t:", F.array_join(F.array_sort(core), "-"), F.size(core) > 0), marked("a:", initials, initials.isNotNull()), marked("a:", normalized, X.looks_like_acronym(name))))
    keys = F.array_distinct(F.concat(single, words))
    return F.when(normalized == "", F.array().cast("array<string>")).otherwise(F.transform(keys, lambda k: F.concat(type_group(entity_type), F.lit("|"), k)))


def candidate_pairs(names: DataFrame, max_block: int = 40) -> DataFrame:
    """names (id, name, entity_type; several per id allowed): pairs a < b that share a block, with the keys they share.

    Blocks with more than max_block members say too little and are skipped, before anything is joined; skipped_blocks lists them.
    """
    keyed = names.select("id", F.explode(blocking_keys(F.col("name"), F.col("entity_type"))).alias("key")).distinct()
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n").between(2, max_block)).select("key")
    kept = keyed.join(sizes, "key")
    other = kept.select("key", F.col("id").alias("b"))
    pairs = kept.withColumnRenamed("id", "a").join(other, "key").where("a < b")
    return pairs.groupBy("a", "b").agg(F.array_join(F.array_sort(F.collect_list(F.element_at(F.split("key", r"\|", 2), 2))), ",").alias("keys"))


def skipped_blocks(names: DataFrame, max_block: int = 40) -> DataFrame:
    """key and n (members) of the blocks that candidate_pairs leaves out for their size."""
    keyed = names.select("id", F.explode(blocking_keys(F.col("name"), F.col("entity_type"))).alias("key")).distinct()
    return keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > max_block)


def pair_key(a: Column, b: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.least(a, b), F.greatest(a, b)), 256)


def guard(pairs: DataFrame, must_not_link: list[str] | None = None) -> Column:
    """Why a pair (entity_type_, state_, name_, normalized_ with suffixes a and b) may not be merged, or null; the first reason counts."""
    c = lambda x, s: F.col(f"{x}_{s}")
    reviewed = lambda s: c("state", s).isin("HUMAN_VERIFIED", "CORRECTED")
    forbidden = F.lit(False) if not must_not_link else pair_key(F.col("a"), F.col("b")).isin(must_not_link)
    return (
        F.when(type_group(c("entity_type", "a")) != type_group(c("entity_type", "b")), F.concat(F.lit("different entity types ("), c("entity_type", "a"), F.lit(" / "), c("entity_type", "b"), F.lit(")")))
        .when(forbidden, "recorded as different entities")
        .when(reviewed("a") & reviewed("b"), "both entities were reviewed")
        .when(c("normalized", "a") == c("normalized", "b"), F.lit(None).cast("string"))
        .when(X.number_tokens(c("name", "a")) != X.number_tokens(c("name", "b")), "version or index numbers differ")
        .when(X.opposite_qualifier(c("name", "a"), c("name", "b")), "names differ by opposite qualifiers")
    )


def scored(pairs: DataFrame) -> DataFrame:
    """pairs with name_ and normalized_ of a and b: similarity, decisive (EXACT_NAME or null) and reason.

    The character ratio is the one Python step; it sees only pairs that no rule decided.
    """
    ta, tb = X.core_tokens(F.col("name_a")), X.core_tokens(F.col("name_b"))
    da, db = F.array_distinct(ta), F.array_distinct(tb)
    both, either = F.size(F.array_intersect(da, db)), F.size(F.array_union(da, db))
    exact = F.col("normalized_a") == F.col("normalized_b")
    ratio = F.when(exact, F.lit(1.0)).otherwise(fuzzy.sequence_ratio(F.when(~exact, F.col("normalized_a")), F.when(~exact, F.col("normalized_b"))))
    extends = ((F.size(da) >= 2) & (F.size(da) < F.size(db)) & (both == F.size(da))) | ((F.size(db) >= 2) & (F.size(db) < F.size(da)) & (both == F.size(db)))
    short = F.coalesce(F.col("normalized_a") == X.acronym(F.col("name_b")), F.lit(False)) | F.coalesce(F.col("normalized_b") == X.acronym(F.col("name_a")), F.lit(False))
    base = 0.6 * F.col("ratio") + 0.4 * F.coalesce(F.try_divide(both.cast("double"), either), F.lit(0.0))
    score = F.least(F.lit(0.99), F.greatest(base, F.when(extends, F.lit(0.75)).otherwise(F.lit(0.0)), F.when(short, F.lit(0.8)).otherwise(F.lit(0.0))))
    out = pairs.withColumn("ratio", ratio)
    reason = F.when(exact, "identical normalized name").when(short & (base < 0.8), "acronym of the other name").when(extends & (base < 0.75), "one name extends the other").otherwise("lexical")
    return out.select(*pairs.columns, F.when(exact, F.lit(1.0)).otherwise(F.bround(score, 3)).alias("similarity"), F.when(exact, "EXACT_NAME").alias("decisive"), reason.alias("reason"))


def survivors(members: DataFrame, group: list[str]) -> DataFrame:
    """Per group the entity that stays: reviewed first, no acronym, most aliases, most evidence, created first, smallest id."""
    rows = members.withColumn("__o", F.struct(
        (~F.col("state").isin("HUMAN_VERIFIED", "CORRECTED")).alias("r"), X.looks_like_acronym(F.col("name")).alias("y"), (-F.coalesce("n_aliases", F.lit(0))).alias("al"), (-F.coalesce("n_evidence", F.lit(0))).alias("ev"), "created_rank", F.col("id").alias("i"),
    ))
    return rows.groupBy(*group).agg(F.min_by("id", "__o").alias("id"))


def cluster(edges: DataFrame, forbidden: DataFrame, in_task: int = 50_000) -> DataFrame:
    """Constrained clustering of edges (component, a, b, priority, similarity, pair_key), taken by priority, falling similarity and pair_key.

    An edge joins the groups of its ends, unless a forbidden pair (component, a, b, reason) would meet.  Components of up to ``in_task`` edges and
    forbidden pairs are walked in tasks, one component in memory at a time; larger ones are done in rounds of joins, so none has to fit a task.
    Gives component, id, grp (smallest member), and rows for refusals (id and grp null; a, b, reason: that of the smallest forbidden pair between the two
    groups as they are at the end).
    """
    order = F.struct("priority", (-F.col("similarity")).alias("s"), "pair_key", "a", "b")
    none = F.lit(None).cast("string")
    taken = edges.select("component", F.lit(True).alias("edge"), "a", "b", none.alias("reason"), order.alias("rank"))
    bans = forbidden.where("a <> b").join(edges.select("component").distinct(), "component", "left_semi")
    rows = settled(taken.unionByName(bans.select("component", F.lit(False).alias("edge"), "a", "b", "reason"), allowMissingColumns=True))
    large = settled(rows.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > in_task).select("component"))
    if not large.limit(1).count():
        return _walked(rows)
    rest = rows.join(large, "component", "left_semi")
    in_rounds = _in_rounds(rest.where("edge").select("component", "a", "b", "rank"), rest.where("not edge").select("component", "a", "b", "reason"))
    return _walked(rows.join(large, "component", "left_anti")).unionByName(in_rounds)


CLUSTERED = "component string, id string, grp string, a string, b string, reason string"


def _walked(rows: DataFrame) -> DataFrame:
    """Edges and forbidden pairs (edge: which of them) of components that each fit a task: one walk over all edges, in the order of rank."""
    rows = rows.withColumn("component", F.col("component").cast("string"))
    rows = rows.repartition("component").sortWithinPartitions("component", "edge", "rank").select("component", "edge", "a", "b", "reason")

    def run(batches):
        name, part = None, []
        for batch in batches:
            done = []
            for row in batch.itertuples(index=False, name=None):
                if row[0] != name:
                    done += _groups(name, part)
                    name, part = row[0], []
                part.append(row[1:])
            yield pd.DataFrame(done, columns=CLUSTERED.replace(" string", "").split(", "), dtype=object)
        yield pd.DataFrame(_groups(name, part), columns=CLUSTERED.replace(" string", "").split(", "), dtype=object)

    return rows.mapInPandas(run, CLUSTERED)


def _groups(component: str | None, rows: list[tuple]) -> list[tuple]:
    """rows (edge, a, b, reason), forbidden pairs first: the groups of one component and the edges that were refused."""
    up: dict[str, str] = {}
    apart: dict[str, set[str]] = {}

    def top(x: str) -> str:
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    refused, ends = [], set()
    for edge, a, b, _ in rows:
        one, other = top(a), top(b)
        if not edge:
            apart.setdefault(one, set()).add(other)
            apart.setdefault(other, set()).add(one)
            continue
        ends |= {a, b}
        if one == other:
            continue
        if other in apart.get(one, ()):
            refused.append((a, b))
            continue
        if len(apart.get(one, ())) < len(apart.get(other, ())):
            one, other = other, one
        up[other] = one
        for third in apart.pop(other, ()):
            apart[third].discard(other)
            apart[third].add(one)
            apart.setdefault(one, set()).add(third)
    least: dict[str, str] = {}
    for x in sorted(ends):
        least.setdefault(top(x), x)
    why: dict[tuple[str, str], tuple] = {}
    for edge, a, b, reason in rows if refused else ():
        for x, y in () if edge else ((a, b), (b, a)):
            key = top(x), top(y)
            why[key] = min(why.get(key, (x, y, reason)), (x, y, reason))
    return [(component, x, least[top(x)], None, None, None) for x in sorted(ends)] + [(component, None, None, a, b, why[top(a), top(b)][2]) for a, b in refused]


def _in_rounds(edges: DataFrame, forbidden: DataFrame) -> DataFrame:
    """Edges (component, a, b, rank) and forbidden pairs in rounds of joins: an edge that is the first of both groups that it touches would be the next to
    touch them in a walk over all edges too, so all such edges join at once, after all edges between groups that may not meet are refused.
    """
    ends = edges.select("component", F.col("a").alias("id")).union(edges.select("component", "b")).distinct()
    members = settled(ends.withColumn("grp", F.col("id")))
    live = settled(edges.where("a <> b").select("component", "a", "b", F.col("a").alias("ga"), F.col("b").alias("gb"), "rank"))
    either = forbidden.select("component", "a", "b", "reason").union(forbidden.select("component", "b", "a", "reason"))
    bans = settled(either.select("component", F.col("a").alias("ga"), F.col("b").alias("gb"), F.struct("a", "b", "reason").alias("why")))
    refused = None
    while True:
        # A ban between two groups stays as they grow, so their edges can be refused at once.
        banned = bans.select("component", "ga", "gb").distinct().withColumn("banned", F.lit(True))
        checked = settled(live.join(banned, ["component", "ga", "gb"], "left").select(*live.columns, "banned"))
        gone = checked.where("banned").select("component", "a", "b")
        refused = gone if refused is None else refused.unionByName(gone)
        rest = checked.where("banned is null").drop("banned")
        touching = rest.select("component", F.col("ga").alias("g"), "rank").union(rest.select("component", "gb", "rank")).groupBy("component", "g").agg(F.min("rank").alias("rank"))
        first = touching.groupBy("component", "rank").agg(F.count("*").alias("n")).where("n = 2").select("component", "rank")
        into = settled(rest.join(first, ["component", "rank"]).select("component", F.greatest("ga", "gb").alias("g"), F.least("ga", "gb").alias("to")))
        if not into.limit(1).count():
            break

        def moved(rows: DataFrame, c: str, into: DataFrame = into) -> DataFrame:
            names = rows.columns
            return rows.join(into.withColumnRenamed("g", c), ["component", c], "left").withColumn(c, F.coalesce("to", c)).select(*names)

        live = moved(moved(rest, "ga"), "gb").where("ga <> gb")
        bans = settled(moved(moved(bans, "ga"), "gb"))
        members = settled(moved(members, "grp"))
    none = F.lit(None).cast("string")
    why = bans.groupBy("component", "ga", "gb").agg(F.min("why")["reason"].alias("reason"))
    for s in "ab":
        refused = refused.join(members.select("component", F.col("id").alias(s), F.col("grp").alias(f"g{s}")), ["component", s])
    refused = refused.join(why, ["component", "ga", "gb"])
    component = F.col("component").cast("string").alias("component")
    out = members.select(component, "id", "grp", none.alias("a"), none.alias("b"), none.alias("reason"))
    return out.unionByName(refused.select(component, none.alias("id"), none.alias("grp"), "a", "b", "reason"))


def with_vectors(rated: DataFrame, vectors: DataFrame) -> DataFrame:
    """rated pairs (a, b, similarity, decisive) with vectors (id, embedding): the similarity is the mean of the lexical one and the cosine where both have vectors of one width; decisive pairs stay."""
    out = rated
    for s in "ab":
        out = out.join(vectors.select(F.col("id").alias(s), F.col("embedding").alias(f"v_{s}")), s, "left")
    cosine = 1 - cosine_distance(F.col("v_a"), F.col("v_b"))
    usable = F.col("decisive").isNull() & (F.size("v_a") == F.size("v_b")) & F.exists("v_a", lambda x: x != 0) & F.exists("v_b", lambda x: x != 0)
    return out.select(*(F.when(usable, (F.col("similarity") + cosine) / 2).otherwise(F.col("similarity")).alias(c) if c == "similarity" else c for c in rated.columns))


def from_cache(pairs: DataFrame, known: DataFrame, budget: int = 200, least: float = 0.85) -> DataFrame:
    """pairs (pair_key, fingerprint, similarity) with known decisions (pair_key, fingerprint, decision, confidence): a decision holds while the fingerprint is the same.

    A known SAME needs a confidence of ``least``, else it is UNSURE.  Of pairs without a decision the first ``budget`` by falling similarity and pair_key are to be judged, the rest deferred.
    """
    same = F.when((F.col("decision") == "SAME") & (F.col("confidence") < least), "UNSURE").otherwise(F.col("decision"))
    found = pairs.join(known.withColumnRenamed("fingerprint", "seen"), "pair_key", "left").withColumn("decision", F.when(F.col("seen") == F.col("fingerprint"), same))
    open_ = found.where("decision is null").orderBy(F.desc("similarity"), "pair_key").limit(budget).select("pair_key", F.lit("JUDGE").alias("turn"))
    return found.join(open_, "pair_key", "left").select("pair_key", F.coalesce("decision", "turn", F.lit("DEFERRED")).alias("outcome"))
