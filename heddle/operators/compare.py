"""Comparison of two versions: metadata, sections, statements, entities and relationships."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.functions import fuzzy
from heddle.operators.graph import settled
from heddle.operators.resolve import type_group

# Fixed values.
PAIRING, SECTION_FUZZY, RENAME = 0.5, 0.85, 0.80
# Pairs of statements that are compared at a time, common letters that are counted at a time, and section pairs that a task looks at together.
PAIRS, CELLS, TOGETHER = 1 << 16, 1 << 20, 64
# Pairs, and names of both sides, that are compared in one task without looking for those that may be alike first.
WITHIN = (1 << 22, 1 << 14)


def severity(change: Column) -> Column:
    return F.when(change.isin("REMOVED", "TARGET_CHANGED", "SOURCE_CHANGED"), "HIGH").when(change.isin("TYPE_CHANGED", "RELATIONSHIP_TYPE_CHANGED", "RENAMED"), "MEDIUM").otherwise("INFO")


def metadata_changes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old, new (pair, and a column per key): pair, key, before, after where they differ."""
    rows = old.select("pair", *(F.col(k).alias(f"old_{k}") for k in keys)).join(new.select("pair", *(F.col(k).alias(f"new_{k}") for k in keys)), "pair")
    listed = F.explode(F.array(*(F.struct(F.lit(k).alias("key"), F.col(f"old_{k}").cast("string").alias("before"), F.col(f"new_{k}").cast("string").alias("after")) for k in keys)))
    return rows.select("pair", listed.alias("x")).select("pair", "x.*").where(~F.col("before").eqNullSafe(F.col("after")))


def _zip_rest(old: DataFrame, new: DataFrame, keys: list[str], change: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs the k-th left of old with the k-th of new within keys; gives the pairs and what is left of both."""
    names = ", ".join(keys)
    number = lambda df, c: df.withColumn("k", F.expr(f"row_number() over (partition by {names} order by id)")).select(*keys, "k", F.col("id").alias(c))
    # Written: each step and each way of being left over would else do all steps before anew.
    pairs = settled(number(old, "old_id").join(number(new, "new_id"), [*keys, "k"]).select("old_id", "new_id", F.lit(change).alias("change")))
    left = lambda df, c: settled(df.join(pairs.select(F.col(c).alias("id")), "id", "left_anti"))
    return pairs, left(old, "old_id"), left(new, "new_id")


def relationship_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """old, new (id, source, target, type): old_id, new_id, change, severity.

    What is only on one side is paired by equal source and type, then equal target and type, then equal ends, each time in the order of ids;
    the rest is removed or added.
    """
    old, new = settled(old), settled(new)
    removed, added = settled(old.join(new.select("id"), "id", "left_anti")), settled(new.join(old.select("id"), "id", "left_anti"))
    found = None
    for keys, change in ((["source", "type"], "TARGET_CHANGED"), (["target", "type"], "SOURCE_CHANGED"), (["source", "target"], "RELATIONSHIP_TYPE_CHANGED")):
        pairs, removed, added = _zip_rest(removed, added, keys, change)
        found = pairs if found is None else found.unionByName(pairs)
    none = F.lit(None).cast("string")
    found = found.unionByName(removed.select(F.col("id").alias("old_id"), none.alias("new_id"), F.lit("REMOVED").alias("change"))).unionByName(added.select(none.alias("old_id"), F.col("id").alias("new_id"), F.lit("ADDED").alias("change")))
    return found.withColumn("severity", severity(F.col("change")))


def _numbered(rows: DataFrame, keys: list[str], order: list[str], as_: str) -> DataFrame:
    """rows with their place (from 1) within keys in the given order.  A group may lie in several tasks: each numbers its range, behind those before it."""
    placed = settled(rows.repartitionByRange(*keys, *order).withColumn("part", F.spark_partition_id()))
    names = ", ".join(keys)
    ahead = placed.groupBy(*keys, "part").agg(F.count("*").alias("n")).withColumn("ahead", F.expr(f"coalesce(sum(n) over (partition by {names} order by part rows between unbounded preceding and 1 preceding), 0)")).drop("n")
    turn = F.expr(f"row_number() over (partition by {names}, part order by {', '.join(order)})")
    return placed.withColumn("turn", turn).join(ahead, [*keys, "part"]).select(*rows.columns, (F.col("ahead") + F.col("turn")).alias(as_))


def similar_names(old: DataFrame, new: DataFrame, ratio: float = RENAME, apart: int | None = None) -> DataFrame:
    """old, new (kind, name): kind, a, b, ratio of all distinct pairs with a sequence ratio of ``ratio`` (above 2 / 3) at least; ``apart``: of lengths that differ by no more.

    Such a pair shares at least (1.5 ratio - 1) T - 1 pairs of neighbouring characters (T: summed lengths), since the share 1 - ratio of the characters is unmatched and
    parts the rest into runs.  So of a name's pairs that the other side has, too, the rarest, all but as many as its shortest partner must share, hold one that both have.
    Names of up to three characters meet on single characters too.  Tokens are hashes with their kind, names are numbers, and both are told again before ratios are taken.
    They are joined by merging: their size shows only after the explode, too late for a broadcast.
    """
    sides = old.select("kind", "name", F.lit(True).alias("old")).unionByName(new.select("kind", "name", F.lit(False).alias("old"))).where("name is not null and kind is not null").distinct()
    sides, size = settled(sides.withColumn("id", F.monotonically_increasing_id())), F.length("name")
    pairs = F.when(size > 1, F.transform(F.sequence(F.lit(1), F.greatest(size - 1, F.lit(1))), lambda i: F.substring(F.col("name"), i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    # The k-th time that a pair occurs is a token of its own.
    counted = F.transform("pairs", lambda x, i: F.concat(x, F.size(F.filter(F.slice("pairs", F.lit(1), i + 1), lambda y: y == x)).cast("string")))
    short = F.when(size < 4, F.array_distinct(F.split("name", ""))).otherwise(F.array().cast("array<string>"))
    tokens = sides.withColumn("pairs", pairs).select("id", "old", size.alias("size"), F.explode(F.transform(F.concat(counted, short), lambda t: F.xxhash64("kind", t))).alias("token"))
    often = tokens.groupBy("token").agg(F.count("*").alias("n"), F.bool_or("old").alias("x"), F.bool_and("old").alias("y")).where("x and not y").select("token", "n")
    listed = tokens.join(often.hint("merge"), "token").groupBy("id", "old", "size").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("all"))
    least = F.greatest(F.lit(1), F.ceil(F.col("size") * ((1.5 * ratio - 1) * 2 / (2 - ratio)) - 1 - 1e-9)).cast("int")
    rare = settled(listed.where(F.size("all") >= least).select("id", "old", "size", F.explode(F.slice("all", F.lit(1), F.size("all") - least + 1)).alias("x")).select("id", "old", "size", "x.token"))
    side = lambda which, c: rare.where(F.col("old") == which).select("token", F.col("id").alias(c), F.col("size").alias(f"n_{c}"))
    fits = F.least("n_a", "n_b") * 2 >= (F.col("n_a") + F.col("n_b")) * ratio - 1e-9
    if apart is not None:
        fits = fits & (F.abs(F.col("n_a") - F.col("n_b")) <= apart)
    met = side(True, "a").join(side(False, "b").hint("merge"), "token").where(fits).select("a", "b").distinct()
    told = lambda c: sides.select(F.col("id").alias(c), F.struct("kind", "name").alias(f"{c}_is")).hint("merge")
    met = met.join(told("a"), "a").join(told("b"), "b").where("a_is.kind = b_is.kind").select("a_is.kind", F.col("a_is.name").alias("a"), F.col("b_is.name").alias("b"))
    return met.withColumn("ratio", fuzzy.sequence_ratio("a", "b")).where(F.col("ratio") >= ratio)


def similar_within(old: DataFrame, new: DataFrame, ratio: float) -> DataFrame:
    """similar_names for many kinds of few names: those of a kind are compared in one task, without tokens; kinds of more than WITHIN pairs or names go the other way."""
    sides = old.select("kind", "name", F.lit(True).alias("old")).unionByName(new.select("kind", "name", F.lit(False).alias("old"))).where("name is not null and kind is not null")
    sizes = settled(sides.groupBy("kind").agg(F.count_if("old").alias("n_a"), F.count_if(~F.col("old")).alias("n_b")).where("n_a > 0 and n_b > 0"))
    few = (F.col("n_a") * F.col("n_b") <= WITHIN[0]) & (F.col("n_a") + F.col("n_b") <= WITHIN[1])
    of = lambda kinds: sides.join(kinds.select("kind"), "kind", "left_semi")
    side = lambda which, c: F.collect_set(F.when(F.col("old") == which, F.col("name"))).alias(c)
    listed = of(sizes.where(few)).repartition(8 * old.sparkSession.sparkContext.defaultParallelism, "kind").groupBy("kind").agg(side(True, "a"), side(False, "b"))

    def run(batches):
        for batch in batches:
            some, rows, n = [], [], 0
            for row, a, b in zip(range(len(batch)), *(batch.column(k).to_pylist() for k in (1, 2)), strict=True):
                for at in range(0, len(a), step := max(1, PAIRS // len(b))):
                    x, y = _may_pair(a[at : at + step], b, ratio)
                    if len(x):
                        some.append((a[at : at + step], b, x, y))
                        rows.append(row)
                        n += len(x)
                    if n >= PAIRS:
                        yield told(batch.column(0), rows, some)
                        some, rows, n = [], [], 0
            yield told(batch.column(0), rows, some)

    def told(kinds: pa.Array, rows: list[int], some: list) -> pa.RecordBatch:
        x, y, ratios, _, _ = _ratios(some, ratio)
        near = np.flatnonzero(ratios >= ratio)
        at = np.repeat(np.array(rows, dtype=np.int64), [len(b[2]) for b in some])[near]
        names = ([t for b in some for t in b[k]] for k in (0, 1))
        a, b = (pa.array([side[n] for n in which[near].tolist()], pa.string()) for side, which in zip(names, (x, y), strict=True))
        return pa.RecordBatch.from_arrays([kinds.take(pa.array(at)), a, b, pa.array(ratios[near])], names=["kind", "a", "b", "ratio"])

    near = listed.mapInArrow(run, f"kind {old.schema['kind'].dataType.simpleString()}, a string, b string, ratio double")
    if not sizes.where(~few).limit(1).count():
        return near
    rest = of(sizes.where(~few))
    return near.unionByName(similar_names(rest.where("old"), rest.where("not old"), ratio))


def renames(old: DataFrame, new: DataFrame) -> DataFrame:
    """old, new (kind, id, name, normalized): old_id, new_id.  In the order of name and id each old one takes the most similar new one of its kind that is left, the first of equals.

    Entities of one name are alike, so names share out their members: each name asks, by falling ratio, for as many as it still lacks, and of another name gets what
    earlier names have left.  Shares only fall from round to round, and when none does they are those of taking turns.
    """
    sizes = lambda df, c: df.groupBy("kind", "name", "normalized").agg(F.count("*").alias(f"n_{c}")).toDF("kind", c, f"norm_{c}", f"n_{c}")
    ratios = similar_names(*(df.select("kind", F.col("normalized").alias("name")) for df in (old, new))).toDF("kind", "norm_a", "norm_b", "ratio")
    edges = ratios.join(sizes(old, "a"), ["kind", "norm_a"]).join(sizes(new, "b"), ["kind", "norm_b"]).select("kind", "a", "b", "n_a", "n_b", "ratio", F.col("n_b").alias("share"))
    edges = settled(edges)
    while True:
        before = F.expr("coalesce(sum(share) over (partition by kind, a order by ratio desc, b rows between unbounded preceding and 1 preceding), 0)")
        asked = edges.withColumn("from_a", before).withColumn("take", F.greatest(F.lit(0), F.least("share", F.col("n_a") - F.col("from_a"))))
        taken = F.expr("coalesce(sum(take) over (partition by kind, b order by a rows between unbounded preceding and 1 preceding), 0)")
        asked = asked.withColumn("from_b", taken).withColumn("next", F.least("share", F.greatest(F.lit(0), F.col("n_b") - F.col("from_b"))))
        asked = settled(asked)
        if not asked.where("next < share").limit(1).count():
            break
        edges = asked.withColumn("share", F.col("next")).select(*edges.columns)
    shares = asked.where("take > 0").select("kind", "a", "b", "take", "from_a", "from_b")
    left = _numbered(old.select("kind", F.col("name").alias("a"), F.col("id").alias("old_id")), ["kind", "a"], ["old_id"], "k")
    right = _numbered(new.select("kind", F.col("name").alias("b"), F.col("id").alias("new_id")), ["kind", "b"], ["new_id"], "m")
    placed = left.join(shares, ["kind", "a"]).where((F.col("k") > F.col("from_a")) & (F.col("k") <= F.col("from_a") + F.col("take")))
    return placed.withColumn("m", F.col("k") - F.col("from_a") + F.col("from_b")).join(right, ["kind", "b", "m"]).select("old_id", "new_id")


def entity_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """old, new (id, name, normalized, entity_type): type changes by equal name, renames by similar name within a kind, else removed or added."""
    ids = lambda df: df.select(F.col("id").alias("other"))
    removed, added = (a.join(ids(b), F.col("id") == F.col("other"), "left_anti") for a, b in ((old, new), (new, old)))
    number = lambda df, c: df.withColumn("k", F.expr("row_number() over (partition by normalized order by name, id)")).select("normalized", "k", F.col("id").alias(c), F.col("entity_type").alias(f"{c}_type"))
    typed = number(removed, "old_id").join(number(added, "new_id"), ["normalized", "k"]).where("old_id_type <> new_id_type").select("old_id", "new_id", F.lit("TYPE_CHANGED").alias("change"))
    typed = settled(typed)
    left = lambda df, pairs, c: df.join(pairs.select(F.col(c).alias("other")), F.col("id") == F.col("other"), "left_anti")
    removed, added = settled(left(removed, typed, "old_id")), settled(left(added, typed, "new_id"))
    grouped = lambda df: df.select(F.coalesce(type_group(F.col("entity_type")), F.lit("")).alias("kind"), "id", "name", "normalized")
    renamed = settled(renames(grouped(removed), grouped(added)).withColumn("change", F.lit("RENAMED")))
    removed, added = left(removed, renamed, "old_id"), left(added, renamed, "new_id")
    none = F.lit(None).cast("string")
    out = typed.unionByName(renamed).unionByName(removed.select(F.col("id").alias("old_id"), none.alias("new_id"), F.lit("REMOVED").alias("change"))).unionByName(added.select(none.alias("old_id"), F.col("id").alias("new_id"), F.lit("ADDED").alias("change")))
    return out.withColumn("severity", severity(F.col("change")))


def _rest(rows: DataFrame, pairs: DataFrame, side: str) -> DataFrame:
    return rows.join(pairs.select("pair", F.col(side).alias("ordinal")), ["pair", "ordinal"], "left_anti")


def pair_sections_by_key(old: DataFrame, new: DataFrame) -> DataFrame:
    """old, new (pair, key, ordinal): sections of equal key, the k-th with the k-th; then those whose key is unique on both sides by its last part."""
    number = lambda df, c: df.withColumn("k", F.expr("row_number() over (partition by pair, key order by ordinal)")).select("pair", "key", "k", F.col("ordinal").alias(c))
    same = number(old, "old").join(number(new, "new"), ["pair", "key", "k"]).select("pair", "old", "new", F.lit("SAME_PATH").alias("how"))

    def unique(df: DataFrame, c: str) -> DataFrame:
        left = _rest(df, same, c).withColumn("last", F.element_at(F.split("key", " > "), -1))
        return left.withColumn("n", F.expr("count(*) over (partition by pair, last)")).where("n = 1").select("pair", "last", F.col("ordinal").alias(c))

    return same.unionByName(unique(old, "old").join(unique(new, "new"), ["pair", "last"]).select("pair", "old", "new", F.lit("SAME_HEADING").alias("how")))


def extended_headings(old: DataFrame, new: DataFrame) -> DataFrame:
    """(pair, old, new) of sections under one parent of which one's last heading has all words of the other's.

    The smaller set's rarest word stands in the larger, so each side's rarest words meet all words of the other.
    """
    def side(rows: DataFrame) -> DataFrame:
        parts = F.split("key", " > ")
        parent = F.array_join(F.slice(parts, 1, F.size(parts) - 1), " > ")
        words = F.array_distinct(F.array_remove(F.split(F.element_at(parts, -1), r"\s+"), ""))
        return rows.select("pair", parent.alias("parent"), "ordinal", words.alias("words")).where(F.size("words") > 0)

    left, right = side(old), side(new)
    # Under a parent that one side alone has nothing meets.
    parents = [rows.select("pair", "parent").distinct() for rows in (left, right)]
    both_have = settled(parents[0].join(parents[1], ["pair", "parent"]))
    left, right = (settled(rows.join(both_have, ["pair", "parent"], "left_semi")) for rows in (left, right))
    spread = lambda df: df.select("pair", "parent", "ordinal", F.explode("words").alias("word"))
    often = spread(left).unionByName(spread(right)).groupBy("pair", "parent", "word").agg(F.count("*").alias("n"))
    rarest = lambda df: spread(df).join(often, ["pair", "parent", "word"]).groupBy("pair", "parent", "ordinal").agg(F.min_by("word", F.struct("n", "word")).alias("word"))
    at = ["pair", "parent", "word"]
    a, b = (lambda df: df.withColumnRenamed("ordinal", "old")), (lambda df: df.withColumnRenamed("ordinal", "new"))
    met = a(rarest(left)).join(b(spread(right)), at).unionByName(a(spread(left)).join(b(rarest(right)), at)).select("pair", "old", "new").distinct()
    both = met.join(a(left).select("pair", "old", F.col("words").alias("x")), ["pair", "old"]).join(b(right).select("pair", "new", F.col("words").alias("y")), ["pair", "new"])
    return both.where((F.size(F.array_except("x", "y")) == 0) | (F.size(F.array_except("y", "x")) == 0)).select("pair", "old", "new")


def take_turns(edges: DataFrame, best: bool) -> DataFrame:
    """(pair, old, new) taken from edges (pair, old, new, ratio), as if the old ones took turns in their order.

    In its turn an old one takes its only new one that is left, if no other old one is left for that; with ``best`` its most similar one (the first of equals),
    if it is the most similar left (the first of equals) to that.  Who takes nothing stays in the way of others.  In a round all decide at once that have no undecided
    one before them at any of their new ones, so rounds are as many as the longest chain of such neighbours, not as the sections.
    """
    edges, taken = settled(edges.withColumn("decided", F.lit(False))), None
    at_old, at_new = Window.partitionBy("pair", "old"), Window.partitionBy("pair", "new")
    while edges.where("not decided").limit(1).count():
        rows = edges.withColumn("first", F.min(F.when(~F.col("decided"), F.col("old"))).over(at_new))
        rows = rows.withColumn("turn", ~F.col("decided") & (F.min("first").over(at_old) == F.col("old")))
        if best:
            mine = F.max_by("new", F.struct("ratio", (-F.col("new")).alias("o"))).over(at_old) == F.col("new")
            theirs = F.max_by("old", F.struct("ratio", (-F.col("old")).alias("o"))).over(at_new) == F.col("old")
        else:
            mine, theirs = F.count("*").over(at_old) == 1, F.count("*").over(at_new) == 1
        rows = settled(rows.withColumn("takes", F.col("turn") & mine & theirs))
        now = settled(rows.where("takes").select("pair", "old", "new"))
        taken = now if taken is None else taken.unionByName(now)
        left = rows.join(now.select("pair", "old"), ["pair", "old"], "left_anti").join(now.select("pair", "new"), ["pair", "new"], "left_anti")
        edges = settled(left.withColumn("decided", F.col("decided") | F.col("turn")).select(*edges.columns))
    return edges.select("pair", "old", "new") if taken is None else taken


def pair_sections(old: DataFrame, new: DataFrame) -> DataFrame:
    """old, new (pair, key, ordinal): pair, old, new and how: SAME_PATH, SAME_HEADING, EXTENDED or RENAMED, each among what the ways before it leave.

    A key's parts are joined by ' > '.  EXTENDED: under one parent, a heading with all words of the other's; RENAMED: the most similar to each other, by a ratio of SECTION_FUZZY at least.
    """
    old, new = settled(old), settled(new)
    pairs = settled(pair_sections_by_key(old, new))
    left, right = settled(_rest(old, pairs, "old")), settled(_rest(new, pairs, "new"))
    extended = take_turns(extended_headings(left, right).withColumn("ratio", F.lit(1.0)), best=False)
    left, right = settled(_rest(left, extended, "old")), settled(_rest(right, extended, "new"))
    flat = lambda df, c, name: df.select(F.col("pair").alias("kind"), F.col("ordinal").alias(c), F.replace("key", F.lit(" > "), F.lit(" ")).alias(name))
    a, b = flat(left, "old", "a"), flat(right, "new", "b")
    near = similar_within(a.select("kind", F.col("a").alias("name")), b.select("kind", F.col("b").alias("name")), SECTION_FUZZY)
    edges = near.join(a, ["kind", "a"]).join(b, ["kind", "b"]).select(F.col("kind").alias("pair"), "old", "new", "ratio")
    renamed = take_turns(edges, best=True)
    how = lambda df, name: df.select("pair", "old", "new", F.lit(name).alias("how"))
    return pairs.unionByName(how(extended, "EXTENDED")).unionByName(how(renamed, "RENAMED"))


def most_similar(blocks: list[tuple[list[str], list[str]]]) -> list[dict[str, list[int]]]:
    """Of each block (asked, texts): per asked one the texts with a ratio of PAIRING at least, the best last, of equals the first.

    Common letters bound a ratio, so only pairs whose bound reaches PAIRING are compared, those of blocks with up to about PAIRS of them together.
    """
    out, some, owners, n = [{} for _ in blocks], [], [], 0

    def done() -> None:
        for owner, near in zip(owners, _compared(some), strict=True):
            out[owner] |= near

    for owner, (asked, texts) in enumerate(blocks):
        asked = list(dict.fromkeys(asked))
        for at in range(0, len(asked), step := max(1, PAIRS // max(1, len(texts)))):
            some.append((asked[at : at + step], texts, *_may_pair(asked[at : at + step], texts, PAIRING)))
            owners.append(owner)
            n += len(some[-1][2])
            if n >= PAIRS:
                done()
                some, owners, n = [], [], 0
    done()
    return out


def _may_pair(asked: list[str], texts: list[str], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of asked ones and texts whose common letters let their ratio reach ``least``."""
    sizes = np.array([len(t) for t in [*asked, *texts]], dtype=np.int64)
    letters, codes = np.unique(np.frombuffer("".join([*asked, *texts]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), return_inverse=True)
    bags = np.bincount(np.repeat(np.arange(len(sizes)), sizes) * len(letters) + codes, minlength=len(sizes) * len(letters)).astype(np.int32).reshape(len(sizes), -1)
    x, y, left, right = [], [], bags[: len(asked)], bags[len(asked) :]
    for n in range(0, len(asked), step := max(1, CELLS // max(1, right.size))):
        total = sizes[n : min(n + step, len(asked)), None] + sizes[len(asked) :]
        common = np.minimum(left[n : n + step, None], right).sum(axis=2)
        i, j = np.nonzero(np.where(total > 0, 2.0 * common / np.maximum(total, 1), 1.0) >= least)
        x.append(i + n)
        y.append(j)
    return (np.concatenate(x), np.concatenate(y)) if x else (np.zeros(0, dtype=np.int64),) * 2


def _ratios(blocks: list[tuple[list[str], list[str], np.ndarray, np.ndarray]], least: float) -> tuple[np.ndarray, ...]:
    """Of blocks (asked, texts, and places of both that may pair): places among those of all blocks, their ratios as of sequence_ratios, and where each block's begin."""
    before, behind = (np.cumsum([0, *(len(b[k]) for b in blocks)]) for k in (0, 1))
    x, y = (np.concatenate([b[k] + at for b, at in zip(blocks, first, strict=False)] or [np.zeros(0, dtype=np.int64)]) for k, first in ((2, before), (3, behind)))
    return x, y, fuzzy.sequence_ratios([t for b in blocks for t in b[0]], [t for b in blocks for t in b[1]], x, y, least), before, behind


def _compared(blocks: list[tuple[list[str], list[str], np.ndarray, np.ndarray]]) -> list[dict[str, list[int]]]:
    x, y, ratios, before, behind = _ratios(blocks, PAIRING)
    near = np.flatnonzero(ratios >= PAIRING)
    near = near[np.lexsort((-y[near], ratios[near], x[near]))]
    bounds = np.searchsorted(x[near], np.arange(before[-1] + 1))
    return [{text: (y[near[bounds[at + n] : bounds[at + n + 1]]] - ahead).tolist() for n, text in enumerate(b[0])} for b, at, ahead in zip(blocks, before, behind, strict=False)]


class Candidates:
    """Statements of which the most similar to another is taken, the first of equals, if its ratio is PAIRING at least.  near: as of most_similar, for statements that are asked for."""

    def __init__(self, texts: list[str], near: dict[str, list[int]] | None = None):
        self.texts, self.free, self.near = list(texts), np.ones(len(texts), dtype=bool), near or {}

    def take(self, before: str) -> str | None:
        if before not in self.near:
            self.near |= most_similar([([before], self.texts)])[0]
        near = self.near[before]
        while near and not self.free[near[-1]]:
            near.pop()
        if not near:
            return None
        at = near.pop()
        self.free[at] = False
        return self.texts[at]

    def left(self) -> list[str]:
        return [t for t, free in zip(self.texts, self.free, strict=True) if free]


def diff_statements(old: list[str], new: list[str], values) -> list[tuple[str, str | None, str | None]]:
    """(change, before, after) of two lists of statements: CHANGED (other values), REWORDED, REMOVED, ADDED.

    values: the numbers of a statement.
    """
    return diffs_of_statements([(old, new)], values)[0]


def diffs_of_statements(pairs: list[tuple[list[str], list[str]]], values) -> list[list[tuple[str, str | None, str | None]]]:
    """diff_statements of each pair; the statements of all are compared together."""
    blocks = [(n, old[i:j], new[k:m]) for n, (old, new) in enumerate(pairs) for tag, i, j, k, m in SequenceMatcher(None, old, new, autojunk=False).get_opcodes() if tag != "equal"]
    out = [[] for _ in pairs]
    for (n, asked, texts), near in zip(blocks, most_similar([b[1:] for b in blocks]), strict=True):
        rest = Candidates(texts, near)
        for before in asked:
            after = rest.take(before)
            if after is not None:
                out[n].append(("REWORDED" if values(before) == values(after) else "CHANGED", before, after))
            else:
                out[n].append(("REMOVED", before, None))
        out[n] += [("ADDED", None, after) for after in rest.left()]
    return out


def statement_changes(pairs: DataFrame) -> DataFrame:
    """pairs (pair, old, new: arrays of statements): pair, change, before, after.  A section pair is one task's work at most."""
    import re

    from heddle.functions.text import VALUE

    find = re.compile(VALUE).findall

    def run(batches):
        for part in batches:
            for n in range(0, len(part), TOGETHER):
                some = part.iloc[n : n + TOGETHER]
                found = diffs_of_statements([(list(a), list(b)) for a, b in zip(some["old"], some["new"], strict=True)], lambda s: [" ".join(v.lower().split()) for v in find(s)])
                yield pd.DataFrame([(p, *x) for p, rows in zip(some["pair"], found, strict=True) for x in rows], columns=["pair", "change", "before", "after"])

    return pairs.select("pair", "old", "new").mapInPandas(run, f"pair {pairs.schema['pair'].dataType.simpleString()}, change string, before string, after string")


def line_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """old, new (pair, line): added and removed lines with their numbers, as multisets."""
    count = lambda df, c: df.groupBy("pair", "line").agg(F.count("*").alias(c))
    both = count(old, "n_old").join(count(new, "n_new"), ["pair", "line"], "full_outer").na.fill(0, ["n_old", "n_new"])
    return both.where("n_old <> n_new").select("pair", F.when(F.col("n_old") > F.col("n_new"), "REMOVED").otherwise("ADDED").alias("change"), "line", F.abs(F.col("n_old") - F.col("n_new")).alias("n"))


def section_findings(changes: DataFrame) -> DataFrame:
    """changes (pair, change, n) of paired sections, a finding per pair that has any: severity and summary.  Lost or changed statements weigh more than new ones."""
    said = {"CHANGED": "value change(s)", "REMOVED": "statement(s) removed", "ADDED": "statement(s) added", "REWORDED": "reworded"}
    counts = changes.groupBy("pair").agg(*(F.coalesce(F.sum(F.when(F.col("change") == k, F.col("n"))), F.lit(0)).alias(k) for k in said))
    parts = F.array_compact(F.array(*(F.when(F.col(k) > 0, F.concat(F.col(k).cast("string"), F.lit(f" {what}"))) for k, what in said.items())))
    return counts.select("pair", F.lit("MODIFIED").alias("classification"), F.when((F.col("CHANGED") > 0) | (F.col("REMOVED") > 0), "MEDIUM").otherwise("LOW").alias("severity"), F.array_join(parts, ", ").alias("summary"))


def analysed(findings: DataFrame, attempts: int = 40, enough: int = 10) -> DataFrame:
    """findings (scope, severity, summary, n_impacts) whose impacts are looked at: relationships first, then by severity and summary, until ``enough`` have any or ``attempts`` are made."""
    order = [F.when(F.col("scope") == "RELATIONSHIP", 0).otherwise(1), F.when(F.col("severity") == "HIGH", 0).when(F.col("severity") == "MEDIUM", 1).when(F.col("severity") == "LOW", 2).otherwise(3), F.col("summary")]
    # At most ``attempts`` rows are left for the windows over all of them.
    first = findings.withColumn("o", F.struct(*(c.alias(f"o{k}") for k, c in enumerate(order)))).orderBy("o").limit(attempts)
    before = F.expr("coalesce(sum(if(n_impacts > 0, 1, 0)) over (order by o rows between unbounded preceding and 1 preceding), 0)")
    return first.withColumn("attempt", F.expr("row_number() over (order by o)")).withColumn("before", before).where(F.col("before") < enough).select("attempt", "scope", "severity", "summary", "n_impacts")
