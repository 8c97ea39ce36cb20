"""Graph operators as unrolled joins over the live edges, and change impact."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.operators.facts import SPREAD


def spread_directions() -> tuple[list[str], list[str]]:
    """Types that a change follows from source to target, and from target to source."""
    return [k for k, v in SPREAD.items() if "OUT" in v], [k for k, v in SPREAD.items() if "IN" in v]


def kept_folder(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir (without that setting, on one machine only, in a folder of its own), which goes when the driver ends."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="heddle-"))
    path = f"{context.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    atexit.register(_removed_quietly, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _removed_quietly(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended first
        remove(spark, path)


def settled(df: DataFrame) -> DataFrame:
    """df written as Parquet to the folder of kept_folder and read from there, so that its lineage ends, it is computed once and joins know its size."""
    path = kept_folder(df.sparkSession, "settled")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, key: str, placed: bool = False) -> DataFrame:
    """df written in buckets by key, so that joins and groupings by it read it as it lies, without a shuffle.  placed: it is dealt by key to spark.sql.shuffle.partitions already."""
    spark, n, table = df.sparkSession, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), f"heddle_{uuid.uuid4().hex}"
    (df if placed else df.repartition(n, key)).write.bucketBy(n, key).sortBy(key).option("path", kept_folder(spark, "dealt")).option("compression", "zstd").saveAsTable(table)
    atexit.register(_forgotten_quietly, spark, table)
    return spark.table(table)


def _forgotten_quietly(spark: SparkSession, table: str) -> None:
    with contextlib.suppress(Exception):
        spark.sql(f"drop table if exists {table}")


def steps(edges: DataFrame, out_types: list[str] | None = None, in_types: list[str] | None = None) -> DataFrame:
    """Edges as steps: forwards if their type is in out_types, backwards if in in_types (None: all, empty: none)."""
    allowed = lambda types: F.lit(True) if types is None else F.col("type").isin(types)
    step = edges.where(allowed(out_types)).select(F.col("source").alias("at"), F.col("target").alias("to"), "id", "type", F.lit(True).alias("forward"))
    return step.unionByName(edges.where(allowed(in_types)).select(F.col("target").alias("at"), F.col("source").alias("to"), "id", "type", F.lit(False).alias("forward")))


def reach(edges: DataFrame, roots: DataFrame, depth: int, out_types: list[str] | None = None, in_types: list[str] | None = None) -> DataFrame:
    """First arrivals over edges within depth steps of each root: root, node, depth, id, type, forward, path and nodes, as of traverse.

    Each node is left once, by its smallest path (element by element) of those with fewest edges, and each edge is taken at its least depth only, from either
    of its ends that is so near; so a level costs at most its edges, however many paths there are.
    """
    step = settled(steps(edges, out_types, in_types))
    front = roots.select("root", F.col("root").alias("node"), F.array().cast("array<string>").alias("path"), F.array("root").alias("nodes")).distinct()
    seen = front.select("root", "node")
    found = taken = None
    for k in range(1, depth + 1):
        here = front.withColumnRenamed("node", "at").join(step, "at")
        if taken is not None:
            here = here.join(taken, ["root", "id"], "left_anti")
        arrived = settled(here.select("root", F.col("to").alias("node"), F.lit(k).alias("depth"), "id", "type", "forward", F.concat("path", F.array("id")).alias("path"), F.concat("nodes", F.array("to")).alias("nodes")))
        found = arrived if found is None else found.unionByName(arrived)
        if k < depth:
            taken = found.select("root", "id").distinct()
            front = settled(arrived.join(seen, ["root", "node"], "left_anti").groupBy("root", "node").agg(F.min(F.struct("path", "nodes")).alias("x")).select("root", "node", "x.*"))
            seen = seen.unionByName(front.select("root", "node"))
    return found


def traverse(edges: DataFrame, roots: DataFrame, depth: int, out_types: list[str] | None = None, in_types: list[str] | None = None) -> DataFrame:
    """All paths of up to depth steps over edges (id, source, target, type) from roots (root).

    An edge occurs once in a path, nodes may repeat, so their number grows with the degree to the power of depth: for depths and impacts use reach.
    Gives root, node, depth, id (the last edge), type, forward, path (edge ids) and nodes.
    """
    if not 1 <= depth <= 3:
        raise ValueError("depth is 1 to 3")
    step = steps(edges, out_types, in_types)
    front = roots.select("root", F.col("root").alias("node"), F.array().cast("array<string>").alias("path"), F.array("root").alias("nodes"))
    found = None
    for k in range(1, depth + 1):
        front = front.select("root", "node", "path", "nodes").join(step, F.col("node") == F.col("at")).where(~F.array_contains("path", F.col("id")))
        front = front.select("root", F.col("to").alias("node"), F.lit(k).alias("depth"), "id", "type", "forward", F.concat("path", F.array("id")).alias("path"), F.concat("nodes", F.array("to")).alias("nodes"))
        found = front if found is None else found.unionByName(front)
    return found


def shortest_per_edge(paths: DataFrame) -> DataFrame:
    """Of each root and edge the occurrence with the least depth, then path, then node."""
    order = F.struct("depth", "path", "node")
    return paths.groupBy("root", "id").agg(F.min_by(F.struct(*[c for c in paths.columns if c not in ("root", "id")]), order).alias("x")).select("root", "id", "x.*")


def node_depths(paths: DataFrame) -> DataFrame:
    return paths.where("node <> root").groupBy("root", "node").agg(F.min("depth").alias("depth"))


def limited(rows: DataFrame, order: list[str], limit: int) -> DataFrame:
    """The first rows in order, and whether there were more."""
    names = rows.columns
    first = rows.orderBy(*order).limit(limit + 1)
    # At most limit + 1 rows are left, so the window over all of them is small.
    return first.withColumn("truncated", F.expr("count(*) over ()") > limit).orderBy(*order).limit(limit).select(*names, "truncated")


def impact(edges: DataFrame, roots: DataFrame, depth: int = 3, node_limit: int = 250) -> DataFrame:
    """What a change of each root affects: the first fact that reaches a node, over the spreading types.

    edges also have confidence, extraction, state and evidence.  Along the chain: the least confidence, whether any
    fact is inferred, the weakest state; a fact without evidence makes the traceability insufficient.
    """
    out_types, in_types = spread_directions()
    paths = reach(edges, roots, depth, out_types, in_types).where("node <> root")
    order = F.struct("depth", "type", F.col("id").alias("o"), F.col("path").alias("p"))
    first = paths.groupBy("root", "node").agg(F.min_by(F.struct("depth", "path"), order).alias("x")).select("root", "node", "x.*")
    chain = first.select("root", "node", "depth", F.explode("path").alias("edge")).join(edges.select(F.col("id").alias("edge"), "confidence", "extraction", "state", "evidence"), "edge")
    weak = F.when(F.col("state") == "PENDING", 0).when(F.col("state") == "CORRECTED", 1).otherwise(2)
    out = chain.groupBy("root", "node", "depth").agg(F.min("confidence").alias("confidence"), F.bool_or(F.col("extraction") == "INFERRED").alias("inferred"), F.min(weak).alias("weak"), F.bool_or(F.col("evidence") == 0).alias("gap"))
    state = F.element_at(F.array(*map(F.lit, ("PENDING", "CORRECTED", "HUMAN_VERIFIED"))), F.col("weak") + 1)
    kind = F.when(F.col("depth") == 1, "DIRECT").otherwise("INDIRECT")
    out = out.select("root", "node", "depth", kind.alias("kind"), "confidence", "inferred", state.alias("state"), F.when(F.col("gap"), "INSUFFICIENT_TRACEABILITY").otherwise("TRACEABLE").alias("traceability"))
    rank = F.expr("row_number() over (partition by root order by depth, node)")
    return out.withColumn("rank", rank).where(F.col("rank") <= node_limit).drop("rank")


def nearest_ancestor(tree: DataFrame, climbs: int) -> DataFrame:
    """tree (id, up, lead): per id the nearest node, itself first, that has a lead, within climbs steps."""
    out = tree.select("id", F.col("id").alias("at"), F.when(F.col("lead"), F.col("id")).alias("found"), F.col("up").alias("next"))
    for _ in range(climbs):
        above = tree.select(F.col("id").alias("next"), F.col("up").alias("further"), "lead")
        out = out.join(above, "next", "left").select("id", F.coalesce("found", F.when(F.col("lead"), F.col("next"))).alias("found"), F.when(F.col("found").isNull(), F.col("further")).alias("next"))
    return out.select("id", "found")


def follow_pointers(nodes: DataFrame, hops: int = 10) -> DataFrame:
    """nodes (id, up): where each id's pointers end, after at most hops; a pointer to a missing row ends at the row ahead of it."""
    known = nodes.select(F.col("id").alias("next"), F.col("up").alias("further"))
    out = nodes.select("id", F.col("id").alias("end"), F.col("up").alias("next"))
    for _ in range(hops):
        moved = out.join(known.withColumn("here", F.lit(True)), "next", "left")
        out = moved.select("id", F.when(F.col("here"), F.col("next")).otherwise(F.col("end")).alias("end"), F.when(F.col("here"), F.col("further")).alias("next"))
    return out.select("id", "end")


def soft_merge(relationships: DataFrame, survivors: DataFrame) -> DataFrame:
    """Relationships re-pointed by survivors (id, survivor), set-wise.

    A loop becomes inactive; of twins (equal ends and type) the one of the higher rank, then the smallest id, stays and the
    others are superseded by it.
    """
    out = relationships
    for side in ("source", "target"):
        to = survivors.select(F.col("id").alias(side), F.col("survivor").alias(f"new_{side}"))
        out = out.join(to, side, "left").withColumn(side, F.coalesce(f"new_{side}", side)).drop(f"new_{side}")
    rank = F.when(F.col("state").isin("HUMAN_VERIFIED", "CORRECTED"), 3).when(F.col("state") == "REJECTED", 2).otherwise(1)
    out = out.withColumn("rank", rank)
    winner = F.expr("first(id) over (partition by source, target, type order by rank desc, id)")
    out = out.withColumn("winner", winner)
    loop = F.col("source") == F.col("target")
    return out.select("id", "source", "target", "type", loop.alias("loop"), F.when(~loop & (F.col("winner") != F.col("id")), F.col("winner")).alias("superseded_by"))


def components(links: DataFrame) -> DataFrame:
    """(id, component) by label propagation with pointer jumping: each id gets the smallest that it reaches (links: a, b)."""
    both = links.select("a", "b").union(links.select("b", "a")).distinct()
    both = settled(both)
    labels = both.select(F.col("a").alias("id")).distinct().withColumn("component", F.col("id"))
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        low = labels.join(near, "id").select("id", F.least("component", "near").alias("component"), (F.col("near") < F.col("component")).alias("moved"))
        up = low.select(F.col("id").alias("component"), F.col("component").alias("above"))
        nxt = low.join(up, "component").select("id", F.least("component", "above").alias("component"), "moved")
        nxt = settled(nxt)
        labels = nxt.select("id", "component")
        if not nxt.where("moved").limit(1).count():
            return labels


def tree_paths(headings: DataFrame, keys: list[str]) -> DataFrame:
    """headings (keys, ordinal, level, heading): parent ordinal, depth and path ' > ', by the last earlier heading of a lower level.

    Levels 1 to 6 are carried as the last ordinal per level that no heading of a lower level has closed.
    """
    names = ", ".join(keys)
    rows = headings
    for k in range(1, 7):
        rows = rows.withColumn(f"at{k}", F.expr(f"last(if(level = {k}, ordinal, null), true) over (partition by {names} order by ordinal rows between unbounded preceding and 1 preceding)"))
        rows = rows.withColumn(f"name{k}", F.expr(f"last(if(level = {k}, heading, null), true) over (partition by {names} order by ordinal rows between unbounded preceding and 1 preceding)"))
    # An ancestor at level k is open if it is below the heading's level and no later heading of a level up to k has closed it.
    opened = []
    for k in range(1, 7):
        later = F.greatest(F.lit(-1), *(F.coalesce(F.col(f"at{j}"), F.lit(-1)) for j in range(1, k))) if k > 1 else F.lit(-1)
        opened.append(F.when((F.lit(k) < F.col("level")) & F.col(f"at{k}").isNotNull() & (F.col(f"at{k}") > later), F.struct(F.col(f"at{k}").alias("o"), F.col(f"name{k}").alias("h"))))
    trail = F.array_compact(F.array(*opened))
    rows = rows.withColumn("trail", trail)
    return rows.select(*keys, "ordinal", "level", "heading", F.element_at("trail.o", F.when(F.size("trail") > 0, -1)).alias("parent"), (F.size("trail") + 1).alias("depth"), F.array_join(F.concat("trail.h", F.array("heading")), " > ").alias("path"))


def hard_merge(relationships: DataFrame, merges: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """relationships with the ends of merged entities replaced, and the aliases that the merges add.

    merges (id, survivor, alias, normalized): of one id the smallest survivor counts.  A name becomes an alias of the survivor unless it is one already
    (aliases: entity_id, alias, normalized); of several survivors with one name the smallest gets it.
    """
    to = merges.groupBy("id").agg(F.min("survivor").alias("survivor"))
    out = relationships
    for side in ("source", "target"):
        out = out.join(to.withColumnRenamed("id", side), side, "left").withColumn(side, F.coalesce("survivor", side)).drop("survivor")
    new = merges.where("normalized <> ''").groupBy("normalized").agg(F.min(F.struct("survivor", "alias")).alias("x")).select(F.col("x.survivor").alias("entity_id"), F.col("x.alias").alias("alias"), "normalized")
    return out.select(*relationships.columns), new.join(aliases.select("normalized").distinct(), "normalized", "left_anti").select("entity_id", "alias", "normalized")
