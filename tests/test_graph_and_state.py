"""Graph walks, findings, review state and streams on small hand-made tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from heddle.operators import compare, facts, findings, graph, resolve, retrieval, review
from heddle.streaming import events


def edges(spark, rows):
    return spark.createDataFrame([(f"{a}{b}", a, b, t) for a, b, t in rows], "id string, source string, target string, type string")


def root(spark, name):
    return spark.createDataFrame([(name,)], "root string")


def test_cycles_end_and_directions_hold(spark):
    cycle = edges(spark, [("a", "b", "USES"), ("b", "c", "USES"), ("c", "a", "USES")])
    paths = graph.traverse(cycle, root(spark, "a"), 3)
    assert {r["id"] for r in graph.shortest_per_edge(paths).collect()} == {"ab", "bc", "ca"}
    assert all(len(set(r["path"])) == len(r["path"]) for r in paths.collect())
    assert {(r["node"], r["depth"]) for r in graph.node_depths(paths).collect()} == {("b", 1), ("c", 1)}
    assert {r["node"] for r in graph.traverse(cycle, root(spark, "a"), 1, ["USES"], []).collect()} == {"b"}
    assert graph.traverse(cycle, root(spark, "a"), 2, [], []).count() == 0


def test_impact_takes_the_weakest_link(spark):
    rows = edges(spark, [("u", "x", "USES"), ("v", "u", "REQUIRES"), ("x", "w", "USES")]).withColumn("confidence", F.when(F.col("id") == "ux", 0.6).otherwise(0.9))
    rows = rows.withColumn("extraction", F.lit("EXPLICIT")).withColumn("state", F.when(F.col("id") == "vu", "PENDING").otherwise("HUMAN_VERIFIED")).withColumn("evidence", F.when(F.col("id") == "vu", 0).otherwise(2))
    got = {r["node"]: r for r in graph.impact(rows, root(spark, "x"), 3).collect()}
    assert got.keys() == {"u", "v"}  # x USES w: a change of x doesn't reach w
    assert (got["v"]["confidence"], got["v"]["state"], got["v"]["kind"], got["v"]["traceability"]) == (0.6, "PENDING", "INDIRECT", "INSUFFICIENT_TRACEABILITY")
    assert got["u"]["kind"] == "DIRECT"


def test_merges_and_pointers(spark):
    rels = spark.createDataFrame([("1", "a", "x", "USES", "PENDING"), ("2", "a", "y", "USES", "HUMAN_VERIFIED"), ("3", "x", "y", "USES", "PENDING")], "id string, source string, target string, type string, state string")
    got = {r["id"]: r for r in graph.soft_merge(rels, spark.createDataFrame([("y", "x")], "id string, survivor string")).collect()}
    assert got["1"]["superseded_by"] == "2" and got["2"]["superseded_by"] is None and got["3"]["loop"]
    ends = graph.follow_pointers(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", None), ("d", "gone")], "id string, up string"))
    assert dict(map(tuple, ends.collect())) == {"a": "c", "b": "c", "c": "c", "d": "d"}
    chain = spark.createDataFrame([(k, k + 1) for k in range(40)], "a int, b int")
    assert {r["component"] for r in graph.components(chain).collect()} == {0}


def test_tree_paths(spark):
    rows = spark.createDataFrame([("d", k, lv, f"h{k}") for k, lv in enumerate([1, 2, 3, 2, 1, 3])], "doc string, ordinal int, level int, heading string")
    got = {r["ordinal"]: (r["parent"], r["path"]) for r in graph.tree_paths(rows, ["doc"]).collect()}
    assert got == {0: (None, "h0"), 1: (0, "h0 > h1"), 2: (1, "h0 > h1 > h2"), 3: (0, "h0 > h3"), 4: (None, "h4"), 5: (4, "h4 > h5")}


def test_confidence_rounds_half_even(spark):
    rows = spark.createDataFrame([("0.900", "INFERRED", 1), ("0.990", "EXPLICIT", 3), ("0.950", "EXPLICIT", 0), ("0.850", "INFERRED", 1)], "raw string, extraction string, evidence int").withColumn("raw", F.col("raw").cast("decimal(4,3)"))
    assert [str(r["c"]) for r in rows.select(facts.confidence(F.col("raw"), F.col("extraction"), F.col("evidence")).alias("c")).collect()] == ["0.765", "1.000", "0.000", "0.722"]


def test_findings_lifecycle(spark):
    known = spark.createDataFrame([("a", "OPEN"), ("b", "DISMISSED"), ("c", "RESOLVED"), ("d", "OPEN")], "fingerprint string, status string")
    got = {r["fingerprint"]: (r["status"], r["event"]) for r in findings.sync(known, spark.createDataFrame([("a",), ("b",), ("c",), ("e",)], "fingerprint string")).collect()}
    assert got == {"a": ("OPEN", "UNCHANGED"), "b": ("DISMISSED", "UNCHANGED"), "c": ("OPEN", "REOPENED"), "d": ("RESOLVED", "RESOLVED"), "e": ("OPEN", "OPENED")}


def test_rank_fusion_and_diversity(spark):
    rank = lambda ids: spark.createDataFrame([(1, i, k) for k, i in enumerate(ids, 1)], "query int, id string, rank int")
    scores = {r["id"]: r["fused"] for r in retrieval.fuse({"dense": rank("abc"), "lexical": rank("dab")}).collect()}
    assert max(scores, key=scores.get) == "a"
    rows = spark.createDataFrame([(1, i, s, f) for i, s, f in (("a", "s", 5.0), ("b", "s", 4.0), ("c", "s", 3.0), ("d", "t", 1.0))], "query int, id string, section string, fused double")
    assert [r["id"] for r in retrieval.diverse(rows, 4, 2).orderBy("place").collect()] == ["a", "b", "d", "c"]


def test_claims_need_one_statement(spark):
    cited = "BrakeController REQUIRES P_WheelSpeed_In.\nBrakeController PROVIDES P_Torque_Out."
    rows = spark.createDataFrame([(1, "BrakeController requires P_WheelSpeed_In", cited), (2, "P_Torque_Out with P_WheelSpeed_In", cited), (3, "MissingThing_X here", cited)], "id int, claim string, cited string")
    assert {r["id"]: r["supported"] for r in retrieval.claim_support(rows).collect()} == {1: True, 2: False, 3: False}


def test_relationship_changes_equal_a_loop(spark):
    import random

    rng = random.Random(2)
    rel = lambda: (rng.choice("ab"), rng.choice("xyz"), rng.choice("UR"))
    make = lambda mark: {f"{mark}{k}": rel() for k in range(12)}
    shared = make("s")
    old, new = shared | make("o"), shared | make("n")
    removed, added, want = sorted(set(old) - set(new)), sorted(set(new) - set(old)), set()
    for keys, change in (((0, 2), "TARGET_CHANGED"), ((1, 2), "SOURCE_CHANGED"), ((0, 1), "RELATIONSHIP_TYPE_CHANGED")):
        for a in list(removed):
            twin = next((b for b in added if all(old[a][k] == new[b][k] for k in keys)), None)
            if twin:
                removed.remove(a)
                added.remove(twin)
                want.add((a, twin, change))
    want |= {(a, None, "REMOVED") for a in removed} | {(None, b, "ADDED") for b in added}
    frame = lambda rows: spark.createDataFrame([(i, *r) for i, r in rows.items()], "id string, source string, target string, type string")
    assert {(r["old_id"], r["new_id"], r["change"]) for r in compare.relationship_changes(frame(old), frame(new)).collect()} == want


def test_blocks_that_are_too_large_are_skipped(spark):
    rows = spark.createDataFrame([(f"e{k:02d}", f"Common{k} Thing", "SIGNAL") for k in range(50)] + [("p", "Rare Item", "SIGNAL"), ("q", "rare_item", "SIGNAL"), ("r", "Rare Item", "PORT")], "id string, name string, entity_type string")
    assert {(r["a"], r["b"]) for r in resolve.candidate_pairs(rows).collect()} == {("p", "q")}


def test_review_and_jobs(spark):
    known = spark.createDataFrame([("a", "PENDING"), ("b", "PENDING"), ("c", "PENDING")], "id string, state string")
    done = spark.createDataFrame([("a", 1, "verify", "x"), ("a", 2, "reject", "x"), ("b", 3, "correct", "y")], "id string, seq int, action string, actor string")
    got = {r["id"]: (r["state"], r["superseded_by"], r["trust"]) for r in review.current_states(known, done).collect()}
    assert got == {"a": ("REJECTED", None, "TRUSTED"), "b": ("CORRECTED", "b~3", "TRUSTED"), "c": ("PENDING", None, "CANDIDATE")}
    log = spark.createDataFrame([(1, 1, "enqueued"), (1, 2, "claimed"), (1, 3, "failed"), (2, 1, "claimed"), (3, 1, "failed"), (3, 2, "failed"), (3, 3, "failed")], "job int, seq int, kind string")
    assert {r["job"]: (r["state"], r["delay"]) for r in review.job_states(log).collect()} == {1: ("PENDING", 5), 2: ("RUNNING", None), 3: ("FAILED", None)}
    chains = review.job_chains(spark.createDataFrame([(1, 2), (2, 3), (3, None), (9, None)], "id int, next int"))
    assert {r["chain"] for r in chains.collect()} == {"1>2>3", "9"}


def test_streams_equal_the_batch(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    batch = spark.read.parquet(f"{folder}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    stream = events.event_stream(spark, folder)
    query = events.to_table(events.window_counts(stream), "windows", f"{tmp_path}/a")
    query.awaitTermination(120)
    assert sorted(map(str, spark.table("windows").collect())) == sorted(map(str, events.window_counts(batch).collect()))
    query = events.to_folder(events.enqueued(stream, "event_id"), f"{tmp_path}/out", f"{tmp_path}/b")
    query.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == batch.select("event_id").distinct().count()
    leases = spark.createDataFrame([(1, "RUNNING", 1, "2024-01-01 00:00:00"), (2, "RUNNING", 3, "2024-01-01 00:00:00")], "id int, state string, attempts int, lease_until string").withColumn("lease_until", F.col("lease_until").cast("timestamp"))
    assert {r["id"]: r["state"] for r in events.expired_leases(leases, F.lit("2024-06-01").cast("timestamp")).collect()} == {1: "PENDING", 2: "FAILED"}
