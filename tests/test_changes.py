"""Merges, undo and corrections against a walk over plain dicts, one operation after the other."""

from __future__ import annotations

import random

import pytest

from heddle.operators import changes, corrections, merges
from heddle.operators.graph import kept_folder

SCHEMAS = {
    "entities": "id string, name string, normalized string, entity_type string, state string, merged_into string, superseded_by string",
    "relationships": "id string, source string, target string, type string, state string, superseded_by string, inactive_reason string",
    "entity_evidence": "id string, entity_id string, chunk_id string", "relationship_evidence": "id string, relationship_id string, chunk_id string",
    "aliases": "id string, entity_id string, alias string, normalized string, source string",
}


def made(rng: random.Random) -> dict[str, list[tuple]]:
    entities = [(f"e{k:02d}", f"Name {k // 2}", f"name{k // 2}", "SYSTEM", "PENDING", None, None) for k in range(24)]
    ids = [e[0] for e in entities]
    ends = {(rng.choice(ids), rng.choice(ids), rng.choice("RU")) for _ in range(70)}
    edges = [(f"r{k:02d}", a, b, t, rng.choice(["PENDING", "REJECTED", "HUMAN_VERIFIED"]), None, None) for k, (a, b, t) in enumerate(sorted(ends)) if a != b]
    entity_evidence = [(f"v{k:03d}", rng.choice(ids), f"c{rng.randrange(9)}") for k in range(60)]
    edge_evidence = [(f"w{k:03d}", rng.choice(edges)[0], f"c{rng.randrange(6)}") for k in range(120)]
    aliases = [(f"a{k}", rng.choice(ids), f"Alias {k}", f"alias{k}" if k else "name3", "DOCUMENT") for k in range(12)]
    return {"entities": entities, "relationships": edges, "entity_evidence": entity_evidence, "relationship_evidence": edge_evidence, "aliases": aliases}


def frames(spark, tables) -> changes.Knowledge:
    return changes.Knowledge(**{n: spark.createDataFrame(tables[n], s) for n, s in SCHEMAS.items()})


def rows(knowledge) -> dict[str, set]:
    return {n: {tuple(r) for r in getattr(knowledge, n).collect()} for n in SCHEMAS}


RANK = {"HUMAN_VERIFIED": 3, "HUMAN_CORRECTED": 3, "REJECTED": 2}


def merge_walk(tables, merged, survivor):
    """One merge over lists of lists."""
    t = {n: [list(r) for r in rs] for n, rs in tables.items()}
    known = {r[2] for r in t["entity_evidence"] if r[1] == survivor}
    for r in sorted(t["entity_evidence"]):
        if r[1] == merged and r[2] not in known:
            known.add(r[2])
            next(x for x in t["entity_evidence"] if x[0] == r[0])[1] = survivor
    name = {e[0]: e for e in t["entities"]}
    for r in t["aliases"]:
        r[1] = survivor if r[1] == merged else r[1]
    if name[merged][2] != name[survivor][2] and all(r[3] != name[merged][2] for r in t["aliases"]):
        t["aliases"].append([f"merge:{merged}", survivor, name[merged][1], name[merged][2], "MERGE"])
    for r in sorted(t["relationships"]):
        r = next(x for x in t["relationships"] if x[0] == r[0])
        if r[5] is not None or merged not in (r[1], r[2]):
            continue
        a, b = (survivor if x == merged else x for x in (r[1], r[2]))
        if a == b:
            r[6] = "endpoints merged"
            continue
        twin = next((x for x in t["relationships"] if x[5] is None and x[:4][1:] == [a, b, r[3]] and x[0] != r[0]), None)
        if twin is None:
            r[1], r[2] = a, b
            continue
        winner, loser = (r, twin) if RANK.get(r[4], 1) > RANK.get(twin[4], 1) else (twin, r)
        loser[5] = winner[0]
        have = {x[2] for x in t["relationship_evidence"] if x[1] == winner[0]}
        for x in sorted(t["relationship_evidence"]):
            if x[1] == loser[0] and x[2] not in have:
                have.add(x[2])
                next(y for y in t["relationship_evidence"] if y[0] == x[0])[1] = winner[0]
        if winner is r:
            r[1], r[2] = a, b
    name[merged][5] = survivor
    return {n: [tuple(r) for r in rs] for n, rs in t.items()}


def test_one_merge_equals_a_walk_and_undo_gives_all_back(spark):
    for seed in range(2):
        tables = made(random.Random(seed))
        before = frames(spark, tables)
        for merged, survivor in (("e01", "e00"), ("e05", "e18")):
            after, log = merges.merge(before, spark.createDataFrame([(merged, survivor)], "merged string, survivor string"), 1)
            want = merge_walk(tables, merged, survivor)
            assert rows(after) == {n: set(r) for n, r in want.items()}
            back, decisions, refused = merges.undo(after, log, spark.createDataFrame([(merged,)], "merged string"))
            assert rows(back) == {n: set(r) for n, r in tables.items()}
            assert [(r["entity_a"], r["entity_b"], r["decision"], r["decided_by"]) for r in decisions.collect()] == [(merged, survivor, "DIFFERENT", "HUMAN")] and not refused.count()


def test_batches_undone_in_part(spark):
    """Of an edge between two merged entities only the end whose merge is undone goes back; a survivor merged again is refused."""
    tables = {n: [] for n in SCHEMAS}
    tables["entities"] = [(x, x, x, "SYSTEM", "PENDING", None, None) for x in "abcd"]
    tables["relationships"] = [("r", "a", "b", "R", "PENDING", None, None)]
    pairs = lambda *x: spark.createDataFrame(list(x), "merged string, survivor string")
    after, log = merges.merge(frames(spark, tables), pairs(("a", "c"), ("b", "d")), 1)
    assert rows(after)["relationships"] == {("r", "c", "d", "R", "PENDING", None, None)}
    back, _, _ = merges.undo(after, log, spark.createDataFrame([("a",)], "merged string"))
    assert rows(back)["relationships"] == {("r", "a", "d", "R", "PENDING", None, None)}
    further, more = merges.merge(after, pairs(("c", "d")), 2)
    assert rows(further)["relationships"] == {("r", "c", "d", "R", "PENDING", None, "endpoints merged")}
    same, decisions, refused = merges.undo(further, log.unionByName(more), spark.createDataFrame([("a",), ("d",), ("z",)], "merged string"))
    assert {tuple(r) for r in refused.collect()} == {("a", "the survivor was merged again"), ("d", "not merged"), ("z", "not merged")}
    assert rows(same) == rows(further) and decisions.count() == 0
    whole, _, _ = merges.undo(further, log.unionByName(more), spark.createDataFrame([("c",), ("b",)], "merged string"))
    assert rows(whole)["relationships"] == {("r", "c", "b", "R", "PENDING", None, None)}


@pytest.mark.parametrize("pairs", [[("a", "a")], [("a", "z")], [("a", "b"), ("b", "c")], [("a", "b"), ("a", "c")]])
def test_refused_merges(spark, pairs):
    tables = {n: [] for n in SCHEMAS} | {"entities": [(x, x, x, "SYSTEM", "PENDING", None, None) for x in "abc"]}
    with pytest.raises(ValueError, match="can't be merged"):
        merges.merge(frames(spark, tables), spark.createDataFrame(pairs, "merged string, survivor string"), 1)


def test_corrections_fan_out_and_run_twice(spark):
    entities = [("a", "Old", "old", "SYSTEM", "PENDING", None, None), ("b", "B", "b", "SYSTEM", "PENDING", None, None), ("c", "C", "c", "SYSTEM", "PENDING", None, None), ("g", "G", "g", "SYSTEM", "PENDING", "b", None)]
    edges = [("1", "a", "b", "R", "PENDING", None, None), ("2", "a", "a", "R", "PENDING", None, None), ("3", "c", "a", "U", "REJECTED", None, None), ("4", "a", "c", "R", "PENDING", "1", None), ("5", "b", "c", "R", "PENDING", None, None)]
    tables = {"entities": entities, "relationships": edges, "entity_evidence": [("v1", "a", "k1"), ("v2", "b", "k1")], "relationship_evidence": [("w1", "1", "k1"), ("w2", "5", "k1")], "aliases": [("al", "a", "Elder", "elder", "DOCUMENT")]}
    asked = [("a", " New Name ", "SYSTEM", 7), ("a", "Newer", "SYSTEM", 8), ("b", "B", "SYSTEM", 9), ("c", "b!", "SYSTEM", 10), ("g", "x", "SYSTEM", 11), ("z", "x", "SYSTEM", 12), ("b", "--", "SYSTEM", 13)]
    before = frames(spark, tables)
    wanted = spark.createDataFrame(asked, "id string, name string, entity_type string, seq long")
    reasons = {(r["id"], r["seq"]): r["reason"] for r in corrections.judged(before, wanted).collect()}
    assert reasons == {("a", 7): None, ("a", 8): "corrected before", ("b", 9): "changes nothing", ("c", 10): "the name is taken", ("g", 11): "the entity was replaced", ("z", 12): "unknown entity", ("b", 13): "no name"}
    store = changes.Store(spark, kept_folder(spark, "store"), parts=4)
    store.write(before)
    change_set = corrections.correction_changes(before, wanted)
    want = {n: set(r) for n, r in tables.items()}
    want["entities"] = {*entities[1:], ("a", "Old", "old", "SYSTEM", "HUMAN_CORRECTED", None, "a~7"), ("a~7", "New Name", "newname", "SYSTEM", "HUMAN_CORRECTED", None, None)}
    want["relationships"] = {edges[1], edges[3], edges[4], ("1", "a", "b", "R", "PENDING", "1~7", None), ("1~7", "a~7", "b", "R", "PENDING", None, None), ("3", "c", "a", "U", "REJECTED", "3~7", None), ("3~7", "c", "a~7", "U", "REJECTED", None, None)}
    want["entity_evidence"].add(("v1~7", "a~7", "k1"))
    want["relationship_evidence"].add(("w1~1~7", "1~7", "k1"))
    want["aliases"] = {("al", "a~7", "Elder", "elder", "DOCUMENT"), ("human:a", "a~7", "Old", "old", "HUMAN")}
    for _ in range(2):  # a second run changes nothing
        store.commit(change_set)
        assert rows(store.read()) == want
    # Taken back: the clones go, and all cells are what they were.
    store.commit(changes.inverse(change_set))
    assert rows(store.read()) == {n: set(r) for n, r in tables.items()}


def test_a_table_alone_changes_as_with_all_others(spark):
    from heddle.operators.changes import TABLES, applied

    tables = made(random.Random(5))
    before = frames(spark, tables)
    pairs = spark.createDataFrame([("e01", "e00"), ("e03", "e02"), ("e05", "e20"), ("e07", "e20")], "merged string, survivor string")
    whole = rows(merges.merge(before, pairs, 1)[0])
    for table in TABLES:
        after, log = merges.merge(before, pairs, 1, (table,))
        assert {r["table"] for r in log.collect()} <= {table}
        assert {tuple(r) for r in getattr(after, table).collect()} == whole[table]
    # A join takes both sides by id once, and rows aren't read a second time for the ids that are created.
    changed = applied(before.aliases, "aliases", spark.createDataFrame([(["e01"], "aliases", "a1", "entity_id", "x", "y")], "by array<string>, table string, id string, column string, before string, after string"))
    changed.collect()
    assert changed._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


@pytest.fixture
def merging(spark):
    """Joins by merging, as of tables too large to broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_tables_dealt_by_id_meet_their_changes_without_a_shuffle(spark, merging):
    # Each change set dealt all rows of a table anew, those of the log and of what is undone too.
    from heddle.operators.graph import dealt

    tables = made(random.Random(6))
    before = changes.Knowledge(**{n: dealt(spark.createDataFrame(tables[n], s), "id") for n, s in SCHEMAS.items()})
    pairs = lambda *x: spark.createDataFrame(list(x), "merged string, survivor string")
    after, first = merges.merge(before, pairs(("e01", "e00"), ("e05", "e20")), 1)
    after, second = merges.merge(after, pairs(("e03", "e00"), ("e07", "e20")), 2)
    back, _, refused = merges.undo(after, first.unionByName(second), spark.createDataFrame([("e01",), ("e03",), ("e05",), ("e07",)], "merged string"))
    assert rows(after) != rows(before) == rows(back) and not refused.count()
    for table in ("entities", "relationships", "entity_evidence", "relationship_evidence"):
        for knowledge in (after, back):
            assert "Exchange" not in getattr(knowledge, table)._jdf.queryExecution().executedPlan().toString()


def test_moved_evidence_is_applied_where_it_lies(spark, merging):
    # Both evidence tables and their changes were dealt by id to be joined.
    from heddle.plans.registry import QUERIES

    moved = QUERIES["t10_moved_evidence"](spark, "/root/testdata/sf0.001")
    assert "Exchange" not in moved._jdf.queryExecution().executedPlan().toString() and moved.count() > 0
