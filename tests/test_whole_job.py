"""Operators over whole tables, against brute force: no slice of the input stands for the rest."""

from __future__ import annotations

import random
from datetime import datetime
from difflib import SequenceMatcher

import numpy as np
import pytest

from heddle.operators import compare, retrieval
from heddle.plans.registry import QUERIES


def test_dense_channel_takes_any_number_of_queries(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(3000, 8)).astype(np.float32).tolist()
    for k in range(0, 600, 3):
        vectors[k] = vectors[0]
    vectors[7], vectors[8], vectors[9] = [0.0] * 8, None, [1.0, 2.0]
    rows = spark.createDataFrame(list(enumerate(vectors)), "id long, embedding array<float>").repartition(5)
    asked = rows.where("id % 2 = 0").selectExpr("id as query", "embedding as vector")
    frame = retrieval.dense_channel(rows, asked, 10, block_bytes=20_000)
    plan = frame._jdf.queryExecution().analyzed().toString()
    assert len(plan) < 100_000  # the query vectors aren't literals of the plan
    got = {}
    for r in frame.collect():
        got.setdefault(r["query"], {})[r["rank"]] = r["id"]
    ids = [i for i, x in enumerate(vectors) if i not in (7, 8, 9)]
    unit = np.array([vectors[i] for i in ids], dtype=np.float64)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    scores = np.round(unit @ unit.T, 9)
    for n, i in enumerate(ids):
        if i % 2 == 0:
            want = [ids[x] for x in np.lexsort((ids, -scores[n]))[:10]]
            assert [got[i][k] for k in range(1, 11)] == want
    assert got.keys() == {i for i in ids if i % 2 == 0}


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """Two interfaces, one provided and one used, each by a statement of quantity 1."""
    folder = str(tmp_path_factory.mktemp("parts"))
    put = lambda name, schema, rows: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    put("supplier", "s_suppkey long, s_name string", [(1, "Supplier one")])
    put("customer", "c_custkey long, c_name string", [(1, "Customer one"), (2, "Customer two")])
    put("part", "p_partkey long, p_name string, p_brand string, p_type string", [(2, "red bolt", "Brand#11", "ECONOMY TIN"), (4, "blue nut", "Brand#11", "STANDARD TIN")])
    line = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    put("lineitem", line, [(1, 2, 1, 1, 1.0, 0.1, "A", "F", datetime(1995, 1, 1)), (1, 4, 1, 2, 1.0, 0.1, "R", "F", datetime(1995, 1, 1))])
    return folder


def test_findings_are_of_all_statements(spark, parts):
    rows = {r["key"]: r for r in QUERIES["f5_findings_listing"](spark, parts).collect()}
    assert "p2" not in rows
    assert rows["p4"]["severity"] == "HIGH" and rows["p4"]["summary"].endswith("It is used by Supplier one.")
    assert {r["total"] for r in rows.values()} == {len(rows)}
    assert sum(r["finding_type"] == "POSSIBLE_DUPLICATE" for r in QUERIES["f5_findings_listing"](spark, parts).collect()) == 2


def test_every_part_is_asked_and_linked_by_its_name(spark, parts):
    got = {(r["id"], r["entity"], r["start"]) for r in QUERIES["q6_linked_entities"](spark, parts).collect()}
    assert got == {(2, "p2", 2), (4, "p4", 2), (4, "p2", 5)}


def test_every_version_is_compared_with_its_successor(spark, tmp_path):
    texts = [f"The limit is {k} volts." for k in range(6)]
    spark.createDataFrame([(k, t, "en", "a") for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {(r["pair"], r["change"], r["before"], r["after"]) for r in QUERIES["d2_statement_changes"](spark, str(tmp_path)).collect()}
    assert got == {(f"a/en#{k + 1}", "CHANGED", texts[k], texts[k + 1]) for k in range(5)}


def test_the_bound_on_ratios_changes_no_pairing():
    rng = random.Random(8)
    for _ in range(150):
        old, new = ([" ".join(rng.choice(["volt", "limit", "of", "the", "lo", "bus"]) for _ in range(rng.randrange(0, 6))) for _ in range(rng.randrange(0, 9))] for _ in "ab")
        mine, rest = compare.Candidates(new), list(new)
        for before in old:
            ratios = [SequenceMatcher(None, before, after).ratio() for after in rest]
            want = rest.pop(ratios.index(max(ratios))) if ratios and max(ratios) >= compare.PAIRING else None
            assert mine.take(before) == want
        assert mine.left() == rest


def test_excerpts_are_found_in_any_case_and_place(spark, tmp_path):
    texts = ["xx small start of it yy", "SMALL  start *of* it", "tiny", "a small start", "Über den Berg gehen"]
    items = spark.createDataFrame([(1, "small start of it"), (2, "tiny"), (3, "über den berg gehen"), (4, None), (5, "of it y")], "item_id long, text string")
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = {(r["doc_id"], r["item_id"], r["start"], r["exact"]) for r in retrieval.find_excerpts(docs, items.withColumnRenamed("text", "excerpt")).collect()}
    assert got == {(0, 1, 3, True), (0, 5, 15, True), (1, 1, None, False), (2, 2, 0, True), (4, 3, None, False)}
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {tuple(r) for r in QUERIES["x21_excerpts"](spark, str(tmp_path)).collect()} == got


def test_renames_equal_taking_turns(spark):
    """Names share out their members as a walk over all old entities does, ties, short, equal and null names included."""
    rng = random.Random(5)
    words = ["pump", "pumps", "valve", "valves", "gauge", "a", "b", "ab", "axb", "unit", "units"]
    name = lambda: " ".join(rng.choice(words) for _ in range(rng.choice([1, 1, 2])))
    side = lambda mark, n: [(f"{mark}{k:03d}", x, x.lower(), rng.choice(["SOFTWARE_COMPONENT", "COMPONENT", "SYSTEM"])) for k in range(n) for x in [name()]]
    old, new = side("o", 150), side("n", 130)
    # A name that a third of all rows have.
    old += [(f"p{k:03d}", "Pump unit", "pump unit", "SYSTEM") for k in range(70)] + [("z1", None, None, "SYSTEM")]
    new += [(f"q{k:03d}", "Pump units", "pump units", "SYSTEM") for k in range(50)] + [("z2", None, None, "SYSTEM")]
    schema = "id string, name string, normalized string, entity_type string"
    frames = [spark.createDataFrame(rows, schema) for rows in (old, new)]
    rows = compare.entity_changes(*frames).collect()
    typed = {(r["old_id"], r["new_id"]) for r in rows if r["change"] == "TYPE_CHANGED"}
    kind = lambda x: "COMPONENT" if x[3] == "SOFTWARE_COMPONENT" else x[3]
    rest = lambda side, k: sorted((x for x in side if x[1] is not None and x[0] not in {t[k] for t in typed}), key=lambda x: (x[1], x[0]))
    left, want = rest(new, 1), set()
    for a in rest(old, 0):
        scores = [(SequenceMatcher(None, a[2], b[2]).ratio(), b) for b in left if kind(b) == kind(a)]
        best = max(scores, key=lambda s: s[0], default=(0, None))
        if best[0] >= 0.8:
            want.add((a[0], best[1][0]))
            left.remove(best[1])
    assert typed and {(r["old_id"], r["new_id"]) for r in rows if r["change"] == "RENAMED"} == want and len(want) > 80
    assert {("z1", None, "REMOVED"), (None, "z2", "ADDED")} <= {(r["old_id"], r["new_id"], r["change"]) for r in rows}
    assert compare.entity_changes(*(f.where("false") for f in frames)).count() == 0
