"""Every query with SQL against that SQL in DuckDB, as the driver compares them, on the smallest tables."""

from __future__ import annotations

import decimal

import duckdb
import pytest

from heddle.plans.registry import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _once(rows, *columns):
    keys = [tuple(r[c] for c in columns) for r in rows]
    return len(keys) == len(set(keys)) > 0


#: What holds for the rows of the queries without SQL.
INVARIANTS = {
    "c1_chunks": lambda rows: _once(rows, "doc", "section", "chunk") and all(0 < r["n_tokens"] <= 800 for r in rows),
    "d1_all_passes": lambda rows: _once(rows, "pair", "old") and _once(rows, "pair", "new") and {r["how"] for r in rows} <= {"SAME_PATH", "SAME_HEADING", "EXTENDED", "RENAMED"},
    "d2_statement_changes": lambda rows: all((r["before"] is None) == (r["change"] == "ADDED") and (r["after"] is None) == (r["change"] == "REMOVED") for r in rows),
    "d5_entity_changes": lambda rows: all((r["old_id"] is None) == (r["change"] == "ADDED") and (r["new_id"] is None) == (r["change"] == "REMOVED") for r in rows) and _once([r for r in rows if r["old_id"]] or rows, "old_id", "new_id"),
    "f5_findings_listing": lambda rows: len(rows) <= 50 and {r["total"] for r in rows} == {max(r["total"] for r in rows)} and [r["severity"] for r in rows] == sorted((r["severity"] for r in rows), key=["HIGH", "MEDIUM", "LOW", "INFO"].index),
    "m5_sequence_ratio": lambda rows: _once(rows, "p_name", "other") and all(r["p_name"] < r["other"] and 0 < r["ratio"] < 1 for r in rows),
    "q6_linked_entities": lambda rows: _once(rows, "id", "entity") and all(0 <= r["start"] < r["stop"] <= r["start"] + 5 for r in rows),
    "q6_near_spellings": lambda rows: _once(rows, "id", "entity") and any(r["similarity"] < 1 for r in rows) and all(r["similarity"] >= 0.88 for r in rows),
    "q8_claim_support": lambda rows: _once(rows, "id") and all(0 <= r["support"] <= 1 and r["supported"] == (r["support"] >= 0.6) for r in rows),
    "q16_extractive_answers": lambda rows: _once(rows, "query", "id") and all(r["sentence"].strip() for r in rows),
    "r4_scores": lambda rows: _once(rows, "a", "b") and all(0 <= r["similarity"] <= 1 and (r["similarity"] == 1) == (r["decisive"] == "EXACT_NAME") for r in rows),
    "r8_legacy_resolution": lambda rows: _once(rows, "mention", "kind") and {r["state"] for r in rows} <= {"EXACT", "ALIAS", "MERGED", "AMBIGUOUS", "UNRESOLVED"} and all((r["id"] is not None) == (r["state"] in ("EXACT", "ALIAS", "MERGED")) for r in rows),
    "t9_constrained_clusters": lambda rows: _once(rows, "id") and all(r["grp"] <= r["id"] for r in rows) and {r["grp"] for r in rows} <= {r["id"] for r in rows},
}


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def rounded(row):
    return tuple(round(float(v), 6) if isinstance(v, float | decimal.Decimal) else v for v in row)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, database, name):
    frame = QUERIES[name](spark, FOLDER)
    rows = frame.collect()
    if name not in ORACLES:
        assert INVARIANTS[name](rows)
        return
    result = database.sql(ORACLES[name])
    columns = sorted(frame.columns)
    assert columns == sorted(result.columns)
    got = sorted((rounded(r[c] for c in columns) for r in rows), key=repr)
    want = sorted((rounded(r[result.columns.index(c)] for c in columns) for r in result.fetchall()), key=repr)
    assert got == want


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert entry.oracle_sql().keys() <= entry.queries().keys()
