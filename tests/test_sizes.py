"""What large tables need of plans: no broadcasts that grow with names, no limits, no work done twice."""

from heddle.operators import compare, lexical_index, questions


def ran(df):
    """The plan that Spark ran for df's rows."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_names_are_not_broadcast(spark):
    # A small file of names explodes to many times its size, so a join that looks at the file's size alone fills the driver.
    names = spark.createDataFrame([(0, f"customer{n:09d}") for n in range(50)], "kind int, name string")
    asked = spark.createDataFrame([(0, "custmer000000007")], "kind int, name string")
    near = compare.similar_names(asked, names, 0.9)
    assert (near.count(), "BroadcastHashJoin" in ran(near)) == (18, False)
    index = spark.createDataFrame([(f"name{n % 7}", f"e{n}") for n in range(40)], "normalized string, entity string")
    known = questions.owners(index)
    assert {(r["normalized"], r["n_owners"], len(r["entities"])) for r in known.collect()} == {(f"name{n}", 6 if n < 5 else 5, 6 if n < 5 else 5) for n in range(7)}
    assert "BroadcastHashJoin" not in ran(known)
    spans = questions.mentions(spark.createDataFrame([(1, "What has Name3 of name 5?")], "id int, text string"), known)
    assert sorted(r["normalized"] for r in spans.collect()) == ["name3", "name5"]
    assert "BroadcastHashJoin" not in ran(spans)
    found = questions.linked(spark.createDataFrame([(n, f"What has Name{n % 9}?") for n in range(18)], "id int, text string"), index)
    assert {r["id"] for r in found.collect()} == {n for n in range(18) if n % 9 < 7}
    assert "BroadcastHashJoin" not in ran(found).split("SortMergeJoin")[0]  # the join with the questions is the last


def test_names_meet_by_tokens_that_both_sides_have(spark, monkeypatch):
    # Names and tokens are numbers, not copied into every row, and tokens of one side only are in no list.
    kept, settled = [], compare.settled
    monkeypatch.setattr(compare, "settled", lambda df: kept.append(settled(df)) or kept[-1])
    old = spark.createDataFrame([(k, f"{c * 6}{k}") for k in range(3) for c in "abc"] + [(7, None), (None, "xyz")], "kind int, name string")
    new = spark.createDataFrame([(k, f"{c * 6}{k}") for k in range(3) for c in "cdefgh"] + [(9, "aaaaaa0"), (None, "xyz")], "kind int, name string")
    assert sorted(map(tuple, compare.similar_names(old, new).collect())) == [(k, f"cccccc{k}", f"cccccc{k}", 1.0) for k in range(3)]
    assert "string" not in {t for _, t in kept[-1].dtypes} and kept[-1].select("id").distinct().count() == 6


def test_relationship_changes_do_no_step_anew(spark):
    old, new = (spark.createDataFrame([(f"{s}{t}{k}", s, t, k) for s in "ab" for t in ts for k in "xy"], "id string, source string, target string, type string") for ts in ("cd", "de"))
    found = compare.relationship_changes(old, new)
    assert sorted((r["old_id"], r["new_id"]) for r in found.collect()) == [(f"{s}c{k}", f"{s}e{k}") for s in "ab" for k in "xy"]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join" not in plan


def test_findings_write_no_row_per_statement_and_the_listing_reads_written_drafts(spark, tmp_path, monkeypatch):
    from datetime import datetime

    from heddle.operators import graph
    from heddle.plans.registry import QUERIES

    kept, settled = [], graph.settled
    monkeypatch.setattr(graph, "settled", lambda df: kept.append(settled(df)) or kept[-1])

    put = lambda name, schema, rows: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    put("supplier", "s_suppkey long, s_name string", [(k, f"S{k}") for k in range(1, 51)])
    put("customer", "c_custkey long, c_name string", [(1, "C")])
    put("part", "p_partkey long, p_name string, p_brand string, p_type string", [(1, "part", "B", "ECONOMY TIN")])
    line = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    day = datetime(1995, 1, 1)
    # Supplier 7 has two equal statements; supplier 99 and part 5 aren't there.
    put("lineitem", line, [(k, 1, k, n, 1.0, 0.1, "R", "F", day) for n in range(1, 5) for k in [*range(1, 51), 7, 99]] + [(1, 1, 1, 9, 1.0, 0.1, "A", "F", day), (2, 5, 8, 1, 1.0, 0.1, "A", "F", day), (3, 5, 7, 1, 1.0, 0.1, "A", "F", day)])
    by_type = QUERIES["a4_findings_by_type"](spark, str(tmp_path))
    # Rejected are suppliers 7, 17 to 47: 24 statements, five relationships, and the one of supplier 7 with part 5.
    assert {r["finding_type"]: r["n"] for r in by_type.collect()} == {"DANGLING_RELATIONSHIP": 30, "POSSIBLE_DUPLICATE": 1}
    assert max(df.count() for df in kept) < 100
    listed = QUERIES["f5_findings_listing"](spark, str(tmp_path))
    assert {r["total"] for r in listed.collect()} == {31}
    plan = listed._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("Join ") == 1


def test_a_semi_join_asks_for_no_whole_relationships(spark, tmp_path):
    from datetime import datetime

    from heddle.plans.registry import QUERIES

    put = lambda name, schema, rows: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    put("supplier", "s_suppkey long, s_name string", [(1, "S")])
    put("customer", "c_custkey long, c_name string", [(1, "C")])
    put("part", "p_partkey long, p_name string, p_brand string, p_type string", [(k, f"part {k}", "B", "ECONOMY TIN") for k in (1, 2)])
    line = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    put("lineitem", line, [(k, 1, k, 1, 1.0, 0.1, "R", "F", datetime(1995, 1, 1)) for k in range(50)] + [(1, 2, 1, 2, 1.0, 0.1, "A", "F", datetime(1995, 1, 1))])
    used, unprovided = (QUERIES[q](spark, str(tmp_path)) for q in ("j11_semi_join", "j12_anti_join"))
    assert [r["id"] for r in used.collect()] == ["p1"] and [r["id"] for r in unprovided.collect()] == ["p1"]
    for df in (used, unprovided):
        assert max(rows_of(df, "Aggregate")) <= 8
    # Candidates and chunks are read from the same written rows, so only they are joined.
    valid = QUERIES["e1_validated_candidates"](spark, str(tmp_path))
    assert valid.count() == 2 and valid._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_phrases_cost_no_more_than_the_words(spark):
    # Both words of every phrase stand in each document, apart but in two: meeting documents by word made rows per phrase and document.
    words = spark.createDataFrame([(q, 0, k, 2, w) for q in range(60) for k, w in enumerate(["a", "b"])], "query int, term int, k int, of int, token string")
    found = spark.createDataFrame([(t, d, 1, [1 if t == "a" else 2 if d < 2 else 5]) for d in range(40) for t in "ab"], "token string, id int, n int, positions array<int>")
    hits = lexical_index.phrase_hits(found, words)
    assert sorted(map(tuple, hits.collect())) == sorted((q, d, 1, 2) for q in range(60) for d in (0, 1))
    assert max(rows_of(hits, "Join")) <= 120


def test_postings_read_a_text_where_it_lies(spark, monkeypatch):
    # The words of all texts went by the word through a shuffle, after a pass over the texts for the stems alone.
    import random

    import pyarrow as pa
    from pyspark.sql import functions as F

    from heddle.functions import text as X

    rng, bits = random.Random(8), ["a", "B", "3", "_", "__", "AB", "ing", "Ed", "s", "IES", "ches", "us", "e", "wheel", "Speed"]
    texts = [" ".join("".join(rng.choices(bits, k=rng.randrange(1, 5))) for _ in range(rng.randrange(12))) + rng.choice(["", "é", ".\n"]) for _ in range(200)] + ["", None, "_", "ÄB-x_Ab"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    places = {}
    for r in docs.select("id", F.posexplode(F.split(X.lexical_text(F.col("text")), " ")).alias("p", "w")).where("w <> ''").select("id", "p", X.stem(F.col("w")).alias("t")).collect():
        places.setdefault((r["t"], r["id"]), []).append(r["p"] + 1)
    as_dict = lambda rows: {(r["token"], r["id"]): r["positions"] for r in rows if r["n"] == len(r["positions"])}
    assert as_dict(lexical_index.postings(docs).collect()) == {k: sorted(x) for k, x in places.items()} and len(places) > 500
    tokens = sorted({t for t, _ in places})[::9]
    wanted = spark.createDataFrame([(t,) for t in tokens * 2], "token string")
    some = lexical_index.postings(docs, wanted)
    assert "Exchange" not in ran(some) and as_dict(some.collect()) == {k: sorted(x) for k, x in places.items() if k[0] in tokens}
    monkeypatch.setattr(lexical_index, "ASKED", len(tokens) // 3)  # several passes
    assert sorted(map(tuple, lexical_index.postings(docs, wanted).collect())) == sorted(map(tuple, some.collect()))
    monkeypatch.setattr(lexical_index, "WORDS", 5)  # several parts of a batch, spellings forgotten in between
    monkeypatch.setattr(lexical_index, "SPELLINGS", 4)
    parts = list(lexical_index._listed(None)([pa.record_batch({"id": pa.array(range(len(texts))), "text": pa.array(texts)})]))
    assert len(parts) > 50 and as_dict(r for part in parts for r in part.to_pylist()) == {k: sorted(x) for k, x in places.items()}


def test_texts_stay_where_they_lie_when_excerpts_are_looked_for(spark):
    # A text's words were found twice, and all texts went to the few places to look at.
    from heddle.operators.retrieval import find_excerpts

    docs = spark.createDataFrame([(n, f"one two w{n} three four") for n in range(50)], "doc_id long, text string")
    found = find_excerpts(docs, spark.createDataFrame([(1, "two w7 three"), (2, "two w8 four"), (3, "w9")], "item_id long, excerpt string"))
    plan = ran(found)
    assert {(r["doc_id"], r["item_id"], r["exact"]) for r in found.collect()} == {(7, 1, True), (9, 3, True)}
    assert "hashpartitioning(doc_id" not in plan


def test_texts_stay_where_they_lie_when_few_are_answered_from(spark):
    # All texts went to the three hits of each question.
    from heddle.plans.registry import QUERIES

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")  # less than the texts
    try:
        told = QUERIES["q16_extractive_answers"](spark, "/root/testdata/sf0.001")
        plan = ran(told)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "hashpartitioning(id#" not in plan and told.count() > 0


def test_all_vector_pairs_have_no_limit(spark, tmp_path):
    from heddle.plans.registry import QUERIES

    near = "array(cast(cos(id) as float), cast(sin(id) as float))"
    spark.range(20_000).selectExpr("id as vec_id", f"{near} as embedding", "0 as label").where("vec_id % 20 > 0 or vec_id < 60").write.parquet(str(tmp_path / "embeddings.parquet"))
    rows = {r["query"]: r for r in QUERIES["j16_vector_pairs"](spark, str(tmp_path)).collect()}
    assert {q: r["n"] for q, r in rows.items()} == {q: 19_003 for q in (0, 20, 40)}
    assert all(r["least"] < -0.9999 and r["most"] == 1.0 for r in rows.values())


def test_a_run_finds_its_mark_without_sorting_all_rows_in_one_task(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from heddle.operators.embedding_index import EmbeddingIndex

    kind = type(spark.range(1))
    limit = kind.limit
    monkeypatch.setattr(kind, "limit", lambda df, n: limit(df, n) if n == 1 else 1 / 0)  # a limit's rows all go to one task
    index, rows = EmbeddingIndex(spark, str(tmp_path / "e")), spark.range(0, 2000, 2).select(F.col("id"), F.col("id").cast("string").alias("content"))
    marks = [(r["total"], r["upto"]) for r in (index.run(rows, lambda c: F.array(F.length(c).cast("double")), "m", "1", 300) for _ in range(5))]
    assert marks == [(300, 598), (300, 1198), (300, 1798), (100, 1998), (0, 1998)]


def test_probes_travel_as_bits(spark, tmp_path):
    import numpy as np

    from heddle.operators.vector_index import VectorIndex

    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(rng.normal(size=(1500, 4)))], "id long, embedding array<double>")
    index = VectorIndex.build(rows, str(tmp_path / "v"), lists=20)
    unit = rng.normal(size=(1301, 4))
    bits = index._wanted(unit, 7)
    assert index._wanted(unit, 20) is None and bits.nbytes <= 20 * (1301 // 8 + 1)
    asks = np.unpackbits(bits, axis=1, count=1301)
    assert all(set(np.flatnonzero(asks[:, q])) == set(order[:7]) for q, order in enumerate(index._order(unit)))
    near = index.search(rows.selectExpr("id as query", "embedding as vector"), 1, 1)
    assert near.where("query = id").count() == 1500


def test_word_files_are_made_a_few_at_a_time(spark, tmp_path, monkeypatch):
    from heddle.plans import files
    from heddle.plans.registry import QUERIES

    seen = []
    monkeypatch.setattr(files, "stored", lambda v, rows: seen.append(rows) or 1 / 0)
    spark.range(200_000).selectExpr("id as p_partkey", "concat('part ', id) as p_name", "'B' as p_brand").write.parquet(str(tmp_path / "part.parquet"))
    try:
        QUERIES["s7_docx_blocks"](spark, str(tmp_path))
    except ZeroDivisionError:
        pass
    assert "MapInArrow" in seen[0]._jdf.queryExecution().executedPlan().toString() and seen[0].count() == 200


def rows_of(df, kind):
    """How many rows each operator of that kind made."""
    df.collect()
    out, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        at = todo.pop()
        name = at.getClass().getSimpleName()
        todo += [at.executedPlan()] if name == "AdaptiveSparkPlanExec" else [at.plan()] if name.endswith("QueryStageExec") else [at.children().apply(k) for k in range(at.children().size())]
        if kind in name and at.metrics().contains("numOutputRows"):
            out.append(at.metrics().apply("numOutputRows").value())
    return out
