"""The five stages on a small fixture, each held against brute force on its own input."""

from __future__ import annotations

import random

import corpus_pipeline
from heddle.llm import quality
from tests.llm.test_operators import DOCS, brute_components, brute_fit, brute_line_dedup, prose


def test_stages(spark, tmp_path):
    rng = random.Random(21)
    line, item = prose(rng, 30), " ".join(f"q{k}x" for k in range(30))
    rows = []
    for k in range(120):
        text = "\n".join([prose(rng, 70), *([line] if k % 4 == 0 else []), prose(rng, 40)])
        if k % 10 == 9:
            text = rows[-1][1].replace("\n", " ").replace("ka", "kaa", 1)
        if k % 15 == 2:
            text += "\n" + prose(rng, 5) + " " + item.replace("q7x", "changed")
        if k % 20 == 5:
            text = "short one"
        if k % 20 == 6:
            text = rows[1][1]
        rows.append((k, text, "en", "hot" if k % 3 else "cold", len(text)))
    rows += [(200, None, None, None, None), (201, "", "en", None, 0), rows[0], (0, rows[0][1], "de", None, 1), (None, prose(rng, 60), "en", "hot", 3), (None, prose(rng, 60), None, None, None)]
    folder = str(tmp_path)
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, docs.limit(0), folder).count() == 0
        loose = sorted(r["text"] for r in docs.where("doc_id is null").collect())
        before = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] is not None]
        stage(spark, docs, folder).write.parquet(f"{folder}/{k}.parquet")
        docs = spark.read.parquet(f"{folder}/{k}.parquet")
        after = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] is not None}
        assert sorted(r["text"] for r in docs.where("doc_id is null").collect()) == loose  # clean, and copies of nothing
        assert docs.where("doc_id = 0").count() == (3 if k < 2 else 1)
        if name == "quality_rules":
            assert after.keys() == {i for i, t in before if len((t or "").split()) >= 50}
        elif name == "line_dedup":
            want = brute_line_dedup(before, 10)
            assert after == {i: t for i, t in want.items() if t.split()}
            assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
        elif name == "near_dedup":
            assert after == {i: t for i, t in before if brute_components(before, 5, 80)[i][2]}
        elif name == "decontamination":
            assert after == {i: t for i, t in before if brute_fit(item.split(), t.lower().split()) > 6}
            assert len(after) < len(before)
        else:
            assert after == dict(before)
        assert docs.columns[: len(columns)] == columns
    assert [(r["mix_slot"], r["mix_offset"]) for r in corpus_pipeline.run(spark, folder).collect()] == sorted((r["mix_slot"], r["mix_offset"]) for r in docs.collect())
    assert quality.quality_filter(docs.limit(0).select(columns)).count() == 0
