"""The file store and the embedding index: commits, losses, runs over growing tables."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from heddle.operators import ingest
from heddle.operators.embedding_index import EmbeddingIndex
from heddle.sources import datasource, markup


def rows(spark, path, **options):
    return spark.read.format(datasource.FORMAT).options(**options).load(str(path))


def test_store_shows_what_is_committed(spark, tmp_path):
    datasource.register(spark)
    frame = spark.createDataFrame([("a.md", b"# One\n\nText."), ("b/c.md", b"# One\n\nText."), ("d.csv", b"x,y\n1,2\n"), ("e", b"")], "path string, content binary").repartition(3)
    frame.write.format(datasource.FORMAT).mode("append").save(str(tmp_path))
    got = {(r["path"], bytes(r["content"])) for r in rows(spark, tmp_path).collect()}
    assert got == {("a.md", b"# One\n\nText."), ("b/c.md", b"# One\n\nText."), ("d.csv", b"x,y\n1,2\n"), ("e", b"")}
    keys = {r["path"]: r["key"] for r in rows(spark, tmp_path).collect()}
    assert keys["a.md"] == keys["b/c.md"] and "a.md" not in keys.values()  # equal contents are stored once, under a key that says nothing
    # What a lost job left, files and a list without a commit, isn't seen.
    (tmp_path / "_lists" / "lost.json").write_text(json.dumps([["x.md", "nowhere.md"]]))
    (tmp_path / "stray.md").write_text("# Stray")
    assert rows(spark, tmp_path).count() == 4
    frame.limit(1).write.format(datasource.FORMAT).mode("overwrite").save(str(tmp_path))
    assert rows(spark, tmp_path).count() == 1
    assert not list(tmp_path.glob("**/*.part"))


def test_plain_folders_and_blocks(spark, tmp_path):
    datasource.register(spark)
    assert rows(spark, tmp_path).count() == 0
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.docx").write_bytes(markup.write_docx([("Heading1", "A & B"), ("", "Plain <text>."), ("ListParagraph", "one"), ("ListParagraph", "two"), ("table", [["k", "v"], ["1", "x"]])]))
    (tmp_path / "broken.docx").write_bytes(b"no zip")
    (tmp_path / "_hidden.md").write_text("# no")
    got = [(r["path"], r["n"], r["kind"], r["text"]) for r in rows(spark, tmp_path, **{"as": "blocks"}).where("problem is null").orderBy("n").collect()]
    assert got == [("sub/a.docx", 0, "HEADING", "A & B"), ("sub/a.docx", 1, "TEXT", "Plain <text>."), ("sub/a.docx", 2, "TEXT", "- one\n- two"), ("sub/a.docx", 3, "TABLE", "| k | v |\n| --- | --- |\n| 1 | x |")]
    assert [r["path"] for r in rows(spark, tmp_path, **{"as": "blocks"}).where("problem is not null").collect()] == ["broken.docx"]


def test_empty_store(spark, tmp_path):
    datasource.register(spark)
    spark.createDataFrame([], "path string, content binary").write.format(datasource.FORMAT).mode("append").save(str(tmp_path))
    assert rows(spark, tmp_path).count() == 0


def test_second_run_embeds_the_difference_only(spark, tmp_path):
    table = [(1, "a"), (2, "b"), (3, "a"), (5, None), (7, "c")]
    frame = lambda t: spark.createDataFrame(t, "id long, content string")
    index = EmbeddingIndex(spark, f"file://{tmp_path}/index")
    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def embed(text):
        seen.add(1)
        return [float(ord(text[0]))]

    first = index.run(frame(table), embed, "m", "1")
    assert {k: first[k] for k in ("after", "upto", "total", "reused", "computed")} == {"after": None, "upto": 7, "total": 4, "reused": 1, "computed": 3} and seen.value == 3
    table += [(8, "b"), (9, "d"), (10, "d")]
    second = index.run(frame(table), embed, "m", "1")
    assert {k: second[k] for k in ("after", "upto", "total", "reused", "computed")} == {"after": 7, "upto": 10, "total": 3, "reused": 2, "computed": 1} and seen.value == 4
    third = index.run(frame(table), embed, "m", "1")
    assert (third["total"], third["computed"], third["upto"]) == (0, 0, 10)
    # Another version starts anew, and shares nothing with the first.
    other = index.run(frame(table), embed, "m", "2", most=2)
    assert (other["after"], other["upto"], other["computed"]) == (None, 2, 2)
    assert {(r["id"], r["embedding"][0]) for r in index.embedded(frame(table), "m", "2").collect()} == {(1, 97.0), (2, 98.0), (3, 97.0), (8, 98.0)}
    assert index.embedded(frame(table), "m", "1").count() == 7 and index.vectors("m", "1").count() == 4
    # A run whose row was lost finds its vectors again.
    index.spark.createDataFrame([("x" * 64, [0.0], "m", "3")], "content_hash string, embedding array<double>, model string, version string").write.mode("append").parquet(f"file://{tmp_path}/index/vectors")
    assert index.run(frame([(1, "z")]), embed, "m", "3")["computed"] == 1
    with pytest.raises(Exception):
        index.run(frame([(1, "")]), embed, "m", "4")
    assert index.run(frame([(1, "y")]), embed, "m", "4")["run"] == 6


def test_revision_tables(spark):
    head = ["Version", "Date", "Author"]
    tables = [
        ("a", 2, [head, ["1", "2024", "x"], ["", " ", None], ["2", "2025"]]), ("a", 1, [["Name", "Date", "Author"], ["1", "2", "3"]]), ("a", 3, [head, ["9", "9", "9"]]),
        ("b", 1, [["Version", "Date"], ["1", "2"]]), ("c", 1, [head]), ("d", 1, []), ("e", 1, [["rev date", "Date", "by"], ["a  b", "c", "d" * 300]]), ("f", 1, [head, *([str(k), "d", "e"] for k in range(150))]),
        ("g", 1, [["by", "description", None, "date", "version"], ["p", "q", "r", "s", "t"]]),
    ]
    got = ingest.revisions(spark.createDataFrame(tables, "doc string, n int, rows array<array<string>>")).collect()
    by = lambda doc: [tuple(r)[1:] for r in sorted(got, key=lambda r: r["k"]) if r["doc"] == doc]
    assert by("a") == [(1, "1", "2024", None, "x"), (2, "2", "2025", None, None)]
    assert by("e") == [(1, "a b", "c", None, "d" * 200)] and by("g") == [(1, "t", "s", "q", "p")]
    assert not by("b") and not by("c") and not by("d") and len(by("f")) == 100


def test_tables_as_text():
    assert markup.table_text([["a", "b  c"], [], ["", ""], ["1"], ["x", "y", "z"]]) == "| a | b c |  |\n| --- | --- | --- |\n| 1 |  |  |\n| x | y | z |"
    assert markup.table_text([]) == markup.table_text([["", ""]]) == ""
