"""Scalar functions and folds against their stated results."""

from __future__ import annotations

import io
import random
import zipfile
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from heddle.functions import fuzzy, vectors
from heddle.functions import text as X
from heddle.operators import compare, graph, ingest, questions, resolve, retrieval
from heddle.sources import files, markup


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("name", "tokens", "core", "numbers"),
    [("P_WheelSpeed_In", ["p", "wheel", "speed", "in"], ["p", "wheel", "speed", "in"], []), ("ABSModule2", ["abs", "module", "2"], ["abs", "module"], ["2"]), ("BrakeInterface_V1", ["brake", "interface", "v", "1"], ["brake", "v"], ["1"]), ("", [], [], [])],
)
def test_names(spark, name, tokens, core, numbers):
    got = spark.createDataFrame([(name,)], "n string").select(X.name_tokens(F.col("n")).alias("a"), X.core_tokens(F.col("n")).alias("b"), X.number_tokens(F.col("n")).alias("c")).first()
    assert (got["a"], got["b"], got["c"]) == (tokens, core, numbers)


def test_identifiers_and_terms(spark):
    assert one(spark, X.split_identifier(F.col("t")), t="ABSModule") == ["abs", "module"]
    assert one(spark, X.lexical_text(F.col("t")), t="The P_WheelSpeed_In port") == "the p wheelspeed in port pwheelspeedin p wheel speed in"
    terms = one(spark, X.query_terms(F.col("t")), t="What does the BrakeController of ECU use? brakecontroller")
    assert [(t["joined"], t["words"]) for t in terms] == [("brakecontroller", ["brake", "controller"]), ("ecu", []), ("use", [])]
    assert one(spark, X.search_expression(X.query_terms(F.col("t"))), t="BrakeController speed") == "(brakecontroller | (brake <-> controller)) | speed"
    assert one(spark, X.matched_term_ratio(X.query_terms(F.col("t")), F.col("l")), t="wheel speeds missing", l="the wheel speed") == pytest.approx(2 / 3)
    assert one(spark, X.opposite_qualifier(F.col("a"), F.col("b")), a="WheelSpeed_FL", b="WheelSpeed_FR") is True
    assert one(spark, X.canonical_relationship_type(F.col("t")), t=" sends_to ") == "SENDS_TO"
    assert one(spark, X.normalize_type(F.col("t")), t="software-component") == "SOFTWARE_COMPONENT"
    assert one(spark, X.normalize_name(F.col("t")), t="Straße_1") == "strasse1"


def test_text(spark):
    assert [one(spark, X.stem(F.col("w")), w=w) for w in ("computes", "computed", "compute", "bodies", "classes", "bus", "running")] == ["comput", "comput", "comput", "body", "class", "bus", "runn"]
    assert one(spark, X.sentences(F.col("t")), t="First is 1.5 ms. Second one! third? Fourth.") == ["First is 1.5 ms.", "Second one! third?", "Fourth."]
    assert one(spark, X.values_in(F.col("t")), t="10 ms or 0xF190, 3.5 V") == ["10 ms", "0xf190", "3.5 v"]
    assert one(spark, X.split_number(F.col("t")), t="1.2 Interfaces").asDict() == {"number": "1.2", "title": "Interfaces"}
    assert one(spark, X.citation_ids(F.col("t")), t="[chunk:0F0E0D0C-0000-4000-8000-000000000001] again 0f0e0d0c-0000-4000-8000-000000000001") == ["chunk:0f0e0d0c-0000-4000-8000-000000000001"]
    assert one(spark, X.safe_filename(F.col("t")), t="..\\a/b.md") == "b.md" and one(spark, X.safe_filename(F.col("t")), t="a/..") is None
    assert one(spark, X.safe_cell(F.col("t")), t="=1+1") == "'=1+1"
    assert one(spark, X.section_key(F.col("t")), t="1 Scope > 1.2 Timing") == "scope > timing"
    assert one(spark, X.redact(F.col("t")), t="Bearer abc token=xyz") == "Bearer [REDACTED] token=[REDACTED]"
    at = one(spark, fuzzy.excerpt_offsets(F.col("t"), F.col("e")), t="The **Brake**  Controller", e="the brake controller")
    assert (at["start"], at["stop"], at["exact"]) == (0, 25, False)


def test_vectors(spark):
    assert one(spark, vectors.trigram_similarity(F.col("a"), F.col("b")), a="word", b="two words") == pytest.approx(4 / 11)
    zero = spark.range(1).select(vectors.l2_normalize(F.array(F.lit(0.0), F.lit(0.0))).alias("x"), vectors.l2_normalize(F.array(F.lit(3.0), F.lit(4.0))).alias("y")).first()
    assert zero["x"] == [0, 0] and zero["y"] == pytest.approx([0.6, 0.8])


MARKDOWN = b"""Intro line
goes on.
Next paragraph

# 1 Scope
Text here.

- item one
  continued
- item two

| a | b |
|---|---|
| 1 | 2 |

```
code | x
```
## 1.1 Sub ##
End.
"""


def test_markdown():
    blocks = markup.read_markdown(MARKDOWN)
    assert [(b.kind, b.text, b.level) for b in blocks] == [
        ("TEXT", "Intro line goes on.", None), ("TEXT", "Next paragraph", None), ("HEADING", "1 Scope", 1), ("TEXT", "Text here.", None), ("TEXT", "- item one continued\n- item two", None),
        ("TABLE", "| a | b |\n| --- | --- |\n| 1 | 2 |", None), ("TEXT", "code | x", None), ("HEADING", "1.1 Sub", 2), ("TEXT", "End.", None),
    ]
    assert MARKDOWN[blocks[2].start : blocks[2].stop] == b"# 1 Scope\n"


def test_markdown_runs():
    texts = lambda t: [(b.kind, b.text) for b in markup.read_markdown(t)]
    assert texts(b"- a\nprose\nlower goes on\n  Indented starts anew\n  and goes on\n") == [("TEXT", "- a"), ("TEXT", "prose lower goes on"), ("TEXT", "Indented starts anew and goes on")]
    assert texts(b"```\n# no heading\n\n```\n~~~\nleft open") == [("TEXT", "# no heading\n"), ("TEXT", "left open")]
    assert texts(b"") == texts(b"\n \n") == texts(b"|---|\n") == []


def test_numbered_headings():
    number = lambda text: ingest._number(text)
    accepted = lambda line, last: ingest.numbered_heading(line, last and number(last)) is not None
    assert accepted("7 Any first number", None) and accepted("1.1 Below", "1") and accepted("4 Three on", "1.2") and accepted("1.4 Sibling", "1.2.9") and accepted("A.2 Letter", "A.1")
    assert not accepted("5 Four on", "1") and not accepted("1.2 Skips one", "1") and not accepted("1 Again", "1") and not accepted("1.1.1 Two below", "1")
    assert not accepted("2 ends in a full stop.", "1") and not accepted("2 lower case", "1") and not accepted("2 One. Two. Three", "1") and not accepted("2 " + "Word " * 17, "1") and not accepted("2 " + "W" * 111, "1")


def test_office_readers_and_workbook_round_trip():
    book = markup.write_xlsx({"First": [["a", "b"], ["1", "<&>"]], "Second": [["x"]]})
    assert [(b.kind, b.text) for b in markup.read_xlsx(book)] == [("HEADING", "First"), ("TABLE", "| a | b |\n| --- | --- |\n| 1 | <&> |"), ("HEADING", "Second"), ("TABLE", "| x |\n| --- |")]
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    p = lambda text, style: f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>'
    body = p("Title it", "Title") + p("Part", "Heading2") + p("plain", "Normal") + p("one", "ListBullet") + p("two", "ListBullet") + "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>h</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    assert [(b.kind, b.text, b.level) for b in markup.read_docx(out.getvalue())] == [("HEADING", "Title it", 0), ("HEADING", "Part", 2), ("TEXT", "plain", None), ("TEXT", "- one\n- two", None), ("TABLE", "| h |\n| --- |", None)]
    assert markup.read_csv(b"\xef\xbb\xbfa,b\n\n1,2\n")[0].text.startswith("| a | b |")


def test_scan_and_uploads(spark, tmp_path):
    (tmp_path / "a.md").write_bytes(MARKDOWN)
    (tmp_path / "bad.xlsx").write_bytes(b"PKnothing")
    rows = files.read_blocks(files.scan(spark, str(tmp_path)))
    assert rows.where("problem is null").count() == 9 and rows.where("problem is not null").count() == 1
    checked = spark.createDataFrame([("a.pdf", "application/pdf", bytearray(b"%PDF-1")), ("a.pdf", "application/pdf", bytearray(b"nope!")), ("a.md", "text/plain; charset=utf-8", bytearray(b"x")), ("..", "text/plain", bytearray(b"x")), ("a.exe", "x", bytearray(b"x")), ("a.md", "text/plain", bytearray(b""))], "n string, m string, c binary")
    got = [r["x"] for r in checked.select(files.upload_problem(F.col("n"), F.col("m"), F.col("c")).alias("x")).collect()]
    assert got == [None, "not a PDF file", None, "bad file name", "unsupported file type", "empty file"]
    flat = files.flat(spark.createDataFrame([(["a", "=b"], [(1,)], "=x")], "l array<string>, s array<struct<i:int>>, t string")).first()
    assert tuple(flat) == ("a; =b", "1 passage(s)", "'=x")


def test_layout_lines(spark):
    lines = [("d", p, 5.0 if k == 0 else 95.0 if k == 3 else 50.0, 100.0, t) for p in range(1, 5) for k, t in enumerate([f"Manual rev {p}", f"Body {'abcd'[p - 1]} text", "Contents ..... 4" if p == 1 else f"more {'wxyz'[p - 1]}", str(p)])]
    left = files.running_lines(spark.createDataFrame(lines, "doc string, page int, y double, page_height double, text string"))
    assert sorted(r["text"] for r in left.collect()) == sorted([f"Body {c} text" for c in "abcd"] + [f"more {c}" for c in "xyz"])
    fonts = spark.createDataFrame([("d", 0, 16.0, False, "1 Scope"), ("d", 1, 10.0, False, "long body text " * 9), ("d", 2, 13.0, False, "Details")], "doc string, n int, size double, bold boolean, text string")
    assert {(r["n"], r["level"]) for r in files.font_headings(fonts).collect()} == {(0, 1), (2, 2)}


def test_sections_and_chunks(spark):
    blocks = [(b.kind, b.text, b.level) for b in markup.read_markdown(MARKDOWN)]
    got = ingest.sections(blocks, True)
    assert [(s[0], s[1], s[2], s[5]) for s in got] == [(1, None, 0, ""), (2, None, 1, "Scope"), (3, 2, 2, "Scope > Sub")]
    plain = ingest.sections([("TEXT", "1 Scope\nbody text\n1.1 Detail\nmore\n3 Later\n9 Not a heading because of skips", None)], False)
    assert [s[5] for s in plain] == ["Scope", "Scope > Detail", "Later"]
    text = " ".join(f"Sentence number {k} has words." for k in range(400))
    chunks = ingest.chunk_section([("TEXT", text)], 100, 200, 30)
    assert all(ingest.n_tokens(c) <= 200 for _, c in chunks)
    joined = " ".join(c for _, c in chunks)
    assert all(f"number {k} has" in joined for k in range(400))
    table = "| h |\n| --- |\n" + "\n".join(f"| row {k} |" for k in range(300))
    parts = ingest.chunk_section([("TABLE", table)], 100, 120, 10)
    assert len(parts) > 1 and all(c.startswith("| h |\n| --- |") and k == "TABLE" for k, c in parts)
    with pytest.raises(ValueError, match="overlap"):
        ingest.chunk_section([], 10, 10, 10)
    rows = spark.createDataFrame([("d", k, *b, "markdown") for k, b in enumerate(blocks)], "doc string, n int, kind string, text string, level int, source string")
    assert [r["path"] for r in ingest.chunk_documents(rows).orderBy("section", "chunk").collect()] == ["", "Scope", "Scope > Sub"]


def test_clusters_equal_a_walk_over_all_edges(spark):
    """Random graphs with forbidden pairs, against taking one edge after the other."""
    rng = random.Random(12)
    edges, no, want, refused = [], [], {}, set()
    for component in range(6):
        ids = [f"{component}{chr(97 + k)}" for k in range(9)]
        own = [(f"k{component}", a, b, rng.randrange(2), rng.randrange(80, 100) / 100, f"{rng.random()}") for k, a in enumerate(ids) for b in ids[k + 1 :] if rng.random() < 0.5]
        bad = {frozenset(rng.sample(ids, 2)) for _ in range(5)}
        edges += own
        no += [(f"k{component}", *sorted(p), f"never {k}") for k, p in enumerate(bad)]
        group = {x: {x} for e in own for x in e[1:3]}
        for e in sorted(own, key=lambda e: (e[3], -e[4], e[5])):
            left, right = group[e[1]], group[e[2]]
            if left is right:
                continue
            if any(frozenset((x, y)) in bad for x in left for y in right):
                refused.add(e[1:3])
                continue
            left |= right
            for x in right:
                group[x] = left
        want |= {x: min(g) for x, g in group.items()}
    both = [x for _, a, b, why in no if a in want and b in want for x in ((a, b, why), (b, a, why))]
    frames = spark.createDataFrame(edges, "component string, a string, b string, priority int, similarity double, pair_key string"), spark.createDataFrame(no, "component string, a string, b string, reason string")
    sizes = sorted(sum(r[0] == f"k{c}" for r in [*edges, *no]) for c in range(6))
    pair = lambda r: (r["a"], r["b"])
    # All in tasks, some of them and none; the last asks for a refusal's reason too.
    for in_task in (50_000, sizes[2], 0):
        rows = resolve.cluster(*frames, in_task).collect()
        assert {r["id"]: r["grp"] for r in rows if r["id"]} == want and sum(r["id"] is not None for r in rows) == len(want)
        assert {pair(r) for r in rows if not r["id"]} == refused
        for r in rows:
            if not r["id"]:
                reasons = [(x, y, why) for x, y, why in both if (want[x], want[y]) == (want[r["a"]], want[r["b"]])]
                assert r["reason"] == min(reasons)[2]


def test_clusters_are_permutation_invariant(spark):
    pairs = [("k", "a", "b", 0, 0.9, "1"), ("k", "b", "c", 1, 0.95, "2"), ("k", "c", "d", 0, 0.7, "3")]
    no = spark.createDataFrame([("k", "a", "c", "never")], "component string, a string, b string, reason string")
    results = set()
    for seed in range(3):
        random.Random(seed).shuffle(pairs)
        rows = resolve.cluster(spark.createDataFrame(pairs, "component string, a string, b string, priority int, similarity double, pair_key string"), no)
        results.add(tuple(sorted(map(str, rows.collect()))))
    assert len(results) == 1 and "never" in str(results)


def test_guards_and_scores(spark):
    names = [("BrakeInterface_V1", "BrakeInterface_V2"), ("WheelSpeed_FL", "WheelSpeed_FR"), ("Wheel Speed Sensor", "WSS"), ("Brake Control", "Brake Control Unit"), ("Same_Name", "samename")]
    rows = spark.createDataFrame([(f"a{k}", f"b{k}", a, b) for k, (a, b) in enumerate(names)], "a string, b string, name_a string, name_b string")
    for s in "ab":
        rows = rows.withColumn(f"normalized_{s}", X.normalize_name(F.col(f"name_{s}"))).withColumn(f"entity_type_{s}", F.lit("SIGNAL")).withColumn(f"state_{s}", F.lit("PENDING"))
    reasons = [r["x"] for r in rows.select(resolve.guard(rows).alias("x")).collect()]
    assert reasons[0] == "version or index numbers differ" and reasons[1] == "names differ by opposite qualifiers" and reasons[2:] == [None] * 3
    got = {r["a"]: r for r in resolve.scored(rows).collect()}
    assert got["a2"]["similarity"] >= 0.8 and got["a3"]["similarity"] >= 0.75 and got["a4"]["decisive"] == "EXACT_NAME"


def test_comparison():
    values = lambda s: [w for w in s.split() if w.isdigit()]
    got = compare.diff_statements(["The limit is 10 ms always.", "Stays.", "Goes away entirely now."], ["The limit is 20 ms always.", "Stays.", "Brand new content xyz."], values)
    assert ("CHANGED", "The limit is 10 ms always.", "The limit is 20 ms always.") in got


def test_ratios_of_many_pairs_are_difflibs(monkeypatch):
    rng = random.Random(4)
    text = lambda: "".join(rng.choice("aab cdé\U0001f600" if rng.random() < 0.5 else "ab") for _ in range(rng.choice([0, 1, 5, 30, 64, 65, 130, 199, 200, 230])))
    left, right = ([text() for _ in range(25)] for _ in "ab")
    right += [t[3:] + t[:9] for t in left]
    x, y = (np.array(c) for c in zip(*[(a, b) for a in range(len(left)) for b in range(len(right))], strict=True))
    want = np.array([SequenceMatcher(None, left[a], right[b]).ratio() for a, b in zip(x, y, strict=True)])
    for words in (fuzzy.WORDS, 40):
        monkeypatch.setattr(fuzzy, "WORDS", words)
        assert (fuzzy.sequence_ratios(left, right, x, y, 0.0) == want).all()
        half = fuzzy.sequence_ratios(left, right, x, y, 0.5)
        assert ((half == want) | (want < 0.5)).all() and (half < 0.5).tolist() == (want < 0.5).tolist()
    monkeypatch.setattr(compare, "SequenceMatcher", lambda *texts, **_: SequenceMatcher(*texts, autojunk=False) if len(texts) == 3 and isinstance(texts[1], list) else 1 / 0)
    assert len(compare.diff_statements(left, right, len)) >= len(right)  # short statements of a block are compared together, not one by one


def test_questions(spark):
    index = spark.createDataFrame([("brakecontroller", "e1"), ("controller", "e2"), ("wheelspeed", "e3"), ("wheelspeed", "e4")], "normalized string, entity string")
    asked = spark.createDataFrame([(1, "Does the Brake Controller need wheel speed?")], "id long, text string")
    assert [(r["entity"], r["ambiguous"]) for r in questions.linked(asked, index).orderBy("start", "entity").collect()] == [("e1", False), ("e3", True), ("e4", True)]


def test_question_files(spark):
    one = '{"questions": [{"id": "q1", "category": "fact", "question": "What?", "answerable": false, "expected_sections": ["1 Scope"], "expected_terms": ["a", "b"]}, {"id": "q2", "question": "Why?"}]}'
    rows = retrieval.question_rows(spark.createDataFrame([("a.json", bytearray(one.encode())), ("b.json", bytearray(b'[{"id": "q3", "question": "Who?", "answerable": true}]'))], "path string, content binary")).collect()
    assert [(r["id"], r["answerable"], r["expected_sections"], r["expected_terms"]) for r in sorted(rows)] == [("q1", False, ["1 Scope"], ["a", "b"]), ("q2", True, [], []), ("q3", True, [], [])]


def test_joined_lines(spark):
    lines = ["A wrapped line that is bro-", "ken goes on", "here.", "- an item", "and its rest", "2.1 Next Heading", "stands alone before this", "and that"]
    got = spark.createDataFrame([(lines,), ([],)], "l array<string>").select(X.joined_lines(F.col("l")).alias("x")).collect()
    assert got[0]["x"].split("\n") == ["A wrapped line that is broken goes on here.", "- an item and its rest", "2.1 Next Heading", "stands alone before this and that"] and got[1]["x"] == ""


def test_table_markdown_of_no_rows(spark):
    rows = spark.createDataFrame([([["", ""]],), ([],), ([["a"]],)], "r array<array<string>>")
    assert [r["x"] for r in rows.select(X.table_markdown(F.col("r")).alias("x")).collect()] == ["", "", "| a |\n| --- |"]


def test_first_arrivals_equal_the_shortest_of_all_paths(spark):
    """On random graphs: least depths of nodes and edges, and the smallest shortest path of each node."""
    rng = random.Random(31)
    edges = [(f"e{k:02}", f"n{rng.randrange(9)}", f"n{rng.randrange(9)}", rng.choice(["USES", "PROVIDES"])) for k in range(24)]
    frame, roots = spark.createDataFrame(edges, "id string, source string, target string, type string"), spark.createDataFrame([("n0",), ("n4",)], "root string")
    for out_types, in_types in ((None, None), (["USES"], ["PROVIDES"])):
        every, first = (f(frame, roots, 3, out_types, in_types) for f in (graph.traverse, graph.reach))
        least = lambda rows, c: {(r["root"], r[c]): r["d"] for r in rows.where("node <> root or id is not null and '" + c + "' = 'id'").groupBy("root", c).agg(F.min("depth").alias("d")).collect()}
        assert least(every, "id") == least(first, "id") and least(every, "node") == least(first, "node")
        paths = lambda rows: {(r["root"], r["node"]): r["x"]["path"] for r in rows.where("node <> root").groupBy("root", "node").agg(F.min(F.struct("depth", "path")).alias("x")).collect()}
        assert paths(every) == paths(first)


def test_statements_of_all_blocks_are_compared_together_and_far_ones_not_matched(monkeypatch):
    # Each block had calls of its own, and all pairs with enough common letters were matched.
    rng = random.Random(12)
    words = ["volt", "limit", "of", "the", "bus", "größe", "x", "pump", "is", "not"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    near = lambda t: t[: len(t) // 3] + rng.choice(words) + t[len(t) // 2 :]
    pairs = [([a := text(rng.choice([1, 8, 30, 90])), text(5), text(60)], [near(a), text(6), "", text(70)]) for _ in range(30)]
    calls = []
    count = lambda f, n: lambda *a: calls.append(n) or f(*a)
    monkeypatch.setattr(fuzzy, "sequence_ratios", count(fuzzy.sequence_ratios, "ratios"))
    found = compare.diffs_of_statements(pairs, len)
    assert calls == ["ratios"]
    for (old, new), got in zip(pairs, found, strict=True):
        rest, want = list(new), []
        for before in old:
            ratios = [SequenceMatcher(None, before, after).ratio() for after in rest]
            if ratios and max(ratios) >= compare.PAIRING:
                want.append((before, rest.pop(ratios.index(max(ratios)))))
        assert [(b, a) for _, b, a in got if None not in (a, b)] == want
    sides = [[text(n) for n in (0, 1, 2, 9, 20, 33, 34, 50, 80, 200) for _ in range(4)] for _ in "ab"]
    x, y = (c.ravel() for c in np.meshgrid(np.arange(40), np.arange(40), indexing="ij"))
    want = np.array([SequenceMatcher(None, sides[0][a], sides[1][b]).ratio() for a, b in zip(x, y, strict=True)])
    for few in (0, 1 << 30):  # all together, and all one by one
        monkeypatch.setattr(fuzzy, "FEW", few)
        got = fuzzy.sequence_ratios(*sides, x, y, 0.45)
        assert np.where(want >= 0.45, got == want, got < 0.45).all() and (want >= 0.45).sum() > 50
        assert (fuzzy.sequence_ratios(*sides, x, y, 0.0) == want).all()
    monkeypatch.setattr(fuzzy, "_matched", lambda *a: 1 / 0)
    monkeypatch.setattr(fuzzy, "_matched_far", lambda *a: 1 / 0)
    assert not fuzzy.sequence_ratios(["abcdefgh" * 40, "abcdefgh"], ["hgfedcba" * 40, "hgfedcba"], np.array([1, 1]), np.array([1, 0]), 0.6).any()
