"""Indexes, spelling links and section pairs against walks that look at everything."""

from __future__ import annotations

import random
import re
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import pytest

from heddle.operators import answers, compare, lexical_index, questions
from heddle.operators.graph import kept_folder
from heddle.operators.vector_index import VectorIndex

# ---- vectors


def vectors(n: int, width: int = 12):
    rng = np.random.default_rng(4)
    middle = rng.normal(size=(9, width))
    return [(k, [float(x) for x in middle[k % 9] + rng.normal(size=width) * 0.4]) for k in range(n)]


def exact(rows, query, k):
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    scores = [(-round(float(unit(query) @ unit(v)), 9), i) for i, v in rows]
    return [i for _, i in sorted(scores)[:k]]


def test_vector_index(spark):
    rows = vectors(600)
    odd = [(1000, [0.0] * 12), (1001, None), (1002, [None] + [1.0] * 11)]
    frame = spark.createDataFrame(rows[:500] + odd, "id long, embedding array<double>")
    index = VectorIndex.build(frame, kept_folder(spark, "test"), lists=16)
    index.add(spark.createDataFrame(rows[500:], "id long, embedding array<double>"))
    asked = [(q, rows[q][1]) for q in range(0, 600, 20)] + [(9999, [0.0] * 12), (9998, None)]
    queries = spark.createDataFrame(asked, "query long, vector array<double>")
    whole = index.search(queries, 10).collect()
    for q, v in asked[:-2]:
        assert [r["id"] for r in sorted(whole, key=lambda r: r["rank"]) if r["query"] == q] == exact(rows, v, 10)
    assert {r["query"] for r in whole} == {q for q, _ in asked[:-2]}
    probes = index.tuned_probes(10, 0.95)
    assert 1 <= probes < 16
    near = {(r["query"], r["id"]) for r in index.search(queries, 10, probes).collect()}
    assert len(near & {(r["query"], r["id"]) for r in whole}) >= 0.9 * len(whole)


def test_vector_index_of_nothing(spark):
    with pytest.raises(ValueError, match="direction"):
        VectorIndex.build(spark.createDataFrame([(1, [0.0])], "id long, embedding array<double>"), kept_folder(spark, "test"))


# ---- phrases


def cover_walk(places: dict[int, set], phrases: list[list], singles: set) -> int:
    """Covers as a scan finds them: the least end from a start on, then the last start for that end, then on behind that start."""
    last, at, n = max(places, default=0), 1, 0
    while True:
        found = None
        for end in range(at, last + 1):
            starts = [end] if places.get(end, set()) & singles else []
            starts += [end - len(p) + 1 for p in phrases if end - len(p) + 1 >= at and all(w in places.get(end - len(p) + 1 + k, set()) for k, w in enumerate(p))]
            if starts:
                found = max(starts)
                break
        if found is None:
            return n
        n, at = n + 1, found + 1


def test_covers_equal_a_walk(spark):
    rng = random.Random(3)
    alphabet = ["abba", "bolt", "crank", "drum", "egret"]
    docs = [(k, " ".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 40)))) for k in range(40)]
    asked = []
    for q in range(12):
        identifiers = ["".join(w.capitalize() for w in rng.sample(alphabet, rng.randrange(2, 4))) for _ in range(rng.randrange(1, 4))]
        asked.append((q, " ".join([*identifiers, *rng.sample(alphabet, rng.randrange(0, 2))])))
    frames = spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(asked, "query long, text string")
    want = {}
    for q, text in asked:
        terms = text.split()
        phrases = list({t: [x.lower() for x in re.findall("[A-Z][a-z]+", t)] for t in terms if t[0].isupper()}.values())
        singles = {t.lower() for t in terms}
        for d, words in docs:
            n = cover_walk({i + 1: {w} for i, w in enumerate(words.split())}, phrases, singles)
            if n:
                want[q, d] = n
    got = {(r["query"], r["id"]): r["n_covers"] for r in lexical_index.lexical_channel(*frames, k=1000).collect()}
    assert got == want and len(got) > 100
    kept = lexical_index.LexicalIndex.build(frames[0].where("id < 30"), kept_folder(spark, "test"), parts=3)
    kept.add(frames[0].where("id >= 30"))
    assert {(r["query"], r["id"]): r["n_covers"] for r in kept.search(frames[1], 1000).collect()} == want


def test_a_task_keeps_the_best_texts_of_each_query(spark, monkeypatch):
    rng = random.Random(4)
    alphabet = ["abba", "bolt", "crank", "drum", "egret", "flint"]
    docs = [(rng.randrange(60), " ".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 30)))) for _ in range(90)]  # ids with several texts
    asked = [(q, " ".join(["".join(w.capitalize() for w in rng.sample(alphabet, 2)), *rng.sample(alphabet, 2)])) for q in range(20)]
    frames = spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(asked, "query long, text string")
    row = lambda r: (r["query"], r["id"], r["n_covers"], r["n_phrases"])
    whole = sorted(map(row, lexical_index.lexical_channel(*frames, k=1000).collect()), key=lambda r: (r[0], -r[2], r[1]))
    first = [r for n, r in enumerate(whole) if n < 4 or whole[n - 4][0] != r[0]]
    assert len(whole) > 800 and sorted(map(row, lexical_index.lexical_channel(*frames, k=4).collect())) == sorted(first)
    # Several batches, parts of a batch and prunings in a task.
    class shared:
        value = lexical_index._Asked(lexical_index.expressions(frames[1]).toArrow())

    monkeypatch.setattr(lexical_index, "WORDS", 50)
    monkeypatch.setattr(lexical_index, "CELLS", 81)
    ids = [d for d, _ in docs]
    batches = [pa.record_batch({"id": pa.array(ids[n : n + 7]), "again": pa.array([ids.count(x) > 1 for x in ids[n : n + 7]]), "text": pa.array([t for _, t in docs[n : n + 7]])}) for n in range(0, 90, 7)]
    for k in (4, 30):
        out = [r for b in lexical_index._scored(shared, k)(batches) for r in b.to_pylist()]
        once = {x for x in ids if ids.count(x) == 1}
        assert {row(r) for r in out if r["id"] in once} >= {r for r in first if r[1] in once}
        total = {}
        for r in out:
            total[r["query"], r["id"]] = total.get((r["query"], r["id"]), 0) + r["n_covers"]
        assert all(total.get((q, d), 0) == n for q, d, n, _ in whole if d not in once)
        assert k == 30 or max(sum(r["query"] == q and r["id"] in once for r in out) for q in range(20)) <= k


def test_the_lexical_channel_asks_all_items(spark, tmp_path):
    # Only items with ids divisible by 20 were asked.
    from heddle.plans.registry import QUERIES

    texts = ["The crank of the bolt turns. It stops.", "An egret flies over drums.", "nothing here"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "crank bolt"), (19, "egret"), (20, "drum"), (21, "zebra")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r["query"], r["id"], r["rank"], r["score"]) for r in QUERIES["q2_lexical_channel"](spark, str(tmp_path)).collect()}
    assert got == {(1, 0, 1, 0.166667), (19, 1, 1, 0.090909), (20, 1, 1, 0.090909)}
    answers = {(r["query"], r["id"], r["sentence"]) for r in QUERIES["q16_extractive_answers"](spark, str(tmp_path)).collect()}
    assert answers == {(1, 0, "The crank of the bolt turns."), (19, 1, texts[1]), (20, 1, texts[1])}


# ---- spellings


def near_walk(word: str, names: list[str]):
    if len(word) < 6 or not re.search(r"[_\d]|[a-z][A-Z]|[A-Z]{2}", word):
        return None
    plain = re.sub("[^a-z0-9]+", "", word.casefold())
    scored = sorted(((SequenceMatcher(None, plain, n).ratio(), n) for n in names if abs(len(n) - len(plain)) <= 3), reverse=True)
    if not scored or scored[0][0] < 0.88 or (len(scored) > 1 and scored[0][0] - scored[1][0] < 0.04):
        return None
    return scored[0][1], round(scored[0][0], 3)


def test_near_spellings_equal_a_walk(spark):
    rng = random.Random(9)
    parts = ["brake", "wheel", "speed", "control", "ler", "sensor", "unit", "a", "pump", "valve", "x2"]
    names = sorted({"".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(120)})
    words = {"brakes", "BrakeContoller", "ABcdef", "plain"}
    for n in names:
        for _ in range(3):
            at = rng.randrange(len(n))
            words.add(rng.choice([n[:at] + n[at + 1 :], n[:at] + rng.choice("xyz") + n[at:], n[:at] + "_" + n[at + 1 :]]).title().replace("_", "") + rng.choice(["", "9", "_a"]))
    got = {r["word"]: (r["normalized"], round(r["ratio"], 3)) for r in questions.near_spellings(spark.createDataFrame([(w,) for w in sorted(words)], "word string"), spark.createDataFrame([(n,) for n in names], "normalized string")).collect()}
    want = {w: near_walk(w, names) for w in words}
    assert got == {w: x for w, x in want.items() if x} and len(got) > 30


def test_links_take_longest_spans_then_spellings(spark):
    index = spark.createDataFrame([("brakecontroller", "e1"), ("controller", "e2"), ("wheelspeed", "e3"), ("wheelspeed", "e4"), ("pumpunit", "e5"), ("pump", "e1")] + [("many", f"m{k:02d}") for k in range(30)], "normalized string, entity string")
    asked = [(1, "Does the Brake Controller need wheel speed?"), (2, "Does BrakeContoller need PumpUnti or the controller?"), (3, "many pump"), (4, None), (5, ""), (6, "Does BrakeContoller need PumpUnti or the controller?"), (7, "pump and Brake Controller")]
    rows = questions.linked(spark.createDataFrame(asked, "id long, text string"), index).collect()
    got = {(r["id"], r["start"], r["entity"], r["ambiguous"], r["similarity"]) for r in rows}
    first = {(1, 2, "e1", False, 1.0), (1, 5, "e3", True, 1.0), (1, 5, "e4", True, 1.0)}
    second = {(i, *x) for i in (2, 6) for x in ((1, "e1", False, 0.966), (3, "e5", False, 0.875), (6, "e2", False, 1.0))}
    second = {x for x in second if x[4] >= 0.88}
    assert got == first | second | {(3, 0, f"m{k:02d}", True, 1.0) for k in range(3)} | {(7, 2, "e1", False, 1.0)}


# ---- sections


def pair_walk(old: list[tuple[int, str]], new: list[tuple[int, str]]):
    """All four ways, one old section after the other."""
    left, right, out = list(old), list(new), []
    parts = lambda x: x[1].split(" > ")
    words = lambda x: set(parts(x)[-1].split())

    def take(a, b, how):
        left.remove(a)
        right.remove(b)
        out.append((a[0], b[0], how))

    for a in old:
        same = [b for b in right if b[1] == a[1]]
        if same:
            take(a, same[0], "SAME_PATH")
    for a in list(left):
        mine, theirs = ([x for x in side if parts(x)[-1] == parts(a)[-1]] for side in (left, right))
        if len(mine) == len(theirs) == 1:
            take(a, theirs[0], "SAME_HEADING")
    holds = lambda a, b: parts(a)[:-1] == parts(b)[:-1] and bool(words(a)) and bool(words(b)) and (words(a) <= words(b) or words(b) <= words(a))
    for a in list(left):
        on = [b for b in right if holds(a, b)]
        if len(on) == 1 and sum(holds(x, on[0]) for x in left) == 1:
            take(a, on[0], "EXTENDED")
    ratio = lambda a, b: SequenceMatcher(None, a[1].replace(" > ", " "), b[1].replace(" > ", " ")).ratio()
    for a in list(left):
        best = max(right, key=lambda b: ratio(a, b), default=None)
        if best and ratio(a, best) >= 0.85 and max(left, key=lambda x: ratio(x, best)) == a:
            take(a, best, "RENAMED")
    return set(out)


def test_sections_equal_a_walk(spark):
    rng = random.Random(12)
    vocabulary = ["bus", "timing", "diagnostics", "limits", "power", "interfaces", "tests"]
    heading = lambda: " ".join(rng.sample(vocabulary, rng.randrange(1, 4)))
    typo = lambda s: s if rng.random() < 0.6 else (lambda at: s[:at] + rng.choice("abc") + s[at + rng.randrange(0, 2) :])(rng.randrange(len(s)))
    olds, news, want = [], [], set()
    for p in range(60):
        keys = [" > ".join([rng.choice("xy"), *([heading()] if rng.random() < 0.8 else [])]) for _ in range(rng.randrange(0, 9))]
        old = list(enumerate(keys))
        new = [(k, typo(x if rng.random() < 0.7 else f"{x} {rng.choice(vocabulary)}")) for k, x in enumerate(rng.sample(keys, len(keys)))] + [(90, "x > " + heading())]
        olds += [(p, k, x) for k, x in old]
        news += [(p, k, x) for k, x in new]
        want |= {(p, *x) for x in pair_walk(old, new)}
    rows = compare.pair_sections(*(spark.createDataFrame(side, "pair long, ordinal long, key string") for side in (olds, news))).collect()
    assert {(r["pair"], r["old"], r["new"], r["how"]) for r in rows} == want
    assert {h for *_, h in want} == {"SAME_PATH", "SAME_HEADING", "EXTENDED", "RENAMED"}
    assert compare.pair_sections(*(spark.createDataFrame([], "pair long, ordinal long, key string") for _ in "ab")).count() == 0


def test_word_containment_pairs(spark):
    """The two cases of a heading that extends another without beginning like it."""
    frame = lambda key: spark.createDataFrame([(1, 0, key)], "pair long, ordinal long, key string")
    for a, b in (("x > timing", "x > bus timing"), ("x > timing and bus", "x > bus timing")):
        assert [tuple(r) for r in compare.pair_sections(frame(a), frame(b)).collect()] == [(1, 0, 0, "EXTENDED")]


def test_legacy_resolution_equals_a_walk(spark):
    rng = random.Random(21)
    stems = ["brakeunit", "brakeunits", "brakecontrol", "wheelspeed", "wheelspeeds", "pump", "valvecontroller"]
    spell = lambda: (lambda w: w[: rng.randrange(3, len(w) + 1)] + rng.choice(["", "", "x", "ab"]))(rng.choice(stems))
    candidates = [(f"c{k}", spell(), rng.choice("SI")) for k in range(40)]
    aliases = [(rng.choice(candidates)[0], spell()) for _ in range(15)]
    mentions = sorted({(w, w, kind) for w, kind in ((spell(), rng.choice("SI")) for _ in range(90))} | {("zzzz", "zzzz", "S")})
    want = set()
    for mention, name, kind in mentions:
        own = [c for c in candidates if c[2] == kind]
        exact = [c[0] for c in own if c[1] == name]
        alias = sorted({c[0] for c in own if (c[0], name) in aliases})
        blocked = sorted(((SequenceMatcher(None, name, c[1]).ratio(), c[0]) for c in own if c[1][:4] == name[:4]), reverse=True)
        near = [x for x in blocked if x[0] >= 0.8]
        if len(exact) == 1:
            want.add((mention, kind, "EXACT", exact[0], 1, 1.0))
        elif len(alias) == 1:
            want.add((mention, kind, "ALIAS", alias[0], 1, 1.0))
        elif blocked and blocked[0][0] >= 0.96 and len(near) == 1:
            want.add((mention, kind, "MERGED", blocked[0][1], 1, blocked[0][0]))
        else:
            want.add((mention, kind, "AMBIGUOUS" if blocked else "UNRESOLVED", None, len(near), near[0][0] if near else None))
    frames = [spark.createDataFrame(rows, schema) for rows, schema in ((mentions, "mention string, normalized string, kind string"), (candidates, "id string, normalized string, kind string"), (aliases, "id string, normalized string"))]
    got = {tuple(r) for r in answers.legacy_resolution(*frames).collect()}
    assert got == want and {x[2] for x in want} >= {"EXACT", "ALIAS", "AMBIGUOUS", "UNRESOLVED"}


def test_names_of_a_pair_are_compared_in_one_task(spark, monkeypatch):
    # Names of all pairs were told apart into tokens, and words of all headings were counted.
    rng = random.Random(9)
    words = ["pump", "pumps", "valve", "valves", "gauge", "größe", "unit", "units"]
    side = lambda kinds: [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 5)))) for k in kinds for _ in range(12)] + [(3, None), (None, "pump"), (3, "")]
    frames = [spark.createDataFrame(side(kinds), "kind long, name string") for kinds in (range(8), range(2, 10))]
    rows = lambda df: sorted(tuple(r[c] for c in ("kind", "a", "b", "ratio")) for r in df.collect())
    want = rows(compare.similar_names(*frames, 0.85))
    assert len(want) > 10 and ("", "") not in {r[1:3] for r in want if r[0] != 3}
    for pairs, step in (((1 << 22, 1 << 14), 1 << 16), ((130, 1 << 14), 1 << 16), ((1 << 22, 3), 1 << 16), ((1 << 22, 1 << 14), 5)):
        monkeypatch.setattr(compare, "WITHIN", pairs)
        monkeypatch.setattr(compare, "PAIRS", step)
        assert rows(compare.similar_within(*frames, 0.85)) == want
    monkeypatch.setattr(compare, "WITHIN", (1 << 22, 1 << 14))
    monkeypatch.setattr(compare, "similar_names", lambda *x: 1 / 0)
    kept, settled = [], compare.settled
    monkeypatch.setattr(compare, "settled", lambda df: kept.append(settled(df)) or kept[-1])
    sections = lambda mark: [(p, k, f"{mark}{k} > pump of unit {mark}") for p in range(20) for k in range(5)]
    old, new = (spark.createDataFrame([*sections(mark), (7, 9, f"one > gauge {more}valve")], "pair long, ordinal long, key string") for mark, more in (("x", ""), ("y", "or ")))
    assert [tuple(r) for r in compare.extended_headings(old, new).collect()] == [(7, 9, 9)] and max(df.count() for df in kept) == 1
    assert (7, 9, 9, "EXTENDED") in {tuple(r) for r in compare.pair_sections(old, new).collect()}
