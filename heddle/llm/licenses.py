"""License scans with a positional rare-token index, in DataFrame functions.

Templates are word sequences with a label and a mandatory key phrase.  A first pass counts in how many files each word of a key phrase
occurs, over all files.  The index has postings by word: of each template the ``anchors`` words of its key phrase of highest IDF, with
their offsets.  In a file, the words that are some template's rarest are looked up; each posting gives a template and a place where it would start,
the template's other postings must stand at their relative positions, and the key phrase is verified word by word.  So a word that is frequent in
some language (mit) is no entry to the index if a rarer one will do.

The index is data, one literal table, not one expression per template, so the plan doesn't grow with the templates.
Both passes are projections without a shuffle of texts; the counts are aggregated before
they are shuffled, and their number is that of the key phrases' words.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    key: str  # the mandatory phrase, part of text
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def key_at(self) -> int:
        n = len(self.key.split())
        return next(i for i in range(len(self.words)) if self.words[i : i + n] == self.key.split())


#: Phrases and labels of the contract, then notices of public licences.
TEMPLATES = [
    Template("mit", "under the mit license", "under the mit license", base=True),
    Template("apache-2", "apache license version 2", "apache license version 2", base=True),
    Template("cc-by-nc", "cc by nc", "cc by nc", base=True),
    Template("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template("gpl-2", "this work is licensed under the gnu general public license version 2", "gnu general public license version 2"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    Template("mpl-2", "subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    Template("all-rights-reserved", "all rights reserved", "all rights reserved"),
    Template("lgpl-2.1", "under the terms of the gnu lesser general public license version 2 1", "gnu lesser general public license version 2 1"),
    Template("agpl-3", "under the terms of the gnu affero general public license version 3", "gnu affero general public license version 3"),
    Template("epl-2", "under the terms of the eclipse public license v 2 0", "eclipse public license v 2 0"),
    Template("eupl-1.2", "licensed under the european union public licence v 1 2", "european union public licence v 1 2"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "distribute this software for any purpose with or without fee"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software released into the public domain"),
    Template("boost-1", "distributed under the boost software license version 1 0", "boost software license version 1 0"),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", "in no event will the authors be held liable"),
    Template("artistic-2", "under the terms of the artistic license 2 0", "artistic license 2 0"),
    Template("cc0-1", "released under cc0 1 0 universal public domain dedication", "cc0 1 0 universal"),
    Template("cc-by-4", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0 international"),
    Template("cc-by-sa-4", "licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike 4 0 international"),
]


def words_of(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(lowered, SEPARATORS, -1), lambda w: w != "")


def frequencies(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """In how many files each of the template words occurs.  One row per template word reaches the driver."""
    listed = F.array(*map(F.lit, vocabulary))
    rows = docs.select(F.explode(F.array_intersect(words_of(F.col("text")), listed)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return dict.fromkeys(vocabulary, 0) | {r["word"]: r["n"] for r in rows.collect()}


_POSTINGS = "map<string, array<struct<t: int, o: int>>>"
_TEMPLATES = "array<struct<label: string, base: boolean, key: array<string>, others: array<struct<o: int, w: string>>, text: array<string>, key_at: int>>"


def index_of(templates: list[Template], count: dict[str, int], anchors: int) -> tuple[dict, list]:
    """Postings of each template's rarest word, and per template its other anchors, the words to verify and the label."""
    postings, rows = {}, []
    for t, template in enumerate(templates):
        key = template.key.split()
        rarest, *others = sorted(range(len(key)), key=lambda i: (count[key[i]], i))[:anchors]
        postings.setdefault(key[rarest], []).append({"t": t, "o": rarest})
        rows.append({"label": template.label, "base": template.base, "key": key, "others": [{"o": i, "w": key[i]} for i in others], "text": template.words, "key_at": template.key_at})
    return postings, rows


def scan(docs: DataFrame, templates: list[Template] = TEMPLATES, anchors: int = 3) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score; one row per row of docs.

    n_base counts the places of base templates, first_word and last_word are their smallest and largest start; without any they are null.
    score is the largest share of a found template's words that stand at their places, 0 without a label.
    Null and empty texts have no words and no labels (empty strings).  Repeated rows are
    scanned one by one, ids may be null, and only doc_id and text are read.
    """
    count = frequencies(docs.select("text"), sorted({w for t in templates for w in t.key.split()}))
    postings, rows = index_of(templates, count, anchors)
    found_by = F.from_json(F.lit(json.dumps(postings)), _POSTINGS)
    listed = F.from_json(F.lit(json.dumps(rows)), _TEMPLATES)
    entries = F.array(*map(F.lit, sorted(postings)))
    texts = docs.select("doc_id", words_of(F.col("text")).alias("words"))
    hits = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: F.array_contains(entries, x["w"]))
    texts = texts.select("doc_id", "words", F.when(F.arrays_overlap("words", entries), hits).otherwise(F.array().cast("array<struct<w:string,i:int>>")).alias("hits"))
    # Each template of a hit's postings, with where it would start.
    starts = F.flatten(F.transform("hits", lambda h: F.transform(F.element_at(found_by, h["w"]), lambda p: F.struct(F.get(listed, p["t"]).alias("t"), (h["i"] - p["o"]).alias("start")))))
    fits = lambda x: (x["start"] >= 0) & (x["start"] + F.size(x["t"]["key"]) <= F.size("words"))
    meets = lambda x: F.forall(x["t"]["others"], lambda a: F.get("words", x["start"] + a["o"]) == a["w"])
    holds = lambda x: F.slice("words", x["start"] + 1, F.size(x["t"]["key"])) == x["t"]["key"]
    texts = texts.select("doc_id", "words", F.filter(starts, lambda x: fits(x) & meets(x) & holds(x)).alias("found"))
    base = F.transform(F.filter("found", lambda x: x["t"]["base"]), lambda x: x["start"])
    labels = lambda kept: F.array_join(F.array_sort(F.array_distinct(F.transform(kept, lambda x: x["t"]["label"]))), ",")
    standing = lambda x: F.size(F.filter(F.transform(x["t"]["text"], lambda w, i: F.coalesce(F.get("words", x["start"] - x["t"]["key_at"] + i) == w, F.lit(False))), lambda ok: ok))
    score = F.coalesce(F.array_max(F.transform("found", lambda x: standing(x) / F.size(x["t"]["text"]))), F.lit(0.0))
    return texts.select(
        "doc_id", F.size("words").cast("long").alias("n_words"), F.size(base).cast("long").alias("n_base"), F.array_min(base).cast("long").alias("first_word"), F.array_max(base).cast("long").alias("last_word"),
        labels(F.filter("found", lambda x: x["t"]["base"])).alias("base_labels"), labels(F.col("found")).alias("labels"), score.alias("score"),
    )


def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _oracle() -> str:
    def place(t: Template) -> str:
        return f"CASE WHEN contains(j, ' {t.key} ') THEN list_filter(range(1, len(ws) + 2 - {len(t.key.split())}), lambda i: list_slice(ws, i, i + {len(t.key.split()) - 1}) = {t.key.split()!r}) ELSE [] END"

    def share(k: int, t: Template) -> str:
        if t.key == t.text:
            return f"CASE WHEN len(at{k}) > 0 THEN 1.0 ELSE 0.0 END"
        terms = " + ".join(f"CASE WHEN s - {t.key_at} + {i} >= 1 AND ws[greatest(s - {t.key_at} + {i}, 1)] = '{w}' THEN 1 ELSE 0 END" for i, w in enumerate(t.words))
        return f"coalesce(list_max(list_transform(at{k}, lambda s: {terms})) / {len(t.words)}.0, 0.0)"

    base = [k for k, t in enumerate(TEMPLATES) if t.base]
    labels = lambda ks: "array_to_string(list_sort(list_distinct(list_filter([" + ", ".join(f"CASE WHEN len(at{k}) > 0 THEN '{TEMPLATES[k].label}' END" for k in ks) + "], lambda x: x IS NOT NULL))), ',')"
    every = "list_concat(list_concat(at0, at1), at2)"
    return rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
p AS (SELECT *, {", ".join(f"{place(t)} AS at{k}" for k, t in enumerate(TEMPLATES))} FROM (SELECT *, ' ' || array_to_string(ws, ' ') || ' ' AS j FROM w))
SELECT doc_id, len(ws)::BIGINT AS n_words, len({every})::BIGINT AS n_base, list_min({every}) - 1 AS first_word, list_max({every}) - 1 AS last_word,
  {labels(base)} AS base_labels, {labels(range(len(TEMPLATES)))} AS labels, greatest({", ".join(share(k, t) for k, t in enumerate(TEMPLATES))})::DOUBLE AS score FROM p
"""


ORACLE = _oracle()
