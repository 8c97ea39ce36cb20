"""Edit-aware token counts.

A document is cut into leaves of up to LEAF pre-tokens each; a table keeps per document its text and the leaves' characters, tokens and
pre-tokens (``count_trees``).  A table of edits is applied to it (``apply_edits``) without encoding what the edits don't touch: a segment tree over the kept sums finds an
edit's leaves by descent; from the leaf that holds the third character ahead of the
edit (as far as the pre-token pattern looks ahead) the text is split and encoded again, up to the first leaf border behind the edit that is a
border still.  Behind it the split can't differ, as the pattern never looks back.  The new pre-tokens are dealt to the touched leaves and
only the sums on their paths are renewed; the tree is laid out anew (from sums, without encoding) when they outgrow their leaves.
"""

from __future__ import annotations

import base64
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heddle.llm.store import Scratch

#: Default of the vocabulary parameter; $HEDDLE_VOCABULARY overrides it.
VOCABULARY = os.environ.get("HEDDLE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: the public byte-level BPE's pre-token pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LOOKAHEAD = 3
LEAF = 64
#: A leaf takes so many times LEAF pre-tokens before the tree is laid out anew.
FULL = 4
CACHE = 400_000


class Counter:
    """Tokens of pre-tokens, with a bounded memory of those seen."""

    def __init__(self, vocabulary: bytes):
        import regex
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
        self.encoding = tiktoken.Encoding("counter", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(PATTERN).findall
        self.seen: dict[str, int] = {}

    def counts(self, pretokens: list[str]) -> list[int]:
        seen = self.seen
        try:
            return [seen[p] for p in pretokens]
        except KeyError:
            if len(seen) > CACHE:
                seen.clear()
            missing = [p for p in dict.fromkeys(pretokens) if p not in seen]
            seen.update(zip(missing, map(len, map(self.encoding.encode_ordinary, missing)), strict=True))
            return [seen[p] for p in pretokens]


class Tree:
    """Sums of (characters, tokens, pre-tokens) over leaves; leaf k is node size + k."""

    def __init__(self, leaves: list[tuple[int, int, int]]):
        self.size = 1
        while self.size < len(leaves):
            self.size *= 2
        self.sums = np.zeros((2 * self.size, 3), dtype=np.int64)
        if len(leaves):
            self.sums[self.size : self.size + len(leaves)] = leaves
        level = self.size
        while level > 1:
            self.sums[level // 2 : level] = self.sums[level : 2 * level : 2] + self.sums[level + 1 : 2 * level : 2]
            level //= 2

    def leaf_at(self, position: int) -> tuple[int, int]:
        """The leaf that holds a character, and the characters ahead of that leaf."""
        node, before = 1, 0
        while node < self.size:
            node *= 2
            if position >= before + self.sums[node, 0]:
                before += int(self.sums[node, 0])
                node += 1
        return node - self.size, before

    def put(self, leaf: int, sums: tuple[int, int, int]) -> None:
        node = self.size + leaf
        self.sums[node] = sums
        while node > 1:
            node //= 2
            self.sums[node] = self.sums[2 * node] + self.sums[2 * node + 1]

    @property
    def total(self) -> tuple[int, int, int]:
        return tuple(int(x) for x in self.sums[1])


class Document:
    """A text with its tree.  ``leaves``: kept sums (characters, tokens, pre-tokens) per leaf; without them the whole text is encoded."""

    def __init__(self, text: str, counter: Counter, leaves: np.ndarray | None = None):
        self.counter, self.text = counter, text
        self.encoded = self.laid_out = 0
        if leaves is None:
            pretokens = counter.split(text)
            leaves = self._sums(pretokens, -(-len(pretokens) // LEAF))
        self.tree, self.n_leaves = Tree(leaves), len(leaves)

    def _sums(self, pretokens: list[str], n: int) -> list[tuple[int, int, int]]:
        """Sums of n leaves to which the pre-tokens are dealt evenly."""
        sizes = np.cumsum([0, *map(len, pretokens)])
        tokens = np.cumsum([0, *self.counter.counts(pretokens)])
        cuts = np.arange(n + 1) * len(pretokens) // max(n, 1)
        return [tuple(x) for x in np.stack([np.diff(sizes[cuts]), np.diff(tokens[cuts]), np.diff(cuts)], axis=1).tolist()]

    @property
    def leaves(self) -> np.ndarray:
        return self.tree.sums[self.tree.size : self.tree.size + self.n_leaves]

    @property
    def n_tokens(self) -> int:
        return self.tree.total[1]

    def edit(self, start: int, stop: int, new: str) -> None:
        """Replaces characters [start, stop) by new; both are cut to the text."""
        length = len(self.text)
        start = min(max(start, 0), length)
        stop = min(max(stop, start), length)
        grown = len(new) - (stop - start)
        self.text = self.text[:start] + new + self.text[stop:]
        if not self.n_leaves:
            self.tree, self.n_leaves = Tree([(0, 0, 0)]), 1
        first, head = self.tree.leaf_at(max(0, min(start - LOOKAHEAD, length - 1)))
        first = min(first, self.n_leaves - 1)
        last = first
        end = head + int(self.leaves[first, 0])  # the end of leaf ``last`` in the old text
        while end < stop and last + 1 < self.n_leaves:
            last, end = last + 1, end + int(self.leaves[last + 1, 0])
        while True:
            # Characters behind the border are read as well: enough for the pattern, and to see a pre-token that crosses it.
            more = end + grown + 4 * LOOKAHEAD
            pretokens = self.counter.split(self.text[head:more])
            border, place, kept = end + grown - head, 0, 0
            while kept < len(pretokens) and place < border:
                place += len(pretokens[kept])
                kept += 1
            if more >= len(self.text):
                whole = last + 1 == self.n_leaves
                if whole or place == border:
                    kept = len(pretokens) if whole else kept
                    break
            elif place == border:
                break
            last, end = last + 1, end + int(self.leaves[last + 1, 0])
        pretokens = pretokens[:kept]
        self.encoded += len(pretokens)
        touched = last - first + 1
        if len(pretokens) <= FULL * LEAF * touched:
            for k, sums in enumerate(self._sums(pretokens, touched)):
                self.tree.put(first + k, sums)
            return
        self.laid_out += 1
        old = [tuple(x) for x in self.leaves.tolist()]
        old[first : last + 1] = self._sums(pretokens, -(-len(pretokens) // LEAF))
        self.tree, self.n_leaves = Tree(old), len(old)


LEAF_FIELDS = ("chars", "tokens", "pretokens")
TREE = T.StructType([T.StructField(f, T.ArrayType(T.IntegerType())) for f in LEAF_FIELDS])
RESULT = T.StructType([T.StructField("text", T.StringType()), *(T.StructField(f, T.LongType()) for f in ("n_tokens_after", "n_encoded_again")), *TREE.fields])
EDITS = "array<struct<start: long, stop: long, new: string>>"
#: One per worker process: building it takes longer than a batch.
_counters: dict[bytes, Counter] = {}


def _counter(vocabulary) -> Counter:
    if vocabulary.value not in _counters:
        _counters.clear()
        _counters[vocabulary.value] = Counter(vocabulary.value)
    return _counters[vocabulary.value]


def _lists(leaves: list[np.ndarray]) -> list[pa.Array]:
    """A list column per leaf field."""
    ends = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in leaves])]).astype(np.int32))
    rows = np.concatenate(leaves) if leaves else np.zeros((0, 3), dtype=np.int64)
    return [pa.ListArray.from_arrays(ends, pa.array(rows[:, k].astype(np.int32))) for k in range(3)]


def _growing(vocabulary):
    @F.arrow_udf(TREE)
    def grow(text: pa.Array) -> pa.Array:
        counter = _counter(vocabulary)
        return pa.StructArray.from_arrays(_lists([Document(t.as_py() or "", counter).leaves for t in text]), names=list(TREE.names))

    return grow


def _editing(vocabulary):
    @F.arrow_udf(RESULT)
    def edit(text: pa.Array, chars: pa.Array, tokens: pa.Array, pretokens: pa.Array, edits: pa.Array) -> pa.Array:
        counter, texts, rows, leaves = _counter(vocabulary), [], [], []
        kept = [x.values.to_numpy(zero_copy_only=False) for x in (chars, tokens, pretokens)]
        ends = chars.offsets.to_numpy()
        for t, a, b, changes in zip(text, ends[:-1], ends[1:], edits, strict=True):
            document = Document(t.as_py() or "", counter, np.stack([x[a:b] for x in kept], axis=1))
            for e in changes.as_py() or []:
                if e is not None:
                    document.edit(e["start"] or 0, e["stop"] or 0, e["new"] or "")
            texts.append(t.as_py() if document.text == (t.as_py() or "") else document.text)
            rows.append((document.n_tokens, document.encoded))
            leaves.append(document.leaves)
        table = np.array(rows, dtype=np.int64).reshape(-1, 2)
        return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(table[:, 0]), pa.array(table[:, 1]), *_lists(leaves)], names=list(RESULT.names))

    return edit


def _ranks(spark, vocabulary: str):
    """The vocabulary's bytes for the executors (about 1 MB)."""
    with open(vocabulary, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def count_trees(docs: DataFrame, vocabulary: str = VOCABULARY, columns: list[str] = ["doc_id"]) -> DataFrame:  # noqa: B006
    """columns of docs, then text, n_pretokens, n_tokens and the leaves' sums (chars, tokens, pretokens: arrays): the table to keep.

    Null and empty texts have no leaves and no tokens.  Repeated rows are counted one by one, ids may be null, an empty table gives an empty one.
    Of docs only text and columns are read; columns named like those added aren't allowed.  vocabulary: a .tiktoken file that the driver reads.
    """
    grown = docs.select(*columns, "text", _growing(_ranks(docs.sparkSession, vocabulary))(F.col("text")).alias("__tree"))
    total = lambda f: F.aggregate(F.col("__tree")[f], F.lit(0).cast("long"), lambda s, x: s + x)
    return grown.select(*columns, "text", total("pretokens").alias("n_pretokens"), total("tokens").alias("n_tokens"), *(F.col("__tree")[f].alias(f) for f in LEAF_FIELDS))


def apply_edits(trees: DataFrame, edits: Column, vocabulary: str = VOCABULARY) -> DataFrame:
    """A table of count_trees after edits (a column of it, EDITS): text, n_pretokens, n_tokens and leaves anew, with n_encoded_again (pre-tokens encoded for the edits).

    Each edit replaces characters start up to stop of the text that
    the earlier ones left.  Ends are cut to the text; null edits and null arrays change nothing, a null end counts as 0 and
    a null new as empty; a null text takes edits as an empty one, and stays null if they leave it empty.  Rows of one id are edited one by one.
    """
    done = trees.withColumn("__x", _editing(_ranks(trees.sparkSession, vocabulary))("text", *LEAF_FIELDS, edits.cast(EDITS)))
    x = F.col("__x")
    after = {"text": x["text"], "n_tokens": x["n_tokens_after"], "n_pretokens": F.aggregate(x["pretokens"], F.lit(0).cast("long"), lambda s, y: s + y), **{f: x[f] for f in LEAF_FIELDS}}
    return done.select(*(after[c].alias(c) if c in after else c for c in trees.columns), x["n_encoded_again"].alias("n_encoded_again"))


def edits_of(edits: DataFrame) -> DataFrame:
    """doc_id and edits (EDITS, in the order of seq) from a table of edits (doc_id, seq, start, stop, new); join it to a table of trees.  Of equal seq the order is that of start, stop and new."""
    listed = F.array_sort(F.collect_list(F.struct("seq", "start", "stop", "new")))
    return edits.where("doc_id is not null").groupBy("doc_id").agg(F.transform(listed, lambda e: F.struct(e["start"].alias("start"), e["stop"].alias("stop"), e["new"].alias("new"))).alias("edits"))


def revision_edits() -> Column:
    """The query's edits: a replacement, an insertion and a deletion, at a quarter, the middle and three quarters of the text."""
    n = F.coalesce(F.length("text"), F.lit(0))
    part = lambda start, stop, new: F.struct(start.cast("long").alias("start"), stop.cast("long").alias("stop"), new.alias("new"))
    quarter, half, late = F.floor(n / 4), F.floor(n / 2), F.floor(3 * n / 4)
    return F.array(part(quarter, quarter + 7, F.substring(F.col("text"), 1, 11)), part(half, half, F.lit(" (revised: 2nd edition) ")), part(late, late + 13, F.lit("")))


def op2_edit_aware_token_counts(spark, sf_dir: str) -> DataFrame:
    """The trees of all documents, kept as a table, and the counts after each document's revision."""
    trees = Scratch(spark, "tokens").keep(count_trees(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    after = apply_edits(trees.withColumn("before", F.col("n_tokens")), revision_edits())
    return after.select("doc_id", "n_pretokens", F.col("before").alias("n_tokens"), F.col("n_tokens").alias("n_tokens_after"), "n_encoded_again")
