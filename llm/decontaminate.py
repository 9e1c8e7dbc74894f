"""Benchmark decontamination by suffix arrays of the training text.

Documents are cut into shards (one Arrow piece each). A shard's array holds the suffixes that can match: words
outside the benchmark's vocabulary separate runs, and runs shorter than the shortest window are left out, which
changes no answer. Every suffix of every test item is looked up by binary search, word by word, which yields its
longest verbatim match and, for windows, all places. Test items come to the workers in blocks of a bounded
number of words, one at a time, so the benchmark may grow; texts are never shuffled.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import batches, per_batch, stored, texts_of

WINDOW = 10
# Words of test items that one pass over the documents holds in memory.
BLOCK_WORDS = 2_000_000
# Bytes of documents in one shard; a longer document is a shard of its own.
SHARD_BYTES = 8 << 20
# Word bytes (0-9, a-z, all of non-ASCII characters) with capitals lowered; other bytes part words.
TABLE = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


class TestSet:
    """The suffixes of a block of items as word numbers, 1 upwards; 0 is any other word."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        self.items = []
        for key, text in items:
            words = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            if words:
                self.items.append((key, words, min(window, len(words))))
        self.shortest = min((w for _, _, w in self.items), default=0)
        self.depth = max((w for _, _, w in self.items), default=0)


def suffix_array(tokens: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """``starts`` in order of the ``depth`` words from each, by prefix doubling; equal ones stay in text order."""
    rank = tokens.astype(np.int64)
    have = 1
    while have < depth:
        step = min(have, depth - have)
        pairs = rank[:len(rank) - step] * (int(rank.max()) + 1) + rank[step:]
        rank = np.unique(np.r_[pairs, np.zeros(step, np.int64)], return_inverse=True)[1]
        have += step
    return starts[np.argsort(rank[starts], kind="stable")]


def find(order: list[int], tokens: list[int], words: list[int], depth: int) -> tuple[int, int, int]:
    """Longest match of ``words`` (to ``depth``) in the array: its length and the range of places."""
    lo, hi, n = 0, len(order), 0
    while n < depth:
        a = bisect_left(order, words[n], lo, hi, key=lambda s: tokens[s + n])
        b = bisect_right(order, words[n], a, hi, key=lambda s: tokens[s + n])
        if a == b:
            break
        lo, hi, n = a, b, n + 1
    return n, lo, hi


def shard_matches(tests: TestSet, docs: list[list[bytes]]) -> tuple[list[set[str]], list[np.ndarray], list[dict[str, tuple[int, int]]]]:
    """Per document: items with windows in it, its hit words as a mask, longest match per item (words, place)."""
    number = tests.vocabulary.get
    items: list[set[str]] = [set() for _ in docs]
    longest: list[dict] = [{} for _ in docs]
    marks = [np.zeros(len(d) + 1, np.int32) for d in docs]
    pieces, owner, place = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, words in enumerate(docs):
        if not tests.shortest or len(words) < tests.shortest:
            continue
        ids = np.fromiter([number(w, 0) for w in words], np.int64, len(words))
        edges = np.flatnonzero(np.diff(np.r_[0, ids > 0, 0]))
        for a, b in edges.reshape(-1, 2)[np.diff(edges)[::2] >= tests.shortest]:
            pieces.append(np.r_[ids[a:b], 0])
            owner.append(np.full(b - a + 1, i))
            place.append(np.arange(a, b + 1))
    tokens = np.r_[np.concatenate(pieces), np.zeros(tests.depth + 1, np.int64)]
    if len(tokens) > tests.depth + 1:
        owner, place = np.concatenate(owner), np.concatenate(place)
        order = suffix_array(tokens, np.flatnonzero(tokens), tests.depth)
        listed, flat = order.tolist(), tokens.tolist()
        for key, words, window in tests.items:
            for s in range(len(words) - window + 1):
                n, lo, hi = find(listed, flat, words[s:s + window], window)
                for at in order[lo:hi] if n == window else ():
                    i, p = int(owner[at]), int(place[at])
                    items[i].add(key)
                    marks[i][p] += 1
                    marks[i][p + window] -= 1
                    more = window
                    while s + more < len(words) and flat[at + more] == words[s + more]:
                        more += 1
                    if more > longest[i].get(key, (0, 0))[0]:
                        longest[i][key] = (more, p)
    return items, [np.cumsum(m)[:-1] > 0 for m in marks], longest


def block_table(benchmark: DataFrame, id_col: str, text_col: str, block_words: int) -> DataFrame:
    """Items with the block each belongs to, of about ``block_words`` words at most, stored in the shared folder."""
    def run(it):
        part, block, room = TaskContext.get().partitionId(), 0, block_words
        for batch in batches(it, "text"):
            names = []
            for text in texts_of(batch, "text"):
                size = len(text) // 2 + 1
                if room < size and room < block_words:
                    block, room = block + 1, block_words
                room -= size
                names.append(f"{part}-{block}")
            yield pa.RecordBatch.from_arrays([pa.array(names), *batch.columns], ["block", "item_id", "text"])
    items = benchmark.select(F.col(id_col).cast("string").alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return stored(items.mapInArrow(run, "block string, item_id string, text string"), "decontaminate-items")


def blocks_of(benchmark: DataFrame, id_col: str, text_col: str, block_words: int) -> Iterator[tuple[bool, list[tuple[str | None, bytes]]]]:
    """Whether more follow, and the items, block by block: the driver and a task hold one block at a time. An empty
    benchmark is one empty block."""
    table = block_table(benchmark, id_col, text_col, block_words)
    names = [r[0] for r in table.select("block").distinct().orderBy("block").toLocalIterator()] or [""]
    for name in names:
        yield name != names[-1], [(r[0], r[1].encode()) for r in table.where(F.col("block") == name).select("item_id", "text").collect()]


PART = "doc_id long, key long, n_words long, hit array<int>, items array<string>, longest array<struct<item_id:string,words:long,position:long>>"
LONGEST = pa.list_(pa.struct([("item_id", pa.string()), ("words", pa.int64()), ("position", pa.int64())]))


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
                       item_id: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``contaminated``,
    and ``longest``: per item found, its longest verbatim match in words and where it begins.

    An item shorter than ``window`` is one window of its own length; null and wordless items never match. An item whose
    id is null hits words like any other, but as it can't be named it is neither counted in ``n_items`` nor listed. Null
    text has no words; very long texts are a shard of their own. Repeated rows are each reported; items that share an id
    count once. Empty ``docs`` give an empty result; an empty benchmark hits nothing. Other columns are not looked at.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    every, hits = None, None
    # One pass a block, each written before the next block is fetched. The first pass answers every row, the others
    # bring hits only; rows with the same id and text have the same ones.
    for more, block in blocks_of(benchmark, item_id, item_text, block_words):
        part = base.mapInArrow(per_batch(_scan(block, window, every is None), "text", SHARD_BYTES), PART)
        part = stored(part, "decontaminate-part") if more else part
        if every is None:
            every = part
        else:
            hits = part if hits is None else hits.unionByName(part)
    if hits is not None:
        lists = ("hit", "items", "longest")
        later = hits.groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).agg(*[F.array_distinct(F.flatten(F.collect_set(c))).alias(f"_{c}") for c in lists])
        both = every.join(later, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left")
        every = both.select("doc_id", "n_words", *[F.when(F.col("_key").isNull(), F.col(c)).otherwise(F.array_union(c, f"_{c}")).alias(c) for c in lists])
    names = F.array_sort("items")
    return every.select("doc_id", "n_words", F.size("hit").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (F.size("hit") > 0).alias("contaminated"), "longest")


def _scan(block, window: int, every: bool):
    tests: list[TestSet] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not tests:
            tests.append(TestSet(block, window))
        words = [words_of(t) for t in texts_of(batch, "text")]
        items, hit, longest = shard_matches(tests[0], words)
        out = pa.RecordBatch.from_arrays(
            [*batch.columns[:2], pa.array([len(w) for w in words], pa.int64()), pa.array([np.flatnonzero(h).astype(np.int32) for h in hit], pa.list_(pa.int32())),
             pa.array([sorted(x - {None}) for x in items], pa.list_(pa.string())),
             pa.array([[{"item_id": k, "words": n, "position": p} for k, (n, p) in sorted(x.items(), key=str)] for x in longest], LONGEST)],
            ["doc_id", "key", "n_words", "hit", "items", "longest"])
        return out if every else out.filter(pa.array([bool(x) for x in items], pa.bool_()))
    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", item_id: str = "item_id",
                      item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` without any window of ``benchmark``, with all their columns, whatever their names.

    Null and empty texts stay, items without an id count too, repeated rows are judged each, an empty table stays empty and
    an empty benchmark takes nothing. A scan for each block of items, the result written between two; no shuffle.
    """
    for more, block in blocks_of(benchmark, item_id, item_text, block_words):
        def run(batch: pa.RecordBatch, tests: list = [], block=block) -> pa.RecordBatch:  # noqa: B006  (kept per task)
            if not tests:
                tests.append(TestSet(block, window))
            items, _, _ = shard_matches(tests[0], [words_of(t) for t in texts_of(batch, text_col)])
            return batch.filter(pa.array([not x for x in items], pa.bool_()))
        docs = docs.mapInArrow(per_batch(run, text_col, SHARD_BYTES), docs.schema)
        docs = stored(docs, "decontaminate") if more else docs
    return docs
