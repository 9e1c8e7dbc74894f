"""Ranked lexical search by a hybrid of term-at-a-time and document-at-a-time scoring.

Documents are cut into shards, each with an inverted list per term, stored as a table of rows (shard, term). Of
each shard a query item takes the lists of its terms. The short ones are added up term by term into an accumulator
of (document, sum), which then is one more list with a known largest value. This list and the long ones are walked
document by document, in stretches of document numbers: a list whose bound, together with those of all lists of
smaller bounds, can't lift a document above the best found so far is not walked but only searched for documents
that others brought up. Each shard gives its best documents, Spark ranks them over all shards.

Items come in blocks of a bounded number of terms, so the item table may be of any size; documents are read once.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from llm.common import batches, stored, texts_of
from llm.decontaminate import words_of

TOP = 20
# Bytes of text in a shard (a longer document is a shard of its own), terms of items in a block.
SHARD_BYTES, BLOCK_TERMS = 8 << 20, 200_000
# Lists of at most this share of a shard's documents are summed up first; documents in one stretch of the walk.
SHORT_SHARE, STRETCH = 1 / 16, 1024
# Fixed values of the score: m = BASE + (SPREAD * n * N) div L, part = (UNIT * tf) div (1000 * tf + SLOPE * m).
BASE, SPREAD, UNIT, SLOPE, FACTOR = 75, 25, 1_000_000_000, 12, 1000


class Shard:
    """The lists of one shard as they grow, document by document."""

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.ids, self.terms, self.tf, self.size = [], [], [], 0

    def add(self, key, text: bytes) -> None:
        bag = Counter(words_of(text))
        self.size += len(text)
        if bag:
            number = self.number
            self.ids.append(key)
            self.terms.append(np.fromiter((number.setdefault(w, len(number)) for w in bag), np.int32, len(bag)))
            self.tf.append(np.fromiter(bag.values(), np.int32, len(bag)))

    def rows(self, name: str, kind: pa.DataType) -> pa.RecordBatch:
        docs, n = len(self.ids), len(self.number)
        order = sorted(range(docs), key=lambda i: (self.ids[i] is None, self.ids[i] if self.ids[i] is not None else 0))
        place = np.empty(docs, np.int32)
        place[order] = np.arange(docs, dtype=np.int32)
        at = np.repeat(place, [len(t) for t in self.terms])
        terms, tf = np.concatenate(self.terms), np.concatenate(self.tf)
        by = np.lexsort((at, terms))
        ends = np.cumsum(np.bincount(terms, minlength=n))
        total = [int(self.tf[i].sum(dtype=np.int64)) for i in order]
        return pa.RecordBatch.from_arrays(
            [pa.array([name] * (n + 1)), pa.array([w.decode() for w in self.number] + [""]),
             pa.ListArray.from_arrays(pa.array(np.r_[0, ends, ends[-1]].astype(np.int32)), pa.array(at[by])),
             pa.ListArray.from_arrays(pa.array(np.r_[0, ends, ends[-1] + docs].astype(np.int32)), pa.array(np.r_[tf[by], total].astype(np.int32))),
             pa.array([None] * n + [[self.ids[i] for i in order]], pa.list_(kind))], ["shard", "term", "at", "tf", "ids"])


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Rows (shard, term, ``at``, ``tf``, ``ids``) of every term of every shard, stored.

    ``at`` numbers documents inside the shard by ascending id, null ids last. The row of the empty term lists the
    shard's documents: their ids, and in ``tf`` their numbers of terms. Documents without a term are not listed.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(it):
        part, count, shard, key_type = TaskContext.get().partitionId(), 0, Shard(), None
        for batch in it:
            key_type = batch.schema.field(0).type
            for key, text in zip(batch.column(0).to_pylist(), texts_of(batch, "_text"), strict=True):
                if shard.ids and shard.size + len(text) > shard_bytes:
                    yield shard.rows(f"{part}-{count}", key_type)
                    count, shard = count + 1, Shard()
                shard.add(key, text)
        if shard.ids:
            yield shard.rows(f"{part}-{count}", key_type)
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return stored(base.mapInArrow(run, f"shard string, term string, at array<int>, tf array<int>, ids array<{kind}>"), "search-index")


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """Rows (``block``, ``item``, ``term``, ``times``), stored: ``item`` numbers the rows of ``items``, whose id is ``item_id``."""
    def run(it):
        part, n, block, room = TaskContext.get().partitionId(), 0, 0, block_terms
        for piece in batches(it, "_text"):
            rows = []
            for key, text in zip(piece.column(0).to_pylist(), texts_of(piece, "_text"), strict=True):
                bag = Counter(words_of(text))
                if len(bag) > room and room < block_terms:
                    block, room = block + 1, block_terms
                room -= len(bag)
                rows += [(f"{part}-{block}", f"{part}-{n}", key, w.decode(), c) for w, c in bag.items()]
                n += 1
            if rows:
                a, b, c, d, e = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(c, piece.schema.field(0).type), pa.array(d), pa.array(e, pa.int64())],
                                                 ["block", "item", "item_id", "term", "times"])
    kind = items.schema[id_col].dataType.simpleString()
    base = items.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return stored(base.mapInArrow(run, f"block string, item string, item_id {kind}, term string, times long"), "search-items")


class Best:
    """The best documents of one item so far. ``bar`` is what a document must reach."""

    def __init__(self, top: int):
        self.top, self.bar = top, 1
        self.at, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def take(self, at: np.ndarray, score: np.ndarray) -> None:
        fit = score >= self.bar
        if not fit.any():
            return
        at, score = np.r_[self.at, at[fit]], np.r_[self.score, score[fit]]
        keep = np.lexsort((at, -score))[:self.top]
        self.at, self.score = at[keep], score[keep]
        if len(keep) == self.top:
            # Later documents have larger numbers, so at equal score they come after those held.
            self.bar = max(self.bar, int(self.score[-1]) + 1)


def rank_shard(lists: list[tuple[np.ndarray, np.ndarray]], n_docs: int, top: int = TOP, short_share: float = SHORT_SHARE,
               stretch: int = STRETCH) -> tuple[np.ndarray, np.ndarray]:
    """The ``top`` documents of a shard by summed values, as (document numbers, sums), only sums above 0.

    A list is (ascending document numbers, values of 0 or more).
    """
    short, long = [], []
    for at, value in lists:
        if len(at):
            (short if len(at) <= short_share * n_docs else long).append((at, value))
    best = Best(top)
    if short:  # term at a time
        sums = np.zeros(n_docs, np.int64)
        for at, value in short:
            sums[at] += value
        at = np.flatnonzero(sums)
        long.append((at, sums[at]))
        if len(at) > top:  # what the accumulators have already is a bound from below
            best.bar = max(1, int(np.partition(sums[at], len(at) - top)[len(at) - top]))
    # Lists by falling bound: those at the end are searched only, as long as their bounds stay below the bar.
    long = sorted(((at, value, int(value.max())) for at, value in long if len(at)), key=lambda x: -x[2])
    rest = np.r_[np.cumsum([b for _, _, b in long][::-1])[::-1], 0]
    walked = len(long)
    lows = [0] * len(long)
    start = 0
    while start < n_docs:
        while walked and rest[walked - 1] < best.bar:
            walked -= 1
        if not walked:
            break
        # The next document that any walked list has: nothing lies between.
        heads = []
        for j in range(walked):
            lows[j] += int(np.searchsorted(long[j][0][lows[j]:], start))
            if lows[j] < len(long[j][0]):
                heads.append(int(long[j][0][lows[j]]))
        if not heads:
            break
        start = min(heads)
        stop = start + stretch
        sums = np.zeros(stretch, np.int64)
        for j in range(walked):
            at, value, _ = long[j]
            high = lows[j] + int(np.searchsorted(at[lows[j]:lows[j] + stretch], stop))
            sums[at[lows[j]:high] - start] += value[lows[j]:high]
            lows[j] = high
        found = np.flatnonzero(sums + rest[walked] >= best.bar)
        sums = sums[found]
        found = found + start
        for j in range(walked, len(long)):  # searched lists, for documents that can still reach the bar
            can = sums + rest[j] >= best.bar
            found, sums = found[can], sums[can]
            if not len(found):
                break
            at, value, _ = long[j]
            spot = np.minimum(np.searchsorted(at, found), len(at) - 1)
            sums = sums + np.where(at[spot] == found, value[spot], 0)
        best.take(found, sums)
        start = stop
    return best.at, best.score


def search(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
           item_text: str = "text", shard_bytes: int = SHARD_BYTES, block_terms: int = BLOCK_TERMS, short_share: float = SHORT_SHARE) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id``, ``score``: the ``top`` documents of each item with a score above 0.

    Null texts have no terms and neither find nor are found. Each row of ``items`` is an item of its own, also where
    ids repeat or are null; each row of ``docs`` is a document of its own. Equal scores rank by id, null ids last.
    Empty tables give an empty result. Other columns are not looked at, whatever their names.
    """
    index = build_index(docs, id_col, text_col, shard_bytes)
    queries = item_terms(items, item_id, item_text, block_terms)
    totals = index.where("term = ''").agg(F.sum(F.size("ids")).alias("n"), F.sum(F.aggregate("tf", F.lit(0).cast("long"), lambda a, x: a + x)).alias("l")).first()
    n_docs, n_terms = totals["n"] or 0, totals["l"] or 0
    wanted = queries.select(F.col("term").alias("q_term")).distinct()
    if wanted.count() <= block_terms:  # few enough to send to every task; else index and terms are shuffled by term
        wanted = F.broadcast(wanted)
    df = (index.select("term", F.size("at").alias("df")).join(wanted, F.col("term") == F.col("q_term"), "left_semi")
          .groupBy("term").agg(F.sum("df").alias("df")).select(F.col("term").alias("q_term"), "df"))
    terms = stored(queries.join(df, F.col("term") == F.col("q_term")).select("block", "item", "item_id", "term", "times", "df"), "search-terms")
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    parts = None
    for (block,) in terms.select("block").distinct().orderBy("block").toLocalIterator():
        part = _block(index, terms.where(F.col("block") == block), n_docs, n_terms, top, short_share, kind)
        parts = part if parts is None else parts.unionByName(part)
    if parts is None:
        return docs.sparkSession.createDataFrame([], f"item_id {item_kind}, rank int, doc_id {kind}, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "shard", "at")
    ranked = parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    names = terms.select(F.col("item").alias("_item"), "item_id").distinct()
    return ranked.join(names, F.col("item") == F.col("_item")).select("item_id", "rank", "doc_id", "score")


def _block(index: DataFrame, terms: DataFrame, n_docs: int, n_terms: int, top: int, short_share: float, kind: str) -> DataFrame:
    """Of a block of items: (``item``, ``shard``, ``at``, ``doc_id``, ``score``) of the best documents of each shard."""
    weights, bags = {}, {}
    for r in terms.collect():  # of one block, at most BLOCK_TERMS rows and an item
        weights[r["term"]] = math.floor(FACTOR * math.log((2 * n_docs + 2) / (2 * r["df"] + 1)))
        if weights[r["term"]] > 0:
            bags.setdefault(r["item"], []).append((r["term"], r["times"]))
    weights = {t: w for t, w in weights.items() if w > 0}

    def run(key, table):
        rows = {t: i for i, t in enumerate(table.column("term").to_pylist())}
        at, tf, ids = (table.column(c).combine_chunks() for c in ("at", "tf", "ids"))
        home = rows[""]
        counts = tf[home].values.to_numpy().astype(np.int64)
        m = BASE + (SPREAD * counts * n_docs) // n_terms
        parts = {}
        for term, i in rows.items():
            if term:
                where, often = at[i].values.to_numpy().astype(np.int64), tf[i].values.to_numpy().astype(np.int64)
                parts[term] = where, weights[term] * ((UNIT * often) // (1000 * often + SLOPE * m[where]))
        items, places, scores = [], [], []
        for item, bag in bags.items():
            lists = [(parts[t][0], parts[t][1] * times if times > 1 else parts[t][1]) for t, times in bag if t in parts]
            if lists:
                found, score = rank_shard(lists, len(counts), top, short_share)
                items += [item] * len(found)
                places.append(found)
                scores.append(score)
        places = np.concatenate(places) if places else np.zeros(0, np.int64)
        return pa.table([pa.array(items, pa.string()), pa.array([key[0].as_py()] * len(items), pa.string()), pa.array(places, pa.int64()),
                         ids[home].values.take(pa.array(places)), pa.array(np.concatenate(scores) if scores else places, pa.int64())],
                        names=["item", "shard", "at", "doc_id", "score"])
    named = terms.sparkSession.createDataFrame([(t,) for t in ["", *weights]], "q_term string")
    picked = index.join(named, F.col("term") == F.col("q_term"), "left_semi")
    return picked.groupBy("shard").applyInArrow(run, f"item string, shard string, at long, doc_id {kind}, score long")
