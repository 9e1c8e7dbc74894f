"""Substring dedup by prefix-partitioned suffix trees.

A sparse suffix tree: of each document only the suffixes at anchors are kept, an anchor being the least hash of
``PREFIX`` consecutive words in a stretch of ``window - PREFIX + 1`` positions. Every window has exactly one
anchor and equal windows have it at the same place, so windows that repeat meet in one subtree. Suffixes are
parted by their prefix: first the ``PREFIX`` words of the anchor; where that group exceeds what a task should
hold, the prefix grows to the full window, whose node is pre-aggregated before any shuffle. A group's tree is
given by the sorted suffixes (to the right) and the sorted reversed contexts (to the left) with the lengths that
neighbours share; nodes that are deep enough, left depth plus right depth reaching the window, are the repeats.

Steps: digest every document (copies of a whole text fall to their smallest id at once); find prefixes that occur
in two documents or more; carry only the words around these; build the trees; cut the words from the texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import flat_words, gram_hashes, per_batch, sliding_min, stored, texts_of, word_hashes

WINDOW, PREFIX = 50, 16
# Suffixes (occurrences, however many documents have them) of one prefix that a single tree may hold; above, the prefix is lengthened to the window.
GROUP_ROWS = 4_000
# Suffixes that a task holds at once (whole groups).
TREE_ROWS = 10_000


def anchors_of(hashes: np.ndarray, window: int, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of one document: place, first and last window start that belong to it."""
    grams = gram_hashes(hashes, prefix)
    span = window - prefix + 1
    if len(grams) < span:
        none = np.zeros(0, np.int64)
        return none, none, none
    # Ties within a stretch go to the leftmost place: compare (hash, place) through the high bits of the hash.
    least = sliding_min(grams, span)
    where = np.full(len(least), -1, np.int64)
    ends = np.arange(len(least))
    # For each window the first place in its stretch that holds the least value.
    order = np.argsort(grams, kind="stable")
    ranked, places = grams[order], order
    # (value, place) pairs in order: the first place >= window start among equal values.
    low = np.searchsorted(ranked, least, "left")
    unique_here = (low + 1 >= len(ranked)) | (ranked[np.minimum(low + 1, len(ranked) - 1)] != least)
    where[unique_here] = places[low[unique_here]]
    for w in np.flatnonzero(~unique_here):
        stop = np.searchsorted(ranked, least[w], "right")
        group = places[low[w]:stop]
        where[w] = group[np.searchsorted(group, w)]
    cuts = np.flatnonzero(np.diff(where)) + 1
    first, last = np.r_[0, cuts], np.r_[cuts, len(where)] - 1
    return where[first], ends[first], ends[last]


def _runs(texts: list[bytes]):
    words, starts = flat_words(texts)
    return words, starts, word_hashes(words)


def digests(docs: DataFrame, window: int, prefix: int) -> DataFrame:
    """``doc_id``, ``n_words``, ``sha`` of the words joined by one space, ``anchors`` (distinct prefix hashes), ``times`` (occurrences of each)."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, starts, hashes = _runs(texts_of(batch, "text"))
        shas, lists, times = [], [], []
        for i, (a, b) in enumerate(zip(starts, starts[1:])):
            shas.append(hashlib.sha256(b" ".join(words[a:b])).hexdigest())
            grams = gram_hashes(hashes[a:b], prefix)
            values, often = np.unique(grams[anchors_of(hashes[a:b], window, prefix)[0]], return_counts=True)
            lists.append(values.view(np.int64))
            times.append(often)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(starts)), pa.array(shas), pa.array(lists, pa.list_(pa.int64())),
                                           pa.array(times, pa.list_(pa.int64()))], ["doc_id", "n_words", "sha", "anchors", "times"])
    return docs.mapInArrow(per_batch(run, "text"), "doc_id long, n_words long, sha string, anchors array<long>, times array<long>")


SNIPPET = "prefix long, doc_id long, place int, span int, firsts array<int>, snippet binary"


def snippets(hit: DataFrame, window: int, prefix: int) -> DataFrame:
    """Suffixes of moderate groups: from ``hit`` (doc_id, text, repeated) the words that the anchor's windows span.

    Equal suffixes of one document are one row, with the places where they begin (``firsts``)."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, starts, hashes = _runs(texts_of(batch, "text"))
        ids, wanted = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        out = []
        for i, (a, b) in enumerate(zip(starts.tolist(), starts[1:].tolist())):
            places, first, last = anchors_of(hashes[a:b], window, prefix)
            values = gram_hashes(hashes[a:b], prefix)[places].view(np.int64)
            own: dict[tuple, list[int]] = {}
            for k in np.flatnonzero(np.isin(values, np.asarray(wanted[i] or [], np.int64))).tolist():
                f, l = int(first[k]), int(last[k])
                own.setdefault((int(values[k]), int(places[k]) - f, l - f, b" ".join(words[a + f:a + l + window])), []).append(f)
            out += [(value, ids[i], place, span, firsts, snippet) for (value, place, span, snippet), firsts in own.items()]
        return _rows(out, [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.binary()], ["prefix", "doc_id", "place", "span", "firsts", "snippet"])
    return hit.mapInArrow(per_batch(run, "text"), SNIPPET)


def full_prefixes(hit: DataFrame, window: int, prefix: int) -> DataFrame:
    """Leaf nodes of groups that are too large for one tree: digest of each window, document, starts (one row per document)."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, starts, hashes = _runs(texts_of(batch, "text"))
        ids, wanted = batch.column(0).to_pylist(), batch.column(3).to_pylist()
        out = []
        for i, (a, b) in enumerate(zip(starts.tolist(), starts[1:].tolist())):
            if not wanted[i]:
                continue
            places, first, last = anchors_of(hashes[a:b], window, prefix)
            values = gram_hashes(hashes[a:b], prefix)[places].view(np.int64)
            own: dict[bytes, list[int]] = {}
            for k in np.flatnonzero(np.isin(values, np.asarray(wanted[i], np.int64))).tolist():
                for s in range(int(first[k]), int(last[k]) + 1):
                    own.setdefault(hashlib.blake2b(b" ".join(words[a + s:a + s + window]), digest_size=16).digest(), []).append(s)
            out += [(node, ids[i], at) for node, at in own.items()]
        return _rows(out, [pa.binary(), pa.int64(), pa.list_(pa.int32())], ["node", "doc_id", "starts"])
    return hit.mapInArrow(per_batch(run, "text"), "node binary, doc_id long, starts array<int>")


def _rows(rows: list[tuple], types: list, names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def shared_lengths(keys: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """How many leading entries each sorted row shares with the row before it."""
    if not len(keys):
        return np.zeros(0, np.int64)
    differ = keys[1:] != keys[:-1]
    depth = np.where(differ.any(1), differ.argmax(1), keys.shape[1])
    return np.r_[0, np.minimum(depth, np.minimum(lengths[1:], lengths[:-1]))]


def deep_nodes(rows: list[tuple], window: int) -> list[tuple[int, int]]:
    """Windows of whole groups of suffixes that repeat in a smaller document: (row number, window start
    within the snippet).

    Rows: (prefix, doc_id, place of the anchor in the snippet, last start in the snippet, firsts, snippet). Both trees are arrays of sorted
    word numbers; the node of a row at depth t is the run of neighbours that share t entries or more.
    """
    number: dict[bytes, int] = {}
    split = [r[5].split() for r in rows]
    coded = [np.fromiter([number.setdefault(w, len(number) + 1) for w in s], np.int64, len(s)) for s in split]
    n = len(rows)
    place = np.fromiter([r[2] for r in rows], np.int64, n)
    span = np.fromiter([r[3] for r in rows], np.int64, n)
    doc = np.fromiter([r[1] for r in rows], np.int64, n)
    group = np.unique(np.fromiter([r[0] for r in rows], np.int64, n), return_inverse=True)[1]
    reach = max(int(place.max()), 1)
    right, left = np.zeros((n, window + 1), np.int32), np.zeros((n, reach + 1), np.int32)
    right[:, 0] = left[:, 0] = group
    for i, c in enumerate(coded):
        p = int(place[i])
        tail, head = c[p:p + window], c[:p][::-1]
        right[i, 1:1 + len(tail)] = tail
        left[i, 1:1 + len(head)] = head
    trees = []
    for side in (right, left):
        order = np.lexsort(side.T[::-1])
        lcp = shared_lengths(side[order], np.full(n, side.shape[1]))
        trees.append((order, lcp))
    found = []
    rows_at = np.arange(n)
    for d in range(reach + 1):
        # The window that starts d words before the anchor belongs to the row if d is in its range.
        mine = (place >= d) & (place - d <= span)
        if not mine.any():
            continue
        nodes = []
        for (order, lcp), depth in zip(trees, (window - d + 1, d + 1)):
            node = np.empty(n, np.int64)
            node[order] = np.cumsum(lcp < depth)
            nodes.append(node)
        at = rows_at[mine]
        key = nodes[0][at] * (n + 1) + nodes[1][at]
        inverse = np.unique(key, return_inverse=True)[1]
        least = np.full(inverse.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, inverse, doc[at])
        for r in at[least[inverse] < doc[at]].tolist():
            found.append((r, int(place[r] - d)))
    return found


def tree_repeats(suffixes: DataFrame, window: int, tree_rows: int) -> DataFrame:
    """Trees over suffixes that lie by prefix: (doc_id, starts) of windows that a smaller document has too."""
    def run(it):
        held: list[tuple] = []
        for batch in it:
            for part in range(0, batch.num_rows, 4096):
                held += zip(*[c.to_pylist() for c in batch.slice(part, 4096).columns])
                if len(held) >= tree_rows and held[-1][0] != held[0][0]:
                    cut = len(held) - 1
                    while held[cut - 1][0] == held[-1][0]:
                        cut -= 1
                    yield from solve(held[:cut])
                    held = held[cut:]
        yield from solve(held)

    def solve(rows: list[tuple]):
        by_doc: dict[int, list[int]] = {}
        for r, start in deep_nodes(rows, window) if rows else ():
            by_doc.setdefault(rows[r][1], []).extend([first + start for first in rows[r][4]])
        if by_doc:
            yield pa.RecordBatch.from_arrays([pa.array(list(by_doc), pa.int64()), pa.array(list(by_doc.values()), pa.list_(pa.int32()))], ["doc_id", "starts"])

    return suffixes.mapInArrow(run, "doc_id long, starts array<int>")


def cut_texts(hit: DataFrame, window: int) -> DataFrame:
    """From (doc_id, text, starts): counts, digest of what is left, and the text that is left."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, starts = texts_of(batch, "text"), batch.column(2).to_pylist()
        counts, removed, shas, kept = [], [], [], []
        for text, at in zip(texts, starts):
            words = text.split()
            mark = np.zeros(len(words) + 1, np.int32)
            at = np.unique(np.asarray(at or [], np.int64))
            np.add.at(mark, at, 1)
            np.add.at(mark, np.minimum(at + window, len(words)), -1)
            gone = np.cumsum(mark)[:-1] > 0
            left = b" ".join([w for w, g in zip(words, gone.tolist()) if not g]) if len(at) else b" ".join(words)
            counts.append(len(words))
            removed.append(int(gone.sum()))
            shas.append(hashlib.sha256(left).hexdigest())
            kept.append(left.decode("utf-8", "replace"))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(shas), pa.array(kept)],
                                          ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])
    return hit.mapInArrow(per_batch(run, "text"), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


def repeated_windows(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, group_rows: int = GROUP_ROWS,
                     tree_rows: int = TREE_ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(all documents' digests with ``copy_of``, affected documents with their text, window starts to remove)."""
    info = stored(digests(docs, window, prefix), "substrings-digest")
    # Documents with the same words, all but the smallest id, are repeats as a whole.
    least = info.where(F.col("n_words") >= window).groupBy("sha").agg(F.min("doc_id").alias("_least")).select("_least")
    own = info.where(F.col("n_words") >= window).join(least, F.col("doc_id") == F.col("_least"), "left_semi")
    suffix = own.select("doc_id", F.explode(F.arrays_zip("anchors", "times")).alias("_a")).select("doc_id", F.col("_a.anchors").alias("prefix"), F.col("_a.times").alias("_times"))
    often = suffix.groupBy("prefix").agg(F.count("*").alias("_docs"), F.sum("_times").alias("_n")).where("_docs > 1").withColumnRenamed("prefix", "_prefix")
    again = suffix.join(often, F.col("prefix") == F.col("_prefix"))
    large = F.col("_n") > group_rows
    lists = again.groupBy("doc_id").agg(F.collect_list(F.when(~large, F.col("prefix"))).alias("moderate"), F.collect_list(F.when(large, F.col("prefix"))).alias("large"))
    lists = lists.withColumnRenamed("doc_id", "_hit")
    hit = stored(docs.join(lists, F.col("doc_id") == F.col("_hit")).select("doc_id", "text", "moderate", "large"), "substrings-hit")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_prefix = snippets(hit, window, prefix).repartition(tasks, "prefix").sortWithinPartitions("prefix")
    starts = tree_repeats(by_prefix, window, tree_rows)
    leaves = full_prefixes(hit.where(F.size("large") > 0), window, prefix)
    nodes = leaves.groupBy("node").agg(F.min("doc_id").alias("_least"), F.max("doc_id").alias("_most")).where("_least < _most")
    nodes = nodes.select(F.col("node").alias("_node"), "_least")
    hot = leaves.join(nodes, (F.col("node") == F.col("_node")) & (F.col("_least") < F.col("doc_id"))).select("doc_id", "starts")
    found = starts.unionByName(hot).groupBy("doc_id").agg(F.flatten(F.collect_list("starts")).alias("starts")).withColumnRenamed("doc_id", "_found")
    copies = info.where(F.col("n_words") >= window).join(least, F.col("doc_id") == F.col("_least"), "left_anti").select("doc_id")
    return info.drop("anchors", "times"), hit, found, copies


def dedup_substrings(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, id_col: str = "doc_id", text_col: str = "text",
                     group_rows: int = GROUP_ROWS, tree_rows: int = TREE_ROWS) -> DataFrame:
    """Per document: ``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256``; for documents that lost a part, ``kept_text``.

    A word is removed if a window of ``window`` words over it also starts in a document with a smaller id; windows
    are judged on the input. Null and empty texts have no words. Identifiers are expected to be unique and not
    null: rows that repeat one are judged as separate documents of equal rank, which remove nothing from each
    other. ``kept_text`` is null where nothing was removed (the text stays as it is) and empty where all was.
    Texts shorter than the window are never touched. An empty table gives an empty result; other columns of
    ``docs`` are not looked at.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    info, hit, found, copies = repeated_windows(base, window, prefix, group_rows, tree_rows)
    cut = cut_texts(hit.join(found, F.col("doc_id") == F.col("_found")).select("doc_id", "text", "starts"), window)
    cut = cut.select(F.col("doc_id").alias("_cut"), "n_removed", "kept_sha256", "kept_text")
    whole = copies.select(F.col("doc_id").alias("_copy")).distinct()
    out = info.join(cut, F.col("doc_id") == F.col("_cut"), "left").join(whole, F.col("doc_id") == F.col("_copy"), "left")
    is_copy = F.col("_copy").isNotNull()
    return out.select(
        "doc_id", "n_words", F.when(is_copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(is_copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(is_copy, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"))
