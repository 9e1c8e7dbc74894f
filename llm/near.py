"""Near-duplicate documents: MinHash bands, sequential Bayesian verification, exact check, components.

Documents are sets of word shingles. A signature of least hashes is cut into bands; documents that agree in a band
share a bucket. A candidate pair is compared batch by batch: with m of n hashes equal, the similarity has the
posterior Beta(m + 1, n - m + 1); the pair is dropped as soon as the chance that it reaches the threshold falls
below the chosen miss probability. What survives all batches is checked on the full shingle sets.

Buckets may be very large, so pairs are not formed within them. Each bucket has a hub (the member that shares most
buckets); members are compared with the hub first, then those still apart with a second hub. Only members of
buckets that still span several components are compared with each other, in blocks of bounded size inside tasks,
and only across components: a link between two documents of one component could not change the result. Before
that, shingles that no other document of these buckets has are counted: they bound how much a document can share
with any other, which rules most of them out exactly. Documents with the same words are one vertex from the start; a vertex is a
text and not an identifier, so rows that repeat an identifier keep the links of each of their texts.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import LOWER, flat_words, free_name, gram_hashes, per_batch, stored, texts_of, word_hashes
from llm.graph import components

SHINGLE, PERCENT = 4, 80
BANDS, ROWS, BATCH = 30, 5, 30
MISS = 1e-6
# Members of a bucket that a block holds.
BLOCK = 256


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct shingles of one document; fewer than ``k`` words are one shingle."""
    return np.unique(gram_hashes(hashes, min(k, len(hashes)))) if len(hashes) else np.zeros(0, np.uint64)


def multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(20240607).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(docs: DataFrame, k: int, size: int) -> DataFrame:
    """``doc_id``, ``raw``, ``n_shingles``, ``words`` (digest of the word sequence), ``sig`` (null without words)."""
    factors = multipliers(size)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, starts = flat_words([t.translate(LOWER) for t in texts_of(batch, "text")])
        hashes = word_hashes(words)
        sets = [shingles(hashes[a:b], k) for a, b in zip(starts, starts[1:])]
        counts = np.array([len(s) for s in sets], np.int64)
        full = np.flatnonzero(counts)
        out = np.zeros((len(full), size), np.uint32)
        if len(full):
            flat = np.concatenate([sets[i] for i in full])
            begin = np.r_[0, np.cumsum(counts[full])[:-1]]
            buffer = np.empty_like(flat)
            for j in range(size):
                np.multiply(flat, factors[j], out=buffer)
                out[:, j] = np.minimum.reduceat(buffer, begin) >> np.uint64(32)
        sigs: list[bytes | None] = [None] * len(sets)
        for i, s in zip(full, out):
            sigs[i] = s.tobytes()
        digests = [hashlib.blake2b(b" ".join(words[a:b]), digest_size=16).digest() if b > a else None for a, b in zip(starts, starts[1:])]
        return pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(counts), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary())],
                                          ["doc_id", "raw", "n_shingles", "words", "sig"])
    return docs.select("doc_id", "raw", "text").mapInArrow(per_batch(run, "text"), "doc_id long, raw long, n_shingles long, words binary, sig binary")


@lru_cache
def least_matches(n: int, percent: int, miss: float) -> int:
    """Fewest equal hashes of ``n`` at which the posterior chance of ``percent`` similarity reaches ``miss``.

    P(Beta(m + 1, n - m + 1) >= t) is P(Binomial(n + 1, t) <= m)."""
    t, total = percent / 100, 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * t ** m * (1 - t) ** (n + 1 - m)
        if total >= miss:
            return m
    return n


def plausible(left: np.ndarray, right: np.ndarray, percent: int, miss: float, batch: int = BATCH) -> np.ndarray:
    """Indices of the row pairs that no batch of hashes prunes."""
    alive, matches = np.arange(len(left)), np.zeros(len(left), np.int64)
    for a in range(0, left.shape[1], batch):
        b = min(a + batch, left.shape[1])
        matches[alive] += (left[alive, a:b] == right[alive, a:b]).sum(1)
        alive = alive[matches[alive] >= least_matches(b, percent, miss)]
    return alive


def verify_batches(pairs: DataFrame, sigs: DataFrame, percent: int, miss: float) -> DataFrame:
    """Candidate pairs (a, b) that stay plausible on whole signatures."""
    one = pairs.join(sigs.select(F.col("doc_id").alias("_a"), F.col("sig").alias("sig_a")), F.col("a") == F.col("_a")).drop("_a")
    two = one.join(sigs.select(F.col("doc_id").alias("_b"), F.col("sig").alias("sig_b")), F.col("b") == F.col("_b")).select("a", "b", "sig_a", "sig_b")

    def run(it):
        for batch in it:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                left, right = (np.frombuffer(b"".join(part.column(i).to_pylist()), np.uint32).reshape(part.num_rows, -1) for i in (2, 3))
                yield part.select(["a", "b"]).take(pa.array(plausible(left, right, percent, miss)))
    return two.mapInArrow(run, "a long, b long")


def verify_exactly(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full shingle sets are similar enough; ``texts`` has the documents that share a bucket."""
    one = pairs.join(texts.select(F.col("doc_id").alias("_a"), F.col("text").alias("text_a")), F.col("a") == F.col("_a")).drop("_a")
    two = one.join(texts.select(F.col("doc_id").alias("_b"), F.col("text").alias("text_b")), F.col("b") == F.col("_b")).select("a", "b", "text_a", "text_b")

    def run(it):
        step = per_batch(lambda part: part, "text_a", 1 << 20)
        known: dict[int, np.ndarray] = {}
        for part in step(it):
            keep = []
            a, b = part.column(0).to_pylist(), part.column(1).to_pylist()
            texts = {**dict(zip(a, texts_of(part, "text_a"))), **dict(zip(b, texts_of(part, "text_b")))}
            fresh = [i for i in texts if i not in known]
            words, starts = flat_words([texts[i].translate(LOWER) for i in fresh])
            hashes = word_hashes(words)
            sets = known | {i: shingles(hashes[s:e], k) for i, s, e in zip(fresh, starts, starts[1:])}
            for x, y in zip(a, b):
                both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                keep.append(100 * both >= percent * (len(sets[x]) + len(sets[y]) - both))
            # Hubs come again; only the sets of the last few are kept.
            known = {i: sets[i] for i in dict.fromkeys(b[-16:] + a[-16:])}
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return two.mapInArrow(run, "a long, b long")


def with_unique(members: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """Add ``n`` (shingles) and ``own`` (those that no other document among ``members`` has)."""
    ids = members.select(F.col("doc_id").alias("_w")).distinct()
    wanted = texts.join(ids, F.col("doc_id") == F.col("_w"), "left_semi")

    def spread(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, starts = flat_words([t.translate(LOWER) for t in texts_of(batch, "text")])
        hashes = word_hashes(words)
        sets = [shingles(hashes[a:b], k) for a, b in zip(starts, starts[1:])]
        owner = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), [len(s) for s in sets])
        return pa.RecordBatch.from_arrays([pa.array(owner, pa.int64()), pa.array(np.concatenate(sets).view(np.int64))], ["owner", "shingle"])

    flat = wanted.mapInArrow(per_batch(spread, "text"), "owner long, shingle long")
    # Both counts come from one shuffle by shingle: a shingle of one document counts for it.
    seen = flat.groupBy("shingle").agg(F.count("*").alias("_n"), F.min("owner").alias("_owner")).where("_n = 1")
    own = seen.groupBy("_owner").agg(F.count("*").alias("_own"))
    return members.join(own, F.col("doc_id") == F.col("_owner"), "left").withColumn("own", F.coalesce("_own", F.lit(0))).drop("_owner", "_own")


def across(members: DataFrame, sigs: DataFrame, texts: DataFrame, k: int, percent: int, miss: float, block: int = BLOCK) -> DataFrame:
    """Links between components in buckets (key, doc_id, component, first: component of the hub, n, own).

    Members outside the hub's component are probes, all members are targets. A document of n shingles, of which
    ``own`` are in no other, reaches the threshold t only with documents of t * n to (n - own) / t - own shingles; it
    is a probe only if its bucket has such sizes. Probes and targets are dealt into chunks of about ``block``; each
    pair of chunks is one group, compared by that bound and on one byte of each hash, which can only make a pair
    look more alike. What stays plausible is checked there on full sets, and a group returns only links that join
    what its earlier links have not joined: fewer rows than documents, which connect all that belongs together."""
    t = percent / 100
    sized = members.groupBy("key").agg(F.min("n").alias("_least"), F.max("n").alias("_most")).withColumnRenamed("key", "_key")
    low_n, high_n = F.floor(F.col("n") * t), F.ceil((F.col("n") - F.col("own")) / t - F.col("own"))
    fits = (low_n <= high_n) & (low_n <= F.col("_most")) & (high_n >= F.col("_least"))
    members = members.join(sized, F.col("key") == F.col("_key")).where(fits).drop("_key", "_least", "_most")
    size = members.groupBy("key").agg(F.count("*").alias("_m"), F.sum((F.col("component") != F.col("first")).cast("long")).alias("_r")).where("_r > 0 and _m > 1")
    size = size.select(F.col("key").alias("_key"), F.ceil(F.col("_m") / block).cast("int").alias("_targets"), F.ceil(F.col("_r") / block).cast("int").alias("_probes"))
    both = members.join(size, F.col("key") == F.col("_key"))
    chunk = lambda n: F.pmod(F.xxhash64("doc_id"), n).cast("int")
    targets = both.select("key", "doc_id", "component", "n", "own", F.lit(0).alias("role"), F.explode(F.sequence(F.lit(0), F.col("_probes") - 1)).alias("i"), chunk(F.col("_targets")).alias("j"))
    probes = both.where("component != first").select("key", "doc_id", "component", "n", "own", F.lit(1).alias("role"), chunk(F.col("_probes")).alias("i"),
                                                     F.explode(F.sequence(F.lit(0), F.col("_targets") - 1)).alias("j"))
    narrow = sigs.select(F.col("doc_id").alias("_doc"), "low").join(texts.select(F.col("doc_id").alias("_text"), "text"), F.col("_doc") == F.col("_text"))
    rows = targets.unionByName(probes).join(narrow, F.col("doc_id") == F.col("_doc"))
    tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select(F.xxhash64("key", "i", "j").alias("cell"), "role", "doc_id", "component", "low", "n", "own", "text").repartition(tasks, "cell").sortWithinPartitions("cell", "role")

    def compare(cell: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        role = np.array([r[1] for r in cell])
        doc, comp = (np.array([r[n] for r in cell], np.int64) for n in (2, 3))
        low = np.frombuffer(b"".join(r[4] for r in cell), np.uint8).reshape(len(cell), -1)
        target = np.flatnonzero(role == 0)
        n, own = (np.array([r[i] for r in cell], np.int64) for i in (5, 6))
        head = {c: c for c in comp.tolist()}
        sets: dict[int, np.ndarray] = {}

        def root(c):
            while head[c] != c:
                head[c] = c = head[head[c]]
            return c

        def full(i):
            if i not in sets:
                sets[i] = shingles(word_hashes(cell[i][7].encode().translate(LOWER).split()), k)
            return sets[i]

        left, right = [], []
        for p in np.flatnonzero(role == 1).tolist():
            most = np.minimum(n[target] - own[target], n[p] - own[p])
            apart = target[(comp[target] != comp[p]) & (100 * most >= percent * (n[target] + n[p] - most))]
            likely = apart[plausible(np.broadcast_to(low[p], (len(apart), low.shape[1])), low[apart], percent, miss)]
            # The most alike come first, so that one link spares the rest of its component.
            for t in likely[np.argsort(-(low[likely] == low[p]).sum(1), kind="stable")].tolist():
                x, y = root(int(comp[p])), root(int(comp[t]))
                if x == y:
                    continue
                both = len(np.intersect1d(full(p), full(t), assume_unique=True))
                if 100 * both >= percent * (len(full(p)) + len(full(t)) - both):
                    head[max(x, y)] = min(x, y)
                    left.append(int(doc[p]))
                    right.append(int(doc[t]))
        return np.array(left, np.int64), np.array(right, np.int64)

    def run(it):
        held: list[tuple] = []
        for batch in it:
            for at in range(0, batch.num_rows, 2048):
                for row in zip(*[c.to_pylist() for c in batch.slice(at, 2048).columns]):
                    if held and row[0] != held[0][0]:
                        yield pack(*compare(held))
                        held = []
                    held.append(row)
        if held:
            yield pack(*compare(held))

    def pack(left, right):
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(left, right)), pa.array(np.minimum(left, right))], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long").distinct()


def near_components(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, miss: float = MISS,
                    id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Per document: ``doc_id``, ``n_shingles``, ``component_id``, ``kept`` (its id is its component's).

    Documents link if 100 * intersection >= ``percent`` * union of their sets of ``shingle`` words (A-Z in lower
    case); fewer words are one shingle. Null, empty and wordless texts have no shingles and link with nothing. Texts of
    any length are read whole. Each row is answered by its own text, also where rows repeat an identifier; a null
    identifier is its component's only where that has no other. An empty table gives an empty result; other columns of
    ``docs`` are not looked at, whatever their names. A true pair is missed with a chance of (1 - s ** rows) ** bands
    for similarity s, and of ``miss`` per batch afterwards.
    """
    out = near_rows(docs, shingle, percent, bands, rows, miss, id_col, text_col, block)
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_rows(docs: DataFrame, shingle: int, percent: int, bands: int, rows: int, miss: float, id_col: str, text_col: str, block: int) -> DataFrame:
    """Per document: ``doc_id``, ``raw`` (hash of its text), ``n_shingles``, and ``component_id`` and ``component_raw``, the
    identifier and text hash of the first document of its component (null without words)."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("raw", F.xxhash64("text"))
    info = stored(signatures(base, shingle, bands * rows), "near-signatures")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "raw"))
    least = info.where("words is not null").groupBy(F.col("words").alias("_words")).agg(first.alias("_first"))
    # Vertices are numbered in the order of their first documents, so a component's least vertex is that of its least document.
    least = least.repartitionByRange("_first").sortWithinPartitions("_first").select("_words", F.col("_first.doc_id").alias("_least"),
                                                                                   F.col("_first.raw").alias("_raw"), F.monotonically_increasing_id().alias("vertex"))
    least = stored(least, "near-least")
    # One byte of each hash for the block comparison.
    low = F.unhex(F.regexp_replace(F.hex("sig"), "(..)......", "$1"))
    mine = info.join(least, F.col("words") == F.col("_words"))
    heads = mine.where(F.col("doc_id").eqNullSafe(F.col("_least")) & (F.col("raw") == F.col("_raw")))
    heads = stored(heads.select(F.col("vertex").alias("doc_id"), "sig", low.alias("low"), F.col("doc_id").alias("_own"), "raw", "n_shingles"), "near-vertices")
    if not heads.groupBy("doc_id").count().where("count > 1").isEmpty():  # rows that repeat id and text, none in sound data
        heads = stored(heads.dropDuplicates(["doc_id"]), "near-vertices")
    sigs = heads.select("doc_id", "sig", "low")
    width = rows * 4
    keys = F.array(*[F.xxhash64(F.lit(b), F.expr(f"substring(sig, {b * width + 1}, {width})")) for b in range(bands)])
    band = sigs.select("doc_id", F.explode(keys).alias("key"))
    size = band.groupBy("key").agg(F.count("*").alias("_n")).where("_n > 1").withColumnRenamed("key", "_key")
    band = stored(band.join(size, F.col("key") == F.col("_key")).select("key", "doc_id", "_n"), "near-bands")
    hub = band.groupBy("doc_id").agg(F.sum("_n").alias("hub")).withColumnRenamed("doc_id", "_doc")
    members = stored(band.join(hub, F.col("doc_id") == F.col("_doc")).select("key", "doc_id", "hub"), "near-members")
    # The texts of all documents that share a bucket are picked once; a merge join at every size, so costs grow evenly.
    shared = heads.join(members.select(F.col("doc_id").alias("_w")).distinct(), F.col("doc_id") == F.col("_w"), "left_semi")
    shared = shared.select(F.col("doc_id").alias("_vertex"), "_own", F.col("raw").alias("_raw"))
    texts = base.hint("merge").join(shared, F.col("doc_id").eqNullSafe(F.col("_own")) & (F.col("raw") == F.col("_raw")))
    texts = stored(texts.select(F.col("_vertex").alias("doc_id"), "text").dropDuplicates(["doc_id"]), "near-texts")
    top = F.max(F.struct("hub", (-F.col("doc_id")).alias("minus")))

    def pairs_with(rest: DataFrame, of: DataFrame) -> DataFrame:
        hubs = of.groupBy("key").agg((-top["minus"]).alias("_hub")).withColumnRenamed("key", "_key")
        out = rest.join(hubs, F.col("key") == F.col("_key")).where("doc_id != _hub")
        return out.select(F.greatest("doc_id", "_hub").alias("a"), F.least("doc_id", "_hub").alias("b")).distinct()

    # Each step starts from the components known so far, which hold all that earlier links say, and adds its own links.
    comps = components(stored(verify_exactly(verify_batches(pairs_with(members, members), sigs, percent, miss), texts, shingle, percent), "near-links"))
    for step in ("second", "blocks"):
        known = comps.select(F.col("doc_id").alias("_doc"), "component_id")
        named = members.join(known, F.col("doc_id") == F.col("_doc"), "left").select("key", "doc_id", "hub", F.coalesce("component_id", "doc_id").alias("component"))
        named = stored(named, "near-named")
        tops = named.groupBy("key").agg(F.max(F.struct("hub", (-F.col("doc_id")).alias("minus"), "component"))["component"].alias("first"),
                                        F.min("component").alias("_x"), F.max("component").alias("_y")).where("_x != _y")
        tops = tops.select(F.col("key").alias("_key"), "first")
        open_ = stored(named.join(tops, F.col("key") == F.col("_key")).select("key", "doc_id", "hub", "component", "first"), "near-open")
        if step == "second":
            rest = open_.where("component != first")
            found = verify_exactly(verify_batches(pairs_with(rest, rest), sigs, percent, miss), texts, shingle, percent)
        else:
            sizes = heads.select(F.col("doc_id").alias("_doc"), F.col("n_shingles").alias("n"))
            counted = with_unique(open_, texts, shingle).join(sizes, F.col("doc_id") == F.col("_doc")).drop("_doc")
            found = across(counted, sigs, texts, shingle, percent, miss, block)
        found = stored(found.select("a", "b"), "near-links")
        if not found.isEmpty():
            comps = components(comps.select(F.col("doc_id").alias("a"), F.col("component_id").alias("b")).unionByName(found))
    comps = comps.select(F.col("doc_id").alias("_doc"), F.col("component_id").alias("_comp"))
    # Of each vertex the first document of its component; most vertices are components of their own and need no look-up.
    named = least.select(F.col("vertex").alias("_v"), F.col("_least").alias("_comp_least"), F.col("_raw").alias("_comp_raw"))
    comps = comps.join(named, F.col("_comp") == F.col("_v")).select("_doc", "_comp_least", "_comp_raw")
    vertex = info.join(least, F.col("words") == F.col("_words"), "left").join(comps, F.col("vertex") == F.col("_doc"), "left")
    linked = F.col("_doc").isNotNull()
    return vertex.select("doc_id", "raw", "n_shingles", F.when(linked, F.col("_comp_least")).otherwise(F.col("_least")).alias("component_id"),
                         F.when(linked, F.col("_comp_raw")).otherwise(F.col("_raw")).alias("component_raw"))


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS,
              rows: int = ROWS, miss: float = MISS, block: int = BLOCK) -> DataFrame:
    """One row of each group of near duplicates, that of the smallest identifier, with all columns, whatever their names.

    Rows are told apart by identifier and text: a row whose identifier another text has too is judged by its own text, and
    of rows that repeat both one stays. Null, empty and wordless texts stay, but repeats of them with the same identifier
    go too; an empty table stays empty.
    """
    found = stored(near_rows(docs, shingle, percent, bands, rows, miss, id_col, text_col, block), "near-rows")
    gone_id, gone_raw = free_name(docs, "gone"), free_name(docs, "gone_raw")
    raw = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    same = F.col("doc_id").eqNullSafe(F.col("component_id")) & F.col("raw").eqNullSafe(F.col("component_raw"))
    gone = found.where(F.col("component_raw").isNotNull() & ~same).select(F.col("doc_id").alias(gone_id), F.col("raw").alias(gone_raw)).distinct()
    left = docs.join(gone, docs[id_col].cast("long").eqNullSafe(F.col(gone_id)) & (raw == F.col(gone_raw)), "left_anti")
    twice = found.groupBy(F.col("doc_id").alias(gone_id), F.col("raw").alias(gone_raw)).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    if twice.isEmpty():
        return left
    # Exact repeats of rows, none in sound data: one of each is picked.
    repeats = docs[id_col].cast("long").eqNullSafe(F.col(gone_id)) & (raw == F.col(gone_raw))
    single = left.join(twice, repeats, "left_anti")
    return single.unionByName(left.join(twice, repeats, "left_semi").dropDuplicates([id_col, text_col]))
