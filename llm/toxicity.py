"""Toxicity by a factorization machine over hashed terms.

Terms of a document are its distinct words and the beginnings of its words, hashed to 32 bits. The machine scores
``bias + sum of w + sum over pairs of <v, v'>``, so two terms may mean more together than apart. It is fitted on
a bounded sample of labelled rows and applied to every document in one scan, without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import flat_words, held_out, per_batch, stored, texts_of, word_hashes
from llm.decontaminate import TABLE

# The sample of labelled rows that the machine is fitted on: at most so many of each class, chosen by hash of the id.
SAMPLE_POSITIVE, SAMPLE_NEGATIVE = 3_000, 6_000
# Terms enter if their presence differs between the classes by this chi-square value (p below 0.0001).
LEAST_CHI2 = 15.1
FACTORS, EPOCHS, RATE, DECAY, SEED = 4, 40, 0.1, 1e-4, 7
ODDS_SHARE, PAIR_DECAY = 0.5, 1e-2
PREFIXES = (4, 5)
THRESHOLD = 0.3


def terms_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed terms of each text: text numbers and terms, sorted by text."""
    sets = [set(t.translate(TABLE).split()) for t in texts]
    words, starts = flat_words([])
    counts = []
    for s in sets:
        words.extend(s)
        counts.append(len(s))
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), counts)
    # A beginning is a term only of longer words; the length salts its hash.
    terms, owners = [word_hashes(words) >> np.uint64(32)], [owner]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for n in PREFIXES:
        longer = np.flatnonzero(lengths > n)
        terms.append(word_hashes([words[i][:n] + b"*" for i in longer.tolist()]) >> np.uint64(32))
        owners.append(owner[longer])
    key = np.unique((np.concatenate(owners).astype(np.uint64) << np.uint64(32)) | np.concatenate(terms))
    return (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)


@dataclass
class Machine:
    """Sorted terms with a weight and a vector each."""
    bias: float = -np.inf
    terms: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint32))
    w: np.ndarray = field(default_factory=lambda: np.zeros(0))
    v: np.ndarray = field(default_factory=lambda: np.zeros((0, FACTORS)))

    def known(self, owner: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.terms):
            return owner[:0], terms[:0].astype(np.int64)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        hit = self.terms[at] == terms
        return owner[hit], at[hit]

    def raw(self, owner: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Sum before the logistic function, and the summed vectors of each row."""
        total = self.bias + np.bincount(owner, self.w[at], n)
        summed = np.stack([np.bincount(owner, self.v[at, f], n) for f in range(self.v.shape[1])], 1) if n else np.zeros((0, self.v.shape[1]))
        squares = np.bincount(owner, (self.v[at] ** 2).sum(1), n)
        return total + 0.5 * ((summed ** 2).sum(1) - squares), summed

    def score(self, texts: list[bytes]) -> np.ndarray:
        owner, at = self.known(*terms_of(texts))
        x = np.clip(self.raw(owner, at, len(texts))[0], -40, 40)
        return 1 / (1 + np.exp(-x)) if np.isfinite(self.bias) else np.zeros(len(texts))


def log_odds(toxic: np.ndarray, df: np.ndarray, n1: float, n: int) -> np.ndarray:
    """Of terms in ``df`` of ``n`` texts, ``toxic`` of them among the ``n1`` toxic ones."""
    return np.log((toxic + 0.5) / (n1 + 1)) - np.log((df - toxic + 0.5) / (n - n1 + 1))


def chosen_terms(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Terms whose presence depends on the label (chi-square with one degree of freedom), ascending, and their log odds.

    Counted by an aggregate over (``_y``, ``_terms``); only the chosen ones come to the driver."""
    sizes = dict(rows.groupBy("_y").count().collect())
    n1, n = sizes.get(1, 0), sizes.get(0, 0) + sizes.get(1, 0)
    if not 0 < n1 < n:
        return np.zeros(0, np.uint32), np.zeros(0)

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        terms = [np.frombuffer(t, np.uint32) for t in batch.column(1).to_pylist()]
        y = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), [len(t) for t in terms])
        found, at = np.unique(np.concatenate(terms), return_inverse=True)
        return pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(np.bincount(at, minlength=len(found))), pa.array(np.bincount(at, y, len(found)).astype(np.int64))],
                                          ["term", "df", "toxic"])
    counted = rows.select("_y", "_terms").mapInArrow(per_batch(count, "_terms"), "term long, df long, toxic long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("toxic").alias("toxic"))
    df, a = F.col("df").cast("double"), F.col("toxic").cast("double")
    chi2 = F.try_divide(n * F.pow(a * n - df * n1, 2), df * (n - df) * n1 * (n - n1))
    got = sorted(map(tuple, counted.where((df >= 3) & (chi2 >= LEAST_CHI2)).select("term", "toxic", "df").collect()))
    terms, toxic, seen = (np.array(x) for x in zip(*got)) if got else (np.zeros(0, np.int64),) * 3
    return terms.astype(np.uint32), log_odds(toxic, seen, n1, n)


def fit_machine(owner: np.ndarray, terms: np.ndarray, y: np.ndarray, chosen: np.ndarray, odds: np.ndarray) -> Machine:
    """Logistic loss over the ``chosen`` terms by AdaGrad over shuffled batches; the same sample gives the same machine."""
    if not len(y):
        return Machine()
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    m = Machine(float(np.log(share / (1 - share))), chosen)
    rng = np.random.default_rng(SEED)
    # Weights start from a part of the log odds, so a term that few documents show alone counts alone too.
    m.w, m.v = ODDS_SHARE * odds, rng.normal(0, 0.05, (len(m.terms), FACTORS))
    owner, at = m.known(owner, terms)
    bounds = np.searchsorted(owner, np.arange(len(y) + 1))
    gw, gv, gb = np.full(len(m.w), 1e-6), np.full(m.v.shape, 1e-6), 1e-6
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for start in range(0, len(order), 64):
            rows = order[start:start + 64]
            where = np.concatenate([np.arange(bounds[r], bounds[r + 1]) for r in rows])
            local = np.repeat(np.arange(len(rows)), bounds[rows + 1] - bounds[rows])
            x = at[where]
            raw, summed = m.raw(local, x, len(rows))
            err = (1 / (1 + np.exp(-np.clip(raw, -40, 40))) - y[rows]) / len(rows)
            gb += err.sum() ** 2
            m.bias -= RATE * err.sum() / gb ** 0.5
            if len(x):
                used, inverse = np.unique(x, return_inverse=True)
                dw = np.bincount(inverse, err[local], len(used)) + DECAY * m.w[used]
                step = err[local][:, None] * (summed[local] - m.v[x])
                dv = np.stack([np.bincount(inverse, step[:, f], len(used)) for f in range(FACTORS)], 1) + PAIR_DECAY * m.v[used]
                gw[used] += dw ** 2
                gv[used] += dv ** 2
                m.w[used] -= RATE * dw / gw[used] ** 0.5
                m.v[used] -= RATE * dv / gv[used] ** 0.5
    return m


def fit_toxicity(docs: DataFrame, labels: DataFrame, positive: int = SAMPLE_POSITIVE, negative: int = SAMPLE_NEGATIVE,
                 id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Machine:
    """Fit on labelled rows that are not held out. The sample's identifiers (a bounded number) are broadcast; of its
    terms only those that an aggregate chooses come to the driver. The classes are sampled at different rates, which depend on the table's size; the bias
    is corrected for them by the counts of all labelled rows, so that a score means the same on any size. Several
    labels of one document: any 1 wins; null labels and ids don't count."""
    known = (labels.select(F.col(id_col).cast("long").alias("_label_id"), F.col(label_col).cast("int").alias("_y"))
             .where("_label_id is not null and _y is not null").where(~held_out("_label_id"))
             .groupBy("_label_id").agg(F.max("_y").alias("_y")).withColumn("_order", F.xxhash64("_label_id")))
    counts = {r["_y"]: r["count"] for r in known.groupBy("_y").count().where("_y in (0, 1)").collect()}
    sample = None
    for y, most in ((1, positive), (0, negative)):
        part = known.where(F.col("_y") == y).orderBy("_order", "_label_id").limit(most)
        sample = part if sample is None else sample.unionByName(part)
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    rows = texts.join(F.broadcast(sample), F.col("_id") == F.col("_label_id")).select("_id", "_y", "_text")

    def extract(batch: pa.RecordBatch) -> pa.RecordBatch:
        owner, terms = terms_of(texts_of(batch, "_text"))
        bounds = np.searchsorted(owner, np.arange(batch.num_rows + 1))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(
            [terms[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary())], ["_id", "_y", "_terms"])

    rows = stored(rows.mapInArrow(per_batch(extract, "_text"), "_id long, _y int, _terms binary"), "toxicity-sample")
    chosen, odds = chosen_terms(rows)

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = [np.intersect1d(np.frombuffer(t, np.uint32), chosen, assume_unique=True).tobytes() for t in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(own, pa.binary())], ["_id", "_y", "_terms"])
    got = sorted((tuple(r) for r in rows.mapInArrow(per_batch(keep, "_terms"), rows.schema).collect()), key=lambda r: (r[0], r[2]))
    if not got:
        return Machine()
    terms = [np.frombuffer(r[2], np.uint32) for r in got]
    owner = np.repeat(np.arange(len(got), dtype=np.int32), [len(t) for t in terms])
    y = np.array([r[1] for r in got], float)
    del got
    machine = fit_machine(owner, np.concatenate(terms), y, chosen, odds)
    if counts.get(1) and counts.get(0):
        machine.bias -= float(np.log(min(1, positive / counts[1]) / min(1, negative / counts[0])))
    return machine


def score_toxicity(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``held_out``, ``score``, ``predicted`` (1 from ``threshold`` on).

    Null and empty texts get the score of a text without terms. Repeated rows are scored each; empty tables give
    empty results; without any labelled row every score is 0. Other columns are not looked at.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(machine.score(texts_of(batch, "_text")), pa.float64())], ["doc_id", "score"])

    scored = base.mapInArrow(per_batch(run, "_text"), "doc_id long, score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, machine: Machine, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns, whatever their names, in one scan.

    Null and empty texts are scored as texts without terms; repeated rows stay or go alike; an empty table stays empty;
    without any labelled row all stay. Whole texts are scored, a very long one in a piece of its own."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(machine.score(texts_of(batch, text_col)) < threshold))

    return docs.mapInArrow(per_batch(run, text_col), docs.schema)
