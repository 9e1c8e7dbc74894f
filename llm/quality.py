"""Quality rules: counts with fixed limits, and a hashed n-gram logistic regression with a fixed threshold.

The model sees word n-grams and character n-grams (of bytes), each hashed into buckets. A family of n-grams enters
with the share that each bucket has of the text's n-grams, so texts of any length are alike in scale. It is fitted
on a bounded sample of labelled rows; a part of the sample that it does not learn weights from calibrates it to
probabilities (Platt's logistic map). Every whole text is then scored in Arrow batches in one scan, without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import gram_hashes, held_out, mix, per_batch, texts_of, word_hashes

# At most so many labelled rows of each class are learnt from, chosen by hash of the id; a quarter of them calibrates.
SAMPLE_LOW, SAMPLE_HIGH = 1_000, 2_000
BUCKET_BITS, WORD_GRAMS, BYTE_GRAMS = 12, (1, 2), (1, 2, 3, 4)
# A bucket's share of a family's n-grams is small; so many times the share is the model's input.
STRETCH = 10.0
EPOCHS, BATCH, RATE, DECAY, SEED = 15, 32, 0.3, 1e-5, 5
# Below this probability of good quality a text is not kept.
THRESHOLD = 0.5
LEAST_WORDS, MOST_REPEAT_PERCENT, SYMBOLS = 50, 50, b"#*$%&|<>"
BUCKETS = (len(WORD_GRAMS) + len(BYTE_GRAMS)) << BUCKET_BITS


def logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Piece:
    """Some texts, cut into words once: words in one list as numbers of distinct words, and where each text begins."""

    def __init__(self, texts: list[bytes]):
        self.texts, number, ids = texts, {}, []
        counts = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            words = text.split()
            counts[i] = len(words)
            ids += [number.setdefault(w, len(number)) for w in words]
        self.distinct, self.counts = list(number), counts
        self.ids = np.array(ids, np.int64)
        self.owner = np.repeat(np.arange(len(texts)), counts)

    def families(self):
        """For each kind of n-gram: the text and the bucket of every one; none crosses from a text into the next."""
        shift, size = np.uint64(64 - BUCKET_BITS), 1 << BUCKET_BITS
        hashes = word_hashes(self.distinct)[self.ids] if len(self.ids) else np.zeros(0, np.uint64)
        base = 0
        for n in WORD_GRAMS:
            inside = self.owner[:len(self.owner) - n + 1] == self.owner[n - 1:]
            yield self.owner[:len(inside)][inside], (gram_hashes(hashes, n)[inside] >> shift).astype(np.int64) + base
            base += size
        raw = np.frombuffer(b"".join(self.texts), np.uint8).astype(np.uint64)
        owner = np.repeat(np.arange(len(self.texts)), [len(t) for t in self.texts])
        packed = np.zeros(len(raw), np.uint64)
        for n in range(1, max(BYTE_GRAMS) + 1):
            packed = (packed[:len(raw) - n + 1] << np.uint64(8)) | raw[n - 1:]
            if n in BYTE_GRAMS:
                inside = owner[:len(packed)] == owner[n - 1:]
                yield owner[:len(packed)][inside], (mix(packed[inside] + np.uint64(n << 56)) >> shift).astype(np.int64) + base
                base += size

    def repeated(self) -> np.ndarray:
        """Of each text, the words inside windows of three words that it holds twice or more. Exact: windows are told
        apart by their word numbers."""
        texts, distinct, x = len(self.texts), len(self.distinct), self.ids
        if len(x) < 3:
            return np.zeros(texts, np.int64)
        head, size = x[:-2] * distinct + x[1:-1], distinct * distinct
        if size * distinct * texts >= 2 ** 62:
            head = np.unique(head, return_inverse=True)[1]
        key = (head * distinct + x[2:]) * texts + self.owner[2:]
        inside = np.flatnonzero(self.owner[:-2] == self.owner[2:])
        _, inverse, often = np.unique(key[inside], return_inverse=True, return_counts=True)
        starts = inside[often[inverse] > 1]
        mark = np.zeros(len(x), bool)
        for j in range(3):
            mark[starts + j] = True
        return np.bincount(self.owner[mark], minlength=texts)

    def base(self) -> dict[str, list[int] | np.ndarray]:
        """The counts that rules look at."""
        chars, symbols, lines = [], [], []
        for text in self.texts:
            words = b"".join(text.split())
            chars.append(len(words.translate(None, CONTINUED)))
            symbols.append(len(text) - len(text.translate(None, SYMBOLS)))
            some = [line for line in text.split(b"\n") if line.strip()]
            lines.append(len(some) - len(set(some)))
        return {"n_words": self.counts, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": lines, "n_repeat_words": self.repeated()}


# Bytes inside a character after its first.
CONTINUED = bytes(range(128, 192))


@dataclass
class Model:
    """Weights of all buckets; ``a`` and ``b`` map the raw sum to a probability. Unfitted, every text is good."""
    weights: np.ndarray | None = None
    bias: float = 0.0
    a: float = 1.0
    b: float = 0.0

    def probability(self, piece: Piece) -> np.ndarray:
        texts = len(piece.texts)
        if self.weights is None:
            return np.ones(texts)
        raw = np.full(texts, self.bias)
        for owner, at in piece.families():
            raw += STRETCH * np.bincount(owner, self.weights[at], texts) / np.maximum(np.bincount(owner, minlength=texts), 1)
        return logistic(self.a * raw + self.b)


def features(piece: Piece) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each text the buckets and the model's inputs."""
    texts, keys, values = len(piece.texts), [], []
    for owner, at in piece.families():
        key, count = np.unique(owner * BUCKETS + at, return_counts=True)
        keys.append(key)
        values.append(STRETCH * count / np.maximum(np.bincount(owner, minlength=texts), 1)[key // BUCKETS])
    key, value = np.concatenate(keys), np.concatenate(values)
    order = np.argsort(key, kind="stable")
    key, value = key[order], value[order].astype(np.float32)
    bounds = np.searchsorted(key, np.arange(texts + 1) * BUCKETS)
    return [((key[a:b] % BUCKETS).astype(np.int32), value[a:b]) for a, b in zip(bounds, bounds[1:])]


def fit_weights(at: list[np.ndarray], value: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic loss by AdaGrad over shuffled batches; the same rows give the same weights."""
    w, g, bias, gb = np.zeros(BUCKETS), np.full(BUCKETS, 1e-8), 0.0, 1e-8
    rng = np.random.default_rng(SEED)
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for start in range(0, len(order), BATCH):
            rows = order[start:start + BATCH]
            local = np.repeat(np.arange(len(rows)), [len(at[r]) for r in rows])
            x, v = np.concatenate([at[r] for r in rows]), np.concatenate([value[r] for r in rows])
            err = (logistic(bias + np.bincount(local, w[x] * v, len(rows))) - y[rows]) / len(rows)
            grad = np.bincount(x, err[local] * v, BUCKETS) + DECAY * w
            g += grad ** 2
            w -= RATE * grad / np.sqrt(g)
            gb += err.sum() ** 2
            bias -= RATE * err.sum() / np.sqrt(gb)
    return w, bias


def calibrate(raw: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """``a`` and ``b`` of the logistic map that makes ``raw`` a probability of ``y``, rows weighted; by Newton's steps on
    targets drawn in by one row of each class, so that separable rows give a finite map."""
    high, low = weight[y == 1].sum(), weight[y == 0].sum()
    if not high or not low:
        return 1.0, 0.0
    goal = np.where(y == 1, ((y == 1).sum() + 1) / ((y == 1).sum() + 2), 1 / ((y == 0).sum() + 2))
    scale = max(float(np.abs(raw).max()), 1e-9)
    x = np.c_[raw / scale, np.ones(len(raw))]
    at = np.array([0.0, np.log(high / low)])

    def loss(t):
        z = x @ t
        return float((weight * (np.logaddexp(0, z) - goal * z)).sum())
    for _ in range(100):
        p = logistic(x @ at)
        grad = x.T @ (weight * (p - goal))
        step = np.linalg.solve((x.T * (weight * p * (1 - p))) @ x + 1e-9 * weight.sum() * np.eye(2), grad)
        size = 1.0
        while loss(at - size * step) > loss(at) and size > 1e-6:
            size /= 2
        at = at - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return float(at[0] / scale), float(at[1])


def fit_quality(docs: DataFrame, labels: DataFrame, low: int = SAMPLE_LOW, high: int = SAMPLE_HIGH, id_col: str = "doc_id",
                text_col: str = "text", label_col: str = "quality") -> Model:
    """Fit on labelled rows that are not held out: at most ``low`` of class 0 and ``high`` of class 1, whatever the size of
    the tables. Rows with crc32(id) mod 4 = 3 calibrate, weighted by the inverse rate at which their class was taken of all
    labelled rows. Several labels of one document: any 0 wins; null labels and ids don't count. Without both classes
    nothing is learnt and every text is good."""
    known = (labels.select(F.col(id_col).cast("long").alias("_label_id"), F.col(label_col).cast("int").alias("_y"))
             .where("_label_id is not null and _y in (0, 1)").where(~held_out("_label_id"))
             .groupBy("_label_id").agg(F.min("_y").alias("_y")).withColumn("_order", F.xxhash64("_label_id")))
    counts = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}
    sample = (known.where("_y = 0").orderBy("_order", "_label_id").limit(low)
              .unionByName(known.where("_y = 1").orderBy("_order", "_label_id").limit(high)))
    part = (F.crc32(F.col("_label_id").cast("string").cast("binary")) % 4 == 3).cast("int")
    sample = sample.withColumn("_part", part)
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    rows = texts.join(F.broadcast(sample), F.col("_id") == F.col("_label_id")).select("_id", "_y", "_part", "_text")  # low + high ids at most

    def extract(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = features(Piece(texts_of(batch, "_text")))
        return pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array([a.tobytes() for a, _ in made], pa.binary()), pa.array([v.tobytes() for _, v in made], pa.binary())],
            ["_id", "_y", "_part", "_at", "_value"])
    got = sorted(map(tuple, rows.mapInArrow(per_batch(extract, "_text"), "_id long, _y int, _part int, _at binary, _value binary").collect()))
    at, value = [np.frombuffer(r[3], np.int32) for r in got], [np.frombuffer(r[4], np.float32) for r in got]
    y, apart = np.array([r[1] for r in got], int), np.array([r[2] for r in got], bool)
    learn = np.flatnonzero(~apart)
    if len(set(y[learn].tolist())) < 2:
        return Model()
    w, bias = fit_weights([at[i] for i in learn], [value[i] for i in learn], y[learn])
    raw = np.array([bias + float((w[at[i]] * value[i]).sum()) for i in np.flatnonzero(apart)])
    rate = {0: counts[0] / min(low, counts[0]), 1: counts[1] / min(high, counts[1])}
    a, b = calibrate(raw, y[apart], np.array([rate[c] for c in y[apart].tolist()]))
    return Model(w, bias, a, b)


OUT = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
       "base_failed boolean, quality double, kept boolean")


def judge(piece: Piece, model: Model, threshold: float, least_words: int, most_repeat: int) -> dict:
    out = piece.base()
    words, repeat = np.asarray(out["n_words"]), np.asarray(out["n_repeat_words"])
    out["base_failed"] = (words < least_words) | (100 * repeat > most_repeat * words)
    out["quality"] = model.probability(piece)
    out["kept"] = ~out["base_failed"] & (out["quality"] >= threshold)
    return out


def quality_rules(docs: DataFrame, model: Model, threshold: float = THRESHOLD, least_words: int = LEAST_WORDS,
                  most_repeat: int = MOST_REPEAT_PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: the five counts, ``base_failed``, ``quality`` (a probability) and ``kept``.

    Null and empty texts have no words and fail where ``least_words`` is above 0. Whole texts are read, a very long one
    in a piece of its own. Repeated rows and null ids are each reported; an empty table gives an empty result. Other
    columns are not looked at, whatever their names.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = judge(Piece(texts_of(batch, "_text")), model, threshold, least_words, most_repeat)
        return pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(v) for v in out.values()]], ["doc_id", *out])
    return base.mapInArrow(per_batch(run, "_text"), OUT)


def drop_low_quality(docs: DataFrame, model: Model, threshold: float = THRESHOLD, least_words: int = LEAST_WORDS,
                     most_repeat: int = MOST_REPEAT_PERCENT, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, with all their columns, in one scan. Null and empty texts go,
    repeated rows stay alike, an empty table stays empty."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(judge(Piece(texts_of(batch, text_col)), model, threshold, least_words, most_repeat)["kept"]))
    return docs.mapInArrow(per_batch(run, text_col), docs.schema)
