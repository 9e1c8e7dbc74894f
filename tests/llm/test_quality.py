"""Quality counts against plain Python, the model's score against a loop over n-grams, and its held-out accuracy."""
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from llm import quality as Q
from llm.common import gram_hashes, mix, word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "text string, doc_id long, quality string, kept int, _text string, n_words string"


def plain(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    covered = {i + j for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), failed


def made(n=150, seed=3):
    rng = random.Random(seed)
    words = ["a", "É", "日本x", "|", "#1", "b$", "x\x1cy", " ", "two", "three", "<p>", "end."] + [f"w{i}" for i in range(300)]
    texts = [None, "", " \t\n", "a a a", "a b", "\n\n", "x\n x\nx\n\r\nx", "y\x0b\ny\x0c\ny", "a b c " * 40, ("a b c d\n" * 9) + "e " * 60, "w " * 50, "| " * 50_000]
    while len(texts) < n:
        few = rng.sample(words, rng.choice([3, 12, 200]))
        texts.append("".join(rng.choice(few) + rng.choice([" ", " ", " ", "\n", "\t", "  "]) for _ in range(rng.randint(1, 200))))
    return texts


def test_counts(spark):
    texts = made()
    frame = spark.createDataFrame([(t, i if i != 7 else None, "q", 5, "z", "w") for i, t in enumerate(texts)], SCHEMA)
    got = Q.quality_rules(frame, Q.Model())
    want = sorted(str((i if i != 7 else None, *plain(t), 1.0, not plain(t)[-1])) for i, t in enumerate(texts))
    assert sorted(str(tuple(r)) for r in got.collect()) == want
    left = Q.drop_low_quality(frame.union(frame), Q.Model())
    assert left.columns == frame.columns and sorted(r["text"] for r in left.collect()) == sorted([t for t in texts if not plain(t)[-1]] * 2)
    assert Q.quality_rules(frame.limit(0), Q.Model()).collect() == [] and Q.drop_low_quality(frame.limit(0), Q.Model()).collect() == []


def test_many_words_in_one_piece():
    """So many distinct words that window numbers are made in two steps."""
    piece = Q.Piece([b" ".join(b"w%d" % i for i in range(1_700_000)) + b" w0 w1 w2"])
    assert piece.repeated().tolist() == [6]


def test_score_is_the_mean_weight_of_ngrams():
    rng = np.random.default_rng(1)
    model = Q.Model(rng.normal(size=Q.BUCKETS), 0.3, 0.7, -0.2)
    texts = [(t or "").encode() for t in made(40)][:11] + [b"ab", b"\xc3\xa9"]
    got = model.probability(Q.Piece(texts))
    size, shift = 1 << Q.BUCKET_BITS, np.uint64(64 - Q.BUCKET_BITS)
    for text, p in zip(texts, got):
        words, raw, base = text.split(), model.bias, 0
        for n in Q.WORD_GRAMS:
            at = [int(gram_hashes(word_hashes(words[i:i + n]), n)[0] >> shift) + base for i in range(len(words) - n + 1)]
            raw += Q.STRETCH * model.weights[at].mean() if at else 0
            base += size
        for n in Q.BYTE_GRAMS:
            keys = [int.from_bytes(text[i:i + n], "big") + (n << 56) for i in range(len(text) - n + 1)]
            at = (mix(np.array(keys, np.uint64)) >> shift).astype(int) + base
            raw += Q.STRETCH * model.weights[at].mean() if len(at) else 0
            base += size
        assert p == pytest.approx(1 / (1 + np.exp(-(model.a * raw + model.b))), rel=1e-9)
    # What the model learns from is what it is scored by.
    for (at, value), p in zip(Q.features(Q.Piece(texts)), got):
        assert Q.logistic(model.a * (model.bias + (model.weights[at] * value).sum()) + model.b) == pytest.approx(p, rel=1e-4)


def test_calibration_gives_rates():
    """Among rows of a raw value the mapped value is the share of good rows, whatever the sampling of the classes."""
    rng = np.random.default_rng(2)
    raw = rng.normal(size=20_000) * 3
    y = (rng.random(len(raw)) < Q.logistic(1.5 * raw - 1)).astype(int)
    keep = (y == 0) | (rng.random(len(raw)) < .25)  # good rows at a quarter
    a, b = Q.calibrate(raw[keep], y[keep], np.where(y[keep] == 1, 4.0, 1.0))
    assert a == pytest.approx(1.5, abs=.1) and b == pytest.approx(-1, abs=.1)
    assert Q.calibrate(np.ones(5), np.ones(5, int), np.ones(5)) == (1.0, 0.0)
    a, b = Q.calibrate(np.r_[np.full(50, -2.0), np.full(50, 2.0)], np.repeat([0, 1], 50), np.ones(100))
    assert np.isfinite([a, b]).all() and Q.logistic(2 * a + b) > .95 and Q.logistic(-2 * a + b) < .05


def test_held_out_accuracy(spark):
    from llm.queries import QUERIES
    sf = "/root/testdata/sf0.01"
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op12_quality_rules"](spark, sf).collect() if r["doc_id"] in label and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    right = [(r["quality"] >= .5) == (label[r["doc_id"]] == 1) for r in rows if not r["base_failed"]]
    assert len(right) > 50 and sum(right) >= .97 * len(right)
    assert all(r["kept"] == (not r["base_failed"] and r["quality"] >= .5) for r in rows)


def test_without_labels(spark):
    docs = spark.createDataFrame([("w " * 60, 1), ("b " * 60, 2)], "text string, doc_id long")
    for labels in ([], [(1, None), (None, 0)], [(1, 1), (2, 1)]):
        assert Q.fit_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int")).weights is None
