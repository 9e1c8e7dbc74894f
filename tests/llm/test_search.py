"""Ranked search against a plain scan of all documents."""
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from llm import search as S

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "text string, doc_id long, item_id string, score int, rank string, shard int, term string, at int, q_term int"


def terms(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def brute(docs, items, top=20):
    bags = [(i, Counter(terms(t))) for t, i in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, n_terms, out = len(bags), sum(sum(b.values()) for _, b in bags), []
    df = Counter(t for _, b in bags for t in b)
    for key, text in items:
        found = []
        for i, bag in bags:
            m = 100 - 25 + (25 * sum(bag.values()) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * bag[t] // (1000 * bag[t] + 12 * m)) for t in terms(text) if bag[t])
            if score > 0:
                found.append((-score, i is None, i))
        found.sort(key=lambda f: (f[0], f[1], f[2] or 0))
        out += [(key, rank, i, -s) for rank, (s, _, i) in enumerate(found[:top], 1)]
    return out


def made(seed, n):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(.6)) % 400}" for _ in range(4000)] + ["É", "naïve", "日本", "don't", "A1"]
    texts = [rng.choice(["", None, " ,;\n", "same old text", "SAME old-text"]) if rng.random() < .4 else " ".join(rng.choices(words, k=rng.randint(1, 120)))
             for _ in range(n)]
    return texts, [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(25)] + ["same same text", "", None, "zzz"]


@pytest.mark.parametrize("shard_bytes,block_terms,short_share", [(1 << 23, 200_000, 1 / 16), (2000, 60, 1 / 16), (9000, 300, 0.0), (9000, 300, 1.0)])
def test_search(spark, shard_bytes, block_terms, short_share):
    texts, queries = made(1, 400)
    docs = [(t, i * 3) for i, t in enumerate(texts)]
    items = [(f"q{i}", t) for i, t in enumerate(queries)]
    frame = spark.createDataFrame([(t, i, "x", 1, "r", 2, "t", 3, 4) for t, i in docs], SCHEMA).repartition(3)
    asked = spark.createDataFrame([(t, 1, q, 1, "r", 2, "t", 3, 4) for q, t in items], SCHEMA)
    got = S.search(frame, asked, shard_bytes=shard_bytes, block_terms=block_terms, short_share=short_share)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect())) == sorted(brute(docs, items))


@pytest.mark.parametrize("seed", range(6))
def test_ranking_of_one_shard(seed):
    """Lists of any lengths, with ties, against summing everything; every stretch and share gives the same."""
    rng = np.random.default_rng(seed)
    n = 3000
    lists = []
    for _ in range(12):
        at = np.flatnonzero(rng.random(n) < rng.choice([.001, .02, .3, .9]))
        lists.append((at, rng.integers(1, rng.choice([3, 1000]), len(at)).astype(np.int64)))
    sums = np.zeros(n, np.int64)
    for at, value in lists:
        sums[at] += value
    want = sorted((-s, i) for i, s in enumerate(sums.tolist()) if s)[:20]
    for share, stretch in ((1 / 16, 1024), (0, 7), (1, 100), (.5, 10_000)):
        at, score = S.rank_shard(lists, n, 20, share, stretch)
        assert sorted((-s, i) for i, s in zip(at.tolist(), score.tolist())) == want


def test_lists_are_skipped():
    """A list that can't lift a document above the best is searched, not walked."""
    touched = []

    class Seen(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, slice) and key.stop is not None:
                touched.append(key)
            return super().__getitem__(key)
    n = 50_000
    strong = np.arange(0, n, 500), np.full(100, 10_000, np.int64)
    weak = np.arange(n).view(Seen), np.ones(n, np.int64)
    at, score = S.rank_shard([strong, weak], n, 20, 0)
    assert at.tolist() == list(range(0, 10_000, 500)) and set(score.tolist()) == {10_001}
    assert len(touched) < 40  # of 49 stretches, each taking two slices of a list that it walks


def test_odd_rows(spark):
    """Repeated ids are documents of their own, null ids come last of equal ones, repeated items answer each."""
    docs = [("alpha beta", 1), ("alpha beta", 1), ("alpha beta", None), ("alpha", 7), ("", 8), (None, 9), ("gamma " * 20_000, 10)]
    items = [("a", "alpha beta"), ("a", "alpha beta"), (None, "gamma"), ("e", None)]
    frame = spark.createDataFrame([(t, i, *[None] * 7) for t, i in docs], SCHEMA)
    asked = spark.createDataFrame([(t, 1, q, *[None] * 6) for q, t in items], SCHEMA)
    assert sorted(map(str, map(tuple, S.search(frame, asked).collect()))) == sorted(map(str, brute(docs, items)))
    for a, b in ((frame.limit(0), asked), (frame, asked.limit(0)), (frame.limit(0), asked.limit(0))):
        assert S.search(a, b).collect() == []
