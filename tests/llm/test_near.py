"""Near duplicates against all pairs of sets."""
import random

import numpy as np
import pytest

from llm.graph import components
from llm.near import least_matches, near_components

SCHEMA = "text string, doc_id long, _doc string, key int"


def sets_of(text, k):
    words = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()).split()
    return {tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute(rows, k, percent):
    sets = {r[1]: sets_of(r[0], k) for r in rows}
    comp = {i: i for i in sets}

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i
    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                u, v = find(a), find(b)
                comp[max(u, v)] = min(u, v)
    return {(i, len(sets[i]), find(i), find(i) == i) for i in ids}


def made(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    texts = []
    for _ in range(5):
        base = [word() for _ in range(rng.randint(60, 200))]
        texts.append(base)
        drift = base
        for n in range(12):
            near = list(base)
            for _ in range(rng.randint(0, 3)):
                near[rng.randrange(len(near))] = word()
            texts.append(near)
            # A chain: each differs a little from the one before, the ends are far apart.
            drift = list(drift)
            drift[rng.randrange(len(drift))] = word()
            drift[rng.randrange(len(drift))] = word()
            texts.append(drift)
    passage = [word() for _ in range(60)]
    texts += [passage + [word() for _ in range(40)] for _ in range(20)]
    ids = list(range(0, 3 * len(texts) + 60, 3))
    rng.shuffle(ids)
    rows = [(" ".join(t) if rng.random() < .9 else " ".join(t).upper(), ids.pop(), None, 1) for t in texts]
    extra = [None, "", " \n", "one", "ONE", "one two", "one two three four", "a b c d", "A\tb c  d", rows[0][0], rows[0][0]]
    return rows + [(t, ids.pop(), "x", None) for t in extra]


@pytest.mark.parametrize("seed,block", [(1, 256), (2, 3)])
def test_equals_brute_force(spark, seed, block):
    rows = made(seed)
    got = near_components(spark.createDataFrame(rows, SCHEMA), block=block)
    assert {tuple(r) for r in got.collect()} == brute(rows, 4, 80)


def test_empty(spark):
    assert near_components(spark.createDataFrame([], SCHEMA)).collect() == []


def test_long_chain_is_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 200)] + [(500, 700), (700, 500)], "a long, b long")
    got = {r[0]: r[1] for r in components(links).collect()}
    assert got == {i: 1 for i in range(2, 201)} | {700: 500}


def test_bound_never_drops_a_likely_pair():
    rng = np.random.default_rng(1)
    for n in (30, 60, 150):
        assert (rng.binomial(n, 0.8, 20000) < least_matches(n, 80, 1e-6)).mean() == 0
        assert least_matches(n, 80, 1e-6) > 0.3 * n


def test_repeated_ids_keep_the_links_of_each_text(spark):
    from llm.near import drop_near
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(a, 1), (a + " more", 5), (b, 2), (b + " more", 5), (b + " again", None), ("alone " * 9, 5), ("none", None), ("", 5), ("", 5), ("alone " * 9, 5)]
    docs = spark.createDataFrame([(t, i, "x", 1) for t, i in rows], SCHEMA)
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near_components(docs).collect()), key=str)
    assert got == sorted([(1, 1, True), (5, 1, False), (2, 2, True), (5, 2, False), (None, 2, False), (5, 5, True), (None, None, True), (5, 5, True), (5, 5, True), (5, 5, True)], key=str)
    left = drop_near(docs)
    assert left.columns == docs.columns
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in left.collect()))) == sorted(map(str, [(1, a), (2, b), (5, "alone " * 9), (None, "none"), (5, "")]))
