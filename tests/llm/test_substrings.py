"""Substring dedup against a dictionary of all windows."""
import hashlib
import random

import pytest

from llm.common import WORD
from llm.substrings import dedup_substrings

SCHEMA = "text string, doc_id long, sha string, _hit string"


def brute(rows, window):
    words = {i: (t or "").encode().split() for t, i, *_ in rows}
    first = {}
    for i in sorted(words):
        w = words[i]
        for s in range(len(w) - window + 1):
            first.setdefault(tuple(w[s:s + window]), i)
    out = set()
    for i, w in words.items():
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s:s + window])] < i:
                gone |= set(range(s, s + window))
        left = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.add((i, len(w), len(gone), hashlib.sha256(left).hexdigest()))
    return out


def made(seed, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(40)] + ["é", "a b", "A", "a"]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(8, 70))] for _ in range(6)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts += rng.choice(passages) if rng.random() < .6 else [rng.choice(vocabulary) for _ in range(rng.randint(1, 40))]
        rows.append((rng.choice([" ", "\n", " \t"]).join(parts), i * 7 % n, "x", "y"))
    rows += [(rows[3][0], n + 5, None, None), (rows[3][0], n + 6, "a", "b"), (None, n + 7, None, None), ("", n + 8, None, None),
             ("z " * 400, n + 9, None, None), ("z " * 300, n + 10, None, None), ("z " * 30 + "y " + "z " * 60, n + 11, None, None)]
    return rows


@pytest.mark.parametrize("seed,group_rows,tree_rows", [(1, 4000, 40000), (2, 3, 40000), (3, 6, 5), (4, 1, 1)])
def test_equals_brute_force(spark, seed, group_rows, tree_rows):
    rows = made(seed)
    got = dedup_substrings(spark.createDataFrame(rows, SCHEMA), window=20, prefix=6, group_rows=group_rows, tree_rows=tree_rows).collect()
    assert {tuple(r)[:4] for r in got} == brute(rows, 20)
    assert len(got) == len(rows)
    for r in got:
        if r["kept_text"] is not None:
            assert hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"]


def test_groups_count_occurrences(spark, monkeypatch):
    """Few documents that repeat a word or a line often are a large group too; equal suffixes of a document are one."""
    from llm import substrings
    line = " ".join(f"k{i}" for i in range(25))
    rows = [("z " * 300, 1, "x", "y"), ("z " * 290 + "end", 2, "x", "y"), (f"{line} " * 3 + "a b", 3, "x", "y"), (f"c {line} " * 4, 4, "x", "y"), (f"{line} " * 2 + "e", 5, "x", "y")]
    seen, trees = [], substrings.tree_repeats
    monkeypatch.setattr(substrings, "tree_repeats", lambda suffixes, *a: seen.extend(suffixes.collect()) or trees(suffixes, *a))
    got = dedup_substrings(spark.createDataFrame(rows, SCHEMA), window=20, prefix=6, group_rows=100).collect()
    assert {tuple(r)[:4] for r in got} == brute(rows, 20)
    groups = [r["prefix"] for r in seen]
    own = [(r["prefix"], r["doc_id"], r["place"], r["snippet"]) for r in seen]
    assert seen and max(groups.count(g) for g in groups) <= 100 and len(own) == len(set(own))


def test_empty(spark):
    assert dedup_substrings(spark.createDataFrame([], SCHEMA)).collect() == []


def test_words_are_the_contract_s():
    import re
    text = "a b\x1cc d e\x0bf\x85g"
    assert [w.encode() for w in re.findall(WORD, text)] == text.encode().split()
