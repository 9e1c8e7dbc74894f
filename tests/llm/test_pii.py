"""Personal data: base spans against the contract's patterns in Python, added spans by example."""
import hashlib
import random
import re

import pytest

from llm.pii import estimate, find_spans, personal_data

SCHEMA = "text string, doc_id long, row int, spans string, kind string"
RULES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(s):
    total = 0
    for i, c in enumerate(reversed(s)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base(text):
    out = []
    for rank, (kind, rule) in enumerate(RULES.items()):
        for m in re.finditer(rule, text or "", re.A):
            number = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(number) <= 19 and luhn(number)):
                continue
            if kind == "phone" and not 10 <= len(number) <= 15:
                continue
            out.append((m.start(), rank, m.end(), kind))
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(out)]


def compare(rows, got):
    want = {r[1]: base(r[0]) for r in rows}
    for r in got:
        mine = want[r["doc_id"]]
        assert r["base_sha256"] == hashlib.sha256(",".join(mine).encode()).hexdigest(), (r, mine)
        for k in RULES:
            assert r[f"n_{k}"] == sum(x.startswith(k) for x in mine)
        assert set(mine) <= set(filter(None, r["spans"].split(",")))


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["text"], r["doc_id"]) for r in docs.collect()]
    got = personal_data(docs).collect()
    assert len(got) == len(rows)
    compare(rows, got)


def test_odd_texts(spark):
    rng = random.Random(5)
    pieces = ["a@b.c", "x@y@z.w", "@", ".", "a.b+c@d-e.f.g", "1.2.3.4", "256.1.1.1", "001.02.3.4.5", "4111 1111-1111 1111", "4111111111111112", "+1 (456) 555-2186",
              "+1", "+12-", "é", "😀", " ", "\n", "-", "(", "1", "22", "378282246310005", "_d@e.f", "%", "日本", "+49 30 1234567890", "\U0001F600 9"]
    rows = [("".join(rng.choice(pieces) for _ in range(rng.randint(0, 25))), i, 1, "x", None) for i in range(300)]
    rows += [(None, 1000, None, None, None), ("", 1001, None, None, None), ("a" * 200_000, 1002, None, None, None), ("1" * 100_000, 1003, None, None, None),
             ("a@b" + ".c" * 50_000, 1004, None, None, None), ("a@b.c " * 5_000, 1005, None, None, None), ("1 " * 50_000, 1006, None, None, None)]
    rows += [rows[0], rows[0]]
    got = personal_data(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    compare(rows, got)


def test_added_spans_overlap_nothing(spark):
    rows = [(f"reach me: call (212) 555-{1000 + i} or write joe{i} (at) mail.example (dot) com; also j{i}@mail.example.com, +1 (212) 555-{2000 + i}", i, 1, "", "") for i in range(50)]
    got = personal_data(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sum(r["n_added"] for r in got) >= 50
    for r in got:
        places = [tuple(map(int, x.split(":")[1:])) for x in r["spans"].split(",")]
        assert all(a[1] <= b[0] for a, b in zip(places, places[1:]))


def test_empty(spark):
    assert personal_data(spark.createDataFrame([], SCHEMA)).collect() == []
    assert find_spans(spark.createDataFrame([("no spans", 1, 1, "", "")], SCHEMA))[1].collect() == []


@pytest.mark.parametrize("good", [0.9, 0.75])
def test_estimates_find_the_reliable_labelers(good):
    rng = random.Random(3)
    counts, right = {}, {}
    for _ in range(20_000):
        truth = rng.random() < .4
        v = tuple((1 if (rng.random() < p) == truth else -1) for p in (good, good, .5, good))
        counts[v] = counts.get(v, 0) + 1
        right[v] = right.get(v, 0) + truth
    got = estimate(counts)
    for v, n in counts.items():
        if n > 500:
            assert abs(got[v] - right[v] / n) < .15
