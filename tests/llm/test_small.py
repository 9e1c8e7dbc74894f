"""Exact dedup, mixing, decontamination, token records and the two classifiers on odd rows, against plain Python."""
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm import common, decontaminate, exact, language, mixing, tokens, toxicity

SCHEMA = "text string, source string, doc_id long, keep_id string, size string, _run int, score string, items int"
public_tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def rows_of(seed=1, n=200):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["É", "don't", "A", "x\x1cy", "naïve", "ﬁn", "日本"]
    rows = []
    for i in range(n):
        text = rng.choice(["", None, "same text", "SAME text", " \n\t"]) if rng.random() < .5 else " ".join(rng.choices(words, k=rng.randint(1, 300)))
        rows.append((text, rng.choice(["a", "b", "é", "Z", None, "hot", "hot", "hot"]), i * 5, "x", None, 3, None, 4))
    return rows


def lower(text):
    return bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()).decode()


@pytest.mark.parametrize("keep,fan,run_rows", [("largest", 4, 65_536), ("smallest", 2, 20), ("largest", 3, 9), ("smallest", 16, 1)])
def test_exact(spark, keep, fan, run_rows):
    rows = rows_of()
    groups = {}
    for r in rows:
        groups.setdefault(lower(r[0]), []).append(r[2])
    pick = max if keep == "largest" else min
    want = {(i, pick(g), len(g), i == pick(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
    docs = spark.createDataFrame(rows, SCHEMA)
    assert {tuple(r) for r in exact.exact_groups(docs, keep=keep, fan=fan, run_rows=run_rows).collect()} == want
    left = exact.drop_exact(docs, keep=keep)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == {i for i, *_, k, _ in want if k}
    assert exact.exact_groups(docs.limit(0)).collect() == []


def test_exact_with_repeated_and_null_ids(spark):
    rows = [("t", None, 1, *[None] * 5), ("t", None, 1, *[None] * 5), ("t", None, None, *[None] * 5), ("u", None, None, *[None] * 5)]
    got = sorted(map(str, exact.exact_groups(spark.createDataFrame(rows, SCHEMA)).drop("text_sha256").collect()))
    assert got == sorted(["Row(doc_id=1, keep_id=1, group_size=3, kept=True)"] * 2 + [
        "Row(doc_id=None, keep_id=1, group_size=3, kept=False)", "Row(doc_id=None, keep_id=None, group_size=1, kept=True)"])


def test_exact_rounds(spark):
    """Every round leaves one row per run and text, a ``fan``-th of the runs, and the verified identifier, though one text
    holds a third of the rows; a round is an exchange by run and stretch, a sort, and an aggregate over sorted rows."""
    rows = [("hot" if i % 3 == 0 else f"t{i % 90}", None, i, *[None] * 5) for i in range(600)]
    docs = spark.createDataFrame(rows, SCHEMA)
    base = docs.select(F.col("doc_id").alias("_id"), F.unhex(F.sha2("text", 256)).alias("_sha"), F.xxhash64("text").alias("_check"), F.octet_length("text").alias("_length"),
                       F.conv(F.hex(F.substring(F.unhex(F.sha2("text", 256)), 1, 4)), 16, 10).cast("long").alias("_at"), F.pmod(F.xxhash64("doc_id"), F.lit(27)).alias("_run"))
    tree = exact.merge_rounds(base, "largest", 3, 3)
    run_of = {r["_id"]: r["_run"] for r in base.collect()}
    text_of = {hashlib.sha256(r[0].encode()).digest(): r[0] for r in rows}
    for level, runs in enumerate(tree):
        want = {}
        for r in rows:
            want.setdefault((run_of[r[2]] // 3 ** level, r[0]), []).append(r[2])
        got = [(r["_run"], text_of[bytes(r["_sha"])], r["_keep"], r["_n"]) for r in runs.collect()]
        assert sorted(got) == sorted((*k, max(v), len(v)) for k, v in want.items())
        assert sum(t == "hot" for _, t, _, _ in got) == 27 // 3 ** level
    plan = exact.sorted_runs(tree[0], F.floor(F.col("_run") / 3), 256, F.max, F.col("_keep").isNotNull())._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" in plan and "HashAggregate" not in plan and plan.count("Exchange hashpartitioning") == 1
    # Equal digests of other texts are told apart by the second hash and the length.
    forged = base.withColumn("_sha", F.lit(b"x" * 32)).withColumn("_at", F.lit(1))
    assert exact.merge_rounds(forged, "largest", 3, 3)[-1].count() == len({r[0] for r in rows})


NASTY = ("_id _text _sha _check _length _run _keep _n _at _stretch stay _stay gone _gone gone_raw mixed _mixed mixed_source mixed_size _copy _copies copies "
         "place share key raw vertex words sig _words _least _raw _comp _doc size _src _class _slice n rows hit items longest _key term tf at shard block item").split()


def test_clashing_names(spark):
    """Extra columns that are named like the operators' own change nothing; stages hand them on."""
    from llm import near, pii, search, substrings, whitening
    plain = [(i, None if i % 9 == 0 else f"{'same words here and there now' if i % 4 == 0 else f'own words {i} a b c d e f g'} x{i % 5} ring me at a{i}@b.co",
              None if i % 5 == 0 else f"s{i % 3}", "en", 3) for i in range(40)]
    docs = spark.createDataFrame(plain, "doc_id long, text string, source string, lang string, n_chars long")
    nasty = docs
    for c in NASTY:
        nasty = nasty.withColumn(c, F.lit("x"))
    bench = spark.createDataFrame([(1, "own words 7 a b c d e f g"), (2, "zz")], "item_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)], "doc_id long, toxic int, quality int")
    whole = {
        "exact": exact.exact_groups, "mix": mixing.mix_sources, "near": near.near_components, "leaks": lambda d: decontaminate.find_contamination(d, bench),
        "toxic": lambda d: toxicity.score_toxicity(d, toxicity.fit_toxicity(d, labels)), "language": lambda d: language.identify(d, language.language_samples(d)),
        "substrings": substrings.dedup_substrings, "pii": pii.personal_data, "search": lambda d: search.search(d, bench),
        "tokens": lambda d: tokens.write_tokens(d, common.shared_dir(spark, "t"), VOCABULARY).select("doc_id", "start", "n_tokens", "ids_crc32")}
    for name, fn in whole.items():
        assert sorted(map(str, fn(nasty).collect())) == sorted(map(str, fn(docs).collect())), name
    stages = {"exact": exact.drop_exact, "mix": mixing.sample_mix, "near": near.drop_near, "leaks": lambda d: decontaminate.drop_contaminated(d, bench),
              "toxic": lambda d: toxicity.drop_toxic(d, toxicity.Machine(), threshold=2.0)}
    for name, fn in stages.items():
        got, want = fn(nasty), fn(docs)
        assert got.columns == nasty.columns, name
        assert sorted(r["doc_id"] for r in got.collect()) == sorted(r["doc_id"] for r in want.collect()), name
    vectors = spark.createDataFrame([(i, [float(i), float(i * i % 7)]) for i in range(9)], "vec_id long, embedding array<double>")
    assert sorted(map(str, whitening.whiten(vectors.withColumn("_x", F.lit(1)).withColumn("_id", F.lit(2)).withColumn("component", F.lit("c"))).collect())) == sorted(
        map(str, whitening.whiten(vectors).collect()))


def test_mix_of_repeated_ids(spark):
    """Rows that share an id share its copies, so the words taken stay near the target."""
    rows = [("w " * (1 + i % 7), "a" if i % 3 else "b", i // 2 if i < 80 else i, *[None] * 5) for i in range(300)] + [("q", "a", None, *[None] * 5)] * 3
    docs = spark.createDataFrame(rows, SCHEMA)
    taken = mixing.mix_sources(docs).collect()
    got = mixing.sample_mix(docs).collect()
    assert len(got) == sum(r["copies"] for r in taken)
    for key in {r[2] for r in rows}:
        assert sum(r["doc_id"] == key for r in got) == sum(r["copies"] for r in taken if r["doc_id"] == key)


def test_items_without_an_id(spark):
    """They hit words, are not named and not counted; blocks of any size agree."""
    text = "one two three four five six seven eight nine ten eleven"
    items = [(None, text), (5, "a b c d e f g h i j"), (None, "a b c d e f g h i j"), (None, None)]
    rows = [(text, 1), ("a b c d e f g h i j " + text, 2), ("nothing", 3), ("a b c d e f g h i j " + text, 2)]
    docs = spark.createDataFrame([(t, None, i, *[None] * 5) for t, i in rows], SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = sorted([(1, 11, 11, 0, sha(""), True), (2, 21, 21, 1, sha("5"), True), (2, 21, 21, 1, sha("5"), True), (3, 1, 0, 0, sha(""), False)])
    for block_words in (3, 10_000):
        assert sorted(tuple(r)[:6] for r in decontaminate.find_contamination(docs, bench, block_words=block_words).collect()) == want
        assert [r["doc_id"] for r in decontaminate.drop_contaminated(docs, bench, block_words=block_words).collect()] == [3]


def filled(sizes):
    """Targets by sharing again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not full:
            return target | {s: level * weight[s] for s in open_}
        target |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(target[s] for s in full)
        open_ -= full
    return target


def test_mixing(spark):
    rows = rows_of(3, 600)
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix_sources(docs).collect()
    size = {r[2]: len((r[0] or "").encode().split()) for r in rows}
    source = {r[2]: r[1] for r in rows}
    sizes, taken = {}, {}
    for i, n in size.items():
        sizes[source[i]] = sizes.get(source[i], 0) + n
    target = filled(sizes)
    assert len(got) == len(rows)
    for r in got:
        s = source[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], sizes[s]) and abs(r["target"] - target[s]) < 1e-6 * target[s]
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[s] = taken.get(s, 0) + r["taken"]
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 700
    assert sorted(got) == sorted(mixing.mix_sources(docs.repartition(7)).collect())
    mixed = mixing.sample_mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.groupBy("doc_id").count().where("count > 2").count() == 0
    assert mixing.mix_sources(docs.limit(0)).collect() == [] and mixing.sample_mix(docs.limit(0)).collect() == []
    assert {r["target"] for r in mixing.mix_sources(docs.withColumn("text", docs["source"].substr(1, 0))).collect()} == {0.0}


def contaminated(rows, items, window=10):
    split = lambda t: [w.encode() for w in re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t))]
    wins = {}
    for key, text in items:
        w = split(text)
        for s in range(len(w) - min(window, len(w)) + 1) if w else ():
            wins.setdefault(tuple(w[s:s + window]), set()).add(str(key))
    out = set()
    for text, i in rows:
        w, hit, found = split(text), set(), set()
        for n in {len(x) for x in wins}:
            for s in range(len(w) - n + 1):
                if tuple(w[s:s + n]) in wins:
                    hit |= set(range(s, s + n))
                    found |= wins[tuple(w[s:s + n])]
        out.add((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("block_words", [10, 10_000])
def test_decontamination(spark, block_words):
    rng = random.Random(7)
    vocabulary = ["a", "b", "c", "é", "x9", "z"] + [f"k{i}" for i in range(30)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 4, 12, 25])))) for i in range(12)] + [(50, None), (51, "..."), (52, "K1 k2. K1")]
    items = [(k, None if t is None or len(t.split()) == 1 else t) for k, t in items]
    rows = []
    for i in range(120):
        parts = []
        for _ in range(rng.randint(0, 3)):
            parts += rng.choices(vocabulary, k=rng.randint(0, 30)) + (rng.choice(items)[1] or "").upper().replace("É", "é").split()
        rows.append(("; ".join(parts), i))
    rows += [(None, 500), ("", 501), ("k1 " * 20_000, 502)]
    docs = spark.createDataFrame([(t, None, i, *[None] * 5) for t, i in rows], SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = contaminated(rows, items)
    got = decontaminate.find_contamination(docs, bench, block_words=block_words)
    assert {tuple(r)[:6] for r in got.collect()} == want
    left = decontaminate.drop_contaminated(docs, bench, block_words=block_words)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == {w[0] for w in want if not w[5]}
    assert decontaminate.find_contamination(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.find_contamination(docs.limit(0), bench).count() == 0


def test_longest_match_and_place(spark):
    item = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([("start " + " ".join(f"w{i}" for i in range(5, 27)) + " end", None, 1, *[None] * 5)], SCHEMA)
    found = decontaminate.find_contamination(docs, spark.createDataFrame([(9, item)], "item_id long, text string")).first()["longest"]
    assert [tuple(x) for x in found] == [("9", 22, 1)]


def test_token_records(spark, tmp_path):
    from tokenizers import Tokenizer
    rows = rows_of(5, 120) + [("x" * 5000, None, -3, *[None] * 5), ("dup", None, 7, *[None] * 5), ("dup 2", None, 7, *[None] * 5),
                              ("<|endoftext|> a<|ENDOFTEXT|>b 'S it's ΣΑΣ İ ½ \x85x\xa0y", None, 8, *[None] * 5)]
    docs = spark.createDataFrame(rows, SCHEMA)
    path = common.shared_dir(spark, "test-tokens")
    index = tokens.write_tokens(docs, path, VOCABULARY, file_bytes=9000).orderBy("start").collect()
    whole = Tokenizer.from_file(VOCABULARY)
    want, start = [], 0
    for r in sorted(rows, key=lambda r: (r[2], r[0] or "")):
        ids = [*whole.encode(r[0] or "", add_special_tokens=False).ids, 1]
        want.append((r[2], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in index] == want
    assert len({r["file"] for r in index}) > 3
    back = {(r["doc_id"], zlib.crc32(np.array(r["ids"], "<u4").tobytes())) for r in tokens.read_tokens(spark, path).collect()}
    assert back == {(w[0], w[3]) for w in want}
    # Shuffled reads: the index leads to each record.
    for r in random.Random(1).sample(index, 10):
        with open(r["file"].removeprefix("file:"), "rb") as f:
            f.seek(r["offset"])
            (at, payload), = tokens.frames(f.read(r["n_bytes"]))
            assert zlib.crc32(np.frombuffer(payload, "<u2", offset=8).astype("<u4").tobytes()) == r["ids_crc32"]
    assert tokens.write_tokens(docs.limit(0), common.shared_dir(spark, "test-tokens"), VOCABULARY).collect() == []


def test_damaged_records_are_found():
    good = tokens.frame(b"12345678ab") + tokens.END
    assert [p for _, p in tokens.frames(good * 2)] == [b"12345678ab"] * 2
    for i in range(len(good)):
        bad = good[:i] + bytes([good[i] ^ 1]) + good[i + 1:]
        with pytest.raises(ValueError):
            list(tokens.frames(bad))
    with pytest.raises(ValueError):
        list(tokens.frames(good[:-1]))


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels))
    assert scored.count() == docs.count()
    rows = scored.where("held_out").join(labels, "doc_id").select("toxic", "predicted", "score").collect()
    assert all(0 <= r["score"] <= 1 for r in rows)
    right = [r for r in rows if r["toxic"] == r["predicted"]]
    assert len(right) > .97 * len(rows)
    assert sum(r["toxic"] for r in right) > .9 * sum(r["toxic"] for r in rows)


def test_machine_learns_pairs():
    """Neither term alone tells the class, the pair does."""
    rng = random.Random(1)
    texts, y = [], []
    for _ in range(3000):
        a, b = rng.random() < .5, rng.random() < .5
        texts.append(" ".join(["insult"] * a + ["group"] * b + [f"n{rng.randrange(50)}" for _ in range(5)]).encode())
        y.append(float(a and b))
    owner, terms = toxicity.terms_of(texts)
    y = np.array(y)
    found, df = np.unique(terms, return_counts=True)
    toxic = np.array([int(y[owner[terms == t]].sum()) for t in found])
    n, n1 = len(y), y.sum()
    chosen = n * (toxic * n - df * n1) ** 2 / (df * (n - df) * n1 * (n - n1)) >= toxicity.LEAST_CHI2
    machine = toxicity.fit_machine(owner, terms, y, found[chosen], toxicity.log_odds(toxic, df, n1, n)[chosen])
    score = lambda t: machine.score([t])[0]
    assert score(b"insult group n1") > .8 and max(score(b"insult n1"), score(b"group n1"), score(b"")) < .2


def test_toxicity_scores_on_any_size(spark):
    """A sample that takes the classes at other rates than the table has them gives about the scores of all rows."""
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(8000):
        toxic = rng.random() < .11
        bad = [f"bad{rng.randrange(4)}"] if rng.random() < (.6 if toxic else .06) else []
        rows.append((" ".join(bad + [f"n{rng.randrange(60)}" for _ in range(6)]), None, i, *[None] * 5))
        labels.append((i, int(toxic)))
    docs, labels = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")
    probes = [f"bad{k} n{n} n{n + 1}".encode() for k in range(4) for n in range(20)], [f"n{n} n{n + 7}".encode() for n in range(50)]
    whole, part = (toxicity.fit_toxicity(docs, labels, *most) for most in ((10**6, 10**6), (400, 800)))
    odds = lambda m, texts: float(np.mean(np.log(1 / m.score(texts) - 1)))
    for texts in probes:
        assert abs(odds(whole, texts) - odds(part, texts)) < .5


def test_toxicity_odd_rows(spark):
    docs = spark.createDataFrame([(None, None, 1, *[None] * 5), ("", None, 2, *[None] * 5), ("x " * 50_000, None, None, *[None] * 5)], SCHEMA)
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, none)).collect()
    assert [(r["score"], r["predicted"]) for r in got] == [(0.0, 0)] * 3
    one = spark.createDataFrame([(1, 0), (1, 0), (2, 1)], "doc_id long, toxic int")
    machine = toxicity.fit_toxicity(docs, one)
    assert toxicity.score_toxicity(docs.limit(0), machine).collect() == []
    assert toxicity.drop_toxic(docs, machine, threshold=2.0).count() == 3


def test_toxicity_score_against_all_pairs(spark):
    """The score of the fitted machine as a plain sum over terms and over all pairs of terms."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    machine = toxicity.fit_toxicity(docs, labels)
    place = {int(t): i for i, t in enumerate(machine.terms)}
    assert len(place) > 10
    texts = {r["doc_id"]: r["text"] or "" for r in docs.limit(150).collect()} | {-1: "", -2: "a", -3: "É ok"}
    split = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    got = dict(zip(texts, machine.score([t.encode() for t in texts.values()])))
    for i, text in texts.items():
        words = {w.encode() for w in split.findall(lower(text))}
        keys = set(words) | {w[:n] + b"*" for w in words for n in toxicity.PREFIXES if len(w) > n}
        at = sorted({place[t] for t in (int(common.word_hashes([k])[0]) >> 32 for k in keys) if t in place})
        raw = machine.bias + sum(machine.w[a] for a in at) + sum(float(machine.v[a] @ machine.v[b]) for x, a in enumerate(at) for b in at[x + 1:])
        assert got[i] == pytest.approx(1 / (1 + np.exp(-max(-40.0, min(40.0, raw)))), rel=1e-9), i


def test_language_against_a_plain_parser(spark):
    """Predictions by searching the labelled text itself for every longest match, word by word."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(25)
    samples = {k: v[:6000] for k, v in language.language_samples(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).items()}
    assert len(samples) > 1

    def phrases(word, text):
        count, at = 0, 0
        while at < len(word):
            n = 1
            while at + n < len(word) and word[at:at + n + 1] in text:
                n += 1
            count, at = count + 1, at + n
        return count
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(docs, samples).collect()}
    for r in docs.collect():
        words = re.findall(r"[^\W\d_]+", (r["text"] or "").lower())
        bits = {k: sum(phrases(f" {w} ", t) for w in words) * np.log2(len(t) + 2) for k, t in samples.items()}
        if words:
            best = min(sorted(bits), key=bits.get)
            assert got[r["doc_id"]][0] == best
            assert got[r["doc_id"]][1] == pytest.approx(1 / sum(2 ** (-(b - bits[best]) / len(words)) for b in bits.values()), rel=1e-4)


def test_language_sample_is_bounded(spark):
    rows = [(f"word{i % 7} text{i}", None, i, f"l{i % 5}" if i % 2 else "l0", *[None] * 4) for i in range(200)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("lang", F.col("keep_id"))
    assert set(language.language_samples(docs)) == {f"l{k}" for k in range(5)}
    few = language.language_samples(docs, docs_per_lang=3, langs=2)
    assert set(few) == {"l0", "l1"} and all(len(t.split()) <= 6 for t in few.values())


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(docs, language.language_samples(docs)).join(docs, "doc_id").where("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) > .97 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_odd_rows(spark):
    rows = [(None, None, 1), ("", None, 2), ("12 ²³ — !", None, 3), ("the cat", None, None), ("日本", None, 4), ("the " * 40_000, None, 5)]
    docs = spark.createDataFrame([(*r, *[None] * 5) for r in rows], SCHEMA)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(docs, {"en": " the cat sat ", "de": " die katze sass "}).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0)
    assert got[None][0] == got[5][0] == "en" and got[4][0] in ("de", "en")
    assert {r["lang_pred"] for r in language.identify(docs, {}).collect()} == {"und"}
    assert language.language_samples(docs.withColumn("lang", docs["source"])) == {}
    assert language.identify(docs.limit(0), {"en": " a "}).collect() == []


def test_suffix_automaton_against_substrings():
    rng = random.Random(2)
    for _ in range(40):
        text = "".join(rng.choices("abc ", k=60))
        machine = language.SuffixAutomaton(text)
        probe = "".join(rng.choices("abcd ", k=40))
        count, at = 0, 0
        while at < len(probe):
            n = 1
            while at + n < len(probe) and probe[at:at + n + 1] in text and probe[at:at + n] in text:
                n += 1
            count, at = count + 1, at + n
        assert machine.phrases(probe) == count
