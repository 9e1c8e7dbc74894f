"""Personal data by weak-supervision aggregation. DataFrame functions only on the executors.

Spans are e-mail addresses, IP addresses, card and telephone numbers. The base spans are fixed patterns with fixed
checks; they always stay. Further candidates are base matches that fail their check, national telephone numbers and
spelled-out addresses. Four labelers vote on every span (1 for, -1 against, 0 abstains): its exact format, gazetteers
of known parts, the words around it, its shape. Spans are counted by kind and votes; expectation-maximisation over
these counts (at most 81 patterns a kind) estimates how reliable each labeler is, which gives each span a
probability. On these a naive Bayes classifier over span features is trained from counts, and candidates that it
accepts and that overlap no other span are added.

Places come from the gaps between matches: ``split`` gives them, ``regexp_extract_all`` the matches, and running sums
of lengths the starts. The text is scanned once; everything after works on rows of spans.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from llm.common import stored

KINDS = ("email", "ip", "card", "phone")
# The base patterns, written so that a text of one long run of characters is read once.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Candidates beside the base patterns, by kind.
MORE = {
    "email": r"[A-Za-z0-9._%+-]++[ ]?[\[(](?:at|AT)[\])][ ]?[A-Za-z0-9-]++(?:(?:\.|[ ]?[\[(](?:dot|DOT)[\])][ ]?)[A-Za-z0-9-]++)++",
    "phone": r"(?<![0-9+().-])(?:\([0-9]{3}\)[ ]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])",
}
# Gazetteers.
ENDINGS = ("com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "io", "co", "uk", "de", "fr", "es", "it", "nl", "eu", "us", "ca", "ch", "at", "be", "jp", "cn", "in", "br", "au", "ru")
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|30[0-5]|36|38|6011|65|35)"
CALLING = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|21[1-8]|35[0-9]|37[0-9]|38[0-9]|42[0-3]|85[2-6]|97[0-9])"
RESERVED = r"^0*(?:0|10|127|22[4-9]|2[3-9][0-9])\."
FOR_WORDS = r"(?i)(?:e-?mail|mail|contact|write|reach|call|phone|tel|telefon|teléfono|téléphone|fax|mobile|ip|host|server|address|card|visa|account|konto|tarjeta|carte)[ :.=#(]*$"
AGAINST_WORDS = r"(?i)(?:version|v|section|chapter|page|isbn|issn|doi|license|licence|cc|no|figure|table|rev|build)[ :.=#(]*$"
CONTEXT = 24
ACCEPT, EM_ROUNDS = 0.5, 50
LABELERS = ("format", "gazetteer", "context", "shape")


def hits(text: Column, number: int, pattern: str, first: int) -> Column:
    """Array of (pattern number, gap before in code points, match, end of the gap), in text order."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(first))
    pairs = F.zip_with(found, F.split(text, pattern, -1), lambda m, gap: F.struct(
        F.lit(number).alias("p"), F.char_length(gap).alias("gap"), m.alias("match"), F.right(gap, F.lit(CONTEXT)).alias("before")))
    return F.filter(pairs, lambda x: x["match"].isNotNull())  # the last gap has no match after it


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Check of the last digit; for short strings of digits."""
    n = F.length(number)

    def value(i):
        x = F.substring(number, n - i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, x).when(x < 5, 2 * x).otherwise(2 * x - 9)
    return F.aggregate(F.transform(F.sequence(F.lit(1), n), value), F.lit(0), lambda a, x: a + x) % 10 == 0


def passes(kind: Column, match: Column) -> Column:
    """The fixed check of each base kind."""
    number = digits(match)
    n = F.length(number)
    octets = F.forall(F.split(match, r"\."), lambda x: x.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])$"))
    return (F.when(kind == "email", True).when(kind == "ip", octets)
            .when(kind == "card", F.when(n.between(14, 19), luhn(number)).otherwise(False)).otherwise(n.between(10, 15)))


def vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def votes(kind: Column, match: Column, before: Column, base: Column) -> list[Column]:
    number = digits(match)
    ending = F.lower(F.regexp_extract(match, "([A-Za-z0-9-]+)$", 1))
    form = (F.when(kind == "email", vote(match.rlike(r"^[A-Za-z0-9][^@]*+@") & match.rlike(r"\.[A-Za-z]{2,}$"), match.contains("@")))
            .when(kind == "phone", vote(base, F.lit(False))).otherwise(vote(base, ~base)))
    known = (F.when(kind == "email", vote(ending.isin(*ENDINGS), ~ending.isin(*ENDINGS)))
             .when(kind == "ip", vote(~match.rlike(RESERVED), match.rlike(RESERVED)))
             .when(kind == "card", vote(number.rlike(ISSUERS), ~number.rlike(ISSUERS)))
             .otherwise(vote(match.rlike(CALLING), match.startswith("+"))))
    around = vote(before.rlike(FOR_WORDS), before.rlike(AGAINST_WORDS) | before.rlike("[A-Za-z0-9]$"))
    shape = (F.when(kind == "email", vote(match.rlike(r"^[A-Za-z]"), match.rlike(r"^[^A-Za-z0-9]")))
             .when(kind == "ip", vote(~match.rlike(r"(?:^|\.)0[0-9]"), match.rlike(r"[0-9]{4}")))
             .when(kind == "card", vote(match.rlike(r"^(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4})$"), F.length(number) < 12))
             .otherwise(vote(match.rlike(r"(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-][0-9]{3,4}[ .-]?[0-9]{3,4}$"), F.length(number) > 15)))
    return [v.cast("int").alias(name) for v, name in zip((form, known, around, shape), LABELERS)]


def estimate(counts: dict[tuple[int, ...], int], rounds: int = EM_ROUNDS) -> dict[tuple[int, ...], float]:
    """EM over vote patterns: labelers are independent given the truth; the start trusts the sum of votes."""
    truth = {v: 1 / (1 + math.exp(-1.5 * sum(v))) for v in counts}
    for _ in range(rounds):
        weight = [[defaultdict(lambda: 1.0) for _ in LABELERS] for _ in (0, 1)]
        mass = [1.0, 1.0]
        for v, n in counts.items():
            for c, p in ((0, 1 - truth[v]), (1, truth[v])):
                mass[c] += n * p
                for labeler, x in enumerate(v):
                    weight[c][labeler][x] += n * p
        for v in counts:
            odds = math.log(mass[1] / mass[0])
            for labeler, x in enumerate(v):
                one, zero = weight[1][labeler], weight[0][labeler]
                odds += math.log(one[x] / (mass[1] + 2)) - math.log(zero[x] / (mass[0] + 2))
            truth[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return truth


def features(kind: Column, match: Column, before: Column) -> Column:
    """A few dozen values a kind: length, digits, marks, first character, the character before."""
    return F.array(
        F.concat(F.lit("length "), F.least(F.length(match), F.lit(40)).cast("string")),
        F.concat(F.lit("digits "), F.least(F.length(digits(match)), F.lit(24)).cast("string")),
        F.concat(F.lit("marks "), F.array_join(F.array_sort(F.array_distinct(F.split(F.regexp_replace(match, "[A-Za-z0-9]", ""), ""))), "")),
        F.concat(F.lit("first "), F.regexp_replace(F.regexp_replace(F.substring(match, 1, 1), "[a-z]", "a"), "[A-Z]", "A")),
        F.concat(F.lit("before "), F.when(before == "", "start").when(before.rlike(r"\s$"), "space").when(before.rlike(r"[\p{L}\p{N}]$"), "word").otherwise("mark")),
        F.concat(F.lit("format "), votes(kind, match, before, passes(kind, match))[0].cast("string")))


def literal_map(values: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for pair in sorted(values.items()) for x in pair]) if values else F.lit(None).cast("map<string,double>")


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(one row per document: ``row``, ``doc_id``; one row per span: row, kind, start, end, match, base, added, probability)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    patterns = [(k, PATTERNS[k]) for k in KINDS] + list(MORE.items())
    none = F.array().cast("array<struct<p:int,gap:int,match:string,before:string>>")
    has = {"@": text.contains("@"), "0": text.rlike("[0-9]"), "at": text.rlike(r"(?:at|AT)[\])]")}
    need = ["@", "0", "0", "0", "at", "0"]
    columns = [F.when(has[w], hits(text, n, pattern, 0)).otherwise(none) for n, ((_, pattern), w) in enumerate(zip(patterns, need))]
    scan = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scan = stored(scan.select("row", "doc_id", F.concat(*columns).alias("hits")), "pii-hits")
    flat = scan.where(F.size("hits") > 0).select("row", F.posexplode("hits").alias("i", "h")).select("row", "i", "h.*")
    order = Window.partitionBy("row", "p").orderBy("i")
    gap_sum, match_sum = F.sum("gap").over(order), F.coalesce(F.sum(F.char_length("match")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    flat = flat.withColumn("start", gap_sum + match_sum)
    kind = F.element_at(F.array(*[F.lit(k) for k, _ in patterns]), F.col("p") + 1)
    spans = flat.select("row", "p", kind.alias("kind"), "start", (F.col("start") + F.char_length("match")).alias("end"), "match", "before")
    check = passes(F.col("kind"), F.col("match"))
    spans = spans.withColumn("base", check & (F.col("p") < len(KINDS)))
    spans = stored(spans.select("*", *votes(F.col("kind"), F.col("match"), F.col("before"), check)), "pii-spans")
    counts: dict[str, dict] = {k: {} for k in KINDS}
    for r in spans.groupBy("kind", *LABELERS).agg(F.count("*").alias("n")).collect():  # at most 81 patterns a kind
        counts[r["kind"]][tuple(r[x] for x in LABELERS)] = r["n"]
    key = F.concat_ws(" ", "kind", *[F.col(x).cast("string") for x in LABELERS])
    truth = {" ".join([k, *map(str, v)]): p for k in KINDS for v, p in estimate(counts[k]).items()}
    learnt = spans.select("kind", F.element_at(literal_map(truth), key).alias("_p"), F.explode(features(F.col("kind"), F.col("match"), F.col("before"))).alias("feature"))
    weights, totals = {}, {}
    for r in learnt.groupBy("kind", "feature").agg(F.sum("_p").alias("one"), F.sum(1 - F.col("_p")).alias("zero")).collect():  # features are bounded
        weights[f"{r['kind']} {r['feature']}"] = (r["one"], r["zero"])
        if r["feature"].startswith("length "):
            one, zero = totals.get(r["kind"], (0.0, 0.0))
            totals[r["kind"]] = (one + r["one"], zero + r["zero"])
    size = {k: len([w for w in weights if w.startswith(f"{k} ")]) for k in totals}
    odds = {w: math.log((one + 1) / (totals[k][0] + size[k])) - math.log((zero + 1) / (totals[k][1] + size[k]))
            for w, (one, zero) in weights.items() for k in [w.split(" ", 1)[0]]}
    prior = {k: math.log((one + 1) / (zero + 1)) for k, (one, zero) in totals.items()}
    total = F.aggregate(features(F.col("kind"), F.col("match"), F.col("before")), F.element_at(literal_map(prior), F.col("kind")),
                        lambda a, f: a + F.coalesce(F.element_at(literal_map(odds), F.concat(F.col("kind"), F.lit(" "), f)), F.lit(0.0)))
    judged = spans.select("row", "kind", "start", "end", "match", "base", (1 / (1 + F.exp(-total))).alias("probability"))
    by_place = Window.partitionBy("row").orderBy("start", "end", "kind", "base")
    earlier, later = by_place.rowsBetween(Window.unboundedPreceding, -1), by_place.rowsBetween(1, Window.unboundedFollowing)

    def free(flag: str) -> Column:
        only = F.col(flag)
        return (F.coalesce(F.max(F.when(only, F.col("end"))).over(earlier) <= F.col("start"), F.lit(True))
                & F.coalesce(F.min(F.when(only, F.col("start"))).over(later) >= F.col("end"), F.lit(True)))
    judged = judged.withColumn("_maybe", ~F.col("base") & (F.col("probability") >= ACCEPT) & free("base"))
    clear = F.coalesce(F.max(F.when(F.col("_maybe"), F.col("end"))).over(earlier) <= F.col("start"), F.lit(True))
    return scan.select("row", "doc_id"), judged.withColumn("added", F.col("_maybe") & clear).drop("_maybe")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_email``, ``n_ip``, ``n_card``, ``n_phone`` (base spans), ``base_sha256``,
    ``spans`` (all spans as kind:start:end in code points), ``n_added``.

    Null text is empty; a text without spans has zeros, an empty list and its digest. Base spans of different
    kinds may overlap, added ones overlap nothing. Repeated rows are each answered; an empty table gives an empty
    result; other columns are not looked at.
    """
    rows, spans = find_spans(docs, id_col, text_col)
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    item = F.struct(F.col("start"), rank.alias("rank"), F.col("end"), F.col("kind"))
    text = lambda x: F.array_join(F.transform(F.array_sort(x), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    per = spans.where("base or added").groupBy(F.col("row").alias("_row")).agg(
        *[F.count(F.when(F.col("base") & (F.col("kind") == k), 1)).alias(f"n_{k}") for k in KINDS], F.count(F.when(F.col("added"), 1)).alias("n_added"),
        text(F.collect_list(F.when(F.col("base"), item))).alias("_base"), text(F.collect_list(item)).alias("spans"))
    out = rows.join(per, F.col("row") == F.col("_row"), "left")
    return out.select("doc_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in (f"n_{k}" for k in KINDS)],
                      F.sha2(F.coalesce("_base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), F.coalesce("n_added", F.lit(0)).alias("n_added"))
