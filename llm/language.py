"""Language identification by cross-parsing entropy.

For each language a suffix automaton holds all substrings of its labelled words. A text is parsed greedily into
longest matches against each automaton (Ziv and Merhav): the language whose text explains it in the fewest
phrases, weighed by the bits that name a phrase (log2 of the automaton's text length), wins. Phrases stay inside
a word with its two borders, so each distinct word is parsed once per worker and whole texts of any length cost
one look-up per word.
"""

from __future__ import annotations

import math
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from llm.common import held_out, per_batch, texts_of

# Sample of labelled rows that the automata are built from: documents a language, and languages, those of most rows.
DOCS_PER_LANG, LANGS = 60, 200
# Words whose parse a worker remembers.
CACHE_ENTRIES = 500_000
LETTERS = re.compile(r"[^\W\d_]+").findall
UND = "und"


class SuffixAutomaton:
    """All substrings of a text; ``step[state]`` maps a character to the next state, 0 is the start."""

    def __init__(self, text: str):
        self.step: list[dict[str, int]] = [{}]
        link, length = [-1], [0]
        last = 0
        for c in text:
            new = len(self.step)
            self.step.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in self.step[p]:
                self.step[p][c] = new
                p = link[p]
            if p >= 0:
                q = self.step[p][c]
                if length[p] + 1 == length[q]:
                    link[new] = q
                else:
                    copy = len(self.step)
                    self.step.append(dict(self.step[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and self.step[p].get(c) == q:
                        self.step[p][c] = copy
                        p = link[p]
                    link[q] = link[new] = copy
            last = new

    def phrases(self, text: str) -> int:
        """Number of phrases of the greedy parse; a character that the text never had is a phrase of its own."""
        step, root = self.step, self.step[0]
        count, state = 0, root
        for c in text:
            nxt = state.get(c)
            if nxt is None:
                count += state is not root
                nxt = root.get(c)
                if nxt is None:
                    count += 1
                    state = root
                    continue
            state = step[nxt]
        return count + (state is not root)


class Identifier:
    """Automata of all languages and the words parsed so far."""

    def __init__(self, samples: dict[str, str]):
        self.names = sorted(samples)
        self.automata = [SuffixAutomaton(samples[n]) for n in self.names]
        self.bits = np.array([math.log2(len(samples[n]) + 2) for n in self.names])
        self.reset()

    def reset(self):
        self.rows: dict[str, int] = {}
        self.table = np.zeros((1024, len(self.names)), np.float32)

    def row(self, word: str) -> int:
        at = self.rows[word] = len(self.rows)
        if at == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        framed = f" {word} "
        self.table[at] = [a.phrases(framed) for a in self.automata]
        return at

    def predict(self, text: str) -> tuple[str, float]:
        words = LETTERS(text.lower())
        if not self.names or not any(map(str.isalpha, "".join(words))):
            return UND, 0.0
        if len(self.rows) > CACHE_ENTRIES:
            self.reset()
        at = list(map(self.rows.get, words))
        for i, r in enumerate(at):
            if r is None:
                known = self.rows.get(words[i])
                at[i] = self.row(words[i]) if known is None else known
        bits = self.table[at].sum(0, dtype=np.float64) * self.bits
        best = int(bits.argmin())
        return self.names[best], float(1 / np.exp2(-(bits - bits[best]) / len(words)).sum())


_IDENTIFIERS: dict[str, Identifier] = {}


def identifier(key: str, samples: dict[str, str]) -> Identifier:
    """The automata of one call, built once per Python worker."""
    if key not in _IDENTIFIERS:
        _IDENTIFIERS.clear()
        _IDENTIFIERS[key] = Identifier(samples)
    return _IDENTIFIERS[key]


def language_samples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                     docs_per_lang: int = DOCS_PER_LANG, langs: int = LANGS) -> dict[str, str]:
    """Distinct words of a bounded sample per language, from rows that are not held out.

    The sample is ``docs_per_lang`` whole texts by hash of the id, of the ``langs`` languages with the most labelled rows
    (as many rows: the first by code point); others are not learnt. Its ids, at most so many times so many, are broadcast."""
    named = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(lang_col).alias("_lang")).where("_id is not null and _lang is not null")
    named = named.where(~held_out("_id"))
    most = named.groupBy("_lang").count().orderBy(F.desc("count"), "_lang").limit(langs).select(F.col("_lang").alias("_known"))
    named = named.join(F.broadcast(most), F.col("_lang") == F.col("_known"), "left_semi")
    order = Window.partitionBy("_lang").orderBy(F.xxhash64("_id"), "_id")
    chosen = named.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= docs_per_lang).select(F.col("_id").alias("_chosen"), "_lang", "_rank")
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_own"))
    rows = texts.join(F.broadcast(chosen), (F.col("_id") == F.col("_chosen")) & (F.col("_own") == F.col("_lang")))

    def distinct(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = [" ".join(dict.fromkeys(LETTERS(t.decode("utf-8", "replace").lower()))) for t in texts_of(batch, "_text")]
        return pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(own, pa.string())], ["_lang", "_rank", "words"])
    words: dict[str, dict[str, None]] = {}
    got = rows.select("_lang", "_rank", "_text").mapInArrow(per_batch(distinct, "_text"), "_lang string, _rank int, words string")
    for lang, _, own in sorted(map(tuple, got.collect())):
        words.setdefault(lang, {}).update(dict.fromkeys(own.split()))
    return {lang: " " + " ".join(w) + " " for lang, w in words.items() if w}


def identify(docs: DataFrame, samples: dict[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``held_out``, ``lang_pred``, ``score`` (share of the winner, 0 to 1).

    Null, empty and letterless texts are ``und`` with score 0, as is everything where no language was learnt. Whole
    texts are read, a very long one in a piece of its own.
    Equal entropies go to the first language by code point. Repeated rows are each answered; an empty table
    gives an empty result; other columns are not looked at.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"))
    key = uuid.uuid4().hex

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        known = identifier(key, samples)
        got = [known.predict(t.decode("utf-8", "replace")) for t in texts_of(batch, "_text")]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got]), pa.array([g[1] for g in got], pa.float64())], ["doc_id", "lang_pred", "score"])

    out = base.mapInArrow(per_batch(run, "_text"), "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
