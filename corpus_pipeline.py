"""From raw documents to token records: what is toxic, repeated or leaked goes, sources are mixed, the rest is encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages the rows lie in the shared folder.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from llm.common import shared_dir, stored, table
from llm.decontaminate import drop_contaminated
from llm.mixing import sample_mix
from llm.near import drop_near
from llm.tokens import write_tokens
from llm.toxicity import drop_toxic, fit_toxicity

TOKENIZER = "word_bpe_49k.json"


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores below its threshold; it learns from the labelled ones among them."""
    return drop_toxic(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group whose shingles of five words are alike to 0.8 or more."""
    return drop_near(docs, shingle=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of ten words of the benchmark."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them (0 to 2 times)."""
    return sample_mix(docs)


def token_records(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Record files below the shared folder; returns what is read back: id, start, number of ids, checksum."""
    index = write_tokens(docs, shared_dir(spark, "pipeline-tokens"), public_tokenizers.path(TOKENIZER))
    return index.select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("token_records", token_records)]
# A learnt score and a tokenizer have no SQL form; tests/llm/test_pipeline.py has the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
