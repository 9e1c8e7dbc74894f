"""The stages one by one against plain versions, and the whole run."""
import zlib

import numpy as np
import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from llm.toxicity import fit_toxicity  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    machine = fit_toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    stages = dict(pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_duplicates", "decontamination", "mixing", "token_records"]

    def step(name, ids):
        out = stages[name](spark, spark.createDataFrame([rows[i] for i in sorted(ids)], docs.schema), SF)
        assert name == "token_records" or out.columns == docs.columns
        return out.collect()

    score = dict(zip(rows, machine.score([(r["text"] or "").encode() for r in rows.values()])))
    clean = {r["doc_id"] for r in step("toxicity", rows)}
    assert clean == {i for i, s in score.items() if s < .3}
    from tests.llm.test_near import brute
    want = {i for i, _, _, kept in brute([(rows[i]["text"], i) for i in clean], 5, 80) if kept}
    single = {r["doc_id"] for r in step("near_duplicates", clean)}
    assert single == want
    from tests.llm.test_small import contaminated
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    good = {r["doc_id"] for r in step("decontamination", single)}
    assert good == {i for i, *_, bad in contaminated([(rows[i]["text"], i) for i in single], items) if not bad}
    mixed = [r["doc_id"] for r in step("mixing", good)]
    assert set(mixed) <= good and max(mixed.count(i) for i in set(mixed)) <= 2
    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(pipeline.public_tokenizers.path(pipeline.TOKENIZER))
    expected, start = [], 0
    for i in sorted(mixed):
        ids = [*whole.encode(rows[i]["text"] or "", add_special_tokens=False).ids, 1]
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, pipeline.run(spark, SF).collect()), key=lambda r: r[1]) == expected


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES])
def test_empty_input(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    assert dict(pipeline.STAGES)[name](spark, docs, SF).collect() == []
