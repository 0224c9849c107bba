"""The pipeline's stages against what the operators say one by one, and the registration."""

import corpus_pipeline
from lexicorn.llm import bpe_codec, cotraining, decontaminate, queries

from conftest import SF001


def test_stages_take_effect(spark):
    import public_tokenizers
    import tiktoken
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    columns = docs.columns
    kept = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = spark.createDataFrame(stage(spark, docs, SF001).collect(), docs.schema)
        assert docs.columns == columns
        kept.append(docs.count())
    assert kept[0] > kept[1] >= kept[2] >= kept[3] > kept[0] / 2
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    labels = spark.read.parquet(f"{SF001}/labels.parquet")
    good = {r["doc_id"] for r in cotraining.score_documents(
        spark.read.parquet(f"{SF001}/documents.parquet"), labels).filter("keep").collect()}
    assert set(texts) <= good
    assert all(not decontaminate.Index([(r["item_id"], r["text"])], decontaminate.Budget()).matches(
        decontaminate.normalise(t)) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()
        for t in list(texts.values())[:40])
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                            mergeable_ranks=bpe_codec.read_ranks(path))
    out = corpus_pipeline.STAGES[3][1](spark, docs, SF001).collect()
    assert {r["doc_id"]: r["ids"] for r in out} == {d: lib.encode_ordinary(t or "") for d, t in texts.items()}


def test_run_returns_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF001)
    assert "ids" in out.columns and out.count() == out.select("doc_id").distinct().count() > 0


def test_every_operator_has_one_query():
    numbers = sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES)
    assert numbers == list(range(1, 14))
