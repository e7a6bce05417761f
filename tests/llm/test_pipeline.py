"""Registered text queries, and the pipeline against its parts done plainly."""

import hashlib

import pytest

import check
import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from shoebox.llm import bpe, crf
from shoebox.llm.oracle import ORACLES
from shoebox.llm.queries import QUERIES
from tests.llm import test_decontam, test_forest


def test_all_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES) and set(QUERIES) | {"pipeline"} <= set(queries()) and set(ORACLES) <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    line, good = check.compare(spark, sf_dir, name, QUERIES[name], ORACLES[name])
    assert good, line


def test_pipeline_against_plain_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stages = stage(spark, stages, sf_dir)
        assert stages.columns == docs.columns, name
    # The language stage has its own tests, with planted junk; here it decides what the others get.
    rows = [(r["doc_id"], r["text"]) for r in crf.known_only(docs).collect()]
    kept = {class_id for _, class_id, *_ in test_forest.plain(rows)}
    rows = [r for r in rows if r[0] in kept]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = {i for i, _, hit, _ in test_decontam.plain(rows, items) if not hit}
    encoding = bpe._encoding("byte_bpe_multi_50k.tiktoken")
    want = [(i, len(encoding.encode_ordinary(t)), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows if i in clean]
    found = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in found) == sorted(want)


def test_pipeline_on_awkward_rows(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{tmp_path}/sf"
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(f"{base}/benchmark.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (7, "", "en", "s", 0), (7, "", "en", "s", 0), (8, " \n ", None, None, 3)], docs.schema)
    clashing = docs.union(odd).union(docs.limit(5)).selectExpr("*", "1 AS key", "'x' AS _text", "2 AS node", "3 AS n_tokens")
    clashing.write.parquet(f"{base}/documents.parquet")
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, base).collect()}
    assert got == {r["doc_id"] for r in corpus_pipeline.run(spark, sf_dir).collect()}
    empty = f"{tmp_path}/empty"
    docs.limit(0).write.parquet(f"{empty}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(f"{empty}/benchmark.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0
