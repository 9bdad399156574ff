"""The pipeline's stages, each against the brute-force version of its operator, and its whole run."""

from __future__ import annotations

import brute
import pytest

import corpus_pipeline

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / "out.parquet")
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append((name, docs.collect(), docs.columns))
    return out


def test_columns(stages):
    assert [name for name, _, _ in stages] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    assert all(columns == list(corpus_pipeline.COLUMNS) for _, _, columns in stages[:-1])


def test_near_duplicates(stages):
    before = [(r.doc_id, r.text) for r in stages[0][1]]
    want = {c for _, c in brute.jaccard_classes(before, 5, 4, 5).values()}
    assert sorted(r.doc_id for r in stages[1][1]) == sorted(want)


def test_decontamination(spark, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    marked = brute.windows_hit([(r.doc_id, r.text) for r in stages[1][1]], items)
    assert sorted(r.doc_id for r in stages[2][1]) == sorted(d for d, m in marked.items() if not m[4])


def test_mixing_and_sharding(stages):
    assert {r.doc_id for r in stages[3][1]} <= {r.doc_id for r in stages[2][1]}
    assert len(stages[4][1]) == len(stages[3][1])
    shards = {}
    for r in stages[4][1]:
        assert 0 <= r.shard < corpus_pipeline.SHARDS and shards.setdefault(r.doc_id, r.shard) == r.shard


def test_run(spark, stages):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.shard) for r in rows) == sorted((r.doc_id, r.shard) for r in stages[4][1])
