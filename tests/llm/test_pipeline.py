"""The stages of the pipeline, in order, each against the brute-force version of its operator."""

import collections

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from test_llm_operators import BASE, brute_components, brute_contamination, near_copies, norm, table


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("sf")
    rows = [*near_copies(7, 12), (5000, BASE), (5001, BASE.replace(" ", "  ")), (5002, None), (5003, "12 34"), (5004, "word " * 30 + BASE)]
    table(spark, rows).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(1, BASE)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "exact_dedup", "ngram_jaccard", "decontaminate", "best_fit_packing"]
    before = [(r.doc_id, r.text) for r in docs.collect()]
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stage(step(spark, docs, folder), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        after = [(r.doc_id, r.text) for r in docs.collect()]
        ids = {i for i, _ in after}
        if name == "language_id":
            assert {i for i, _ in before} - ids == {5002, 5003}
        elif name == "exact_dedup":
            best = {}
            for i, t in before:
                best[norm(t)] = min(best.get(norm(t), (0, i)), (-len(t), i))
            assert ids == {i for _, i in best.values()}
        elif name == "ngram_jaccard":
            assert ids == {i for i, n, c in brute_components(before, 5, 80) if i == c}
        else:
            assert {i for i, _ in before} - ids == {i for i, *_, bad in brute_contamination(before, [(1, BASE)]) if bad}
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    total = collections.Counter()
    for r in packed:
        total[r.doc_id] += r.length
    assert total == collections.Counter({i: len(t.encode()) + 1 for i, t in before})


def test_run(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() > 0


def test_odd_tables(spark, tmp_path):
    """Empty tables, null ids and texts, repeated rows, and columns named like helpers."""
    rows = [(None, None), (None, "the house"), (None, "the house"), (1, BASE), (1, BASE), (2, ""), (3, "x" * 200_000 + " end"), (4, BASE + " one two"), (4, "other words under one id")]
    for name, given in (("full", rows), ("none", [])):
        folder = f"{tmp_path}/{name}"
        docs = table(spark, given).withColumnRenamed("n_chars", "__row").withColumn("bin_id", F.lit("b"))
        docs.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, BASE)] if given else [], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        left = docs
        for _, step in corpus_pipeline.STAGES[:-1]:
            left = corpus_pipeline.stage(step(spark, left, folder), "odd")
            assert left.columns == docs.columns
        assert sorted((r.doc_id is not None, r.doc_id, r.text[:10]) for r in left.collect()) == ([(False, None, "the house"), (True, 3, "xxxxxxxxxx"), (True, 4, "other word")] if given else [])
        packed = corpus_pipeline.run(spark, folder).collect()
        assert sum(r.length for r in packed) == sum(len(r.text.encode()) + 1 for r in left.collect())
