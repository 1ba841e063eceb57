"""The ranker on held-out labels, and its edge cases."""

import zlib

import numpy as np

from tracewell.llm import quality as Q

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = Q.quality_scores(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert np.mean([r.predicted == r.quality for r in held]) >= 0.95


def test_labels_of_held_out_rows_teach_nothing(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality", "'x' AS text")
    score = lambda x: {r.doc_id: r.score for r in Q.quality_scores(docs, x).collect()}
    assert score(labels) == score(turned)


def test_nulls_repeats_and_no_labels(spark):
    docs = spark.createDataFrame(
        [(1, None, "a"), (2, "", "b"), (2, "", "b"), (None, "Some words.", "c"), (4, "word " * 60_000, "d"), (5, "퟿ 中文", "e")], "doc_id long, text string, quality string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 0), (2, None)], "doc_id long, quality int")
    for given in (labels, labels.limit(0)):
        rows = Q.quality_scores(docs, given).collect()
        assert len(rows) == 6 and all(r.predicted == 1 and abs(r.score - 0.3) < 1e-9 for r in rows)
        assert [r.held_out for r in rows if r.doc_id is None] == [False]
    assert Q.drop_rejected(docs, labels).columns == docs.columns
    assert Q.quality_scores(docs.limit(0), labels).count() == 0


def test_pairwise_weights_minimise_the_loss():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3)) + [1.0, -0.5, 0.0]
    w = Q.bradley_terry(x)
    loss = lambda v: np.log1p(np.exp(-x @ v)).sum() + 0.5 * v @ v
    assert all(loss(w) <= loss(w + step) for step in rng.normal(size=(50, 3)) * 0.05)


def test_threshold_is_the_best_quantile():
    strengths = np.concatenate([np.linspace(0, 1, 100), np.linspace(2, 3, 300)])
    good = np.arange(400) >= 100
    assert 1 <= Q.accepting_quantile(strengths, good) <= 2
