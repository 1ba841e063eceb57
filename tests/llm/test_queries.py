"""Registered corpus queries against their SQL, and the pipeline against brute force."""

import re

import pytest
from oracle import compare, connect
from test_simhash import brute as near_groups
from test_simhash import plain_fingerprint

import corpus_pipeline
from tracewell.llm import mixing, quality
from tracewell.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_sql(spark, name):
    got = compare(spark, connect(SF), SF, name, QUERIES[name], ORACLES[name])
    assert got.startswith("ok") and "TYPES" not in got


def test_all_are_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert names >= set(QUERIES) | {"pipeline"}


def test_pipeline_stages_equal_brute_force(spark):
    source = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = {r.doc_id: r for r in source.collect()}
    accepted = {r.doc_id for r in quality.quality_scores(source, labels).collect() if r.score >= 0.3}
    first = {}
    for i in sorted(accepted):
        first.setdefault(re.sub(r"[\x20\x09-\x0d]+", " ", docs[i].text or ""), i)
    rows = [(i, docs[i].text) for i in sorted(first.values())]
    groups = near_groups(rows, [plain_fingerprint(t or "") for _, t in rows])
    apart = {i for i, _, component in groups if i == component}
    con = connect(SF)
    clean = {i for i, bad in con.execute(f"SELECT doc_id, contaminated FROM ({ORACLES['op6_decontamination']})").fetchall() if not bad}
    left = apart & clean

    table, kept = source, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        table = stage(spark, table, SF)
        assert table.columns == source.columns
        kept.append({r.doc_id for r in table.collect()})
    assert kept == [accepted, set(first.values()), apart, left]

    con.execute("CREATE TABLE kept AS SELECT unnest(?) AS doc_id", [sorted(left)])
    con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{SF}/documents.parquet' WHERE doc_id IN (SELECT doc_id FROM kept)")
    want = sorted(con.execute(f"SELECT doc_id, n_tokens, epoch FROM ({mixing.oracle()})").fetchall())
    got = corpus_pipeline.run(spark, SF).select("doc_id", "mix_tokens", "mix_epoch").collect()
    assert sorted(map(tuple, got)) == want
