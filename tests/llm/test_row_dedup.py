"""Dedup stages on rows without id and with repeated ids: one row of each group stays."""

import corpus_pipeline
from pyspark.sql import functions as F
from tracewell.llm import common

STAGES = dict(corpus_pipeline.STAGES)
SCHEMA = "doc_id long, text string, source string"


def kept(spark, stage, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    out = STAGES[stage](spark, docs, "")
    assert out.columns == docs.columns
    return sorted(((r.doc_id, r.text, r.source) for r in out.collect()), key=str)


def test_exact_stage_keeps_one_row_of_each_text(spark):
    rows = [(5, "a"), (5, "a"), (None, "a"), (None, "b"), (None, "b"), (2, "c"), (2, "a"), (2, "a"), (7, "d"), (7, "a"), (8, None), (None, "")]
    got = kept(spark, "exact_dedup", [(i, t, "s") for i, t in rows])
    assert got == sorted([(2, "a", "s"), (2, "c", "s"), (7, "d", "s"), (8, None, "s"), (None, "b", "s")], key=str)


def test_exact_stage_takes_whole_rows(spark):
    rows = [(None, "same  text", f"s{k}") for k in range(50)] + [(None, "same text", "t")]
    got = kept(spark, "exact_dedup", rows)
    assert len(got) == 1 and got[0] in rows
    assert got == kept(spark, "exact_dedup", rows[::-1])


def test_near_stage_keeps_one_row_of_each_component(spark):
    long = "one two three four five six seven eight nine ten"
    rows = [
        (3, long, "s"), (1, long, "s"), (1, long, "s"), (1, long.upper(), "s"), (1, "text of quite another kind here", "s"), (None, long, "s"),
        (None, "nobody knows where this came from", "s"), (None, "nobody knows where this came from", "s"), (None, "a last one that stands all alone", "s")]
    got = kept(spark, "near_dedup", rows)
    assert [(i, t.lower()) for i, t, _ in got] == [(i, t) for i, t, _ in sorted(
        [(1, long, "s"), (1, rows[4][1], "s"), (None, rows[6][1], "s"), (None, rows[8][1], "s")], key=str)]


def test_stages_leave_columns_of_any_name_alone(spark):
    long = "one two three four five six seven eight nine ten"
    schema = "doc_id long, text string, key_doc_id string, mark_doc_id string, row string, key_text_sha256 int, tags map<string, int>, `a.b` int"
    rows = [(i, t, f"k{n}", f"m{n}", f"r{n}", n, {"n": n}, n) for n, (i, t) in enumerate([(1, long), (1, long), (2, long), (3, "other words"), (None, "x y")])]
    docs = spark.createDataFrame(rows, schema)
    for stage in ("exact_dedup", "near_dedup"):
        out = STAGES[stage](spark, docs, "")
        got = [tuple(r) for r in out.collect()]
        assert out.columns == docs.columns and all(r in rows for r in got)
        assert sorted(str(r[0]) for r in got) == ["1", "3", "None"]


def wide_shuffles(plan):
    """Exchanges of a formatted plan whose rows hold the text or the whole row."""
    return [node for node in plan.split("\n\n") if "Exchange\n" in node and "BroadcastExchange" not in node and ("text#" in node or "row#" in node)]


def test_dedup_stages_shuffle_no_document_that_stays(spark):
    """Also where the planner would not broadcast the rows that go, whole documents stay where they are."""
    docs = spark.createDataFrame([(i, f"text {i % 900} of these", "s") for i in range(1000)], SCHEMA)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for stage in ("exact_dedup", "near_dedup"):
            out = STAGES[stage](spark, docs, "")
            plan = out._jdf.queryExecution().explainString(out._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
            assert not wide_shuffles(plan), stage
            assert stage == "near_dedup" or out.count() == 900
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_rows_of_one_hash_are_told_apart_by_their_keys(spark, monkeypatch):
    """Keys that collide: some go, some stay, some are repeated; with and without a broadcast."""
    rows = [(5, "a"), (5, "a"), (None, "a"), (None, "b"), (None, "b"), (2, "c"), (2, "a"), (2, "a"), (7, "d"), (7, "a"), (8, None), (None, "")]
    rows += [(i, f"t{i % 70}") for i in range(100, 200)]
    docs = [(i, t, "s") for i, t in rows]
    want = kept(spark, "exact_dedup", docs)
    monkeypatch.setattr(common, "_key_hash", lambda keys: F.pmod(F.xxhash64(*keys), F.lit(16)))
    assert kept(spark, "exact_dedup", docs) == want
    monkeypatch.setattr(common, "BROADCAST_KEYS", 0)
    assert kept(spark, "exact_dedup", docs) == want
