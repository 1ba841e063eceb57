"""A part of the registered queries against their SQL on the smallest tables, and registry rules."""

import pytest

from oracle import compare, connect

SF = "/root/testdata/sf0.001"
SAMPLE = (
    "E10_pattern_stats", "E2_retry_flow", "E4_tool_rows", "E13_health_profile", "E18_growth", "E19_keyword_stats",
    "C4_split_turns", "D5_turn_asof", "F3_tool_loops", "F6_skill_invocations", "F12_context_pack", "H4_search",
    "J1_document_duplicates", "D8_topic_hint", "K8_intent_triage", "K10_rule_evaluation", "L2_plan_problems",
    "L5_quote_audit", "D6_stage_calls", "A6_transcript", "A8_run_entries", "B5_ledger_upsert",
)


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_its_sql(spark, con, name):
    from tracewell.workloads import ORACLES, QUERIES

    assert compare(spark, con, SF, name, QUERIES[name], ORACLES[name]).startswith("ok")


def test_partition_count_does_not_change_results(spark):
    from tracewell.workloads import QUERIES

    def rows(name):
        return sorted(map(str, QUERIES[name](spark, SF).collect()))

    names = ("E10_pattern_stats", "F6_skill_invocations", "J5_topic_candidates")
    before = {n: rows(n) for n in names}
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert {n: rows(n) for n in names} == before
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_cross_totals_equal_the_error_count(spark):
    from tracewell.workloads import QUERIES

    total = QUERIES["E9_error_meta"](spark, SF).first().error_count
    for name in ("E11_cross_source_model", "E12_cross_skill_source"):
        assert sum(r.total for r in QUERIES[name](spark, SF).collect()) == total
