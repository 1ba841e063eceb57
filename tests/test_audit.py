import pytest
from pyspark.sql import functions as F

from oracle import TABLES, compare, connect
from tracewell.operators import audit as A
from tracewell.plans import contains
from tracewell.workloads import ORACLES, QUERIES


@pytest.mark.parametrize("at_once", [100, 1, 0])
def test_lines_are_looked_up_in_their_own_sessions(spark, monkeypatch, at_once):
    monkeypatch.setattr(A, "SESSION_NEEDLES", at_once)
    rows = [("c:1", 0, "user", "alpha beta gamma"), ("c:1", 1, "user", "delta epsilon"), ("c:2", 0, "user", "zeta eta theta")]
    messages = spark.createDataFrame(rows, "sid string, seq int, role string, raw string")
    sessions = spark.createDataFrame([("c:1", "1"), ("c:2", "2")], "sid string, session_id string")
    cards = spark.createDataFrame(
        [("a", "pitfall", [("c:1", None)], "beta gamma\nzeta eta\nabc\ngammadelta"), ("b", "workflow", [("2", None)], "zeta eta\ndelta epsilon"),
         ("i", "insight", [("c:1", None)], "beta gamma")],
        "id string, type string, anchors array<struct<session_id string, turn int>>, evidence string",
    )
    raised = lambda *a, **b: pytest.fail("needles of all sessions met in one set")
    monkeypatch.setattr(A, "_found_in_sessions", raised)
    got = {(r.id, r.line_no): r.found for r in A.evidence_check(cards, sessions, messages).collect()}
    assert got == {("a", 1): True, ("a", 2): False, ("a", 4): True, ("b", 1): True, ("b", 2): False}


def test_exploded_grams_are_not_broadcast(spark, monkeypatch, tmp_path):
    """The planner takes grams for as small as the file they come from."""
    monkeypatch.setattr(contains, "AUTOMATON_CHARS", 0)
    spark.range(50).select(F.col("id").alias("tid"), F.concat(F.lit("words of text "), "id").alias("body")).write.parquet(f"{tmp_path}/t")
    texts = spark.read.parquet(f"{tmp_path}/t")
    needles = texts.select(F.col("tid").alias("nid"), F.substring("body", 7, 20).alias("word"))
    found = contains.contains_pairs(texts, needles, "tid", "body", "nid", "word")
    assert found.count() == 50 + 4 * 10  # "of text 1" is in "of text 10" as well
    lines = found._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            below = []
            for other in lines[i + 1 :]:
                if depth(other) <= depth(line):
                    break
                below.append(other)
            assert not any("Generate" in x for x in below)


def test_plan_rows_read_the_triage_once(spark, monkeypatch):
    """Four reads of it in one stage meant four times its sorts, and the grams of all turns, in every task."""
    raised = lambda *a, **b: pytest.fail("coherence is not asked for")
    monkeypatch.setattr("tracewell.operators.sequence.coherence", raised)
    plan = QUERIES["L1_plan_rows"](spark, "/root/testdata/sf0.001")
    scans = plan._jdf.queryExecution().executedPlan().toString().count("Scan parquet")
    assert scans <= 4 and plan.count() > 0  # the topics'


@pytest.mark.parametrize("held", [2_000_000, 0])
def test_long_needles_meet_few_texts(spark, monkeypatch, held):
    """Every eight characters of these texts are common; only whole needles are rare."""
    for name, value in (("AUTOMATON_CHARS", 0), ("TASK_HASHES", held), ("HASHED_CHARS", 300)):
        monkeypatch.setattr(contains, name, value, raising=True)
    words = [f"{'tionwhere' * 2}{i:03d}{'tionwhere' * 2}" for i in range(60)]
    texts = [(f"t{i}", None if i == 7 else f"é\U0001f600{words[i]}{words[(i * 7) % 60]}") for i in range(60)] + [("e", "")]
    needles = [(f"n{i}", w[2:38]) for i, w in enumerate(words)] + [("s", "é"), ("u", "\U0001f600t"), ("m", "tionwhereX")]
    t = spark.createDataFrame(texts, "tid string, body string")
    n = spark.createDataFrame(needles, "nid string, word string")
    got = {(r.tid, r.nid) for r in contains.contains_pairs(t, n, "tid", "body", "nid", "word").collect()}
    assert got == {(a, b) for a, x in texts for b, y in needles if x and y in x} and len(got) > 200


@pytest.mark.parametrize("name", ["L12_card_summary", "L12_card_totals"])
def test_cards_without_text_are_counted_as_by_the_sql(spark, tmp_path, name):
    for t in TABLES:
        if t != "documents":
            (tmp_path / f"{t}.parquet").symlink_to(f"/root/testdata/sf0.001/{t}.parquet")
    texts = ["", " ", "\n", "  \n ", "\t", "\xa0", "\nabc", "a | b", "%%%"]
    rows = [(i, x, lang, "src1", len(x)) for i, (lang, x) in enumerate((lang, x) for lang in ("en", "fr", "de") for x in texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.toPandas().to_parquet(tmp_path / "documents.parquet")
    con = connect(str(tmp_path))
    assert compare(spark, con, str(tmp_path), name, QUERIES[name], ORACLES[name]).startswith("ok")
