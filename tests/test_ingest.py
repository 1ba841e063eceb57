import json

import pytest
from pyspark.sql import functions as F

from tracewell.operators import reports as R
from tracewell.session import materialize
from tracewell.sources import formats as FM
from tracewell.sources import ingest as I
from tracewell.sources import sinks as B
from tracewell.sources.buckets import BucketedTables
from tracewell.streaming import ingest as S


def _session(sid, updated, texts):
    messages = [{"role": "user", "text": t, "timestamp": "2024-01-01 00:00:00", "raw": None} for t in texts]
    messages.append({"role": "note", "text": "call", "timestamp": None, "raw": {"kind": "tool_call", "tool": "grep", "detail": "x"}})
    messages.append(
        {"role": "note", "text": "", "timestamp": None, "raw": {"kind": "tool_result", "tool": "grep", "status": "error", "error": "e" * 300}}
    )
    return {
        "source": "src", "session_id": sid, "title": sid, "created_at": "2024-01-01 00:00:00", "updated_at": updated,
        "extra": {"model": "m"}, "messages": messages,
    }


def _write(folder, name, doc):
    path = folder / "chat" / "2024-01"
    path.mkdir(parents=True, exist_ok=True)
    (path / f"{name}.json").write_text(doc if isinstance(doc, str) else json.dumps(doc, ensure_ascii=False), encoding="utf-8")


def _rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def test_archive_with_bad_files(spark, tmp_path):
    _write(tmp_path, "a", _session("a", "2024-01-02 00:00:00", ["你好世界", " hi "]))
    _write(tmp_path, "b", "{not json")
    _write(tmp_path, "c", {"other": 1})
    _write(tmp_path, "export_manifest", {"count": 1})
    archive = FM.read_archive(spark, str(tmp_path)).cache()
    assert tuple(FM.archive_status(archive).first()) == (3, 1, 1)
    sessions, messages, steps = I.build_tables(FM.archive_records(archive, str(tmp_path)))
    row = sessions.first()
    assert (row.sid, row.category, row.model) == ("src:a", "chat", "m")
    assert [(r.seq, r.role, r.text, r.raw) for r in messages.orderBy("seq").collect()] == [
        (0, "user", "你好 好世 世界", "你好世界"), (1, "user", "hi", " hi "), (2, "note", "call", "call"),
    ]
    assert [(r.seq, r.phase, r.status, len(r.error or "")) for r in steps.orderBy("seq").collect()] == [
        (0, "call", None, 0), (1, "result", "error", 300),
    ]


def test_incremental_equals_rebuild(spark, tmp_path):
    for name in "abc":
        _write(tmp_path, name, _session(name, "2024-01-01 00:00:00", [name]))
    old = [materialize(t) for t in I.build_tables(FM.archive_records(FM.read_archive(spark, str(tmp_path))))]
    _write(tmp_path, "b", _session("b", "2024-02-01 00:00:00", ["b", "again"]))
    _write(tmp_path, "d", _session("d", "2024-02-01 00:00:00", ["new"]))
    (tmp_path / "chat" / "2024-01" / "c.json").unlink()
    fresh = FM.archive_records(FM.read_archive(spark, str(tmp_path)))
    parsed = fresh.filter(F.col("sid").isin("src:b", "src:d"))
    dropped = spark.createDataFrame([("src:c",)], "sid string")
    full = I.build_tables(fresh)
    for current, changed, whole in zip(old, I.build_tables(parsed), full):
        assert _rows(I.upsert(current, changed, parsed, dropped)) == _rows(whole)


def test_stream_keeps_the_latest_version(spark, tmp_path):
    inbox, root = tmp_path / "in", tmp_path / "store"
    _write(inbox, "a1", _session("a", "2024-01-05 00:00:00", ["first"]))
    _write(inbox, "b1", _session("b", "2024-01-05 00:00:00", ["b"]))
    hidden = spark.createDataFrame([("src:h",)], "sid string")

    def run():
        q = S.start_ingestion(spark, str(inbox), str(root), str(tmp_path / "cp"), hidden)
        q.awaitTermination(120)
        assert q.exception() is None

    run()
    _write(inbox, "a2", _session("a", "2024-01-09 00:00:00", ["second"]))
    _write(inbox, "h1", _session("h", "2024-01-09 00:00:00", ["hidden"]))
    run()
    _write(inbox, "a3", _session("a", "2024-01-02 00:00:00", ["late and old"]))
    run()
    tables = S.current_tables(spark, str(root))
    assert {(r.sid, r.updated_at) for r in tables["sessions"].collect()} == {("src:a", "2024-01-09 00:00:00"), ("src:b", "2024-01-05 00:00:00")}
    texts = {(r.sid, r.raw) for r in tables["messages"].filter(F.col("role") == "user").collect()}
    assert texts == {("src:a", "second"), ("src:b", "b")}
    assert tables["steps"].count() == 4
    # the stored view equals a batch build over the winning files
    records = FM.archive_records(FM.read_archive(spark, str(inbox)), str(inbox), hidden)
    whole = dict(zip(S.TABLES, I.build_tables(S.latest_per_sid(records))))
    for name in S.TABLES:
        drop = ["file", "category"] if name == "sessions" else []
        assert _rows(tables[name].drop(*drop)) == _rows(whole[name].drop(*drop))


def _files(root):
    return {str(p.relative_to(root)): p.stat().st_mtime_ns for p in root.rglob("*.parquet")}


def test_compaction_equals_a_rebuild_and_leaves_other_buckets_alone(spark, tmp_path):
    inbox, root = tmp_path / "in", tmp_path / "store"

    def run():
        S.start_ingestion(spark, str(inbox), str(root), str(tmp_path / "cp")).awaitTermination(120)

    def rebuilt():
        records = FM.archive_records(FM.read_archive(spark, str(inbox)), str(inbox))
        return {name: _rows(t.drop("file")) for name, t in zip(S.TABLES, I.build_tables(S.latest_per_sid(records)))}

    def current():
        return {name: _rows(t.drop("file")) for name, t in S.current_tables(spark, str(root)).items()}

    for i in range(12):
        _write(inbox, f"s{i}", _session(f"s{i}", "2024-01-05 00:00:00", [f"one {i}", f"two {i}"]))
    run()
    assert current() == rebuilt()
    assert S.compact(spark, str(root), buckets=8) == 0
    assert current() == rebuilt()
    before = _files(root / "tables")
    _write(inbox, "again", _session("s3", "2024-01-09 00:00:00", ["changed"]))
    _write(inbox, "late", _session("s4", "2024-01-01 00:00:00", ["late and old"]))
    _write(inbox, "new", _session("s99", "2024-01-01 00:00:00", ["new"]))
    run()
    assert current() == rebuilt()
    assert S.compact(spark, str(root)) == 1 and S.compact(spark, str(root)) is None
    assert current() == rebuilt()
    store = S._stored(spark, str(root))
    assert store.buckets == 8 and store.commits() == [0, 1]
    after = _files(root / "tables")
    assert {k: v for k, v in after.items() if k in before} == before  # nothing that was there has been rewritten
    moved = {r.bucket for r in store.manifest() if r.table == "sessions" and r.held_by == 1}
    assert 1 <= len(moved) <= 2
    assert all(int(k.split("bucket=")[1].split("/")[0]) in moved for k in set(after) - set(before))
    assert {r.updated_at for r in store.read(0)["sessions"].filter("sid = 'src:s3'").collect()} == {"2024-01-05 00:00:00"}
    assert store.expire() and store.commits() == [1]
    assert current() == rebuilt()
    with pytest.raises(ValueError):
        store.expire(0)


def test_bucketed_replace_deletes_and_survives_a_failed_commit(spark, tmp_path):
    tables = BucketedTables(spark, str(tmp_path / "t"), {"rows": "sid string, n int"}, buckets=4)
    frame = lambda rows: {"rows": spark.createDataFrame(rows, "n int, sid string")}
    sids = lambda *names: spark.createDataFrame([(n,) for n in names], "sid string")
    assert tables.read()["rows"].count() == 0 and tables.merged() == -1
    assert tables.replace(frame([(i, f"s{i % 5}") for i in range(20)]), sids(*[f"s{i}" for i in range(5)]), merged=7) == 0
    assert tables.merged() == 7
    tables.replace(frame([(100, "s1")]), sids("s1", "s2", "absent"), merged=8)
    assert sorted((r.sid, r.n) for r in tables.read()["rows"].collect()) == sorted([(f"s{i % 5}", i) for i in range(20) if i % 5 not in (1, 2)] + [("s1", 100)])
    (tmp_path / "t" / "rows" / "commit=2" / "bucket=0").mkdir(parents=True)  # a commit that wrote rows and no manifest
    again = BucketedTables(spark, str(tmp_path / "t"), {"rows": "sid string, n int"})
    assert again.buckets == 4 and again.read()["rows"].count() == 13
    assert again.replace(frame([]), sids(*[f"s{i}" for i in range(5)])) == 2
    assert again.read()["rows"].count() == 0


def test_tree_prefers_the_latest_subtree_and_larger_numbers(spark):
    def node(children, at):
        return {"children": children, "message": {"inserted_at": at, "fragments": [{"type": "RESPONSE", "content": at}]}}

    tie = {"id": "t", "mapping": {"root": {"children": ["9", "10", "x"]}, "9": node([], "a"), "10": node([], "a"), "x": node([], "a")}}
    deep = {"id": "d", "mapping": {"root": {"children": ["1", "2"]}, "1": node(["3"], "a"), "2": node([], "b"), "3": node([], "c")}}
    loop = {"id": "l", "mapping": {"root": {"children": ["1"]}, "1": node(["root"], "a")}}
    docs = spark.createDataFrame([(json.dumps(x),) for x in (tie, deep, loop)], "doc string")
    got = {r.session_id: (list(r.thread), r.branch_points) for r in FM.tree_threads(docs).collect()}
    assert got["t"] == (["x"], 1)
    assert got["d"] == (["1", "3"], 1)
    assert got["l"][0] == ["1"]


def test_patch_replay_counts_failures(spark):
    log = "\n".join(
        [
            json.dumps({"kind": 1, "k": ["a"], "v": 1}),
            json.dumps({"kind": 0, "v": {"a": {}}}),
            json.dumps({"kind": 1, "k": ["a", "b", "c"], "v": 2}),
            json.dumps({"kind": 2, "k": ["list"], "v": [1, 2]}),
            json.dumps({"kind": 2, "k": ["list"], "v": 3}),
            json.dumps({"kind": 1, "k": ["list", 4, "x"], "v": 5}),
            "nope",
        ]
    )
    row = FM.replay_logs(FM.log_lines(spark.createDataFrame([("s", log)], "session_id string, log string"))).first()
    assert (row.applied, row.failed, row.superseded) == (5, 1, 1)
    assert json.loads(row.state) == {"a": {"b": {"c": 2}}, "list": [1, 2, 3, {}, {"x": 5}]}


def test_run_entry_rules(spark):
    def entry(seq, run, kind, body):
        return ("s", seq, run, kind, json.dumps({"data": {"text": body}}), None)

    rows = [
        entry(0, "r1", "request", "ask"), entry(1, "r1", "request", "ask"), entry(2, "r1", "reasoning", "think it over"),
        entry(3, "r1", "reasoning", "想一想"), entry(4, "r1", "assistant", "done"), entry(5, "r1", "answer", "done"),
        entry(6, "r2", "request", "ask"), entry(7, "r2", "reasoning", "only latin"),
    ]
    df = spark.createDataFrame(rows, "session_id string, entry_seq int, run_id string, entry_type string, payload string, committed_at string")
    got = [(r.role, r.text) for r in FM.parse_run_entries(df).orderBy("seq").collect()]
    assert got == [
        ("user", "ask"), ("note", "[reasoning]\n想一想"), ("assistant", "done"), ("user", "ask"), ("note", "[reasoning]\nonly latin"),
    ]


def test_lines_keep_their_order(spark, tmp_path):
    for f in range(3):
        (tmp_path / f"f{f}.jsonl").write_text("\n".join(json.dumps({"n": i}) for i in range(200)), encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        lines = FM.json_lines(FM.read_lines(spark, str(tmp_path)), "n int")
        assert lines.count() == 600
        assert lines.filter(F.col("o.n") != F.col("line_no")).count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_keyword_runs(spark, tmp_path):
    runs = B.KeywordRuns(spark, str(tmp_path / "kw"))
    assert runs.newest(2) is None
    messages = spark.createDataFrame([("a b bb bb cc",), ("bb",)], "raw string")
    for _ in range(3):
        runs.append(R.keyword_stats(messages, (2,)))
    assert [(r.gram, r.freq, r.doc_freq) for r in runs.newest(2).collect()] == [("bb", 3, 2), ("cc", 1, 1)]
    assert runs.prune(1) == [2, 1] and runs.runs() == [3]
    with pytest.raises(ValueError):
        runs.prune(0)


def test_exports_are_written(spark, tmp_path):
    sessions = spark.createDataFrame(
        [("s:1", "s", "1", "One", None, "2024-03-01", None, None, None), ("s:2", "s", "2", "Two", "c", None, "2023-01-05", None, None)],
        "sid string, source string, session_id string, title string, category string, created_at string, updated_at string, file string, model string",
    )
    messages = spark.createDataFrame([("s:1", 0, "user", None, "hi", "hi"), ("s:1", 1, "note", None, "n", "n"), ("s:2", 0, "assistant", "t", "yo", "yo")], "sid string, seq int, role string, ts string, text string, raw string")
    rows = B.export_rows(sessions, messages)
    B.write_export(rows, str(tmp_path / "out"))
    back = spark.read.json(str(tmp_path / "out"))
    assert {(r.category, str(r.month)) for r in back.select("category", "month").distinct().collect()} == {("uncategorised", "2024-03"), ("c", "2023-01")}
    B.write_corpus(B.corpus_lines(sessions, messages), str(tmp_path / "corpus"))
    assert "## [assistant] · t" in "".join(r.value for r in spark.read.text(str(tmp_path / "corpus")).collect())


def test_latest_threads_of_many_documents_take_one_python_step(spark):
    """More documents than a slice holds, one without nodes' children, and no second worker for a filter."""
    def node(children, at, *texts):
        return {"children": children, "message": json.dumps({"inserted_at": at, "fragments": [{"type": "RESPONSE", "content": t} for t in texts]})}

    docs = []
    for i in range(2 * FM.SLICE_DOCS + 3):
        late = "2024-01-03" if i % 2 else "2024-01-01"
        tree = {"root": node(["1"], ""), "1": node(["2", "3"], "2024-01-01", f"a{i}"), "2": node(None, "2024-01-02", "two"), "3": node([], late, "three")}
        docs.append((json.dumps({"id": f"t{i}", "mapping": tree}),))
    frame = spark.createDataFrame(docs, "doc string").coalesce(1)
    threads = {r.session_id: (r.thread, r.branch_points) for r in FM.tree_threads(frame).collect()}
    assert threads == {f"t{i}": (["1", "3" if i % 2 else "2"], 1) for i in range(len(docs))}
    parsed = FM.parse_fragment_tree(frame)
    assert parsed._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    said = {(r.session_id, r.seq): r.text for r in parsed.collect()}
    assert said[("t1", 0)] == "a1" and said[("t1", 1)] == "three" and said[("t2", 1)] == "two" and len(said) == 2 * len(docs)


def test_stream_reads_small_files_once(spark, tmp_path):
    """Each archive file of a batch is read by one scan only."""
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    for i in range(200):
        text = {"source": "live", "session_id": str(i), "updated_at": "2024-01-01", "messages": [{"role": "user", "text": f"t{i}"}]}
        (inbox / f"f{i}.json").write_text(json.dumps(text))
    held = []
    original = S.latest_per_sid

    def seen(records):
        held.append(records._jdf.queryExecution().analyzed().toString())
        return original(records)

    S.latest_per_sid = seen
    try:
        S.start_ingestion(spark, str(inbox), str(tmp_path / "store"), str(tmp_path / "progress")).awaitTermination()
    finally:
        S.latest_per_sid = original
    (plan,) = held
    assert plan.startswith("LogicalRDD"), plan
    tables = S.current_tables(spark, str(tmp_path / "store"))
    assert sorted(r.raw for r in tables["messages"].collect()) == sorted(f"t{i}" for i in range(200))
