import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewell.plans.scan import Running, floor_quantile, position_scan, running_scan, seq_block, value_runs, with_adaptive_block


def _rows(spark, n=400, keys=5, seed=1):
    rng = random.Random(seed)
    counters = {}
    rows = []
    for _ in range(n):
        k = "hot" if rng.random() < 0.5 else f"k{rng.randrange(keys)}"
        seq = counters.get(k, 0)
        counters[k] = seq + 1
        rows.append((k, seq, rng.randrange(10), rng.choice(["a", "b", None])))
    return spark.createDataFrame(rows, "k string, seq int, v int, s string")


def test_blocked_scan_equals_plain_window(spark):
    df = _rows(spark)
    out = running_scan(
        df,
        ["k"],
        ["seq"],
        seq_block("seq", 7),
        {
            "total": Running("sum", F.col("v")),
            "top": Running("max", F.col("v")),
            "low": Running("min", F.col("v")),
            "seen": Running("last", F.col("s")),
            "before": Running("prev", F.struct("v", "s")),
        },
    )
    w = Window.partitionBy("k").orderBy("seq")
    cum = w.rowsBetween(Window.unboundedPreceding, 0)
    want = df.select(
        "k",
        "seq",
        F.sum("v").over(cum).alias("total"),
        F.max("v").over(cum).alias("top"),
        F.min("v").over(cum).alias("low"),
        F.last("s", ignorenulls=True).over(cum).alias("seen"),
        F.lag(F.struct("v", "s")).over(w).alias("before"),
    )
    cols = want.columns
    assert sorted(map(str, out.select(cols).collect())) == sorted(map(str, want.collect()))


def test_runs_merge_across_blocks(spark):
    df = _rows(spark, seed=3).fillna("b")
    for rows in (1, 3, 8, 1000):
        got = {tuple(r) for r in value_runs(df, ["k"], "seq", "s", seq_block("seq", rows)).select("k", "s", "first_pos", "last_pos", "length").collect()}
        want = set()
        by_key = {}
        for r in df.orderBy("k", "seq").collect():
            by_key.setdefault(r.k, []).append(r)
        for k, rs in by_key.items():
            start = 0
            for i in range(1, len(rs) + 1):
                if i == len(rs) or rs[i].s != rs[start].s:
                    want.add((k, rs[start].s, rs[start].seq, rs[i - 1].seq, i - start))
                    start = i
        assert got == want


def test_adaptive_blocks_cut_only_hot_keys(spark):
    df = _rows(spark)
    blocked = with_adaptive_block(df, ["k"], F.col("seq").cast("long"), hot_rows=100)
    per_key = {r.k: r.n for r in blocked.groupBy("k").agg(F.count_distinct("__pos_block").alias("n")).collect()}
    assert per_key["hot"] > 1
    assert all(n == 1 for k, n in per_key.items() if k != "hot")
    out = running_scan(blocked, ["k"], ["seq"], F.col("__pos_block"), {"nth": Running("sum", F.lit(1))})
    assert out.filter(F.col("nth") != F.col("seq") + 1).count() == 0


def test_a_burst_of_a_hot_key_is_cut_by_its_quantiles(spark):
    rows = [("hot", 10**9 if i == 0 else i, i) for i in range(600)] + [("cold", i, i) for i in range(50)]  # equal widths would leave one piece
    df = spark.createDataFrame(rows, "k string, at long, id int")
    blocked = with_adaptive_block(df, ["k"], F.col("at"), hot_rows=100)
    sizes = [r["count"] for r in blocked.filter("k = 'hot'").groupBy("__pos_block").count().collect()]
    assert len(sizes) >= 6 and max(sizes) <= 130
    for hot_rows in (100, 10**6):
        out = position_scan(df, ["k"], ["at"], F.col("at"), {"nth": Running("sum", F.lit(1))}, hot_rows)
        assert out.columns == ["k", "at", "id", "nth"]
        want = {("hot", i): i for i in range(1, 600)} | {("hot", 0): 600} | {("cold", i): i + 1 for i in range(50)}
        assert {(r.k, r.id): r.nth for r in out.collect()} == want


def test_scans_of_scans_read_their_input_once(spark, tmp_path):
    _rows(spark).write.parquet(f"{tmp_path}/rows")
    df = spark.read.parquet(f"{tmp_path}/rows")
    for size in (7, 100_000):
        out = df
        for n in range(4):
            out = running_scan(out, ["k"], ["seq"], seq_block("seq", size), {f"s{n}": Running("sum", F.col(f"s{n - 1}" if n else "v"))})
        assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation") <= 1
        assert out.count() == df.count()


def test_floor_quantile(spark):
    for n in (1, 7, 10, 20):
        hist = spark.createDataFrame([(i, 1) for i in range(n)], "v long, n long")
        assert floor_quantile(hist, [], "v", {"p": 0.95}).first().p == int(0.95 * (n - 1))
