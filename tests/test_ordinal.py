"""Global row numbers against a sorted list."""

import random

from pyspark.sql import functions as F

from tracewell.plans.ordinal import with_ordinal


def test_numbers_follow_the_order(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["hot", "hot", "cold", None]), rng.randrange(10_000), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "key string, at int, id int").repartition(7)
    got = with_ordinal(df, [F.col("key"), F.col("at"), F.col("id")], "n").collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2]))
    assert [tuple(r)[:3] for r in sorted(got, key=lambda r: r.n)] == want
    assert sorted(r.n for r in got) == list(range(3000))


def test_ties_and_no_rows(spark):
    df = spark.createDataFrame([(1,)] * 50, "at int")
    assert sorted(r.ordinal for r in with_ordinal(df, [F.col("at")]).collect()) == list(range(50))
    assert with_ordinal(df.limit(0), [F.col("at")]).count() == 0
