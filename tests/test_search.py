"""A stored index gives the ranks of scoring everything and reads less."""

import random

import pytest
from pyspark.sql import functions as F

from tracewell.operators import search as H


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(6)
    rare = [f"rare{i}" for i in range(40)]
    rows = []
    for s in range(40):
        for seq in range(30):
            words = ["the"] * rng.randrange(1, 4) + [rng.choice("abcdefgh") * 2 for _ in range(rng.randrange(2, 60))]
            if rng.random() < 0.1:
                words.append(rng.choice(rare))
            if s == 7 and seq < 3:
                words = ["the"] * 30 + ["of", "the"]  # far better for the common word than all others
            rng.shuffle(words)
            rows.append((f"s{s:02d}", seq, "user" if seq % 2 else "assistant", None, " ".join(words) if rng.random() < 0.97 else None))
    rows += [("s40", 0, "user", None, "中文搜索 测试"), ("s40", 1, "user", None, "搜索 中文"), ("s41", 0, "user", None, "")]
    messages = spark.createDataFrame(rows, "sid string, seq int, role string, ts string, raw string")
    sessions = messages.select("sid").distinct().withColumn("source", F.when(F.col("sid") < "s20", "a").otherwise("b")).withColumn("title", F.col("sid"))
    return messages, sessions


QUERIES = ("the", "the rare3", "aa-bb", "rare1 rare2 rare5", "中文搜索", "absent", "the aa bb cc", "搜索")


def ranks(df):
    return sorted((r.qid, r["rank"], r.sid, r.seq, round(r.score, 9)) for r in df.collect())


@pytest.mark.parametrize("source", [None, "b"])
def test_index_gives_the_ranks_of_the_full_form(spark, corpus, tmp_path, source):
    messages, sessions = corpus
    want = ranks(H.search(messages, sessions, QUERIES, limit=5, source=source))
    assert {q for q, *_ in want} == {0, 1, 2, 3, 4, 6, 7}
    path = str(tmp_path / "index")
    H.write_index(messages.filter("sid < 's25'"), path, bucket_rows=3000, cell_rows=16)
    H.append_index(messages.filter("sid >= 's25' AND sid < 's40'"), path, bucket_rows=500)
    index = H.append_index(messages.filter("sid >= 's40'"), path)
    assert len(index.segments) == 3 and len({s.buckets for s in index.segments}) == 3
    assert ranks(H.search(messages, sessions, QUERIES, limit=5, source=source, index=index)) == want
    merged = H.merge_index(spark, path, str(tmp_path / "merged"), bucket_rows=2000)
    assert len(merged.segments) == 1 and merged.n_docs == messages.count()
    assert ranks(H.search(messages, sessions, QUERIES, limit=5, source=source, index=merged)) == want


def test_a_common_word_costs_blocks_not_postings(spark, corpus, tmp_path):
    messages, sessions = corpus
    index = H.write_index(messages, str(tmp_path / "index"), cell_rows=16)
    search = H._BlockSearch(index, sessions, H.query_terms(spark, ["the"]), 3, None)
    first = H.ST.top_per_group(search.bounds, ["qid"], [F.desc("bound"), F.col("cell")], H.FIRST_CELLS)
    best = H._ranked(search.scored(first), sessions, None, 3)
    assert {(r.sid, r.seq) for r in best.collect()} == {("s07", 0), ("s07", 1), ("s07", 2)}
    assert search.bounds.count() > 70 and search.cells_left(first, best).count() == 0
    assert "PushedFilters" in search.scored(first)._jdf.queryExecution().executedPlan().toString()


def test_an_empty_index(spark, corpus, tmp_path):
    messages, sessions = corpus
    index = H.write_index(messages.limit(0), str(tmp_path / "index"))
    assert H.search(messages, sessions, ["the"], index=index).count() == 0


def test_small_buckets_share_files(spark, corpus, tmp_path, monkeypatch):
    messages, sessions = corpus
    want = ranks(H.search(messages, sessions, QUERIES, limit=5))
    index = H.write_index(messages, str(tmp_path / "index"), bucket_rows=50, cell_rows=16)
    assert index.segments[0].buckets > 500
    assert len(list((tmp_path / "index" / "postings").rglob("*.parquet"))) <= 8 and len(list((tmp_path / "index" / "blocks").rglob("*.parquet"))) == 1
    assert ranks(H.search(messages, sessions, QUERIES, limit=5, index=index)) == want
    monkeypatch.setattr(H, "SHELF_ROWS", 10_000)
    several = H.write_index(messages, str(tmp_path / "several"), bucket_rows=50, cell_rows=16)
    assert several.segments[0].shelves > 3
    assert ranks(H.search(messages, sessions, QUERIES, limit=5, index=several)) == want
