"""Exact duplicates against a dictionary of normalised texts, with forced collisions and small buckets."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from tracewell.llm import exact_dedup as X

SCHEMA = "doc_id long, text string, hash_key int, bucket string, body string"


def brute(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0d]+", " ", text or ""), []).append(doc_id)
    out = []
    for body, ids in groups.items():
        named = [i for i in ids if i is not None]
        keep = min(named) if named else None
        sha = hashlib.sha256(body.encode()).hexdigest()
        out += [(i, keep, len(ids), i == keep, sha) for i in ids]
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], SCHEMA)


def test_copies_collisions_and_splits(spark):
    rng = random.Random(3)
    texts = [f"text {rng.randrange(60)}" + " " * rng.randrange(3) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, " "), (903, "\t\n"), (904, " "), (905, "a" * 300_000)]
    docs = frame(spark, rows)
    want = brute(rows)
    for options in ({}, {"capacity": 3, "max_depth": 6}, {"hash_bits": 4, "capacity": 2, "max_depth": 4}, {"hash_bits": 1, "capacity": 1, "max_depth": 3}):
        assert found(X.exact_groups(docs, **options)) == want


def test_null_and_repeated_ids_and_empty_table(spark):
    rows = [(5, "a"), (5, "a"), (None, "a"), (None, "b"), (None, "b"), (2, "c"), (2, "a")]
    docs = frame(spark, rows)
    assert found(X.exact_groups(docs)) == brute(rows)
    assert X.exact_groups(docs.limit(0)).count() == 0
    kept = X.drop_exact_rows(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in kept.collect()) == [(False, 2, "a"), (False, 2, "c"), (True, 0, "b")]


def test_directory_equals_one_by_one_insertion(spark):
    rng, depth_limit, capacity = random.Random(5), 6, 3
    keys = [rng.getrandbits(64) - 2**63 for _ in range(60)] + [17] * 3
    slots = [((k % 2**64) >> (64 - depth_limit)) for k in set(keys)]

    def split(prefix, depth):
        held = [s for s in slots if s >> (depth_limit - depth) == prefix]
        if len(held) <= capacity or depth == depth_limit:
            return {s: depth for s in held}
        return split(prefix * 2, depth + 1) | split(prefix * 2 + 1, depth + 1)

    got = X.directory(spark.createDataFrame([(k,) for k in set(keys)], "hash_key long"), capacity, depth_limit)
    rows = {r.slot: r for r in got.collect()}
    for slot, depth in split(0, 0).items():
        assert rows[slot].depth == depth
        assert rows[slot].bucket == slot >> (depth_limit - depth) << (depth_limit - depth)


def test_hot_text_leaves_each_task_as_one_row(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    groups = X.exact_groups(docs)
    assert groups.filter("keep_id = 0").count() == 1334
    assert groups.filter("kept").count() == 4000 - 1333


def test_directory_doubles_as_far_as_the_keys_ask(spark):
    """Keys that share their first 20 bits need more than 20 doublings; the other bucket stays shallow."""
    shared = [(0b1011 << 60) | (k << 40) for k in range(4)]
    keys = [(k - 2**64,) for k in shared] + [(5 << 40,)]
    frame = spark.createDataFrame(keys, "hash_key long")
    assert X.directory_depth(frame, 5) == 0
    assert X.directory_depth(frame, 4) == 1
    assert X.directory_depth(frame, 2) == 23
    assert X.directory_depth(frame.limit(0), 2) == 0
    depths = {r.bucket: r.depth for r in X.directory(frame.filter("hash_key < 0"), 2, 23).filter("depth = 23").collect()}
    assert len(depths) == 2


def test_another_directory_sends_rows_to_other_owners(spark):
    rows = [(i, f"text {i % 200}") for i in range(400)]
    keyed = frame(spark, rows).select("doc_id", X.normalised().alias("body")).withColumn("hash_key", X.hash_key(F.col("body")))
    keys = keyed.groupBy("hash_key").agg(F.count("*").alias("n_rows"), F.min("doc_id").alias("first_id"))

    def owners(capacity):
        depth = X.directory_depth(keys, capacity)
        slots = X.directory(keys, capacity, depth)
        index = X.build_index(keyed, keys, slots, depth).collect()
        assert sorted((r.keep_id, r.group_size) for r in index) == [(i, 2) for i in range(200)]
        held = {}
        for r in index:
            held[r.bucket] = held.get(r.bucket, 0) + 1
        assert max(held.values()) <= capacity
        return {r.hash_key: r.owner for r in index}

    wide, fine = owners(200), owners(3)
    assert set(wide.values()) == {0}
    assert len(set(fine.values())) > 8
    ordered = sorted(fine, key=lambda k: k % 2**64)
    assert [fine[k] for k in ordered] == sorted(fine.values())


def test_copies_are_combined_before_they_reach_an_owner(spark):
    texts = spark.range(8000, numPartitions=8).select(
        F.lit(0).alias("owner"), F.lit(0).alias("bucket"), F.lit(0).alias("depth"), F.lit(1).cast("long").alias("hash_key"),
        F.when(F.col("id") % 4 == 0, "b").otherwise("a").alias("body"), F.col("id").alias("doc_id"),
    )
    got = {(r.keep_id, r.group_size, r.chain_length, r.chain_text) for r in X.compare_in_owners(texts).collect()}
    assert got == {(0, 2000, 2, "b"), (1, 6000, 2, "a")}
