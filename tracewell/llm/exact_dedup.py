"""Exact duplicates through an extendible-hash index kept in shared files.

1.  Every text is keyed by a 64-bit hash of its normalised form; the distinct
    keys, with the number of their rows, are stored.
2.  The directory doubles until no slot holds more keys than a bucket may: how
    deep it gets follows from the keys alone.  A bucket is split as often as its
    keys ask for, so buckets differ in depth, and a shallow one fills several
    slots.
3.  Consecutive slots belong to an owner.  Keys go to the owner the directory
    names.  A key of one row is an entry of its own: nothing has its hash, so no
    bytes are compared and its text stays where it is.
4.  Texts whose key repeats follow their key to its owner, combined before that
    within each of ``SALTS`` groups of tasks, so thousands of copies arrive as a
    few rows.  The owner's task sorts them and compares each with the one before
    it, byte by byte; different texts with one hash form a chain.
5.  A row finds its entry by the bucket the directory names for its hash; where
    a chain has several entries, which then keep their texts, bytes decide.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import keep_rows, narrow, plain_text, stored

BUCKET_CAPACITY = 16_384
HASH_BITS = 64
#: An owner has two to this power consecutive slots, or one bucket that fills more.
OWNER_BITS = 3
#: Rows of one text that may reach its owner.
SALTS = 16
#: Fixed value: the white space that counts as one space.
WHITE_SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: str | Column = "text") -> Column:
    return F.regexp_replace(plain_text(text), WHITE_SPACE, " ")


def hash_key(body: Column, bits: int = HASH_BITS) -> Column:
    """Leading ``bits`` of the 64-bit hash; fewer bits make collisions, for tests."""
    key = F.xxhash64(body)
    return key if bits == 64 else F.shiftleft(F.shiftrightunsigned(key, 64 - bits), 64 - bits)


def _slot(depth: int) -> Column:
    return F.shiftrightunsigned("hash_key", 64 - depth) if depth else F.lit(0).cast("long")


def directory_depth(keys: DataFrame, capacity: int = BUCKET_CAPACITY) -> int:
    """Depth at which no slot holds more than ``capacity`` of the distinct ``hash_key`` rows.

    Doubling starts where evenly spread keys would fit; each step brings one number to the driver.
    """
    n = keys.count()
    depth = max(0, math.ceil(math.log2(n / capacity))) if n else 0
    while depth < HASH_BITS - 1:
        fullest = keys.groupBy(_slot(depth).alias("slot")).count().agg(F.max("count")).first()[0]
        if (fullest or 0) <= capacity:
            break
        depth += 1
    return depth


def directory(keys: DataFrame, capacity: int, depth: int) -> DataFrame:
    """(slot, depth, bucket, owner) of every slot below an occupied bucket, from distinct ``hash_key`` rows.

    ``depth`` is the directory's; ``bucket`` is the first slot of a bucket, ``owner`` the number of its range of slots.
    """
    fine = keys.groupBy(_slot(depth).alias("slot")).agg(F.count("*").alias("n"))
    prefixes = fine.select(
        "slot", "n", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("depth")
    ).withColumn("prefix", F.expr(f"shiftright(slot, {depth} - depth)"))
    fitting = (
        prefixes.groupBy("depth", "prefix")
        .agg(F.sum("n").alias("held"))
        .filter((F.col("held") <= capacity) | (F.col("depth") == depth))
    )
    first = F.expr(f"shiftleft(prefix, {depth} - depth)")
    last = F.expr(f"shiftleft(prefix + 1, {depth} - depth) - 1")
    settled = fitting.select("depth", F.explode(F.sequence(first, last)).alias("slot")).groupBy("slot").agg(F.min("depth").alias("depth"))
    bucket = F.expr(f"shiftleft(shiftright(slot, {depth} - depth), {depth} - depth)")
    return settled.withColumn("bucket", bucket).withColumn("owner", F.shiftright("bucket", OWNER_BITS))


def compare_in_owners(texts: DataFrame) -> DataFrame:
    """Entries of the texts (owner, bucket, depth, hash_key, body, doc_id): chain_no, chain_length, keep_id, group_size, chain_text.

    A task holds whole owners and goes through its sorted texts; a text is compared with the one before it.
    """
    key = ["owner", "bucket", "depth", "hash_key"]
    combined = texts.groupBy((F.spark_partition_id() % SALTS).alias("salt"), *key, "body").agg(
        F.min("doc_id").alias("least_id"), F.count("*").alias("held")
    )
    bucket = Window.partitionBy(*key)
    along = bucket.orderBy("body")
    fresh = (~F.col("body").eqNullSafe(F.lag("body").over(along))).cast("int")
    chained = (
        combined.repartition("owner")
        .withColumn("fresh", fresh)
        .withColumn("chain_no", F.sum("fresh").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .withColumn("chain_length", F.max("chain_no").over(bucket))
    )
    return (
        chained.withColumn("own_text", F.when(F.col("chain_length") > 1, F.col("body")))
        .groupBy(*key, "chain_no", "chain_length")
        .agg(F.min("least_id").alias("keep_id"), F.sum("held").alias("group_size"), F.max("own_text").alias("chain_text"))
    )


def build_index(keyed: DataFrame, keys: DataFrame, slots: DataFrame, depth: int) -> DataFrame:
    """Index rows (owner, bucket, depth, hash_key, chain_no, chain_length, keep_id, group_size, chain_text).

    ``keyed`` has doc_id, hash_key and body, ``keys`` the distinct hash_key with n_rows and first_id.  Up to
    ``common.BROADCAST_KEYS`` repeated keys are broadcast; beyond, and for the directory, it is left to the planner.
    """
    routed = keys.withColumn("slot", _slot(depth)).join(slots, "slot").drop("slot")
    alone = routed.filter("n_rows = 1").select(
        "owner", "bucket", "depth", "hash_key", F.lit(1).cast("long").alias("chain_no"), F.lit(1).cast("long").alias("chain_length"),
        F.col("first_id").alias("keep_id"), F.col("n_rows").alias("group_size"), F.lit(None).cast("string").alias("chain_text"),
    )
    repeated = stored(routed.filter("n_rows > 1").select("owner", "bucket", "depth", "hash_key"), "exact-repeated")
    return alone.unionByName(compare_in_owners(keyed.join(narrow(repeated), "hash_key")))


def exact_groups(
    docs: DataFrame,
    capacity: int = BUCKET_CAPACITY,
    max_depth: int | None = None,
    hash_bits: int = HASH_BITS,
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Needs the columns ``doc_id`` and ``text``; others are not looked at.  A null
    text is empty, and all empty texts form one group.  Rows that repeat an id
    count each and share their fate.  A null id never stays while its text also
    has an id; if it has none, ``keep_id`` is null and the rows stay.  Texts of
    any length are hashed and compared whole.  No row in, no row out.

    The directory gets as deep as the keys ask for; ``max_depth`` sets its depth
    instead, and buckets of that depth may then hold more than ``capacity``.
    """
    source = docs.select("doc_id", normalised().alias("body"))
    keyed = source.withColumn("hash_key", hash_key(F.col("body"), hash_bits))
    rows = stored(keyed.select("doc_id", "hash_key", F.sha2("body", 256).alias("text_sha256")), "exact-rows")
    counted = rows.groupBy("hash_key").agg(F.count("*").alias("n_rows"), F.min("doc_id").alias("first_id"))
    keys = stored(counted, "exact-keys")
    depth = directory_depth(keys, capacity) if max_depth is None else max_depth
    slots = stored(directory(keys, capacity, depth), "exact-directory")
    index = stored(build_index(keyed, keys, slots, depth), "exact-index")

    at = slots.select("slot", "bucket")
    plain = index.filter("chain_length = 1").select("bucket", "hash_key", "keep_id", "group_size")
    found = rows.withColumn("slot", _slot(depth)).join(at, "slot").join(plain, ["bucket", "hash_key"])
    chains = index.filter("chain_length > 1").select("bucket", "hash_key", "keep_id", "group_size", F.col("chain_text").alias("body"))
    if not chains.isEmpty():
        chained = keyed.join(chains.select("hash_key").distinct(), "hash_key", "left_semi")
        compared = chained.withColumn("slot", _slot(depth)).join(at, "slot").join(chains, ["bucket", "hash_key", "body"])
        columns = ["doc_id", "keep_id", "group_size"]
        found = found.select(*columns, "text_sha256").unionByName(compared.select(*columns, F.sha2("body", 256).alias("text_sha256")))
    return found.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def drop_exact_rows(docs: DataFrame, **options) -> DataFrame:
    """One row for each text, with all columns: of the smallest id, without an id only where no row of the text has one.

    Rows that share an id, or have none, are judged each by itself.  A null text counts as empty, texts of any length
    are compared whole, and columns of any name stay as they are; an empty table stays empty.
    """
    groups = exact_groups(docs, **options)
    return keep_rows(docs, {"doc_id": F.col("doc_id"), "text_sha256": F.sha2(normalised(), 256)}, groups, "kept")
