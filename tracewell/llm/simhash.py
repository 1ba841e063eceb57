"""SimHash near-duplicates found with deletion-variant signatures.

Two fingerprints of 64 bits that differ in at most four bits, cut into three
segments, have a segment that differs in at most one bit.  So each fingerprint
is indexed under every segment with one bit blanked: 64 keys.  Fingerprints that
link share a key; an equality join on the key and a comparison of all 64 bits
finds them.

Only distinct fingerprints are indexed.  The rows of a key are brought together
once, and a task emits links that connect what is linked there, fewer than the
key has rows.  As near fingerprints share many keys, the links of all keys are
joined up in two steps: first each fingerprint's link to the smallest one, then
what links lead from one component of these to another.
Keys that more than ``HEAVY`` fingerprints share are known beforehand from
counts of whole segments; their rows stay spread over the cluster: each is
compared with one leader of its key, and then only those outside the key's
largest component are joined with the rest of it.  Both ways lose no link
between components and cap nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import keep_rows, plain_text, stored
from tracewell.plans.components import connected_components, contracted_components

BITS = 64
SHINGLE_WORDS = 4
MAX_DISTANCE = 4
SEED = 42
#: A key is heavy if more fingerprints than this may share it; up to SMALL rows are compared without a walk.
HEAVY = 20_000
SMALL = 64
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: bytes.split() without argument cuts at exactly these bytes: 0x20 and 0x09 to 0x0D.


def shingle_hashes(text: str, words: int = SHINGLE_WORDS) -> np.ndarray:
    """XXH64 of every word shingle, repeats included."""
    found = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not found:
        return np.empty(0, dtype="<u8")
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 1) - 1
    width = min(words, len(found))
    first = np.concatenate(([0], ends[:-1] + 1))[: len(found) - width + 1].tolist()
    last = ends[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(first, last)), dtype="<u8", count=len(first))


def fingerprint(text: str, words: int = SHINGLE_WORDS) -> int:
    """The fingerprint as a signed 64-bit number; zero for a text without words."""
    hashes = shingle_hashes(text, words)
    counts = np.zeros(BITS, dtype=np.int64)
    for start in range(0, len(hashes), 65_536):
        block = hashes[start : start + 65_536].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint_column(words: int = SHINGLE_WORDS) -> Column:
    """The fingerprint (long) of ``text``; a null text is empty."""

    @F.pandas_udf("long")
    def compute(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t, words) for t in texts], dtype="int64")

    return compute(plain_text())


def with_fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fingerprint long) of every row; a null text is empty."""
    return docs.select("doc_id", fingerprint_column(words).alias("fingerprint"))


def segments(distance: int = MAX_DISTANCE, bits: int = BITS) -> list[tuple[int, int]]:
    """(offset, width) of the fewest segments of which one differs by at most one bit."""
    count = (distance + 2) // 2
    edges = [bits * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _segment(column: str, offset: int, width: int) -> Column:
    return F.shiftrightunsigned(column, offset).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _blanked(value: Column, offset: int, width: int) -> list[Column]:
    """Keys of a segment's value: the blanked bit's place above the other bits."""
    return [
        F.lit((offset + bit) << width).cast("long").bitwiseOR(value.bitwiseAND(F.lit(((1 << width) - 1) ^ (1 << bit)).cast("long")))
        for bit in range(width)
    ]


def deletion_variants(column: str, distance: int = MAX_DISTANCE) -> Column:
    """Array with a key for each segment and each of its bits blanked."""
    return F.array(*[k for o, w in segments(distance) for k in _blanked(_segment(column, o, w), o, w)])


def _near(a: str, b: str, distance: int) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= distance


def heavy_keys(prints: DataFrame, distance: int = MAX_DISTANCE, heavy: int = HEAVY) -> DataFrame:
    """(key) of every key that more than ``heavy`` fingerprints may share; all others are shared by fewer.

    A key blanks one bit of a segment, so it unites two of the segment's values.
    """
    keys = []
    for offset, width in segments(distance):
        counted = prints.groupBy(_segment("fingerprint", offset, width).alias("value")).agg(F.count("*").alias("n"))
        common = counted.filter(F.col("n") > heavy // 2)
        keys.append(common.select(F.explode(F.array(*_blanked(F.col("value"), offset, width))).alias("key")))
    return reduce(DataFrame.unionByName, keys).distinct()


def spanning_links(a: np.ndarray, b: np.ndarray, rows: int) -> np.ndarray:
    """Places of links (a, b) among row numbers that connect what all of them connect, without a circle."""
    root, left, chosen = np.arange(rows), np.arange(len(a)), [np.empty(0, dtype=np.int64)]
    while len(left):
        high, low = np.maximum(root[a[left]], root[b[left]]), np.minimum(root[a[left]], root[b[left]])
        apart = high != low
        left, low = left[apart], low[apart]
        hung, place = np.unique(high[apart], return_index=True)  # each root goes below a smaller one, by one link
        chosen.append(left[place])
        root[hung] = low[place]
        while (root[root] != root).any():
            root = root[root]
    return np.concatenate(chosen)


def bucket_links(keys: np.ndarray, prints: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is linked within each run of equal keys, fewer than the run has rows."""
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.append(starts, len(keys)))
    a, b, steps = [], [], []
    small = np.repeat(sizes <= SMALL, sizes)
    for step in range(1, min(SMALL, int(sizes.max(initial=0)))):
        same = np.flatnonzero((keys[step:] == keys[:-step]) & small[step:])
        if not len(same):
            break
        near = same[np.bitwise_count(prints[same] ^ prints[same + step]) <= distance]
        steps.append(np.stack((near, near + step)))
    if steps:
        pairs = np.concatenate(steps, axis=1)
        pairs = pairs[:, spanning_links(*pairs, len(keys))]
        a.append(prints[pairs[0]])
        b.append(prints[pairs[1]])
    for start, size in zip(starts[sizes > SMALL], sizes[sizes > SMALL]):
        left = prints[start : start + size]
        while len(left):  # a breadth-first walk: what it reaches is compared no more
            front, left = left[:1], left[1:]
            while len(front) and len(left):
                near = np.bitwise_count(left ^ front[0]) <= distance
                a.append(np.full(int(near.sum()), front[0]))
                b.append(left[near])
                front, left = np.concatenate((front[1:], left[near])), left[~near]
    none = np.empty(0, dtype=np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _linked_in_buckets(variants: DataFrame, distance: int) -> DataFrame:
    """(a, b) links among the rows (key, fingerprint) of every key."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_keys, held = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)

        def out(n: int) -> pa.RecordBatch:
            a, b = bucket_links(held_keys[:n], held[:n], distance)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            held_keys = np.concatenate((held_keys, batch.column(0).to_numpy()))
            held = np.concatenate((held, batch.column(1).to_numpy().view(np.uint64)))
            ended = int(np.searchsorted(held_keys, held_keys[-1])) if len(held_keys) else 0  # the last run may go on
            if ended:
                yield out(ended)
                held_keys, held = held_keys[ended:], held[ended:]
        if len(held_keys):
            yield out(len(held_keys))

    return variants.repartition("key").sortWithinPartitions("key").mapInArrow(link, "a long, b long").distinct()


def fingerprint_components(prints: DataFrame, distance: int = MAX_DISTANCE, heavy: int = HEAVY) -> DataFrame:
    """(fingerprint, component) of those fingerprints that link to another one; ``prints`` holds each once."""
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = prints.repartition(parts)  # each row becomes one for every bit, so small partitions are not merged
    variants = spread.select(F.explode(deletion_variants("fingerprint", distance)).alias("key"), "fingerprint")
    crowded = stored(heavy_keys(prints, distance, heavy), "simhash-heavy")
    if crowded.isEmpty():
        links = stored(_linked_in_buckets(variants, distance), "simhash-links")
        return contracted_components(links).withColumnRenamed("node", "fingerprint")

    links = _linked_in_buckets(variants.join(crowded, "key", "left_anti"), distance)
    shared = stored(variants.join(crowded, "key", "left_semi"), "simhash-shared")
    leaders = shared.groupBy("key").agg(F.min("fingerprint").alias("leader"))
    led = shared.join(leaders, "key").filter((F.col("fingerprint") != F.col("leader")) & _near("fingerprint", "leader", distance))
    led = led.select(F.col("fingerprint").alias("a"), F.col("leader").alias("b"))
    links = stored(links.unionByName(led).distinct(), "simhash-links")
    first = stored(contracted_components(links).withColumnRenamed("node", "fingerprint"), "simhash-first")
    members = stored(
        shared.join(first, "fingerprint", "left").select("key", "fingerprint", F.coalesce("component", "fingerprint").alias("part")),
        "simhash-members",
    )
    sizes = members.groupBy("key", "part").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("key").agg(F.max_by("part", F.struct("n", "part")).alias("main"), F.count("*").alias("k")).filter("k > 1").drop("k")
    apart = stored(members.join(mixed, "key"), "simhash-apart")
    a, b = apart.filter("part != main").alias("a"), apart.alias("b")
    crossing = (
        a.join(
            b,
            (F.col("a.key") == F.col("b.key"))
            & (F.col("a.part") != F.col("b.part"))
            & ((F.col("b.part") == F.col("b.main")) | (F.col("a.fingerprint") < F.col("b.fingerprint")))
            & _near("a.fingerprint", "b.fingerprint", distance),
        )
        .select(F.least("a.part", "b.part").alias("a"), F.greatest("a.part", "b.part").alias("b"))
        .distinct()
    )
    second = connected_components(crossing).select(F.col("node").alias("part"), F.col("component").alias("whole"))
    linked = first.unionByName(
        second.select(F.col("part").alias("fingerprint"), F.col("part").alias("component"))
    ).distinct()
    return linked.join(second, linked.component == second.part, "left").select(
        "fingerprint", F.coalesce("whole", "component").alias("component")
    )


def near_groups(
    docs: DataFrame, words: int = SHINGLE_WORDS, distance: int = MAX_DISTANCE, heavy: int = HEAVY
) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Needs ``doc_id`` and ``text``.  A null text and a text without words have
    fingerprint zero and link like others.  Rows that repeat an id are rows of
    their own with one component each.  ``component_id`` is the smallest id
    reachable; null only where no reachable row has an id.  No row in, no row out.
    """
    return _placed_rows(docs, words, distance, heavy).select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _placed_rows(docs: DataFrame, words: int, distance: int, heavy: int) -> DataFrame:
    """One row per document: doc_id, fingerprint, component (its number), component_id."""
    rows = stored(with_fingerprints(docs, words), "simhash-rows")
    prints = rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id"))
    linked = fingerprint_components(prints.select("fingerprint"), distance, heavy)
    placed = prints.join(linked, "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint"))
    # read back, so that the join can be split where one component holds a large part of all fingerprints
    ids = stored(placed.groupBy("component").agg(F.min("first_id").alias("component_id")), "simhash-ids")
    named = placed.join(ids, "component").select("fingerprint", "component", "component_id")
    return rows.join(named, "fingerprint").select("doc_id", "fingerprint", "component", "component_id")


def drop_near_copies(
    docs: DataFrame, words: int = SHINGLE_WORDS, distance: int = MAX_DISTANCE, heavy: int = HEAVY
) -> DataFrame:
    """One row of each group with all columns: of the smallest id, and of its rows the smallest fingerprint.

    Rows that share an id, or have none, are judged each by itself.  A null text counts as empty; texts without words
    link with each other; of equal rows one stays.  Columns of any name stay as they are; an empty table stays empty.
    """
    placed = stored(_placed_rows(docs, words, distance, heavy), "simhash-placed")
    first = F.col("doc_id").eqNullSafe(F.col("component_id"))
    stays = placed.filter(first).groupBy("component").agg(F.min("fingerprint").alias("first_print"))
    judged = placed.filter(first).join(stays, "component").select("doc_id", "fingerprint", (F.col("fingerprint") == F.col("first_print")).alias("stays"))
    rest = placed.filter(~first).select("doc_id", "fingerprint", F.lit(False).alias("stays"))
    return keep_rows(docs, {"doc_id": F.col("doc_id"), "fingerprint": fingerprint_column(words)}, judged.unionByName(rest), "stays")
