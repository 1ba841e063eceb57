"""Exact substring joins without a cross join.

While all needles together are small (``AUTOMATON_CHARS``, measured before
anything is collected), tasks build one automaton of them, whose failure links find every needle in
one pass over a text: the work grows with the texts and their hits, whatever the number
of needles, and no text is shuffled.

Larger sets of needles are joined: every needle is represented by the rarer of its first and its last gram of the longest
length in ``TIERS`` that it can fill; these two cover it, so few texts hold one without the needle.  Tasks hash all
grams of a text by one vector product per length and let only those go that some needle begins or ends with; candidates
come from an equi-join of hashes and are then verified with ``contains``.  Both ways give the same pairs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.session import materialize

#: Characters of all distinct needles together up to which tasks hold an automaton of them (some 50 MB).
AUTOMATON_CHARS = 500_000
#: Gram lengths, each double the one before; a needle uses the longest one it can fill.
TIERS = (1, 2, 4, 8, 16, 32)
#: Hashes of needles up to which tasks hold them (16 MB); beyond, all grams of the texts are joined.
TASK_HASHES = 2_000_000
#: Characters hashed at once.
HASHED_CHARS = 1_000_000


def _gram_hashes(codes: np.ndarray, tiers: Sequence[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(length, hash of the gram that begins at every place), each length from the one before."""
    base = 0x9E3779B97F4A7C15
    size, held = 1, (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    while True:
        if size in tiers:
            # the length goes into the hash
            yield size, ((held ^ (held >> np.uint64(29))) + np.uint64(size)).view(np.int64)
        if size >= max(tiers):
            return
        factor = np.uint64(pow(base, size, 1 << 64))
        held = held[: max(len(held) - size, 0)] * factor + held[size:]
        size *= 2


def _with_ends(tiers: Sequence[int]):
    """Needles with the hashes of their first and last gram, by the column ``__tier``."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, last = [], []
            for needle, tier in zip(batch.column("__needle").to_pylist(), batch.column("__tier").to_pylist()):
                codes = np.frombuffer(needle.encode("utf-32-le"), np.uint32)
                hashes = dict(_gram_hashes(codes, (tier,)))[tier]
                first.append(int(hashes[0]))
                last.append(int(hashes[-1]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first, pa.int64()), pa.array(last, pa.int64())], names=[*batch.schema.names, "__first", "__last"])

    return ends


def _text_hashes(tiers: Sequence[int], wanted: np.ndarray | None, keep: Sequence[str], text: str, most: int):
    """(keep, __hash) of the distinct grams of every text, of ``wanted`` ones if given."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.maximum(pa.array([0 if t is None else len(t) for t in batch.column(text).to_pylist()], pa.int64()).to_numpy(), 0)
            begin = 0
            while begin < len(sizes):
                end = max(begin + 1, begin + int(np.searchsorted(np.cumsum(sizes[begin:]), most, "right")))
                texts = batch.column(text).slice(begin, end - begin).to_pylist()
                codes = np.frombuffer("".join(t for t in texts if t).encode("utf-32-le"), np.uint32)
                row = np.repeat(np.arange(end - begin), sizes[begin:end])
                rows, found = [], []
                for size, held in _gram_hashes(codes, tiers):
                    at = np.flatnonzero(row[: len(held)] == row[size - 1 :][: len(held)]) if len(held) else np.zeros(0, int)
                    if wanted is not None and len(at):
                        place = np.minimum(np.searchsorted(wanted, held[at]), len(wanted) - 1)
                        at = at[wanted[place] == held[at]]
                    rows.append(row[at])
                    found.append(held[at])
                out = pd.DataFrame({"row": np.concatenate(rows), "hash": np.concatenate(found)}).drop_duplicates()
                took = pa.array(out["row"].to_numpy() + begin)
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(took) for c in keep], pa.array(out["hash"].to_numpy())], names=[*keep, "__hash"])
                begin = end

    return hashes


def _found_needles(text: str, words: Sequence[str]) -> Column:
    """The distinct needles in a text, by one automaton a task."""

    @F.pandas_udf("array<string>")
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = ahocorasick.Automaton()
        for word in words:
            automaton.add_word(word, word)
        automaton.make_automaton()
        for texts in batches:
            yield pd.Series([[] if t is None else list({word for _, word in automaton.iter(t)}) for t in texts], dtype=object)

    return search(text)


def contains_pairs(
    texts: DataFrame,
    needles: DataFrame,
    text_id: str,
    text: str,
    needle_id: str,
    needle: str,
    group: Sequence[str] = (),
) -> DataFrame:
    """Distinct (group, text_id, needle_id) where the text contains the needle.

    ``group`` columns must be equal on both sides.  Empty needles never match.
    """
    group = list(group)
    length = F.length(needle)
    tier = F.lit(TIERS[0])
    for t in TIERS[1:]:
        tier = F.when(length >= t, t).otherwise(tier)
    # read several times below
    wanted = materialize(needles.filter(length >= 1).select(*group, needle_id, F.col(needle).alias("__needle"), tier.alias("__tier")))
    distinct = wanted.select("__needle").distinct()
    size = distinct.agg(F.sum(F.length("__needle")).alias("chars")).first().chars
    if size is None:
        return texts.select(*group, text_id).join(wanted.select(needle_id), F.lit(False))
    if size <= AUTOMATON_CHARS:
        words = [r[0] for r in distinct.collect()]
        hits = texts.select(*group, text_id, F.explode(_found_needles(text, words)).alias("__needle"))
        return hits.join(wanted.select(*group, needle_id, "__needle"), [*group, "__needle"]).select(*group, text_id, needle_id).distinct()
    # at most one value per tier comes back: only the gram lengths in use are hashed
    used = sorted(r[0] for r in wanted.select("__tier").distinct().collect())
    plain = distinct.join(wanted.select("__needle", "__tier").distinct(), "__needle")
    ended = materialize(plain.mapInArrow(_with_ends(used), "__needle string, __tier int, __first bigint, __last bigint"))
    hashes = ended.select(F.explode(F.array("__first", "__last")).alias("h")).distinct()
    held = None
    if hashes.count() <= TASK_HASHES:
        held = np.sort(hashes.toArrow()["h"].to_numpy())
    keep = [*group, text_id]
    kinds = ", ".join(f"`{c}` {k}" for c, k in texts.select(*keep).dtypes)
    body = texts.select(*keep, F.col(text).alias("__text"))
    grams = materialize(body.mapInArrow(_text_hashes(used, held, keep, "__text", HASHED_CHARS), f"{kinds}, __hash bigint"))
    frequency = grams.groupBy("__hash").agg(F.count(F.lit(1)).alias("__df"))
    # an end that no text has rules a needle out
    rare = ended.join(frequency.select(F.col("__hash").alias("__first"), F.col("__df").alias("first_df")), "__first").join(
        frequency.select(F.col("__hash").alias("__last"), F.col("__df").alias("last_df")), "__last")
    probes = rare.select("__needle", F.when(F.col("first_df") <= F.col("last_df"), F.col("__first")).otherwise(F.col("__last")).alias("__hash"))
    # the planner judges stored hashes by their compressed files and would broadcast them: hence the hints
    if group:
        probes = probes.join(wanted.select(*group, "__needle").distinct(), "__needle")
    candidates = grams.hint("merge").join(probes, [*group, "__hash"]).select(*keep, "__needle")
    verified = candidates.hint("merge").join(body, keep).filter(F.contains(F.col("__text"), F.col("__needle"))).select(*keep, "__needle")
    return verified.join(wanted.select(*group, needle_id, "__needle"), [*group, "__needle"]).select(*keep, needle_id).distinct()
