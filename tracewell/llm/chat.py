"""Multi-party perspective rotation of dialogues.

For every participant the dialogue is rendered with that speaker as assistant
and all others as named users; the mask marks the characters a model learns
from: the assistant's own words and the marker that ends them.

A dialogue is cut into pieces of ``piece_turns`` rows, so the rows that must be
together are bounded however long a dialogue grows and whatever its turn numbers.  Rows are numbered
over ranges of dialogue and turn, so a hot dialogue, or all rows without
dialogue, are dealt to many tasks.  Only built-in functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import plain_text
from tracewell.plans.ordinal import with_ordinal

PIECE_TURNS = 64
SYSTEM = "system"
UNKNOWN = "unknown"
#: The turn markers.
START, END = "<|im_start|>", "<|im_end|>"


def _escaped(column: Column) -> Column:
    """No text can open or close a turn: a marker's opening is broken by a space."""
    return F.replace(column, F.lit("<|"), F.lit("< |"))


def _header(speaker: Column, perspective: Column) -> Column:
    named = F.concat(F.lit(f"{START}user name="), speaker, F.lit("\n"))
    return (
        F.when(speaker == SYSTEM, F.lit(f"{START}system\n")).when(speaker == perspective, F.lit(f"{START}assistant\n")).otherwise(named)
    )


def perspectives(turns: DataFrame, speaker: str = "role", piece_turns: int = PIECE_TURNS) -> DataFrame:
    """One row per dialogue piece and participant.

    Columns: conv_id, perspective, piece, n_turns, rendered, mask_spans
    (start:end in characters, end exclusive, comma-joined), n_masked.
    Needs ``conv_id``, ``turn``, ``text`` and the speaker column.  System turns
    are rendered for everyone and are no participant; a dialogue of system
    turns alone gives no row.  A null text is empty, a null or empty speaker is
    'unknown', a null turn counts as the first (before all others); rows without conv_id form one dialogue.
    Turns of one number are ordered by speaker, then hash of the text; every row is a turn, also where rows
    are equal.  Names and texts cannot contain turn markers.  Texts of any length are rendered whole; columns of
    other names are not looked at.  An empty table gives no row.
    """
    name = F.regexp_replace(F.coalesce(F.col(speaker), F.lit("")), r"[\r\n]+", " ")
    clean = turns.select(
        "conv_id", F.col("turn").cast("long").alias("turn"),
        _escaped(F.when(name == "", UNKNOWN).otherwise(name)).alias("speaker"), _escaped(plain_text()).alias("text"),
    )
    order = [F.col("conv_id"), F.asc_nulls_first("turn"), F.col("speaker"), F.sha2("text", 256)]
    numbered = with_ordinal(clean, order, "nth")
    starts = numbered.groupBy(F.col("conv_id").alias("within")).agg(F.min("nth").alias("start"))
    placed = numbered.join(starts, numbered["conv_id"].eqNullSafe(starts["within"]))
    piece = F.floor((F.col("nth") - F.col("start")) / piece_turns).cast("long")
    pieces = (
        placed.groupBy("conv_id", piece.alias("piece"))
        .agg(F.sort_array(F.collect_list(F.struct("nth", "speaker", "text"))).alias("turns"))
    )
    speakers = clean.filter(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("of"), F.col("speaker").alias("perspective")).distinct()
    views = pieces.join(speakers, pieces["conv_id"].eqNullSafe(speakers["of"])).drop("of")

    parts = F.transform(
        "turns",
        lambda t: F.struct(
            _header(t["speaker"], F.col("perspective")).alias("head"), t["text"].alias("body"),
            (t["speaker"] == F.col("perspective")).alias("own"),
        ),
    )
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("masked"), F.array().cast("array<string>").alias("spans"))

    def placed(state: Column, part: Column) -> Column:
        body = state["at"] + F.length(part["head"])
        end = body + F.length(part["body"]) + len(END)
        span = F.array(F.concat(body.cast("string"), F.lit(":"), end.cast("string")))
        return F.struct(
            (end + 1).alias("at"), (state["masked"] + F.when(part["own"], end - body).otherwise(0)).alias("masked"),
            F.when(part["own"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"),
        )

    laid = views.withColumn("parts", parts).withColumn("mask", F.aggregate("parts", start, placed))
    return laid.select(
        "conv_id", "perspective", "piece", F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(f"{END}\n"))), "").alias("rendered"),
        F.array_join("mask.spans", ",").alias("mask_spans"), F.col("mask.masked").cast("long").alias("n_masked"),
    )


def oracle(piece_turns: int = PIECE_TURNS) -> str:
    """SQL for ``perspectives`` over ``conversations``."""
    order = "turn NULLS FIRST, speaker, sha256(text)"
    return rf"""WITH n AS (SELECT conv_id, turn, replace(CASE WHEN regexp_replace(coalesce(role, ''), '[\r\n]+', ' ', 'g') = '' THEN '{UNKNOWN}'
    ELSE regexp_replace(role, '[\r\n]+', ' ', 'g') END, '<|', '< |') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations),
  c AS (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY {order}) - 1) AS nth FROM n),
  p AS (SELECT DISTINCT conv_id AS of, speaker AS perspective FROM c WHERE speaker <> '{SYSTEM}'),
  v AS (SELECT *, nth // {piece_turns} AS piece, speaker = perspective AS own, CASE WHEN speaker = '{SYSTEM}' THEN '{START}system' WHEN speaker = perspective
      THEN '{START}assistant' ELSE '{START}user name=' || speaker END || chr(10) AS head FROM c JOIN p ON conv_id IS NOT DISTINCT FROM of),
  l AS (SELECT *, length(head) + length(text) + {len(END) + 1} AS size, sum(length(head) + length(text) + {len(END) + 1}) OVER (PARTITION BY conv_id, perspective, piece
      ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM v)
SELECT conv_id, perspective, piece, count(*) AS n_turns,
  string_agg(head || text || '{END}' || chr(10), '' ORDER BY nth) AS rendered,
  coalesce(string_agg((upto - size + length(head)) || ':' || (upto - 1), ',' ORDER BY nth) FILTER (WHERE own), '') AS mask_spans,
  CAST(coalesce(sum(length(text) + {len(END)}) FILTER (WHERE own), 0) AS BIGINT) AS n_masked
FROM l GROUP BY conv_id, perspective, piece"""
