"""Conversation structure repair by edit distance over Four-Russians block tables.

The cheapest edits that turn a conversation's roles into ``(s?(ua)+)?`` follow
from one vector of costs per row: what completing the conversation costs from each
state of the pattern.  Only differences within a vector matter, and few
normalised vectors exist, so for every block of ``BLOCK`` rows (faults and
roles as symbols) the step from each vector to the next is a table entry.  A
conversation is gone through from its end, a lookup per block.  For the edits
themselves a block is expanded backward from the vector at its end, row by row,
and walked forward with the least letter of those that stay cheapest.

Rows go through two shuffles: their facts, to find repeats and edits, and
their texts, to be hashed in order.  Tasks read conversations as a stream: of the
first a byte a row is held, of the second one batch, so a conversation of any length
fits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from tracewell.llm.common import stored

#: Rows in a block; the table has SYMBOLS ** BLOCK entries for each normalised vector.
BLOCK = 3
#: What edits cost, and what an undeleted truncated row adds.
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
DELETE_LETTER, INSERT_LETTER, KEEP_LETTER, REROLE_LETTER = "DIKR"  # in ASCII order
#: States of the pattern: at the start, after the system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
#: The turn that each state goes on with, as state and as role.
NEXT = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: Initials of roles; every other initial has class 3.
INITIALS = "sua"
#: Symbols: 4 * truncated + class of the initial, a row that must go, and nothing (fills the last block).
GONE, NOTHING = 8, 9
SYMBOLS = 10
SPACES = " \t\n\x0b\x0c\r"
FAULTS = ("blank", "duplicate", "truncated")
_KEPT_AS = {(START, 0): SYSTEM} | {(s, c): NEXT[s] for s in range(STATES) for c in (1, 2) if NEXT[s] == (USER, ASSISTANT)[c - 1]}

Vector = tuple[int, ...]


def _with_inserts(costs: list[int]) -> Vector:
    for _ in range(3):
        costs = [min(c, INSERT + costs[NEXT[s]]) for s, c in enumerate(costs)]
    return tuple(costs)


#: Costs after the last row; only the start and an assistant's turn may end a conversation.
END = _with_inserts([0, 1 << 20, 1 << 20, 0])


def row_step(after: Vector, symbol: int) -> Vector:
    """Costs before a row, of the costs after it."""
    if symbol == NOTHING:
        return after
    costs = [DELETE + c for c in after]
    if symbol != GONE:
        truncated, initial = divmod(symbol, 4)
        for s in range(STATES):
            costs[s] = min(costs[s], TRUNCATED * truncated + REROLE + after[NEXT[s]])
            if (s, initial) in _KEPT_AS:
                costs[s] = min(costs[s], TRUNCATED * truncated + after[_KEPT_AS[s, initial]])
    return _with_inserts(costs)


def _normalised(costs: Vector) -> tuple[Vector, int]:
    least = min(costs)
    return tuple(c - least for c in costs), least


class BlockTables:
    """For every normalised vector and every block: the vector before the block and the cost added."""

    def __init__(self, block: int = BLOCK) -> None:
        self.block = block
        end, self.end_cost = _normalised(END)
        self.vectors, known = [end], {end: 0}
        rows = []
        for vector in self.vectors:  # grows as new vectors are met
            steps = []
            for symbol in range(SYMBOLS):
                before, cost = _normalised(row_step(vector, symbol))
                if before not in known:
                    known[before] = len(self.vectors)
                    self.vectors.append(before)
                steps.append((known[before], cost))
            rows.append(steps)
        one = np.array(rows)  # vector, symbol, (vector before, cost)
        to, cost = np.arange(len(rows))[:, None], np.zeros((len(rows), 1), dtype=int)
        for _ in range(block):  # a block's first symbol has the highest place and is applied last
            more = one[to]  # vector, block so far, symbol
            to = more[..., 0].transpose(0, 2, 1).reshape(len(rows), -1)
            cost = (cost[:, :, None] + more[..., 1]).transpose(0, 2, 1).reshape(len(rows), -1)
        self.to, self.cost = to.tolist(), cost.tolist()
        self.one = one[..., 0].tolist()
        self.expanded: dict[tuple[int, int, int], tuple[str, int]] = {}

    def blocks(self, symbols: np.ndarray) -> list[int]:
        """Numbers of the blocks of a conversation."""
        filled = np.full(-(-len(symbols) // self.block) * self.block, NOTHING)
        filled[: len(symbols)] = symbols
        return (filled.reshape(-1, self.block) @ SYMBOLS ** np.arange(self.block)[::-1]).tolist()

    def expand(self, after: int, number: int, state: int) -> tuple[str, int]:
        """Letters and last state of a block, of the vector after it and the state before it."""
        key = (after, number, state)
        if key not in self.expanded:
            symbols = [number // SYMBOLS**i % SYMBOLS for i in range(self.block)][::-1]
            behind = [self.vectors[after]]
            for symbol in reversed(symbols):  # not normalised: costs of one block compare with each other
                behind.append(row_step(behind[-1], symbol))
            self.expanded[key] = _walk(symbols, behind[::-1], state)
        return self.expanded[key]

    def repair(self, symbols: np.ndarray) -> tuple[int, str]:
        """Cost and letters of the cheapest edits, of equally cheap ones the ASCII-least."""
        numbers, at, cost, after = self.blocks(symbols), 0, self.end_cost, []
        for number in reversed(numbers):
            after.append(at)
            cost += self.cost[at][number]
            at = self.to[at][number]
        cost += self.vectors[at][START]
        letters, state = [], START
        for number, behind in zip(numbers, reversed(after)):
            piece, state = self.expand(behind, number, state)
            letters.append(piece)
        letters.append(_walk([], [END], state)[0])
        return cost, "".join(letters)


def _walk(symbols: list[int], costs: list[Vector], state: int) -> tuple[str, int]:
    """Letters from ``state`` over rows with the costs before each and after the last, and the state reached.

    Inserts before a row that is filled in wait for the next block.
    """
    letters = []
    for symbol, before, after in zip(symbols, costs, costs[1:]):
        if symbol == NOTHING:
            break
        while True:
            truncated, initial = divmod(symbol, 4) if symbol != GONE else (0, None)
            left, extra = before[state], TRUNCATED * truncated
            if left == DELETE + after[state]:
                letters.append(DELETE_LETTER)
                break
            if left == INSERT + before[NEXT[state]]:
                letters.append(INSERT_LETTER)
                state = NEXT[state]
                continue
            kept = _KEPT_AS.get((state, initial))
            if kept is not None and left == extra + after[kept]:
                letters.append(KEEP_LETTER)
                state = kept
            else:
                letters.append(REROLE_LETTER)
                state = NEXT[state]
            break
    if not symbols:
        while costs[0][state]:
            letters.append(INSERT_LETTER)
            state = NEXT[state]
    return "".join(letters), state


def _filled(column: str) -> Column:
    """A null is one space."""
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after damage: conv_id, turn, role, text, copies (2 where the row is repeated adjacently)."""
    chance = F.pmod(F.crc32(F.concat_ws(":", _filled("conv_id"), _filled("turn")).cast("binary")), F.lit(20))
    rows = conversations.select("conv_id", "turn", _filled("role").alias("role"), _filled("text").alias("text"), chance.alias("chance"))
    text = F.when(F.col("chance") == 1, "").when(F.col("chance") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.filter("chance <> 0").select(
        "conv_id", "turn", F.when(F.col("chance") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"), F.when(F.col("chance") == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def _facts(rows: DataFrame) -> DataFrame:
    """A row for each conversation, turn, role and text: initial, fault of its first copy, number of copies, and the order's columns."""
    digest = F.sha2("text", 256)
    last = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1))
    initial = F.lit(len(INITIALS))
    for n, letter in enumerate(INITIALS):
        initial = F.when(F.col("role").startswith(letter), n).otherwise(initial)
    each = rows.groupBy("conv_id", "turn", "role", digest.alias("digest")).agg(
        F.sum("copies").alias("copies"),
        F.first(F.when(last == "", 0).when(~last.isin(".", "!", "?"), 2).otherwise(3).cast("int")).alias("fault"),
        F.first(initial.cast("int")).alias("initial"),
    )
    place = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    seen = each.groupBy(F.col("conv_id").alias("of"), F.col("role").alias("as"), F.col("digest").alias("said")).agg(F.min(place).alias("first"))
    same = each["conv_id"].eqNullSafe(seen["of"]) & (each["role"] == seen["as"]) & (each["digest"] == seen["said"])
    repeated = (F.col("fault") != 0) & ~place.eqNullSafe(F.col("first"))
    return each.join(seen, same).select(
        "conv_id", "turn", "role", "digest", "copies", "initial", F.when(repeated, 1).otherwise(F.col("fault")).cast("int").alias("fault"))


def _found_schema(ids: T.DataType) -> T.StructType:
    counts = ("gaps", *FAULTS, "illegal", "cost")
    return T.StructType([T.StructField("conv_id", ids), *(T.StructField(c, T.LongType()) for c in counts), T.StructField("audit", T.StringType())])


class _Conversation:
    """What is known of a conversation while its rows come in order: a byte a row, and counts."""

    def __init__(self) -> None:
        self.codes, self.turns, self.distinct, self.low, self.high = bytearray(), None, 0, None, None

    def add(self, turn: int | None, code: int, repeat: int, copies: int) -> None:
        self.codes.append(code)
        if copies > 1:
            self.codes.extend(bytes([repeat]) * (copies - 1))
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.distinct, self.high = self.distinct + 1, turn

    def row(self, tables: BlockTables) -> tuple:
        codes = np.frombuffer(bytes(self.codes), dtype=np.uint8).astype(int)
        initial, fault = codes & 3, codes >> 2
        pair = initial[:-1] * 4 + initial[1:]
        legal = (pair == 1) | (pair == 6) | (pair == 9)  # su, ua, au
        symbols = np.where(fault < 2, GONE, initial + 4 * (fault == 2))
        cost, audit = tables.repair(symbols)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return (gaps, *(int((fault == f).sum()) for f in range(3)), int((~legal).sum()), cost, audit)


def _edits(facts: DataFrame, block: int) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation with rows."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, current, held, out = BlockTables(block), None, _Conversation(), []
        for batch in batches:
            ids, turns, copies, initials, faults = (batch.column(i).to_pylist() for i in range(5))
            for conv_id, turn, n, initial, fault in zip(ids, turns, copies, initials, faults):
                if held.codes and conv_id != current:
                    out.append((current, *held.row(tables)))
                    held = _Conversation()
                current = conv_id
                held.add(turn, initial + 4 * fault, initial + 4 * min(fault, 1), n)
            if len(out) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
                out = []
        if held.codes:
            out.append((current, *held.row(tables)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    found = _found_schema(facts.schema["conv_id"].dataType)
    schema = to_arrow_schema(found)
    ordered = facts.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "digest")
    return ordered.select("conv_id", "turn", "copies", "initial", "fault").mapInArrow(scan, found)


def _hashes(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): the edits of each conversation come before its rows and are applied as these pass."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, open_ = None, None, False
        out_ids, out_hashes = [], []

        def close() -> None:
            if open_:
                state.finish()
                out_ids.append(current)
                out_hashes.append(state.sha.hexdigest())

        for batch in batches:
            for conv_id, audit, role, text, copies in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if audit is not None:
                    close()
                    current, state, open_ = conv_id, _Repair(audit), True
                else:
                    for _ in range(copies):
                        state.row(role, text)
            if len(out_ids) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(out_ids, ids), pa.array(out_hashes)], names=["conv_id", "repaired_sha256"])
                out_ids, out_hashes = [], []
        close()
        if out_ids:
            yield pa.RecordBatch.from_arrays([pa.array(out_ids, ids), pa.array(out_hashes)], names=["conv_id", "repaired_sha256"])

    kind = rows.schema["conv_id"].dataType
    ids = to_arrow_type(kind)
    none = F.lit(None).cast("string")
    heads = edits.select("conv_id", "audit", F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), none.alias("role"), none.alias("text"), F.lit(0).cast("long").alias("copies"))
    body = rows.select("conv_id", none.alias("audit"), "turn", "role", "text", "copies")
    ordered = heads.unionByName(body).repartition("conv_id").sortWithinPartitions(
        "conv_id", F.desc_nulls_last("audit"), F.asc_nulls_first("turn"), "role", F.sha2("text", 256))
    schema = T.StructType([T.StructField("conv_id", kind), T.StructField("repaired_sha256", T.StringType())])
    return ordered.select("conv_id", "audit", "role", "text", "copies").mapInArrow(scan, schema)


class _Repair:
    """Applies letters to rows as they come and hashes the repaired conversation."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state, self.sha, self.first = audit, 0, START, hashlib.sha256(), True

    def _write(self, role: str, text: str) -> None:
        self.sha.update(f"{'' if self.first else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
        self.first = False

    def _inserts(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == INSERT_LETTER:
            self.state = NEXT[self.state]
            self._write(ROLES[self.state], "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self._inserts()
        letter = self.audit[self.at]
        self.at += 1
        if letter == KEEP_LETTER:
            self.state = SYSTEM if role[0] == INITIALS[0] else NEXT[self.state]
            self._write(role, text)
        elif letter == REROLE_LETTER:
            self.state = NEXT[self.state]
            self._write(ROLES[self.state], text)

    def finish(self) -> None:
        self._inserts()


def repair_report(conversations: DataFrame, rows: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Needs ``conv_id``, ``turn``, ``role`` and ``text``; other columns, whatever
    their names, are left out.  ``rows`` are the rows to be repaired (as of
    ``damaged``, which is the default), ``conversations`` says which
    conversations are reported, also those without rows.  A null role or text is
    one space; rows without conv_id are one conversation; rows without turn come
    first.  Rows of one turn are ordered by role and hash of the text; rows equal in
    all four columns are repeats of the first and count each.  Texts of any length
    are read whole.  An empty table gives an empty result.

    The audit and the hash are one value per conversation, so one task goes
    through a conversation's rows; it streams them and holds a byte a row.
    """
    rows = damaged(conversations) if rows is None else rows
    edits = _edits(_facts(rows), block)
    edits = stored(edits, "conversation-edits")
    hashes = _hashes(rows, edits)
    named = lambda df, name: df.withColumnRenamed("conv_id", name)
    found = named(edits, "of").join(named(hashes, "for"), F.col("of").eqNullSafe(F.col("for"))).drop("for")
    every = conversations.select("conv_id").distinct()
    joined = every.join(found, F.col("conv_id").eqNullSafe(F.col("of")), "left")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", *FAULTS, "illegal", "cost")]
    return joined.select(
        "conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def oracle() -> str:
    """SQL for ``repair_report`` over ``conversations``: a recursion over rows with the best edits that reach each state.

    DuckDB has no crc32; it is computed byte by byte from its polynomial.
    """
    after = {INITIALS[0]: {START: SYSTEM}, INITIALS[1]: {s: USER for s in (START, SYSTEM, ASSISTANT)}, INITIALS[2]: {USER: ASSISTANT}}
    none = "NULL::STRUCT(c BIGINT, e VARCHAR, o VARCHAR)"

    def step(state: str, cost: int | str, letter: str, text: str) -> str:
        said = f"{state}.o || {text}" if text else f"{state}.o"
        return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'e': {state}.e || '{letter}', 'o': {said}}} END"

    def best(options: list[str]) -> str:
        return f"list_min(list_filter([{', '.join(options)}], lambda z: z IS NOT NULL))"

    def inserted(states: list[str]) -> list[str]:
        """The states with inserts allowed; a user turn may follow the first three, an assistant turn a user turn."""
        into = {s: [p for p in range(STATES) if NEXT[p] == s] for s in (USER, ASSISTANT)}
        return [
            best([states[s], *[step(states[p], INSERT, INSERT_LETTER, f"'{ROLES[s]}:' || chr(10)") for p in into[s]]]) if s in into else states[s]
            for s in range(STATES)
        ]

    names = [f"s{i}" for i in range(STATES)]
    taken = []
    for s in range(STATES):
        options = [step(f"s{s}", DELETE, DELETE_LETTER, "")]
        for letter, moves in after.items():
            for p, to in moves.items():
                if to == s:
                    kept = step(f"s{p}", f"{TRUNCATED} * bad", KEEP_LETTER, "role || ':' || text || chr(10)")
                    options.append(f"CASE WHEN fault NOT IN ('blank', 'duplicate') AND left(role, 1) = '{letter}' THEN {kept} END")
        for p in range(STATES):
            if NEXT[p] == s:
                put = step(f"s{p}", f"{REROLE} + {TRUNCATED} * bad", REROLE_LETTER, f"'{ROLES[s]}:' || text || chr(10)")
                options.append(f"CASE WHEN fault NOT IN ('blank', 'duplicate') THEN {put} END")
        taken.append(best(options))
    level = lambda cols: ", ".join(f"{c} AS {n}" for c, n in zip(cols, names))
    first = [f"{{'c': 0::BIGINT, 'e': '', 'o': ''}}::STRUCT(c BIGINT, e VARCHAR, o VARCHAR)", none, none, none]
    inserts = f"SELECT conv, i, {level(inserted(names))} FROM"
    return rf"""WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, CAST(b AS BIGINT))) AS t),
  k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
  h AS (SELECT k.*, xor(list_reduce(range(1, length(key) + 1), lambda x, p: xor(x >> 8, t[(xor(x, ascii(key[p])) & 255) + 1]), 4294967295), 4294967295) % 20 AS chance FROM k, crc),
  d AS (SELECT conv_id AS conv, turn, CASE chance WHEN 4 THEN 'user' ELSE role END AS role, CASE chance WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE chance WHEN 3 THEN 2 ELSE 1 END)) FROM h WHERE chance <> 0),
  n AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, sha256(text)) AS i, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last FROM d),
  f AS (SELECT *, CASE WHEN last = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv ORDER BY i) AS before FROM n),
  g AS (SELECT *, CASE fault WHEN 'truncated' THEN 1 ELSE 0 END AS bad, max(i) OVER (PARTITION BY conv) AS total FROM f),
  r AS ({inserts} (SELECT conv, 0::BIGINT AS i, {level(first)} FROM (SELECT DISTINCT conv FROM g))
    UNION ALL {inserts} ({inserts} (SELECT r.conv, g.i, {level(taken)} FROM r JOIN g ON g.conv IS NOT DISTINCT FROM r.conv AND g.i = r.i + 1))),
  b AS (SELECT r.conv, {best(["s0", "s3"])} AS best FROM r JOIN (SELECT conv, max(total) AS total FROM g GROUP BY conv) m ON m.conv IS NOT DISTINCT FROM r.conv AND r.i = total),
  c AS (SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY conv)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(best.c, 0) AS cost, coalesce(best.e, '') AS audit, sha256(coalesce(left(best.o, length(best.o) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN c ON c.conv IS NOT DISTINCT FROM conv_id LEFT JOIN b ON b.conv IS NOT DISTINCT FROM conv_id"""
