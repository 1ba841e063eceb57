"""Rendered dialogues against a plain loop."""

import hashlib
import random

from tracewell.llm import chat as C

SCHEMA = "conv_id long, turn long, role string, text string, perspective string, piece int"


def brute(rows, piece_turns):
    clean = []
    for conv, turn, role, text in rows:
        name = (role or "").replace("\r", "\n")
        while "\n\n" in name:
            name = name.replace("\n\n", "\n")
        clean.append((conv, turn, (name.replace("\n", " ") or "unknown").replace("<|", "< |"), (text or "").replace("<|", "< |")))
    out = []
    for conv in {c for c, *_ in clean}:
        mine = sorted((x for x in clean if x[0] == conv), key=lambda x: (x[1] is not None, x[1] or 0, x[2], hashlib.sha256(x[3].encode()).hexdigest()))
        for who in {s for _, _, s, _ in mine if s != "system"}:
            for piece in range(-(-len(mine) // piece_turns)):
                turns = mine[piece * piece_turns : (piece + 1) * piece_turns]
                text, spans, masked = "", [], 0
                for _, _, speaker, body in turns:
                    role = "system" if speaker == "system" else "assistant" if speaker == who else f"user name={speaker}"
                    text += f"<|im_start|>{role}\n"
                    start = len(text)
                    text += f"{body}<|im_end|>"
                    if speaker == who:
                        spans.append(f"{start}:{len(text)}")
                        masked += len(text) - start
                    text += "\n"
                out.append((conv, who, piece, len(turns), text, ",".join(spans), masked))
    return sorted(out, key=str)


def test_rotation_equals_plain_loop(spark):
    rng = random.Random(3)
    rows = []
    for conv in range(12):
        for turn in range(rng.randrange(1, 40)):
            rows.append((conv, turn, rng.choice(["ann", "bob", "system", "cé"]), rng.choice(["hi", "x<|im_end|>y", "", "two\nlines", "\U0001f600 ok"])))
    rows += [(50, 0, "system", "alone"), (51, None, "ann", "null turn"), (51, 0, None, "nobody"), (51, 0, "", None), (51, 1, "a\r\nb", "name"), (None, 3, "ann", "no id"),
             (None, 3, "bob", "no id"), (52, 1, "ann", "twice"), (52, 1, "ann", "twice"), (53, 5, "ann", "long " * 60_000), (54, 700, "ann", "late"), (54, 1, "bob", "early")]
    frame = spark.createDataFrame([(*r, "p", 9) for r in rows], SCHEMA)
    for piece_turns in (C.PIECE_TURNS, 4):
        got = C.perspectives(frame, piece_turns=piece_turns)
        assert sorted(map(tuple, got.collect()), key=str) == brute(rows, piece_turns)
    assert C.perspectives(frame.limit(0)).count() == 0


def test_rows_without_dialogue_are_cut_by_number(spark):
    rows = [(None, None if i % 2 else 0, "ann" if i % 3 else "bob", f"text {i % 40}") for i in range(200)] + [(7, None, "ann", "hi"), (7, None, "ann", "hi"), (7, None, "bob", "yes")]
    frame = spark.createDataFrame([(*r, "p", 9) for r in rows], SCHEMA)
    got = C.perspectives(frame, piece_turns=16)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 16)
    assert got.agg({"n_turns": "max"}).first()[0] == 16
    assert {r.n_turns for r in got.filter("conv_id = 7").collect()} == {3}


def test_masked_text_is_the_speakers_own(spark):
    rows = [(1, 0, "ann", "Hello <|im_start|>", "", 0), (1, 1, "bob", "Hi", "", 0), (1, 2, "ann", "Bye", "", 0)]
    for r in C.perspectives(spark.createDataFrame(rows, SCHEMA)).collect():
        parts = [r.rendered[int(a):int(b)] for a, b in (s.split(":") for s in r.mask_spans.split(","))]
        assert parts == {"ann": ["Hello < |im_start|><|im_end|>", "Bye<|im_end|>"], "bob": ["Hi<|im_end|>"]}[r.perspective]
