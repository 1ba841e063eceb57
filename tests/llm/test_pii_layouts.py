"""Layouts of phone numbers and dates: found, linked, turned back; numbers beside others stay whole."""

import random
import re

import pytest

from tracewell.llm import pii as P

KEY = "a key"
NATIONAL = ["+1 (555) 123-4567", "+1-555-123-4567", "+1 555 123 4567", "(555) 123-4567", "555-123-4567", "555.123.4567", "1-555-123-4567", "+15551234567"]


def moved(spark, rows, restore=False):
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id int, text string")
    return [tuple(r)[1:] for r in P.pseudonymised(docs, KEY, restore).orderBy("doc_id").collect()]


def digits(text):
    return re.sub("[^0-9]", "", text)


def test_one_number_in_every_layout(spark):
    out = moved(spark, [f"Call {n}, now." for n in NATIONAL])
    assert all(counts == (1, 1) for _, *counts in [(t, f, c) for t, f, c in out] for counts in [tuple(counts)])
    assert len({digits(t)[-10:] for t, _, _ in out}) == 1
    assert digits(out[0][0])[-10:] != "5551234567"
    for before, (after, _, _) in zip(NATIONAL, out):
        assert re.sub("[0-9]", "#", f"Call {before}, now.") == re.sub("[0-9]", "#", after)
    assert [t for t, _, _ in moved(spark, [t for t, _, _ in out], True)] == [f"Call {n}, now." for n in NATIONAL]


def test_numbers_abroad_keep_their_country(spark):
    rows = ["+49 30 1234567", "+49301234567", "+49-30-1234567", "+44 20 7946 0958"]
    out = [t for t, found, changed in moved(spark, rows) if (found, changed) == (1, 1)]
    assert len(out) == 4 and len({digits(t) for t in out[:3]}) == 1
    assert all(t.startswith("+49") for t in out[:3]) and out[3].startswith("+44 ")
    assert out[0] != rows[0] and [t for t, _, _ in moved(spark, out, True)] == rows


@pytest.mark.parametrize("text", ["555-123-456", "version 1.555.123", "12 555-123-4567 9", "+1 555 1234", "+49 12", "x555-123-4567", "31/31/2024", "2024/13/01"])
def test_what_is_no_number_stays(spark, text):
    assert moved(spark, [text])[0][0] == text


def test_dates_by_slashes(spark):
    rows = [f"{d:02}/{m:02}/{y}" for y in (1901, 1999, 2024) for m in (1, 4, 12) for d in (13, 22, 30)] + ["2024/12/31", "12/31/2024", "2024-12-31"]
    out = [t for t, _, _ in moved(spark, rows)]
    assert all(a != b for a, b in zip(rows, out)) and len(set(out)) == len(out)
    assert all(int(t[:2]) > 12 for t in out[:-3])
    assert out[-3].replace("/", "-") == out[-1] and out[-2] == "/".join((out[-1][5:7], out[-1][8:], out[-1][:4]))
    assert [t for t, _, _ in moved(spark, out, True)] == rows


def test_mixed_text_goes_back(spark):
    rng = random.Random(4)
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    make = [
        lambda: f"({n(3)}) {n(3)}-{n(4)}", lambda: f"{n(3)}-{n(3)}-{n(4)}", lambda: f"+1{n(10)}", lambda: f"+4{n(1)} {n(2)} {n(7)}", lambda: f"+{n(9)}",
        lambda: " ".join((n(4), n(4), n(4), n(4))), lambda: n(16), lambda: f"{n(4)}/{rng.randrange(1, 13):02}/{rng.randrange(1, 30):02}",
        lambda: f"{rng.randrange(1, 32):02}/{rng.randrange(1, 13):02}/20{n(2)}", lambda: f"{n(2)}.{n(2)}.{n(2)}.{n(2)}", lambda: n(3), lambda: "word", lambda: "(",
    ]
    rows = ["".join(rng.choice(make)() + rng.choice([" ", ", ", "-", ".", "\n", " (", ") "]) for _ in range(rng.randrange(1, 8))) for _ in range(1500)]
    out = [t for t, _, _ in moved(spark, rows)]
    back = [t for t, _, _ in moved(spark, out, True)]
    wrong = [(a, b, c) for a, b, c in zip(rows, out, back) if a != c]
    assert not wrong, (len(wrong), wrong[:3])
