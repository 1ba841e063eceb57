"""Values beside other numbers, told apart by hand and not by the operator's own patterns."""

import random

import pytest

from tracewell.llm import pii as P

KEY = "a key"


def luhn(digits):
    return sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(map(int, reversed(digits)))) % 10


def numbered(body):
    return body + str(-luhn(body + "0") % 10)


def cut(digits, sizes, mark):
    at = iter(digits)
    return mark.join("".join(next(at) for _ in range(n)) for n in sizes)


C16, C15, C14, C19 = numbered("411111111111234"), numbered("37828224631000"), numbered("3056930902590"), numbered("600011112222333340")
assert luhn(C19[:16])
#: Pieces of a text: {"value": True} marks what has to change, alone as beside others.
CASES = [
    [("2024-01-01", 1), (" ", 0), ("2024-01-02", 1)], [("2024-01-15", 1), (" ", 0), (cut(C16, [4] * 4, " "), 1)],
    [("item 3 ", 0), (cut(C16, [4] * 4, " "), 1)], [("12 ", 0), (C16, 1)], [(cut(C16, [4] * 4, " "), 1), (" 123", 0)],
    [("1234 ", 0), (cut(C16, [4] * 4, " "), 1), (" 5678 12", 0)], [("5-", 0), (cut(C16, [4] * 4, "-"), 1), ("-77", 0)],
    [(cut(C16, [4] * 4, " "), 1), (" ", 0), (cut(C15, [4, 6, 5], " "), 1), (" ", 0), ("10.0.0.1", 1)], [("7 ", 0), (cut(C14, [4, 6, 4], "-"), 1)],
    [(cut(C16, [4] * 4, " "), 1), (" ", 0), ("2024-01-15", 1), (" ", 0), ("01/02/2020", 1)], [(cut(C19, [4, 4, 4, 4, 3], " "), 1)],
    [("2019 2020 2021 2022 2023 2024", 0)], [(cut(C16, [2, 6, 8], "-"), 1)], [("31.12.1999", 1), ("-", 0), ("01.01.2001", 1)],
]


@pytest.fixture(scope="module")
def moved(spark):
    texts = ["".join(p for p, _ in case) for case in CASES]
    values = sorted({p for case in CASES for p, hit in case if hit})
    docs = spark.createDataFrame(list(enumerate(texts + values)), "doc_id long, text string")
    out = P.pseudonymised(docs, KEY).cache()
    got = {r.doc_id: r for r in out.collect()}
    back = {r.doc_id: r.text for r in P.pseudonymised(out.select("doc_id", "text"), KEY, restore=True).collect()}
    return texts, values, got, back


def test_neighbours_do_not_hide_values(moved):
    texts, values, got, back = moved
    alone = {v: got[len(texts) + i].text for i, v in enumerate(values)}
    assert all(v != p for v, p in alone.items())
    for i, case in enumerate(CASES):
        if case[0][0].startswith("1234 "):  # may be walked
            assert got[i].text.startswith("1234 ") and got[i].text.endswith(" 5678 12") and got[i].n_changed == 1
            continue
        assert got[i].text == "".join(alone[p] if hit else p for p, hit in case), case
        assert got[i].n_changed == sum(hit for _, hit in case)
    assert back == dict(enumerate(texts + values))


def test_rows_of_groups_go_back(spark):
    rng = random.Random(3)
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    texts = []
    for k in range(150):
        mark = " -"[k % 2]
        parts = [cut(numbered(number(15)), [4] * 4, mark) if rng.random() < 0.4 else number(4) for _ in range(rng.randrange(4, 9))]
        texts.append(mark.join(parts + [number(rng.randrange(1, 4))] * (k % 3 == 0)))
    out = P.pseudonymised(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), KEY)
    assert sum(r.n_changed for r in out.collect()) > 150
    back = P.pseudonymised(out.select("doc_id", "text"), KEY, restore=True)
    assert {r.doc_id: r.text for r in back.collect()} == dict(enumerate(texts))
