"""Pseudonyms against a plain Feistel network, and the way back."""

import datetime
import hashlib
import random
import re

from pyspark.sql import functions as F

from tracewell.llm import pii as P

KEY = "a key"
SCHEMA = "doc_id long, text string, found string, moved string"


def plain_feistel(a, b, size_a, size_b, kind):
    for i in range(8):
        f = int(hashlib.sha256(f"{KEY}|{kind}|{i}|{b}".encode()).hexdigest()[:15], 16)
        a, b = b, (a + f) % (size_b if i % 2 else size_a)
    return a, b


def luhn(digits):
    return sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(map(int, reversed(digits)))) % 10


def digits_moved(digits, kind):
    u = len(digits) // 2
    a, b = plain_feistel(int(digits[:u]), int(digits[u:]), 10**u, 10 ** (len(digits) - u), kind)
    return str(a).zfill(u) + str(b).zfill(len(digits) - u)


def plain(value):
    digits = re.sub("[^0-9]", "", value)
    fill = lambda new: "".join(it) if (it := [next(src) if c.isdigit() else c for src in [iter(new)] for c in value]) else ""
    if value.startswith("+1"):
        return fill("1" + digits_moved(digits[1:], "phone"))
    if re.fullmatch(P.IPV4, value):
        p = list(map(int, value.split(".")))
        if max(p) > 255:
            return value
        a, b = plain_feistel(p[0] * 256 + p[1], p[2] * 256 + p[3], 65536, 65536, "ipv4")
        return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"
    for shape, form in ((P.DATE_ISO, "%Y-%m-%d"), (P.DATE_DOTS, "%d.%m.%Y"), (P.DATE_SLASHES, "%m/%d/%Y")):
        if re.fullmatch(shape, value):
            try:
                days = (datetime.datetime.strptime(value, form).date() - datetime.date(1900, 1, 1)).days
            except ValueError:
                return value
            if not 0 <= days < 72900:
                return value
            a, b = plain_feistel(days // 270, days % 270, 270, 270, "date")
            return (datetime.date(1900, 1, 1) + datetime.timedelta(a * 270 + b)).strftime(form)
    if luhn(digits):
        return value
    body = digits_moved(digits[:-1], f"card{len(digits)}")
    return fill(body + str(-luhn(body + "0") % 10))


def numbered(body):
    return body + str(-luhn(body + "0") % 10)


def texts():
    rng = random.Random(7)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    spaced = lambda d: " ".join(d[i : i + 4] for i in range(0, len(d), 4))
    make = [
        lambda: numbered(digits(rng.randrange(12, 19))), lambda: spaced(numbered(digits(15))), lambda: digits(16), lambda: digits(25),
        lambda: f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", lambda: ".".join(str(rng.randrange(300)) for _ in range(4)),
        lambda: f"{rng.randrange(1850, 2150)}-{rng.randrange(1, 14):02}-{rng.randrange(1, 32):02}", lambda: f"{rng.randrange(1, 32):02}.{rng.randrange(1, 13):02}.{rng.randrange(1950, 2050)}",
        lambda: f"{rng.randrange(1, 13):02}/{rng.randrange(1, 32):02}/1999", lambda: "x" + digits(16), lambda: "word", lambda: "é",
    ]
    return ["".join(rng.choice(make)() + rng.choice([" ", ", ", "\n", " é "]) for _ in range(rng.randrange(12))) for _ in range(150)]


def test_rewriting_equals_plain_network_and_goes_back(spark):
    rows = list(enumerate(texts())) + [(900, None), (901, ""), (902, "1"), (903, "8.8.8.8"), (903, "8.8.8.8"), (None, "2020-02-30 2020-02-29"), (904, "pad " * 60_000 + numbered("4" * 15))]
    docs = spark.createDataFrame([(i, t, "a", "b") for i, t in rows], SCHEMA)
    out = P.pseudonymised(docs, KEY)
    want = sorted(((i, t if t is None else re.sub(P.VALUE, lambda m: plain(m[0]), t)) for i, t in rows), key=str)
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == want
    back = P.pseudonymised(out.select("doc_id", "text"), KEY, restore=True)
    assert sorted(((r.doc_id, r.text) for r in back.collect()), key=str) == sorted(rows, key=str)
    for r in out.collect():
        found = re.findall(P.VALUE, dict(rows).get(r.doc_id) or "") if r.doc_id not in (903, None) else None
        assert found is None or (r.n_found == len(found) and r.n_changed == sum(plain(v) != v for v in found))
    assert P.pseudonymised(docs.limit(0), KEY).count() == 0


def test_equal_values_stay_linked_and_formats_hold(spark):
    card = numbered("492934838514630")
    spaced = " ".join(card[i : i + 4] for i in range(0, 16, 4))
    docs = spark.createDataFrame([(1, f"a {card} b"), (2, f"c {spaced}"), (3, card)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in P.pseudonymised(docs, KEY).collect()}
    assert got[1] == f"a {got[3]} b" and got[2].replace(" ", "") == "c" + got[3]
    assert luhn(got[3]) == 0 and got[3] != card
    assert {r.text for r in P.pseudonymised(docs, "other").collect()}.isdisjoint(got.values())


def test_dates_are_permuted(spark):
    days = spark.range(0, 72900, 9).select(F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("v"))
    assert days.select(P.pseudonym(F.col("v"), KEY).alias("p")).distinct().count() == 8100


def test_main_path_has_no_python(spark):
    docs = spark.createDataFrame(texts()[:1], "string").select(F.lit(1).alias("doc_id"), F.col("value").alias("text"))
    assert "Python" not in P.pseudonymised(docs, KEY)._jdf.queryExecution().executedPlan().toString()
