"""Base spans and entropies against plain restatements."""

import hashlib
import math
import random
import re
from collections import Counter

from tracewell.llm import secret_scan as S


def plain_base(text):
    letters = lambda w: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
    words = "|".join([*map(letters, ("password", "passwd", "secret", "token")), letters("api") + "_?" + letters("key")])
    assign = rf"""({words})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    spans = [(m.start(), 0, m.end()) for m in re.finditer(assign, text) if len(m[2]) >= 12]
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(spans)


def samples():
    rng = random.Random(9)
    pieces = ["password=", "Token: ", "api_key'='", "APIKEY = \"", "secret:", "ſecret=", "passwd", "AKIA", "AKIAAKIA", "0123456789abcdef", "é", "\U0001f600", " ", "\n", "==",
              "Zx9Qw7Er5Ty3Ui1OpA8s", "deadbeefdeadbeef", "EXAMPLEKEY1234567890abcd", "a", "B7", "550e8400-e29b-41d4-a716-446655440000", "tokens"]
    return ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 14))) for _ in range(400)] + ["token=secret: abcdefghijklmnop", "token==abcdefghijkl"]


def test_scan_equals_plain_search(spark):
    rows = list(enumerate(samples())) + [(900, None), (901, ""), (902, "f" * 300_000), (903, "token=" + "Ab1" * 50_000), (903, "x"), (None, "AKIA" + "Z" * 14)]
    docs = spark.createDataFrame([(i, t, 1, "s") for i, t in rows], "doc_id long, text string, n_hex int, spans string")
    got = S.secrets(docs).collect()
    want = []
    for doc_id, text in rows:
        spans = plain_base(text or "")
        joined = ",".join(f"{S.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        counts = Counter(k for _, k, _ in spans)
        want.append((doc_id, counts[0], counts[1], counts[2], hashlib.sha256(joined.encode()).hexdigest()))
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    for r in got:  # base spans stay among all spans
        base = [x for x in r.spans.split(",") if x and not x.startswith("entropy")]
        assert hashlib.sha256(",".join(base).encode()).hexdigest() == r.base_sha256
    assert S.secrets(docs.limit(0)).count() == 0


def entropy(window):
    return -sum(n / len(window) * math.log2(n / len(window)) for n in Counter(window).values())


def test_incremental_entropy_equals_direct():
    rng = random.Random(2)
    for size in (5, 20, 21, 300):
        text = "".join(rng.choice("abcXYZ0189+/") for _ in range(size))
        width = min(20, size)
        assert [round(x, 9) for x in S.window_entropies(text)] == [round(entropy(text[i : i + width]), 9) for i in range(size - width + 1)]


def test_entropy_spans_and_allow_list():
    allowed = tuple(map(re.compile, S.ALLOWED))
    find = lambda t: [t[a:b] for a, _, b in S.entropy_spans(t, allowed)]
    key = "Zx9Qw7Er5Ty3Ui1OpA8sKd6F"
    assert find(f"é use {key} now") == [key]
    assert find("EXAMPLE" + key) == [] and find("550e8400-e29b-41d4-a716-446655440000") == []
    assert find("4929348385146306492934838514") == [] and find("internationalisationandlocalisation") == []
    assert find("abababababababababababab") == []
    assert find(key + "a" * 40 + key) == [x for x in (find(key + "a" * 40 + key))] and len(find(key + "a" * 40 + key)) == 2


def test_class_of_windows_equals_direct():
    def direct(w):
        body = w.replace("=", "")
        if body.isdigit():
            return "digits"
        if not set(body) - set("0123456789abcdef") or not set(body) - set("0123456789ABCDEF"):
            return "hex"
        return "letters" if not any(c.isdigit() for c in body) else "upper" if body == body.upper() else "mixed"

    rng = random.Random(8)
    for alphabet in ("0123456789", "0123456789abcdef", "0123456789ABCDEF_", "abcdefghijklmnop-", "ABCXYZ0189", "aZ09+/_-"):
        text = "".join(rng.choice(alphabet) for _ in range(120)) + "=="
        assert [k for _, k in S.windows(text)] == [direct(text[i : i + 20]) for i in range(len(text) - 19)]


def test_keys_behind_prefixes_are_found():
    allowed = tuple(map(re.compile, S.ALLOWED))
    rng = random.Random(7)
    for prefix in ("", "KEY_", "key-", "prod/", "v1/", "docs/example/", "deploy_"):
        found = 0
        for _ in range(300):
            key = "".join(rng.choice("0123456789ABCDEF") for _ in range(32))
            spans = S.entropy_spans(f"see {prefix}{key}.", allowed)
            found += any(a <= 4 + len(prefix) + 12 and b == 4 + len(prefix) + 32 or b - a >= 20 for a, _, b in spans)
        assert found >= 285, (prefix, found)
    secret = "Zx9Qw7Er5Ty3Ui1OpA8sKd6FgH2jLm4NbVcX0z1q"
    (start, _, end), = S.entropy_spans(f"docs/example/{secret}", allowed)
    assert 12 <= start <= 14 and end == 13 + len(secret)


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "é password=abcdef1234567890ff end"), (2, None), (3, "plain")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in S.redact(docs).collect()} == {1: "é [secret] end", 2: None, 3: "plain"}
