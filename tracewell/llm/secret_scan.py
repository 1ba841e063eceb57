"""Secret scans: fixed patterns, and sliding-window entropy over candidate strings.

Candidates are long runs of key characters.  A window slides over each; its
Shannon entropy and its characters' classes are kept by incremental counts (one
character enters, one leaves).  How much entropy is suspicious depends on the class of the
window, so a key behind a prefix or a path is judged like the key alone.  Windows that overlap a
part of the candidate (between separators) in which the allow list has a match add no span;
spans of the fixed patterns are never suppressed.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import plain_text

#: The base patterns, in the order their kinds are listed.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 12, 18, 16

WINDOW = 20
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
#: Bits per character from which a window is suspicious, by the characters of the window.
#: Digits alone reach log2(10) = 3.32 at most and are left to other operators.
THRESHOLDS = {"hex": 3.2, "upper": 3.7, "mixed": 3.8, "letters": 4.0, "digits": math.inf}
#: What parts of a candidate lie between: a path's or a name's parts.
SEPARATORS = "/_-"
ALLOWED = (
    r"(?i)example|placeholder|changeme|dummy",
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"(?i)abcdefghij|0123456789",
    r"^(.{1,4})\1+=*$",
)
_HEX_RUNS = bytes(b if b in b"0123456789abcdef" else 32 for b in range(256))
_KEY_RUNS = bytes(b if chr(b).isascii() and (chr(b).isalnum() or chr(b) in "+/_-") else 32 for b in range(256))


def _has_run(raw: bytes, table: bytes, size: int) -> bool:
    return max(map(len, raw.translate(table).split()), default=0) >= size


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) in code points, unordered."""
    raw = text.encode("utf-8", "surrogatepass")
    spans = []
    lowered = raw.lower()
    if any(k in lowered for k in (b"passw", b"secret", b"token", b"key")):
        spans += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
    if b"AKIA" in raw:
        spans += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_CHARS]
    if _has_run(raw, _HEX_RUNS, HEX_CHARS):
        spans += [(m.start(), "hex", m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= HEX_CHARS]
    return spans


#: Kinds of characters that windows count: digits, a-f, other small letters, A-F, other capitals, the rest; padding is none.
_DIGIT, _SMALL_HEX, _SMALL, _CAPITAL_HEX, _CAPITAL, _REST = range(6)


def _kind(character: str) -> int | None:
    if character.isdigit():
        return _DIGIT
    if character.islower():
        return _SMALL_HEX if character <= "f" else _SMALL
    if character.isupper():
        return _CAPITAL_HEX if character <= "F" else _CAPITAL
    return None if character == "=" else _REST


def class_of(kinds: list[int]) -> str:
    """The class of a window with so many characters of each kind."""
    digits, small_hex, small, capital_hex, capital, rest = kinds
    if digits and not (small_hex or small or capital_hex or capital or rest):
        return "digits"
    if not (small or capital or rest) and not (small_hex and capital_hex):
        return "hex"
    if not digits:
        return "letters"
    return "mixed" if small_hex or small else "upper"


def windows(candidate: str, window: int = WINDOW) -> Iterator[tuple[float, str]]:
    """Entropy in bits and class of every window, left to right; one window if the candidate is shorter."""
    size = min(window, len(candidate))
    weight = [0.0] + [c * math.log2(c) for c in range(1, size + 1)]
    counts: dict[str, int] = {}
    kinds = [0] * 6
    total = 0.0
    for i, entering in enumerate(candidate):
        if i >= size:
            leaving = candidate[i - size]
            n = counts[leaving]
            counts[leaving] = n - 1
            total += weight[n - 1] - weight[n]
            if (kind := _kind(leaving)) is not None:
                kinds[kind] -= 1
        n = counts.get(entering, 0)
        counts[entering] = n + 1
        total += weight[n + 1] - weight[n]
        if (kind := _kind(entering)) is not None:
            kinds[kind] += 1
        if i >= size - 1:
            yield math.log2(size) - total / size, class_of(kinds)


def window_entropies(candidate: str, window: int = WINDOW) -> Iterator[float]:
    return (bits for bits, _ in windows(candidate, window))


def _allowed_starts(candidate: str, allowed: tuple[re.Pattern, ...], size: int) -> set[int]:
    """Starts of the windows that overlap a part, between separators, in which the allow list has a match."""
    starts: set[int] = set()
    for match in (m for a in allowed for m in a.finditer(candidate)):
        begin = max(candidate.rfind(c, 0, match.start()) for c in SEPARATORS) + 1
        end = min((at for c in SEPARATORS if (at := candidate.find(c, match.end())) >= 0), default=len(candidate))
        starts.update(range(max(0, begin - size + 1), end))
    return starts


def entropy_spans(text: str, allowed: tuple[re.Pattern, ...], window: int = WINDOW) -> list[tuple[int, str, int]]:
    """Unions of the suspicious windows of every candidate but those that overlap an allowed part."""
    if not _has_run(text.encode("utf-8", "surrogatepass"), _KEY_RUNS, WINDOW):
        return []
    spans = []
    for match in CANDIDATE.finditer(text):
        candidate = match[0]
        suspicious = [i for i, (bits, kind) in enumerate(windows(candidate, window)) if bits >= THRESHOLDS[kind]]
        if not suspicious:
            continue
        size = min(window, len(candidate))
        skipped = _allowed_starts(candidate, allowed, size)
        first = last = None
        for i in suspicious:
            if i in skipped:
                continue
            if last is not None and i > last:
                spans.append((match.start() + first, "entropy", match.start() + last))
                first = None
            first = i if first is None else first
            last = i + size
        if last is not None:
            spans.append((match.start() + first, "entropy", match.start() + last))
    return spans


def _joined(spans: list[tuple[int, str, int]]) -> str:
    ordered = sorted(spans, key=lambda s: (s[0], KINDS.index(s[1]), s[2]))
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in ordered)


def scan_text(text: str, allowed: tuple[re.Pattern, ...]) -> tuple[int, int, int, str, str]:
    base = base_spans(text)
    kinds = [kind for _, kind, _ in base]
    return (
        kinds.count("assign"), kinds.count("access"), kinds.count("hex"),
        hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base + entropy_spans(text, allowed)),
    )


def secrets(docs: DataFrame, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Needs ``doc_id`` and ``text``; a null text is empty and has no spans.  Spans
    are kind:start:end in code points over the whole match, ordered by start,
    then kind; texts of any length are scanned whole, other columns are not looked at.  Rows that repeat a document are scanned each.  One pass, no
    shuffle; no row in, no row out.
    """

    @F.pandas_udf("n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        patterns = tuple(map(re.compile, allowed))
        for texts in batches:
            yield pd.DataFrame(
                [scan_text(t, patterns) for t in texts], columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"]
            )

    return docs.select("doc_id", scan(plain_text()).alias("r")).select("doc_id", "r.*")


def redact(docs: DataFrame, allowed: tuple[str, ...] = ALLOWED, mark: str = "[secret]") -> DataFrame:
    """The documents with every span replaced by ``mark``; overlapping spans become one.

    A null text stays null, an empty one empty; other columns, whatever their names, stay.  No row in, no row out.
    """

    @F.pandas_udf("string")
    def replace(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        patterns = tuple(map(re.compile, allowed))
        for texts in batches:
            yield pd.Series([None if t is None else redacted(t, patterns, mark) for t in texts], dtype=object)

    return docs.withColumn("text", replace("text")).select(docs.columns)


def redacted(text: str, allowed: tuple[re.Pattern, ...], mark: str) -> str:
    out, at = [], 0
    for start, _, end in sorted(base_spans(text) + entropy_spans(text, allowed)):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])
