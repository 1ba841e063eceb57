"""Scalar text functions as Column expressions (no Python UDF)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace and line breaks as the source data's producer understands them.
SPACE = r"(?U)[\s\x1c-\x1f]+"
_EDGE_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
_FIRST_LINE = r"^([^\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]*)"
# Shapes masked in error keys.
_DRIVE_PATH = r"(?U)[A-Za-z]:[\\/][^\s\"']+"
_QUOTED = r"\"[^\"]*\"|'[^']*'"
_DIGITS = r"(?U)\d+"
# Where an error text starts to echo the caller's input, in checking order.
ECHO_MARKERS = ("String:", "old_string was", "Input:")
# Characters of a word segment, and the CJK range.
WORD_SEGMENT = r"[\u4e00-\u9fffA-Za-z0-9]+"
CJK_RUN_OR_OTHER = r"[\u4e00-\u9fff]+|[^\u4e00-\u9fff]+"


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip(col: str | Column) -> Column:
    return F.regexp_replace(_c(col), _EDGE_SPACE, "")


def fold(col: str | Column) -> Column:
    """Runs of whitespace become one space; ends trimmed."""
    return F.trim(F.regexp_replace(_c(col), SPACE, " "))


def squash(col: str | Column) -> Column:
    """All whitespace removed."""
    return F.regexp_replace(_c(col), SPACE, "")


def head(col: str | Column, n: int | None) -> Column:
    """The first ``n`` characters; all of them without ``n``."""
    return _c(col) if n is None else F.substring(_c(col), 1, n)


def normalize_newlines(col: str | Column) -> Column:
    return F.regexp_replace(F.coalesce(_c(col), F.lit("")), "\r\n", "\n")


def month_key(col: str | Column) -> Column:
    """``YYYY-MM`` of a stamp, null when the text has no month."""
    text = strip(_c(col))
    return F.when((F.length(text) >= 7) & (F.substring(text, 5, 1) == "-"), F.substring(text, 1, 7))


def normalize_error(col: str | Column) -> Column:
    """Grouping key of an error text: first line with paths, quotes and digits masked."""
    text = F.regexp_extract(F.coalesce(_c(col), F.lit("")), _FIRST_LINE, 1)
    text = F.regexp_replace(text, r"(?U)^Error:\s*", "")
    text = F.regexp_replace(text, _DRIVE_PATH, "<path>")
    text = F.regexp_replace(text, _QUOTED, "<q>")
    text = F.regexp_replace(text, _DIGITS, "N")
    return head(fold(text), 100)


def clean_error_sample(col: str | Column, max_len: int | None = None) -> Column:
    """Error text without echoed input, folded to one line."""
    text = F.coalesce(_c(col), F.lit(""))
    cut = text
    for marker in reversed(ECHO_MARKERS):
        cut = F.when(F.contains(text, F.lit(marker)), F.substring_index(text, marker, 1)).otherwise(cut)
    out = fold(cut)
    return out if max_len is None else head(out, max_len)


def loose_key(col: str | Column) -> Column:
    return fold(F.lower(F.coalesce(_c(col), F.lit(""))))


def warning_key(col: str | Column) -> Column:
    return head(F.regexp_replace(F.coalesce(_c(col), F.lit("")), _DIGITS, "#"), 200)


def _pairs(chars: Column) -> Column:
    n = F.size(chars)
    return F.when(
        n > 1,
        F.zip_with(F.slice(chars, F.lit(1), n - 1), F.slice(chars, F.lit(2), n - 1), lambda a, b: F.concat(a, b)),
    ).otherwise(F.array().cast("array<string>"))


def bigrams(col: str | Column) -> Column:
    """All character pairs of the whitespace-free text: the pairs from the first character, then from the second."""
    clean = squash(F.coalesce(_c(col), F.lit("")))
    pair = F.lit("(?s)..")
    return F.concat(
        F.regexp_extract_all(clean, pair, F.lit(0)),
        F.regexp_extract_all(F.substring(clean, F.lit(2), F.length(clean)), pair, F.lit(0)),
    )


def jaccard(a: str | Column, b: str | Column) -> Column:
    """Set similarity of two arrays, 0 when either is empty."""
    a, b = F.array_distinct(_c(a)), F.array_distinct(_c(b))
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) <= 0) | (F.size(b) <= 0) | a.isNull() | b.isNull(), F.lit(0.0)).otherwise(
        both / (F.size(a) + F.size(b) - both)
    )


def extract_grams(col: str | Column, n: int) -> Column:
    """Word segments: ASCII ones whole, mixed ones as sliding n-grams, short ones dropped."""

    def of_segment(seg: Column) -> Column:
        chars = F.split(seg, "")
        sliding = chars
        for k in range(1, n):
            count = F.size(chars) - k
            sliding = F.zip_with(
                F.slice(sliding, F.lit(1), count), F.slice(chars, F.lit(1 + k), count), lambda a, b: F.concat(a, b)
            )
        return (
            F.when(F.length(seg) < n, F.array().cast("array<string>"))
            .when(F.length(seg) == F.octet_length(seg), F.array(seg))  # one byte per character: ASCII
            .otherwise(sliding)
        )

    segments = F.regexp_extract_all(F.coalesce(_c(col), F.lit("")), F.lit(WORD_SEGMENT), F.lit(0))
    return F.flatten(F.transform(segments, of_segment))


def cjk_bigram_rewrite(col: str | Column) -> Column:
    """CJK runs as overlapping bigrams, other text kept, whitespace folded."""

    def of_run(run: Column) -> Column:
        chars = F.split(run, "")
        pairs = F.array_join(_pairs(chars), " ")
        return F.when(run.rlike(r"^[\u4e00-\u9fff]"), F.when(F.size(chars) > 1, pairs).otherwise(run)).otherwise(run)

    runs = F.regexp_extract_all(F.coalesce(_c(col), F.lit("")), F.lit(CJK_RUN_OR_OTHER), F.lit(0))
    return fold(F.array_join(F.transform(runs, of_run), " "))


def search_tokens(col: str | Column) -> Column:
    """Index terms: lower-cased letter/digit runs of the rewritten text, in order."""
    rewritten = F.lower(cjk_bigram_rewrite(col))
    return F.regexp_extract_all(rewritten, F.lit(r"[\p{L}\p{N}\p{M}]+"), F.lit(0))


def est_tokens(col: str | Column) -> Column:
    """Token estimate: CJK characters count one, the rest a quarter, plus one."""
    text = F.coalesce(_c(col), F.lit(""))
    other = F.length(F.regexp_replace(text, r"[\u4e00-\u9fff\u3000-\u303f]", ""))
    return (F.length(text) - other + F.floor(other / 4) + 1).cast("long")


def quote_spans(col: str | Column) -> Column:
    """Corner-bracket quotes of six or more characters."""
    return F.regexp_extract_all(F.coalesce(_c(col), F.lit("")), F.lit("「([^」]{6,})」"), F.lit(1))


def ascii_quote_spans(col: str | Column) -> Column:
    """Text between paired double quotes, line by line."""

    def of_line(line: Column) -> Column:
        parts = F.split(line, '"')
        return F.filter(
            parts, lambda x, i: (i % 2 == 1) & (i < F.size(parts) - 1) & (F.length(strip(x)) >= 2)
        )

    return F.flatten(F.transform(F.split(F.coalesce(_c(col), F.lit("")), "\n"), of_line))


def date_span(col: str | Column) -> Column:
    """``a ~ b`` as struct(start, end) of dates; both null when invalid."""
    parts = F.split(_c(col), "~", 2)
    shape = r"^\d{4}-\d{2}-\d{2}$"

    def day(i: int) -> Column:
        text = strip(F.get(parts, F.lit(i)))
        return F.when(text.rlike(shape), F.try_to_date(text, "yyyy-MM-dd"))

    ok = day(0).isNotNull() & day(1).isNotNull()
    return F.struct(F.when(ok, day(0)).alias("start"), F.when(ok, day(1)).alias("end"))


def note_patterns(col: str | Column) -> Column:
    """Values of ``pattern:`` entries in a note, in order, without repeats."""
    pieces = F.split(F.coalesce(_c(col), F.lit("")), r"[;；\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]")
    stripped = F.transform(pieces, strip)
    hits = F.filter(stripped, lambda s: F.lower(F.substring(s, 1, 8)) == "pattern:")
    values = F.transform(hits, lambda s: strip(F.substring(s, 9, 1_000_000)))
    return F.array_distinct(F.filter(values, lambda s: F.length(s) > 0))


def audit_text(col: str | Column) -> Column:
    """Text as compared by the audits: no emphasis marks, no whitespace."""
    return squash(F.regexp_replace(F.coalesce(_c(col), F.lit("")), r"[\u3000\u00a0*`]", ""))


def contains_any(col: str | Column, words: Iterable[str]) -> Column:
    """True when any word of a fixed list occurs in the text."""
    words = list(words)
    if not words:
        return F.lit(False)
    escaped = "|".join("\\Q" + w + "\\E" for w in words)
    return F.coalesce(_c(col), F.lit("")).rlike(escaped)


def key_matches(key: Column, pattern: Column) -> Column:
    """Equality of normalised keys, or containment when the shorter has 8+ characters."""
    shorter = F.when(F.length(key) <= F.length(pattern), key).otherwise(pattern)
    longer = F.when(F.length(key) <= F.length(pattern), pattern).otherwise(key)
    usable = (F.length(key) > 0) & (F.length(pattern) > 0)
    return usable & ((key == pattern) | ((F.length(shorter) >= 8) & F.contains(longer, shorter)))


def to_local_ts(col: str | Column) -> Column:
    """Epoch seconds/millis and ISO stamps as ``yyyy-MM-dd HH:mm:ss`` in the session zone.

    Unparseable text passes through unchanged; blank and out-of-range give null.
    """
    text = strip(_c(col).cast("string"))
    fmt = "yyyy-MM-dd HH:mm:ss"
    iso = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,6})?)?)?"
    zoned = iso + r"(Z|[+-]\d{2}:?\d{2})$"
    naive = iso + "$"
    canonical = F.regexp_replace(F.regexp_replace(text, " ", "T"), ",", ".")
    as_double = F.when(text.rlike(r"^-?\d+(\.\d+)?([eE][+]?\d+)?$"), text.try_cast("double"))
    return (
        F.when(text == "", F.lit(None).cast("string"))
        .when(text.rlike(r"^\d{13}$"), F.date_format(F.timestamp_millis(text.try_cast("long")), fmt))
        .when(text.rlike(r"^\d{10}(\.\d+)?$"), F.date_format(F.timestamp_seconds(as_double), fmt))
        .when(text.rlike(zoned), F.coalesce(F.date_format(canonical.try_cast("timestamp"), fmt), text))
        .when(text.rlike(naive), F.coalesce(F.date_format(canonical.try_cast("timestamp_ntz"), fmt), text))
        .otherwise(text)
    )


def numeric_to_local_ts(col: str | Column) -> Column:
    """Epoch number (seconds, or milliseconds above 1e11) as a local stamp; null when out of range."""
    value = _c(col).cast("double")
    seconds = F.when(value > 1e11, value / 1000).otherwise(value)
    in_range = (seconds > -62135596800) & (seconds < 253402300800)
    return F.when(in_range, F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm:ss"))
