"""Benchmark decontamination: documents that repeat benchmark passages.

The n-grams (windows) of the benchmark items are a hash set that every task
holds; documents are scanned once, in place, without a shuffle.  A document's
windows are first tested by a rolling hash, then compared word for word with
the set's entry.  The set is only shipped while the benchmark is below
``max_benchmark_words``; larger benchmarks meet the documents in an equality
join on the windows instead.  Both ways judge every row by its own text and
give the same rows and texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import plain_text, stored

WINDOW_WORDS = 13
MAX_BENCHMARK_WORDS = 2_000_000
#: Contaminated from one hit word in this many words on.
SHARE = 20
#: Fixed value: what a word is, after A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD_BYTES = bytes(
    b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)
)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def text_words(text: str) -> list[bytes]:
    """The words of ``WORD``: in UTF-8 all of an excluded character's bytes are ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


def words_column(text: str | Column = "text") -> Column:
    return F.regexp_extract_all(F.translate(plain_text(text), _UPPER, _LOWER), F.lit(WORD), F.lit(0))


class WindowSet:
    """Windows of the benchmark items, by length: rolling hashes and the word sequences with their items."""

    def __init__(self, vocabulary: dict[bytes, int], windows: dict[int, dict[bytes, set[str]]], hashes: dict[int, np.ndarray]):
        self.vocabulary, self.windows, self.hashes = vocabulary, windows, hashes

    @property
    def data(self) -> tuple:
        return self.vocabulary, self.windows, self.hashes

    @classmethod
    def of(cls, items: list[tuple[object, str]], window: int = WINDOW_WORDS) -> WindowSet:
        self = cls({}, {}, {})
        for item_id, text in items:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in text_words(text)], dtype=np.int32)
            width = min(window, len(ids))
            known = self.windows.setdefault(width, {}) if width else {}
            for i in range(len(ids) - width + 1 if width else 0):
                known.setdefault(ids[i : i + width].tobytes(), set()).add(str(item_id))
        for width, known in self.windows.items():
            rows = np.frombuffer(b"".join(known), dtype=np.int32).reshape(-1, width)
            self.hashes[width] = np.unique(self._hash(rows))
        return self

    @staticmethod
    def _hash(rows: np.ndarray) -> np.ndarray:
        total = np.zeros(len(rows), dtype=np.uint64)
        for j in range(rows.shape[1]):
            total = total * _BASE + rows[:, j].astype(np.uint64) + np.uint64(1)
        return total

    def scan(self, text: str) -> tuple[int, np.ndarray, set[str]]:
        """Number of words, a mark per hit word, and the items found."""
        words = text_words(text)
        ids = np.fromiter((self.vocabulary.get(w, -1) for w in words), dtype=np.int32, count=len(words))
        marks, items = np.zeros(len(words) + 1, dtype=np.int32), set()
        unknown = np.concatenate(([0], np.cumsum(ids < 0)))
        for width, known in self.windows.items():
            if len(ids) < width:
                continue
            starts = np.flatnonzero(unknown[width:] == unknown[:-width])
            for block in range(0, len(starts), 65_536):
                part = starts[block : block + 65_536]
                rows = np.lib.stride_tricks.sliding_window_view(ids, width)[part]
                sums, hashes = self._hash(rows), self.hashes[width]
                at = np.searchsorted(hashes, sums)
                maybe = np.flatnonzero(hashes[np.minimum(at, len(hashes) - 1)] == sums)
                for i in maybe:
                    found = known.get(rows[i].tobytes())
                    if found:
                        items |= found
                        marks[part[i]] += 1
                        marks[part[i] + width] -= 1
        return len(words), np.cumsum(marks[:-1]) > 0, items


def _named(items: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def _broadcast_scan(docs: DataFrame, windows: WindowSet) -> DataFrame:
    shipped = docs.sparkSession.sparkContext.broadcast(windows.data)

    @F.pandas_udf("n_words long, n_hit long, n_items long, items_sha256 string")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        windows = WindowSet(*shipped.value)
        for texts in batches:
            rows = []
            for text in texts:
                n, hit, items = windows.scan(text)
                rows.append((n, int(hit.sum()), len(items), _named(items)))
            yield pd.DataFrame(rows, columns=["n_words", "n_hit", "n_items", "items_sha256"])

    return docs.select("doc_id", scan(plain_text()).alias("r")).select("doc_id", "r.*")


def _windows(words: str, width: str) -> Column:
    """(start, gram) of every window of ``width`` words."""
    starts = F.sequence(F.lit(0), F.size(words) - F.col(width))
    return F.explode(
        F.transform(starts, lambda i: F.struct(i.alias("start"), F.array_join(F.slice(F.col(words), i + 1, F.col(width)), " ").alias("gram")))
    )


def _text_key() -> Column:
    """What rows with the same words have in common."""
    return F.sha2(F.array_join(words_column(), " "), 256)


def _joined_hits(docs: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """(text_key, n_words, item, start, width): every place where a window of an item occurs, once for all rows with these words."""
    tested = items.select(F.col("item_id").cast("string").alias("item"), words_column().alias("words")).filter("size(words) > 0")
    tested = tested.withColumn("width", F.least(F.lit(window), F.size("words")))
    grams = tested.select("item", "width", _windows("words", "width").alias("w")).select("item", "width", "w.gram").distinct()
    widths = grams.select("width").distinct()  # at most one row for each window length
    texts = docs.select(words_column().alias("words")).withColumn("text_key", F.sha2(F.array_join("words", " "), 256))
    seen = (
        texts.dropDuplicates(["text_key"])
        .join(F.broadcast(widths), F.size("words") >= F.col("width"))
        .select("text_key", F.size("words").alias("n_words"), "width", _windows("words", "width").alias("w"))
        .select("text_key", "n_words", "width", "w.start", "w.gram")
    )
    return seen.join(grams, ["width", "gram"]).select("text_key", "n_words", "item", "start", "width")


def _hit_places(hits: DataFrame) -> DataFrame:
    """(text_key, n_words, at): the hit words of every text, each once."""
    at = F.explode(F.sequence("start", F.col("start") + F.col("width") - 1))
    return hits.select("text_key", "n_words", at.alias("at")).distinct()


def _join_scan(docs: DataFrame, items: DataFrame, window: int) -> DataFrame:
    hits = stored(_joined_hits(docs, items, window), "window-hits")
    found = hits.groupBy("text_key").agg(F.collect_set("item").alias("found"))
    covered = _hit_places(hits).groupBy("text_key").agg(F.count("*").alias("n_hit"))
    texts = docs.select("doc_id", F.size(words_column()).cast("long").alias("n_words"), _text_key().alias("text_key"))
    none = F.array().cast("array<string>")
    return texts.join(found.join(covered, "text_key"), "text_key", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.size(F.coalesce("found", none)).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.coalesce("found", none)), ","), 256).alias("items_sha256"),
    )


def _with_text_key(docs: DataFrame) -> DataFrame:
    """(row, text_key): rows as they are, whatever their columns are called."""
    return docs.select(F.struct("*").alias("row"), _text_key().alias("text_key"))


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select("item_id", "text").filter("item_id IS NOT NULL AND text IS NOT NULL")


def _small_set(benchmark: DataFrame, window: int, max_words: int) -> WindowSet | None:
    """The window set of a benchmark within the bound; its size is counted before anything is collected."""
    items = _items(benchmark)
    size = items.agg(F.sum(F.size(words_column()) + 1).alias("n")).first().n or 0
    return WindowSet.of([tuple(r) for r in items.collect()], window) if size <= max_words else None


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS, max_benchmark_words: int = MAX_BENCHMARK_WORDS
) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Needs ``doc_id``/``text`` and ``item_id``/``text``.  Null texts have no
    words; items without words or without id hit nothing; items that repeat an
    id count once.  Rows that repeat a document are judged alike.  An empty
    benchmark hits nothing.
    """
    windows = _small_set(benchmark, window, max_benchmark_words)
    scanned = _join_scan(docs, _items(benchmark), window) if windows is None else _broadcast_scan(docs, windows)
    return scanned.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * SHARE >= F.col("n_words")))


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS, max_benchmark_words: int = MAX_BENCHMARK_WORDS
) -> DataFrame:
    """The rows that are not contaminated, with all columns.

    Every row is judged by its own text, also where rows share an id or have none.  A null text is clean.
    """
    windows = _small_set(benchmark, window, max_benchmark_words)
    if windows is None:
        places = _hit_places(_joined_hits(docs, _items(benchmark), window)).groupBy("text_key", "n_words").agg(F.count("*").alias("n_hit"))
        dirty = stored(places.filter(F.col("n_hit") * SHARE >= F.col("n_words")).select("text_key"), "contaminated-texts")
        return _with_text_key(docs).join(dirty, "text_key", "left_anti").select("row.*")
    shipped = docs.sparkSession.sparkContext.broadcast(windows.data)

    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        windows = WindowSet(*shipped.value)
        for texts in batches:
            hits = [(n, int(hit.sum())) for n, hit, _ in map(windows.scan, texts)]
            yield pd.Series([not (h > 0 and h * SHARE >= n) for n, h in hits], dtype=bool)

    return docs.filter(clean(plain_text()))


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS, max_benchmark_words: int = MAX_BENCHMARK_WORDS) -> DataFrame:
    """The rows with every run of hit words cut out of the text, all other columns as they are.

    A run goes from its first word's first character to its last word's last
    one.  A null text stays null.
    """
    found = _small_set(benchmark, window, max_benchmark_words)
    if found is None:
        places = stored(
            _hit_places(_joined_hits(docs, _items(benchmark), window)).groupBy("text_key").agg(F.collect_list("at").alias("places")), "hit-places"
        )  # at most a number for each word of the text

        @F.pandas_udf("string")
        def cut_places(texts: pd.Series, places: pd.Series) -> pd.Series:
            return pd.Series([t if p is None else without_words(t, np.asarray(p)) for t, p in zip(texts, places)], dtype=object)

        joined = _with_text_key(docs).join(places, "text_key", "left").withColumn("cut", cut_places("row.text", "places"))
        return joined.select(*[F.col("cut").alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
    shipped = docs.sparkSession.sparkContext.broadcast(found.data)

    @F.pandas_udf("string")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        windows = WindowSet(*shipped.value)
        for texts in batches:
            yield pd.Series([None if t is None else without_hits(t, windows) for t in texts], dtype=object)

    return docs.withColumn("text", cut("text")).select(docs.columns)


def without_hits(text: str, windows: WindowSet) -> str:
    return without_words(text, np.flatnonzero(windows.scan(text)[1]))


def without_words(text: str, places: np.ndarray) -> str:
    """The text without the words at the given places and what lies between neighbouring ones."""
    if not len(places):
        return text
    raw = text.encode("utf-8", "surrogatepass")
    word = np.frombuffer(raw.translate(_WORD_BYTES), dtype=np.uint8) != 32
    edge = np.diff(np.concatenate(([0], word.view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    hit = np.zeros(len(starts), dtype=np.int8)
    hit[places] = 1
    run = np.diff(np.concatenate(([0], hit, [0])))
    kept, at = [], 0
    for first, last in zip(np.flatnonzero(run == 1), np.flatnonzero(run == -1) - 1):
        kept.append(raw[at : starts[first]])
        at = ends[last]
    return b"".join([*kept, raw[at:]]).decode("utf-8", "surrogatepass")
