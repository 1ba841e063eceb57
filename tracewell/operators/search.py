"""Full-text search: postings, a stored index, query rewriting, ranking and snippets.

A stored index consists of segments.  In each, messages are numbered in order of
session and place, and every so many of them form a cell.  Postings carry the message's
length and the term's places; a table of blocks holds for each term and cell
the number of postings, the largest term frequency and the least length, hence a bound of
what the term can add to a score in that cell.  A search first scores the cells with the
highest bounds; the score of the last hit then kept rules out all cells whose bounds
miss it, and only postings of the cells left are read.  A common word costs its
blocks, not its postings; the ranks are those of scoring everything.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import text
from tracewell.operators import steps as ST
from tracewell.plans.ordinal import with_ordinal
from tracewell.session import materialize

#: The published ranking parameters and the floor of a term's weight.
K1 = 1.2
B = 0.75
MIN_IDF = 1e-6
#: Postings of one bucket of a stored index, about.
BUCKET_ROWS = 20_000_000
#: Postings of one folder, about: small buckets share one, so files grow with the postings and not with the buckets.
SHELF_ROWS = 2_000_000
#: Messages of a cell; cells scored first for every query; cells told to the scan by name at most.
CELL_ROWS = 1024
FIRST_CELLS = 4
NAMED_CELLS = 5_000
#: Rounding that may not let a cell be left out.
_SLACK = 1e-7
_SEGMENT = "segment int, n_docs long, total_len long, first_cell long, cells long, cell_rows int, buckets int, shelves int"
_POSTING = "term string, sid string, seq int, len int, tf int, places array<int>, cell long, bucket int, segment int, shelf int"
_BLOCK = "term string, cell long, n long, max_tf int, min_len int, bucket int, segment int, shelf int"


def postings(messages: DataFrame, keys: Sequence[str] = ("sid", "seq")) -> DataFrame:
    """One row per term occurrence: keys, term, pos."""
    return messages.select(*keys, F.posexplode(text.search_tokens("raw")).alias("pos", "term"))


@dataclass(frozen=True)
class Index:
    """A stored index: postings and blocks by segment and bucket of their term, and a row for each segment.

    Files lie in a folder for each shelf (consecutive buckets) and are sorted by bucket and term.
    """

    path: str
    postings: DataFrame
    blocks: DataFrame
    segments: tuple

    @property
    def n_docs(self) -> int:
        return sum(s.n_docs for s in self.segments)

    @property
    def avg_len(self) -> float | None:
        return sum(s.total_len for s in self.segments) / self.n_docs if self.n_docs else None

    def of_terms(self, rows: DataFrame, terms: Sequence[str]) -> DataFrame:
        """Postings or blocks of these terms; only the shelves of their buckets are opened, and of these files the pages of the buckets read."""
        named = rows.sparkSession.createDataFrame([(t,) for t in terms] or [("",)], "term string")
        asked = F.lit(False)
        for buckets, shelves in sorted({(s.buckets, s.shelves) for s in self.segments}):
            places = named.select(_bucket(buckets).alias("bucket")).select("bucket", _shelf(buckets, shelves).alias("shelf")).collect()
            numbers = [s.segment for s in self.segments if (s.buckets, s.shelves) == (buckets, shelves)]
            inside = F.col("shelf").isin(sorted({r.shelf for r in places})) & F.col("bucket").isin(sorted({r.bucket for r in places}))
            asked = asked | (F.col("segment").isin(numbers) & inside)
        return rows.filter(asked & F.col("term").isin(list(terms)))


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")


def _shelf(buckets: int, shelves: int) -> Column:
    return F.floor(F.col("bucket").cast("long") * shelves / buckets).cast("int")


def _sizes(words: int, bucket_rows: int) -> tuple[int, int]:
    """Numbers of buckets and of shelves for so many words."""
    return max(1, -(-words // bucket_rows)), max(1, -(-words // max(bucket_rows, SHELF_ROWS)))


def _lengths(messages: DataFrame) -> DataFrame:
    return messages.select("sid", "seq", F.size(text.search_tokens("raw")).alias("len"))


def _corpus(lengths: DataFrame) -> DataFrame:
    return lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("len").alias("avg_len"))


def _write_parts(postings: DataFrame, path: str, segment: int, buckets: int, shelves: int) -> None:
    """Postings, sorted by bucket, term and cell, and their blocks."""
    folder = f"{path}/postings/segment={segment}"
    placed = postings.withColumn("bucket", _bucket(buckets)).withColumn("shelf", _shelf(buckets, shelves))
    # a shelf is spread by session: one term may hold a large part of all rows
    spread = placed.repartition("shelf", F.pmod(F.xxhash64("sid"), F.lit(8)))
    spread.sortWithinPartitions("shelf", "bucket", "term", "cell", "sid", "seq").write.partitionBy("shelf").parquet(folder)
    stored = postings.sparkSession.read.schema(_POSTING.replace(", segment int", "")).parquet(folder)
    blocks = stored.groupBy("shelf", "bucket", "term", "cell").agg(
        F.count(F.lit(1)).alias("n"), F.max("tf").alias("max_tf"), F.min("len").alias("min_len")
    )
    ordered = blocks.repartition("shelf").sortWithinPartitions("shelf", "bucket", "term", "cell")
    ordered.write.partitionBy("shelf").parquet(f"{path}/blocks/segment={segment}")


def _write_segment_row(spark: SparkSession, path: str, row: tuple) -> None:
    """The row makes the segment visible, so it is written last."""
    spark.createDataFrame([row], _SEGMENT).coalesce(1).write.json(f"{path}/segments/row={row[0]}")


def _add_segment(messages: DataFrame, path: str, segment: int, first_cell: int, bucket_rows: int, cell_rows: int) -> None:
    spark = messages.sparkSession
    numbered = with_ordinal(messages.select("sid", "seq", "raw"), [F.col("sid"), F.col("seq")], "nth")
    told = numbered.select(
        "sid", "seq", (F.floor(F.col("nth") / cell_rows) + first_cell).cast("long").alias("cell"), text.search_tokens("raw").alias("tokens")
    ).withColumn("len", F.size("tokens"))
    total = told.agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("words")).first()
    buckets, shelves = _sizes(total.words or 0, bucket_rows)
    places = told.select("sid", "seq", "cell", "len", F.posexplode("tokens").alias("pos", "term"))
    postings = places.groupBy("term", "sid", "seq", "cell", "len").agg(F.sort_array(F.collect_list("pos")).alias("places"))
    postings = postings.select("term", "sid", "seq", "len", F.size("places").alias("tf"), "places", "cell")
    _write_parts(postings, path, segment, buckets, shelves)
    _write_segment_row(spark, path, (segment, total.n, total.words or 0, first_cell, -(-total.n // cell_rows), cell_rows, buckets, shelves))


def write_index(messages: DataFrame, path: str, bucket_rows: int = BUCKET_ROWS, cell_rows: int = CELL_ROWS) -> Index:
    """Store an index of these messages below ``path``; the number of buckets follows from the data."""
    _add_segment(messages, path, 0, 0, bucket_rows, cell_rows)
    return read_index(messages.sparkSession, path)


def append_index(messages: DataFrame, path: str, bucket_rows: int = BUCKET_ROWS) -> Index:
    """Add messages that the index does not hold yet as a segment of its own; nothing stored is rewritten."""
    index = read_index(messages.sparkSession, path)
    last = index.segments[-1]
    cell = max(s.first_cell + s.cells for s in index.segments)
    _add_segment(messages, path, last.segment + 1, cell, bucket_rows, last.cell_rows)
    return read_index(messages.sparkSession, path)


def merge_index(spark: SparkSession, path: str, target: str, bucket_rows: int = BUCKET_ROWS) -> Index:
    """All segments as one below ``target``.  Messages are not tokenised again; cells keep their numbers."""
    index = read_index(spark, path)
    words = sum(s.total_len for s in index.segments)
    buckets, shelves = _sizes(words, bucket_rows)
    _write_parts(index.postings.drop("segment", "bucket", "shelf"), target, 0, buckets, shelves)
    cells = max(s.first_cell + s.cells for s in index.segments)
    _write_segment_row(spark, target, (0, index.n_docs, words, 0, cells, index.segments[0].cell_rows, buckets, shelves))
    return read_index(spark, target)


def read_index(spark: SparkSession, path: str) -> Index:
    segments = spark.read.schema(_SEGMENT).json(f"{path}/segments").orderBy("segment").collect()  # a row each
    seen = F.col("segment").isin([s.segment for s in segments])
    return Index(
        path, spark.read.schema(_POSTING).parquet(f"{path}/postings").filter(seen),
        spark.read.schema(_BLOCK).parquet(f"{path}/blocks").filter(seen), tuple(segments),
    )


def query_terms(spark: SparkSession, queries: Sequence[str]) -> DataFrame:
    """(qid, clause, term_pos, term, n_terms): words OR-ed, the grams of one word as a phrase."""
    return terms_of(spark.createDataFrame([(i, q) for i, q in enumerate(queries)], "qid int, query string"))


def terms_of(queries: DataFrame) -> DataFrame:
    """The same for a table of queries (qid, query)."""
    words = queries.select("qid", F.posexplode(F.split(text.fold(F.regexp_replace("query", '"', " ")), " ")).alias("clause", "word"))
    tokens = words.select("qid", "clause", text.search_tokens("word").alias("tokens"))
    return tokens.select(
        "qid", "clause", F.size("tokens").alias("n_terms"), F.posexplode("tokens").alias("term_pos", "term")
    )


def _phrases(matched: DataFrame, more: Sequence[str] = ()) -> DataFrame:
    """Phrase frequency per (qid, clause, sid, seq) of rows with pos, term_pos and n_terms."""
    starts = matched.groupBy("qid", "clause", "sid", "seq", *more, (F.col("pos") - F.col("term_pos")).alias("start")).agg(
        F.count(F.lit(1)).alias("hit"), F.max("n_terms").alias("n_terms")
    )
    return (
        starts.filter(F.col("hit") == F.col("n_terms"))
        .groupBy("qid", "clause", "sid", "seq", *more)
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def _idf(n_docs: Column) -> Column:
    return F.greatest(F.log((n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(MIN_IDF))


def _gain(tf: str, length: str, avg_len: Column) -> Column:
    """What one clause adds to a score for an idf of one: rises with the frequency, falls with the length."""
    return F.col(tf) * (K1 + 1) / (F.col(tf) + K1 * (1 - B + B * F.col(length) / avg_len))


def _ranked(scored: DataFrame, sessions: DataFrame, source: str | None, limit: int) -> DataFrame:
    named = scored.join(sessions.select("sid", "source", "title"), "sid")
    if source is not None:
        named = named.filter(F.col("source") == source)
    return ST.top_per_group(named, ["qid"], [F.round("score", 9).desc(), F.col("sid"), F.col("seq")], limit)


def _full_search(messages: DataFrame, sessions: DataFrame, terms: DataFrame, limit: int, source: str | None) -> DataFrame:
    """Hits (qid, sid, seq, score, rank, source, title) by scoring all messages that hold a term."""
    lengths = _lengths(messages)
    corpus = _corpus(lengths)  # one row
    # the query list is given by the caller as a local list, so this side is small by construction
    hits = _phrases(postings(messages).join(F.broadcast(terms), "term"))
    frequency = hits.groupBy("qid", "clause").agg(F.count(F.lit(1)).alias("df"))  # one row per clause
    weighed = hits.join(F.broadcast(frequency), ["qid", "clause"]).join(F.broadcast(corpus))
    with_len = weighed.join(lengths, ["sid", "seq"])
    gain = _idf(F.col("n_docs")) * _gain("tf", "len", F.col("avg_len"))
    return _ranked(with_len.groupBy("qid", "sid", "seq").agg(F.sum(gain).alias("score")), sessions, source, limit)


class _BlockSearch:
    """A search over a stored index that reads the postings of promising cells only."""

    def __init__(self, index: Index, sessions: DataFrame, terms: DataFrame, limit: int, source: str | None) -> None:
        self.index, self.sessions, self.limit, self.source = index, sessions, limit, source
        self.average = F.lit(index.avg_len)
        # terms are the words of the caller's own list
        self.single = terms.filter("n_terms = 1").select("qid", "clause", "term")
        self.words = sorted({r.term for r in self.single.select("term").collect()})
        phrase = terms.filter("n_terms > 1")
        listed = sorted({r.term for r in phrase.select("term").collect()})
        self.phrase_hits = None
        block = ["qid", "clause", "cell", "n", "max_tf", "min_len"]
        blocks = index.of_terms(index.blocks, self.words).join(F.broadcast(self.single), "term").select(block)
        if listed:  # how often a phrase occurs is not known before its places are compared
            places = index.of_terms(index.postings, listed).select("term", "sid", "seq", "cell", "len", F.explode("places").alias("pos"))
            self.phrase_hits = materialize(_phrases(places.join(F.broadcast(phrase), "term"), ("cell", "len")))
            grouped = self.phrase_hits.groupBy("qid", "clause", "cell").agg(
                F.count(F.lit(1)).alias("n"), F.max("tf").alias("max_tf"), F.min("len").alias("min_len"))
            blocks = blocks.unionByName(grouped.select(block))
        blocks = materialize(blocks)
        self.weights = materialize(
            blocks.groupBy("qid", "clause").agg(F.sum("n").alias("df")).select("qid", "clause", _idf(F.lit(index.n_docs)).alias("idf")))
        best = F.sum(F.col("idf") * _gain("max_tf", "min_len", self.average))
        self.bounds = materialize(blocks.join(self.weights, ["qid", "clause"]).groupBy("qid", "cell").agg(best.alias("bound")))

    def scored(self, cells: DataFrame) -> DataFrame:
        """(qid, sid, seq, score) of all hits in these cells (qid, cell)."""
        named = [r.cell for r in cells.select("cell").distinct().limit(NAMED_CELLS + 1).collect()]
        found = self.index.of_terms(self.index.postings, self.words)
        if len(named) <= NAMED_CELLS:
            found = found.filter(F.col("cell").isin(named))  # reaches the scan; files are sorted by term and cell
        columns = ["qid", "clause", "sid", "seq", "cell", "tf", "len"]
        hits = found.join(F.broadcast(self.single), "term").select(columns)
        if self.phrase_hits is not None:
            hits = hits.unionByName(self.phrase_hits.select(columns))
        hits = hits.join(cells.select("qid", "cell"), ["qid", "cell"], "left_semi").join(self.weights, ["qid", "clause"])
        return hits.groupBy("qid", "sid", "seq").agg(F.sum(F.col("idf") * _gain("tf", "len", self.average)).alias("score"))

    def cells_left(self, first: DataFrame, best: DataFrame) -> DataFrame:
        """(qid, cell) that may hold a better hit than the last of ``best``, but those of ``first``."""
        last = best.groupBy("qid").agg(F.when(F.count(F.lit(1)) >= self.limit, F.min("score")).alias("last"))
        left = self.bounds.join(last, "qid", "left").filter(F.col("bound") >= F.coalesce("last", F.lit(0.0)) - _SLACK)
        return left.join(first.select("qid", "cell"), ["qid", "cell"], "left_anti").select("qid", "cell")

    def run(self) -> DataFrame:
        first = materialize(ST.top_per_group(self.bounds, ["qid"], [F.desc("bound"), F.col("cell")], FIRST_CELLS))
        best = materialize(_ranked(self.scored(first), self.sessions, self.source, self.limit))
        left = materialize(self.cells_left(first, best))
        if left.isEmpty():
            return best
        more = _ranked(self.scored(left), self.sessions, self.source, self.limit)
        both = best.unionByName(more).drop("rank")
        return ST.top_per_group(both, ["qid"], [F.round("score", 9).desc(), F.col("sid"), F.col("seq")], self.limit)


def search(
    messages: DataFrame,
    sessions: DataFrame,
    queries: Sequence[str],
    limit: int = 20,
    source: str | None = None,
    index: Index | None = None,
) -> DataFrame:
    """Ranked hits of every query: qid, rank, sid, seq, source, title, role, ts, snippet, score.

    Okapi BM25 with k1 = 1.2 and b = 0.75; ties by (sid, seq).  With a
    stored ``index`` only postings of cells that may hold hits are read; else all messages
    are tokenised.
    """
    spark = messages.sparkSession
    terms = query_terms(spark, queries)
    if index is None:
        best = _full_search(messages, sessions, terms, limit, source)
    else:
        best = _BlockSearch(index, sessions, terms, limit, source).run()
    # rows left: at most limit per query
    shown = best.join(messages.select("sid", "seq", "role", "ts", "raw"), ["sid", "seq"])
    texts = spark.createDataFrame([(i, q) for i, q in enumerate(queries)], "qid int, query string")
    return shown.join(F.broadcast(texts), "qid").select(
        "qid", "rank", "sid", "seq", "source", "title", "role", "ts", snippet("raw", "query").alias("snippet"), "score"
    )


def search_sids(hits: DataFrame, cap: int | None = None) -> DataFrame:
    """Sessions among the hits, or among the first ``cap``, for the session filter."""
    return (hits if cap is None else hits.filter(F.col("rank") <= cap)).select("sid").distinct()


def snippet(raw: str, query: str, width: int = 60):
    """Text around the first query word found, in query order: 20 before, 2 * width after."""
    body = F.coalesce(F.col(raw), F.lit(""))
    low = F.lower(body)
    words = F.filter(
        F.split(text.fold(F.regexp_replace(F.col(query), '"', " ")), " "), lambda w: F.length(w) > 0
    )
    places = F.filter(F.transform(words, lambda w: F.instr(low, F.lower(w))), lambda p: p > 0)
    at = F.coalesce(F.get(places, F.lit(0)), F.lit(1)) - 1
    start = F.greatest(F.lit(0), at - 20)
    end = F.least(F.length(body), start + width * 2)
    part = F.substring(body, start + 1, end - start)
    return F.concat(
        F.when(start > 0, "…").otherwise(""), part, F.when(end < F.length(body), "…").otherwise("")
    )
