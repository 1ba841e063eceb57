"""Quality classifier: Bradley-Terry ranking of documents.

A document's strength is a weighted sum of properties of its text.  The weights
come from preference pairs (a labelled good document over a labelled bad one):
logistic loss on the difference of the two feature vectors, solved by Newton
steps.  The pairwise loss fixes no origin, so documents are accepted from a
quantile of the training strengths on.

Only a bounded sample of labelled rows reaches the driver (``max_labelled``
rows of some thirty numbers each).  Scoring is one pass without a shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import hash_sample, plain_text

MAX_LABELLED = 20_000
PAIRS = 100_000
ACCEPT = 0.3
SEED = 7
_OTHER, _LETTER, _CAPITAL, _DIGIT, _SYMBOL, _STOP, _COMMA, _BREAK = range(8)


def _kind(char: str) -> int:
    if char in ".!?":
        return _STOP
    if char == ",":
        return _COMMA
    if char == "\n":
        return _BREAK
    if char.isdecimal():
        return _DIGIT
    if char.isalpha():
        return _CAPITAL if char.isupper() else _LETTER
    return _OTHER if char.isspace() or char in ";:'\"()-_" else _SYMBOL


#: Kind of each character of the Latin blocks; all above counts as a letter.
_KINDS = np.array([_kind(chr(c)) for c in range(0x250)] + [_LETTER], dtype=np.uint8)
_NAMES = (
    "log_words", "word_length", "word_spread", "upper", "symbols", "digits", "stops", "commas", "repeats", "distinct",
    "top_share", "short_words", "breaks", "word_per_stop",
)


def text_features(text: str) -> list[float]:
    """Shares and averages that do not depend on the language; an empty text has zeros."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(_NAMES)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kinds = np.bincount(_KINDS[np.minimum(codes, len(_KINDS) - 1)], minlength=8).tolist()
    lengths = np.fromiter(map(len, words), dtype=np.float64, count=n)
    lowered = text.lower().split()
    counts = Counter(lowered)
    letters = max(kinds[_LETTER] + kinds[_CAPITAL], 1)
    return [
        np.log1p(n), float(lengths.mean()), float(lengths.std()), kinds[_CAPITAL] / letters, kinds[_SYMBOL] / n,
        kinds[_DIGIT] / len(text), kinds[_STOP] / n, kinds[_COMMA] / n, sum(map(eq, lowered, lowered[1:])) / n,
        len(counts) / n, max(counts.values()) / n, float((lengths <= 3).mean()), kinds[_BREAK] / n,
        min(n / (kinds[_STOP] + 1), 60.0) / 60.0,
    ]


def expanded(features: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised values and how far each is from the middle, both bounded."""
    z = np.clip((features - centre) / scale, -6, 6)
    return np.hstack([z, np.abs(z)])


class Ranker:
    """Weights, accepted strength and the map to scores."""

    def __init__(self, centre, scale, weights, threshold):
        self.centre, self.scale, self.weights, self.threshold = centre, scale, weights, threshold

    def strengths(self, features: np.ndarray) -> np.ndarray:
        return expanded(features, self.centre, self.scale) @ self.weights

    def scores(self, features: np.ndarray, accept: float = ACCEPT) -> np.ndarray:
        """Between 0 and 1, and ``accept`` at the threshold."""
        z = self.strengths(features) - self.threshold + np.log(accept / (1 - accept))
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def bradley_terry(differences: np.ndarray, penalty: float = 1.0, steps: int = 25) -> np.ndarray:
    """Weights that minimise the logistic loss of winner-minus-loser rows, with an L2 penalty."""
    w = np.zeros(differences.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(differences @ w, -35, 35)))
        gradient = penalty * w - differences.T @ p
        hessian = penalty * np.eye(len(w)) + (differences * (p * (1 - p))[:, None]).T @ differences
        move = np.linalg.solve(hessian, gradient)
        w -= move
        if np.abs(move).max() < 1e-8:
            break
    return w


def accepting_quantile(strengths: np.ndarray, good: np.ndarray) -> float:
    """Of the strength quantiles, in thousandths, the one with the fewest errors in each class; the middle of ties."""
    cuts = np.quantile(strengths, np.arange(1, 1000) / 1000)
    wins, losses = np.sort(strengths[good]), np.sort(strengths[~good])
    missed = np.searchsorted(wins, cuts, side="left") / max(len(wins), 1)
    passed = 1 - np.searchsorted(losses, cuts, side="left") / max(len(losses), 1)
    best = np.flatnonzero(np.isclose(missed + passed, (missed + passed).min()))
    return float(cuts[best[len(best) // 2]])


def fit(features: np.ndarray, good: np.ndarray, pairs: int = PAIRS, seed: int = SEED) -> Ranker:
    """With no row of one class nothing can be learnt: every strength is the threshold, so all are accepted."""
    width = len(_NAMES)
    features = features.reshape(-1, width)
    if not good.any() or good.all():
        return Ranker(np.zeros(width), np.ones(width), np.zeros(2 * width), 0.0)
    centre, scale = features.mean(axis=0), features.std(axis=0)
    scale[scale < 1e-9] = 1.0
    x = expanded(features, centre, scale)
    rng = np.random.default_rng(seed)
    winners = rng.choice(np.flatnonzero(good), pairs)
    losers = rng.choice(np.flatnonzero(~good), pairs)
    weights = bradley_terry(x[winners] - x[losers])
    return Ranker(centre, scale, weights, accepting_quantile(x @ weights, good))


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Rows that never train: crc32 of the id as text, mod 5, is zero; false for a null id."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _features_udf():
    @F.pandas_udf("array<double>")
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([text_features(t) for t in texts], dtype=object)

    return features


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Ranker:
    """Fit on at most ``max_labelled`` labelled rows that are not held out, chosen by a hash of the id."""
    usable = (
        labels.select("doc_id", "quality").filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.max("quality").alias("quality"))
    )
    chosen = hash_sample(usable, "doc_id", max_labelled)
    rows = (
        docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
        .select("doc_id", "quality", _features_udf()(plain_text()).alias("x"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(max_labelled).collect()
    )
    return fit(np.array([r.x for r in rows], dtype=np.float64), np.array([r.quality == 1 for r in rows], dtype=bool))


def score_column(model: Ranker, accept: float = ACCEPT, text: str | Column = "text") -> Column:
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            x = np.array([text_features(t) for t in texts], dtype=np.float64).reshape(-1, len(_NAMES))
            yield pd.Series(model.scores(x, accept))

    return score(plain_text(text))


def quality_scores(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Needs ``doc_id``/``text`` and ``doc_id``/``quality``.  A null text is empty
    and is scored as such.  Labels without id or value teach nothing; of several
    labels of one id the highest counts.  Without labels of both classes every
    score is ``accept`` and every document is accepted.
    """
    score = score_column(train(docs, labels, max_labelled), accept)
    scored = docs.select("doc_id", held_out().alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= accept).cast("int"))


def drop_rejected(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The accepted documents, with all columns; every row is judged by its own text, in place."""
    return docs.filter(score_column(train(docs, labels, max_labelled), accept) >= accept)
