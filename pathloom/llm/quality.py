"""Quality classifier: ordinal cumulative-link regression on hashed text."""

from __future__ import annotations

import math
import operator
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from pathloom.llm.common import free_name, give_back, saved, slices, tidy

#: Most labelled rows that a fit looks at; those with the smallest hash of their id.
SAMPLE = 8_000
WIDTH = 1 << 16
GRADES = 3
#: Chance of the best grade from which a document is kept.
LEAST_CHANCE = 0.55


def token_features(token: str, width: int = WIDTH) -> list[int]:
    """Hashed features of one token: its letters, their beginnings, and its shape."""
    letters = "".join(c for c in token.lower() if c.isalnum())
    shape = "".join(sorted({c for c in token if not c.isalnum()}))
    case = "u" if token.isupper() and len(letters) > 1 else "l"
    own = [f"s{case}{shape}"]
    if letters:
        own += [f"w{letters}", *[f"{k}{letters[:k]}" for k in (3, 4, 5, 6)]]
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) % width for x in own]


def scale_of(tokens: int) -> float:
    """What counts are divided by: about the root of the length, more for short texts, which tell little."""
    return math.sqrt(tokens + 30)


def repeat_feature(width: int = WIDTH) -> int:
    return zlib.crc32(b"r") % width


class Hasher:
    """Feature rows of texts; what a token has is kept for the most recent tokens."""

    def __init__(self, width: int = WIDTH) -> None:
        self.width = width
        self.known: dict[str, list[int]] = {}

    def row(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(feature, value): counts over ``scale_of`` the number of tokens."""
        tokens = (text or "").split()
        counts: Counter[int] = Counter()
        if len(self.known) > 200_000:
            self.known.clear()
        for token, n in Counter(tokens).items():
            own = self.known.get(token)
            if own is None:
                own = self.known[token] = token_features(token, self.width)
            for f in own:
                counts[f] += n
        again = sum(a == b for a, b in zip(tokens, tokens[1:]))
        if again:
            counts[repeat_feature(self.width)] += again
        features = np.fromiter(counts.keys(), np.int32, len(counts))
        values = np.fromiter(counts.values(), np.float32, len(counts)) / np.float32(scale_of(len(tokens)))
        return features, values


class TokenScores(dict):
    """What each token adds to a text's score: the sum of its features' weights, worked out once."""

    def __init__(self, weights: np.ndarray) -> None:
        super().__init__()
        self.weights, self.again = weights, float(weights[repeat_feature(len(weights))])

    def __missing__(self, token: str) -> float:
        value = self[token] = float(self.weights[token_features(token, len(self.weights))].sum())
        return value

    def score(self, text: str | None) -> float:
        """The same as the weighted sum of ``Hasher.row``."""
        tokens = (text or "").split()
        if len(self) > 200_000:  # few, as every task of an executor has its own
            self.clear()
        again = sum(map(operator.eq, tokens, islice(tokens, 1, None)))
        return (sum(map(self.__getitem__, tokens)) + again * self.again) / scale_of(len(tokens))


@dataclass
class OrdinalModel:
    """P(grade <= k) = sigmoid(threshold k - w.x): one weight vector, ordered thresholds."""

    weights: np.ndarray
    thresholds: np.ndarray

    def probabilities(self, scores: np.ndarray) -> np.ndarray:
        """One row per score, one column per grade."""
        below = 1 / (1 + np.exp(-np.clip(self.thresholds - np.asarray(scores)[:, None], -60, 60)))
        below = np.column_stack((np.zeros(len(scores)), below, np.ones(len(scores))))
        return np.diff(below, axis=1)


def fit_rows(
    rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, grades_n: int = GRADES, width: int = WIDTH,
    epochs: int = 12, rate: float = 0.3, decay: float = 3e-4, seed: int = 7,
) -> OrdinalModel:
    """Maximum likelihood by Adagrad over small batches.

    Thresholds are a first value and the logarithms of the gaps above it, so they stay
    ordered. They start at the grades' own shares (with one row added to each grade).
    """
    share = np.cumsum(np.bincount(grades, minlength=grades_n) + 1.0)[:-1] / (len(grades) + grades_n)
    start = np.log(share / (1 - share))
    first, gaps = start[0], np.log(np.diff(start))
    weights, seen = np.zeros(width), np.full(width, 1e-6)
    free_seen = np.full(grades_n - 1, 1e-2)
    rng = np.random.default_rng(seed)
    for _ in range(epochs if len(np.unique(grades)) > 1 else 0):
        for part in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 64)):
            features = np.concatenate([rows[i][0] for i in part])
            values = np.concatenate([rows[i][1] for i in part]).astype(np.float64)
            owner = np.repeat(np.arange(len(part)), [len(rows[i][0]) for i in part])
            scores = np.bincount(owner, weights[features] * values, len(part))
            bounds = np.concatenate(([first], first + np.cumsum(np.exp(gaps))))
            edge = np.concatenate(([-60.0], bounds, [60.0]))
            y = grades[part]
            upper = 1 / (1 + np.exp(-np.clip(edge[y + 1] - scores, -60, 60)))
            lower = 1 / (1 + np.exp(-np.clip(edge[y] - scores, -60, 60)))
            chance = np.maximum(upper - lower, 1e-12)
            up, low = upper * (1 - upper) / chance, lower * (1 - lower) / chance
            slope = (up - low) / len(part)  # d(-log chance) / d score
            gradient = np.bincount(features, slope[owner] * values, width) + decay * weights
            seen += gradient**2
            weights -= rate * gradient / np.sqrt(seen)
            by_bound = np.bincount(y, low, grades_n)[1:] - np.bincount(y, up, grades_n)[:-1]
            by_bound = by_bound / len(part)
            free = np.concatenate(([by_bound.sum()], np.exp(gaps) * np.cumsum(by_bound[::-1])[::-1][1:]))
            free_seen += free**2
            step = 0.1 * free / np.sqrt(free_seen)
            first, gaps = first - step[0], gaps - step[1:]
    return OrdinalModel(weights, np.concatenate(([first], first + np.cumsum(np.exp(gaps)))))


def grade_of(quality: str = "quality", toxic: str = "toxic") -> Column:
    """0 toxic, 1 of low quality, 2 good; null where a rating is missing."""
    return F.when(F.col(toxic).isNull() | F.col(quality).isNull(), F.lit(None)).when(F.col(toxic) != 0, 0).when(F.col(quality) == 0, 1).otherwise(2)


def fit(docs: DataFrame, ratings: DataFrame, sample: int = SAMPLE, text_col: str = "text", id_col: str = "doc_id") -> OrdinalModel | None:
    """Fit on at most ``sample`` rated documents; None if no document is rated.

    ``ratings``: ``id_col`` and ``grade`` (0, 1, 2; null rows are ignored). Of repeated ids the
    lowest grade counts, of repeated documents each. Ids are chosen by the smallest hash, so
    the choice depends on neither order nor size; their rows are hashed on the executors,
    and what reaches the driver is bounded by ``sample``.
    """
    rated = ratings.where(F.col("grade").isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.min("grade").cast("int").alias("_grade"))
    chosen = rated.orderBy(F.xxhash64("_id"), "_id").limit(sample)

    @tidy
    def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher()
        for frame in slices(frames, "text"):
            rows = [hasher.row(t) for t in frame["text"]]
            yield pd.DataFrame({"_id": frame["_id"], "_grade": frame["_grade"], "f": [r[0].tobytes() for r in rows], "v": [r[1].tobytes() for r in rows]})

    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(F.broadcast(chosen), "_id").mapInPandas(hashed, "_id long, _grade int, f binary, v binary")
    # All partitions at once, and the choice among repeated documents made by Spark.
    first = saved(saved(rows, "rated").orderBy("_id", "f").limit(sample), "rated-first")
    rows = sorted(first.collect(), key=lambda r: (r["_id"], bytes(r["f"])))
    if not rows:
        return None
    pairs = [(np.frombuffer(r["f"], np.int32), np.frombuffer(r["v"], np.float32)) for r in rows]
    model = fit_rows(pairs, np.array([r["_grade"] for r in rows]))
    del rows, pairs
    give_back()  # the driver's part of the fit is over
    return model


def score(
    docs: DataFrame, model: OrdinalModel | None, least: int = GRADES - 1, text_col: str = "text", out_col: str = "rating"
) -> DataFrame:
    """Add a struct ``out_col`` (expected_grade, tail_probability, grade) to each row of ``docs``.

    ``tail_probability`` is that of grade ``least`` or better, ``grade`` the likeliest one. A null
    or empty text has no features and gets the shares that the thresholds alone say.
    Without a model all three are null. All columns stay; one named ``out_col`` is replaced.
    """
    columns = [c for c in docs.columns if c.lower() != out_col.lower()]
    if model is None:
        none = F.lit(None).cast("double")
        return docs.select(*columns, F.struct(none.alias("expected_grade"), none.alias("tail_probability"), none.cast("int").alias("grade")).alias(out_col))
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<expected_grade:double,tail_probability:double,grade:int>")
    @tidy
    def rate(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = held.value
        added = TokenScores(own.weights)
        for texts in parts:
            scores = np.array([added.score(text) for text in texts], float)
            chances = own.probabilities(scores)
            yield pd.DataFrame(
                {
                    "expected_grade": chances @ np.arange(chances.shape[1]),
                    "tail_probability": chances[:, least:].sum(axis=1),
                    "grade": chances.argmax(axis=1).astype(np.int32),
                }
            )

    return docs.select(*columns, rate(F.col(text_col).cast("string")).alias(out_col))


def select_good(docs: DataFrame, ratings: DataFrame, least_chance: float = LEAST_CHANCE, **options) -> DataFrame:
    """Rows whose chance of the best grade is at least ``least_chance``; all rows if nothing is rated. Columns are those of ``docs``."""
    rating = free_name(docs, "rating")
    scored = score(docs, fit(docs, ratings, **options), out_col=rating)
    chance = F.col(f"{rating}.tail_probability")
    return scored.where(chance.isNull() | (chance >= least_chance)).select(*docs.columns)
