"""Document fingerprints by consistent weighted sampling."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from pathloom.llm.common import LOWER, utf8

SAMPLES = 64
STEPS = 1 << 16
HELD = 1 << 16  # terms whose values are held at once


def gamma_quantiles() -> np.ndarray:
    """Gamma(2, 1) at the middle of each of ``STEPS`` equal steps of its distribution 1 - (1 + x) exp(-x)."""
    want = (np.arange(STEPS) + 0.5) / STEPS
    low, high = np.zeros(STEPS), np.full(STEPS, 64.0)
    for _ in range(60):
        middle = (low + high) / 2
        below = 1 - (1 + middle) * np.exp(-middle) < want
        low, high = np.where(below, middle, low), np.where(below, high, middle)
    return low


GAMMA = gamma_quantiles().astype(np.float32)
LOG_GAMMA = np.log(GAMMA)
KEYS = np.random.default_rng(0x5EED).integers(1, 1 << 63, (2, SAMPLES), dtype=np.uint64) | np.uint64(1)


def mixed(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """One 64-bit hash per value and key."""
    with np.errstate(over="ignore"):
        x = (values[:, None] ^ (values[:, None] >> np.uint64(31))) * keys[None]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(29))


def terms(text: str | None, words: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(hash, weight) of the distinct runs of ``words`` words, A-Z in lower case; the weight is the count.

    A text of fewer words is one term; one without words has none.
    """
    own = utf8(text).translate(LOWER).split()
    if not own:
        return np.zeros(0, np.uint64), np.zeros(0)
    single = np.array(list(map(xxhash.xxh3_64_intdigest, own)), np.uint64)
    size = min(words, len(own))
    hashes = np.full(len(own) - size + 1, size, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            hashes = (hashes ^ (hashes >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) + single[k : k + len(hashes)]
        hashes = (hashes ^ (hashes >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    hashes, counts = np.unique(hashes, return_counts=True)
    return hashes, counts.astype(np.float64)


def draws(own: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r and log c, both of Gamma(2, 1), and beta of terms, from one hash each."""
    x = mixed(own, keys)
    low = np.uint64(STEPS - 1)
    beta = (x >> np.uint64(40)).astype(np.float32) * np.float32(2.0**-24)
    return GAMMA[x & low], LOG_GAMMA[(x >> np.uint64(16)) & low], beta


def values(hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """log(c / (y exp(r))) of each term and sample, with t = floor(log(weight) / r + beta) and y = exp(r (t - beta))."""
    out = np.empty((len(hashes), SAMPLES), np.float32)
    for at in range(0, len(hashes), 256):
        logs = np.log(weights[at : at + 256]).astype(np.float32)[:, None]
        r, log_c, beta = draws(hashes[at : at + 256], KEYS[0])
        out[at : at + 256] = log_c - r * (np.floor(logs / r + beta) - beta + np.float32(1))
    return out


def drawn(hashes: np.ndarray, weights: np.ndarray, value: np.ndarray) -> np.ndarray:
    """16-bit codes of the smallest value of each sample: of its term, and of its t."""
    if not len(hashes):
        return np.zeros(SAMPLES, np.uint16)
    row = value.argmin(axis=0)
    term = hashes[row]
    logs = np.log(weights[row]).astype(np.float32)
    r, _, beta = (x.diagonal() for x in draws(term, KEYS[0]))
    level = np.floor(logs / r + beta).astype(np.int64).view(np.uint64)
    with np.errstate(over="ignore"):
        code = term + level * np.uint64(0x9E3779B97F4A7C15)
        code = (code ^ (code >> np.uint64(32))) * KEYS[1]
    return np.maximum(code >> np.uint64(48), np.uint64(1)).astype(np.uint16)


def sample(hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """One drawn (term, level) per sample, as 16-bit codes; zeros for no terms.

    For each term and sample, r and c are Gamma(2, 1) and beta is uniform, all from the term's
    hash alone. The term with the smallest c / (y exp(r)) is drawn, together with its t (see
    ``values``). Two weightings draw the same with a chance of their generalised Jaccard
    similarity, sum of the smaller weights over sum of the larger.
    """
    out, least = np.zeros(SAMPLES, np.uint16), np.full(SAMPLES, np.inf, np.float32)
    for at in range(0, len(hashes), HELD):
        own, weight = hashes[at : at + HELD], weights[at : at + HELD]
        value = values(own, weight)
        low = value.min(axis=0)
        out = np.where(low < least, drawn(own, weight, value), out)
        least = np.minimum(low, least)
    return out


@dataclass
class Sampled:
    """The terms of a text, in order of hash, with their values and what was drawn.

    Of a text with more than ``HELD`` terms only the last is kept.
    """

    hashes: np.ndarray
    weights: np.ndarray
    values: np.ndarray
    codes: np.ndarray

    @classmethod
    def of(cls, text: str | None) -> "Sampled":
        hashes, weights = terms(text)
        if len(hashes) > HELD:
            return cls(hashes[:0], weights[:0], np.zeros((0, SAMPLES), np.float32), sample(hashes, weights))
        value = values(hashes, weights)
        return cls(hashes, weights, value, drawn(hashes, weights, value))

    def resampled(self, text: str | None) -> np.ndarray:
        """The codes of a text that shares most of its terms: values of a term and weight are taken over."""
        hashes, weights = terms(text)
        if not len(self.hashes) or not 0 < len(hashes) <= HELD:
            return sample(hashes, weights)
        place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        same = (self.hashes[place] == hashes) & (self.weights[place] == weights)
        value = np.empty((len(hashes), SAMPLES), np.float32)
        value[same] = self.values[place[same]]
        value[~same] = values(hashes[~same], weights[~same])
        return drawn(hashes, weights, value)


def fingerprint(text: str | None) -> np.ndarray:
    return sample(*terms(text))


def shown(codes: np.ndarray) -> str:
    """Four hexadecimal digits per sample."""
    return codes.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of equal samples; 1 for two texts without words."""
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many (or all) of ``following``."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def fingerprints(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``fingerprint`` (hexadecimal digits) to each row. A null or empty text has all zeros."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([shown(fingerprint(t)) for t in texts], dtype=object)

    return docs.withColumn("fingerprint", run(F.col(text_col).cast("string")))


RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def neighbour_likeness(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Fingerprints of each text, of its edited text, and their likeness; and to the next document's.

    The next document is that with the next id, after the last one the first. Rows are dealt
    to ranges of ids, cut at approximate quantiles, and stream through a task in order. The
    first row of each range is also sent to the range before it, so text is moved once.

    A null text is empty. Null ids come first; of equal ids, texts are in order, so repeated
    rows are each other's next. A table of one row is its own next. Other columns are ignored.
    """
    spark = docs.sparkSession
    least = -(1 << 63)
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(least)).alias("place"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx("place", [i / parts for i in range(1, parts)] or [0.5], 100 * parts)).first()[0] or []
    cuts = np.unique(np.array(cuts, np.int64))

    @F.pandas_udf("int")
    def range_of(place: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, place.to_numpy(np.int64), "right").astype(np.int32))

    # One row per range, of which there are as many as shuffle partitions.
    heads = rows.select("place").withColumn("part", range_of("place")).groupBy("part").agg(F.min("place").alias("head")).orderBy("part").collect()
    before = {heads[i]["head"]: heads[i - 1]["part"] for i in range(len(heads))}
    first_of = F.create_map(*[F.lit(x) for pair in before.items() for x in pair]) if before else F.lit(None).cast("map<bigint,int>")
    dealt = rows.withColumn("part", range_of("place"))
    dealt = dealt.withColumn(
        "to",
        F.explode(
            F.filter(
                F.array(F.struct(F.col("part").alias("part"), F.lit(0).alias("guest")), F.struct(F.element_at(first_of, F.col("place")).alias("part"), F.lit(1).alias("guest"))),
                lambda x: x["part"].isNotNull(),
            )
        ),
    ).select("place", "text", F.col("to.part").alias("part"), F.col("to.guest").alias("guest"))

    def stream(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def done(row: tuple, following: tuple) -> tuple:
            doc, text, own = row
            changed = edited(text, following[1])
            other = own.resampled(changed)
            digest = hashlib.sha256(utf8(changed)).hexdigest()
            near = likeness(own.codes, other), likeness(own.codes, following[2].codes)
            return doc, len(text), digest, shown(own.codes), shown(other), *near

        names = RESULT.replace(" long", "").replace(" string", "").replace(" double", "").split(", ")
        last, part, guest_seen = None, None, False
        for frame in frames:
            out = []
            for doc, text, own_part, guest in zip(frame["place"], frame["text"], frame["part"], frame["guest"]):
                if own_part != part:
                    last, part, guest_seen = None, own_part, False
                if guest_seen:
                    continue  # rows that share the next range's first id: the first of them is the next row
                row = (doc, text, Sampled.of(text))
                if last is not None:
                    out.append(done(last, row))
                last = row
                guest_seen = bool(guest)
            yield pd.DataFrame(out, columns=names)

    ordered = dealt.repartition(parts, "part").sortWithinPartitions("part", "guest", "place", "text")
    return ordered.mapInPandas(stream, RESULT).withColumn("doc_id", F.when(F.col("doc_id") != least, F.col("doc_id")))
