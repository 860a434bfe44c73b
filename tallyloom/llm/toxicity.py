"""Toxicity scores from a factorization machine over hashed terms.

A text is the set of its hashed words.  The score is the logistic of a bias, a weight for each
term, and the inner products of the latent vectors of each pair of terms, so two words that
are harmless alone can weigh together what an additive model misses.  The machine holds every
term of its training rows, a bounded, hash-chosen sample of the labelled ones, and is fitted to them
with numpy; its size is bounded by the number of buckets, it is broadcast, and scoring is one pass
over all whole texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, LOWER, materialize, slices, text_buffer, without, word_bounds, word_hashes

TERM_BITS = 20


def term_buckets(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each word (letters and digits, lower-cased) and the n + 1 word offsets of the rows."""
    low = LOWER[buf]
    starts, ends, at = word_bounds(low, offsets, ALNUM)
    return (word_hashes(low, starts, ends) >> np.uint64(64 - TERM_BITS)).astype(np.int32), at


@dataclass(frozen=True)
class FactorizationMachine:
    bias: float
    linear: np.ndarray  # features
    factors: np.ndarray  # features x k
    feature_of: np.ndarray  # bucket -> feature or -1

    def scores(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        rows = len(offsets) - 1
        buckets, at = term_buckets(buf, offsets)
        feature = self.feature_of[buckets]
        hit = np.flatnonzero(feature >= 0)
        row = np.searchsorted(at, hit, "right") - 1
        pairs = np.unique(row.astype(np.int64) << 32 | feature[hit].astype(np.int64))
        row, feature = pairs >> 32, pairs & 0xFFFFFFFF
        z = self.bias + np.bincount(row, self.linear[feature], rows)
        for v in self.factors.T:
            z += 0.5 * (np.bincount(row, v[feature], rows) ** 2 - np.bincount(row, v[feature] ** 2, rows))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def labelled_terms(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_rows: int, max_terms: int = 8_000_000) -> list:
    """Distinct term buckets and the label of the training rows: all of them, or about ``max_rows`` by a hash of the
    id, and in all about ``max_terms`` terms, so that neither repeated ids nor long texts fill the driver.

    The sample of labels is bounded, so it is broadcast and the texts are never shuffled.
    """
    known = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).groupBy("id").agg(F.max("y").alias("y"))
    n = known.count()
    if n > max_rows:
        known = known.where(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < int(1_000_003 * max_rows / n))

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = text_buffer(batch.column(0))
            out = []
            for i, j in slices(offsets):
                buckets, at = term_buckets(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                out += [np.unique(buckets[a:b]).astype("<i4").tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(out, pa.binary())], ["y", "terms"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), "id").select("text", "y")
    found = materialize(rows.mapInArrow(terms, "y int, terms binary"))
    size = found.agg(F.count("*").alias("rows"), F.sum(F.octet_length("terms") / 4).alias("terms")).first()
    share = min(1.0, max_rows / max(size.rows, 1), max_terms / max(size.terms or 0, 1))
    return (found if share > 0.9 else found.sample(share, 5)).collect()


def _logit(ones: np.ndarray, of: np.ndarray) -> np.ndarray:
    return np.log((ones + 0.5) / (of - ones + 0.5))


def single_terms(df1: np.ndarray, df0: np.ndarray, n1: float, n0: float, least_g: float) -> np.ndarray:
    """Features whose presence says much about the label: likelihood ratio of the 2 x 2 table of ``least_g`` or more."""
    seen, n = df1 + df0, n1 + n0
    part = lambda o, e: np.where(o > 0, o * np.log(np.maximum(o, 1e-9) / np.maximum(e, 1e-9)), 0)
    g = 2 * (part(df1, seen * n1 / n) + part(df0, seen * n0 / n) + part(n1 - df1, (n - seen) * n1 / n) + part(n0 - df0, (n - seen) * n0 / n))
    return np.flatnonzero(g >= least_g)


def joint_terms(sets: list[np.ndarray], y: np.ndarray, weight: np.ndarray, df1: np.ndarray, df0: np.ndarray, among: int, pairs: int, least_z: float) -> np.ndarray:
    """Features of the ``pairs`` pairs whose joint presence says most beyond both terms.

    Among the ``among`` most frequent features, a pair is held against what its terms' log odds add up
    to; it counts if 20 rows or more hold both and the label's share is ``least_z`` standard errors off.
    """
    seen = df1 + df0
    frequent = np.lexsort((np.arange(len(seen)), -seen))[:among]
    frequent = frequent[seen[frequent] >= 20]
    at = np.full(len(seen), -1, np.int32)
    at[frequent] = np.arange(len(frequent))
    both, toxic = np.zeros((len(frequent),) * 2, np.float32), np.zeros((len(frequent),) * 2, np.float32)
    for i in range(0, len(sets), 2048):
        x = np.zeros((len(sets[i : i + 2048]), len(frequent)), np.float32)
        for row, s in enumerate(sets[i : i + 2048]):
            held = at[s]
            x[row, held[held >= 0]] = 1
        xw = x * weight[i : i + 2048, None]
        both += xw.T @ x
        toxic += (xw * y[i : i + 2048, None]).T @ x
    alone = _logit(df1[frequent], seen[frequent])
    p = 1 / (1 + np.exp(-np.clip(alone[:, None] + alone[None, :] - _logit((y * weight).sum(), weight.sum()), -6, 6)))
    z = np.abs(toxic - both * p) / np.sqrt(np.maximum(both * p * (1 - p), 1e-9))
    z[(both < 20) | np.tri(len(frequent), dtype=bool)] = 0
    best = np.argsort(-z, axis=None, kind="stable")[:pairs]
    best = best[z.ravel()[best] >= least_z]
    return frequent[np.unique(np.concatenate(np.unravel_index(best, z.shape)))] if len(best) else frequent[:0]


def fit(rows: list, k: int = 4, least_g: float = 15.0, among: int = 1024, pairs: int = 64, least_z: float = 6.0, steps: int = 100, penalty: tuple[float, float] = (1e-4, 1e-5), prior: tuple[float, float] = (1.0, 10.0), seed: int = 3) -> FactorizationMachine:
    """Fit on (label, distinct buckets) rows.

    Every bucket of the rows is a feature with a weight and factors; none is dropped.  Descent on the
    logistic loss takes two paces.  Terms that say much alone (``single_terms``) or in pairs
    (``joint_terms``) start with random factors and move by Adam with small quadratic penalties, the linear
    one heavier, so that what single terms and pairs both explain goes to the pairs.  All other terms,
    of which most are rare, start at zero and move by their slope over a bound on its change, held to
    normal priors of precision ``prior`` (weights, factors), so a term counts as far as its own rows
    support it; their factors follow every tenth step.  Equal rows count as one with a weight.  Without
    rows of both labels every score is the labels' mean (0.5 if none).
    """
    feature_of = np.full(1 << TERM_BITS, -1, np.int32)
    times: dict[tuple[bytes, int], int] = {}
    for label, terms in rows:
        times[bytes(terms), int(label)] = times.get((bytes(terms), int(label)), 0) + 1
    y, weight = np.array([label for _, label in times], np.float64), np.array(list(times.values()), np.float64)
    sets = [np.frombuffer(terms, "<i4") for terms, _ in times]
    n1, n0 = float((y * weight).sum()), float(((1 - y) * weight).sum())
    bias = float(np.log((n1 + 0.5) / (n0 + 0.5)))
    if not (n1 and n0 and any(map(len, sets))):
        return FactorizationMachine(bias, np.zeros(1), np.zeros((1, k)), feature_of)
    known = np.unique(np.concatenate(sets))
    feature_of[known] = np.arange(len(known))
    sets = [feature_of[s] for s in sets]
    df1, df0 = np.zeros(len(known)), np.zeros(len(known))
    for s, label, w in zip(sets, y, weight, strict=True):
        (df1 if label else df0)[s] += w
    chosen = np.union1d(single_terms(df1, df0, n1, n0, least_g), joint_terms(sets, y, weight, df1, df0, among, pairs, least_z)).astype(int)
    place = np.full(len(known), -1)
    place[chosen] = np.arange(len(chosen))
    every = _Cells(sets, len(known))
    told = every.part(place)
    linear, factors, total = np.zeros(len(known)), np.zeros((len(known), k)), n1 + n0
    theta = [np.array([bias]), np.zeros(len(chosen)), np.random.default_rng(seed).normal(0, 0.1, (len(chosen), k))]
    mean, square = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    other, length = place < 0, np.array([len(s) for s in sets])
    bound, speed = 0.25 * every.by_feature(weight * length), np.zeros(len(known))
    rest_s, rest_q = np.zeros((len(sets), k)), np.zeros(len(sets))
    for step in range(1, steps + 1):
        ahead = linear + (step - 1) / (step + 2) * speed
        s, q = told.factor_sums(theta[2])
        s, q = s + rest_s, q + rest_q
        z = theta[0][0] + told.by_row(theta[1]) + every.by_row(ahead) + 0.5 * ((s**2).sum(1) - q)
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
        grads = told.slope(d / total, s, theta[2])
        grads = [grads[0], grads[1] + penalty[0] * theta[1], grads[2] + penalty[1] * theta[2]]
        speed = ahead - other * (every.by_feature(d) + prior[0] * ahead) / (bound + prior[0]) - linear
        linear = linear + speed
        if step % 10 == 0:
            steep = 0.25 * every.by_feature(weight * length * (s**2).sum(1))
            slope = every.slope(d, s, factors)[2] + prior[1] * factors
            factors = factors - other[:, None] * slope / (steep + prior[1])[:, None]
            rest_s, rest_q = every.factor_sums(factors)
        for t, m, v, g in zip(theta, mean, square, grads, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g**2 - v)
            t -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    linear[chosen], factors[chosen] = theta[1], theta[2]
    return FactorizationMachine(float(theta[0][0]), linear, factors, feature_of)


class _Cells:
    """The features of all rows as pairs (row, feature), and sums over them."""

    def __init__(self, sets: list[np.ndarray], features: int):
        self.rows, self.features = len(sets), features
        self.row, self.at = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets).astype(np.int64)

    def part(self, place: np.ndarray) -> _Cells:
        """Only the features that have a place, by it."""
        out = object.__new__(_Cells)
        kept = place[self.at] >= 0
        out.rows, out.features, out.row, out.at = self.rows, int(place.max(initial=-1)) + 1, self.row[kept], place[self.at[kept]]
        return out

    def by_row(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, x[self.at], self.rows)

    def by_feature(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, x[self.row], self.features)

    def factor_sums(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's sum of factors, and its sum of their squares."""
        return np.stack([self.by_row(f) for f in v.T], 1), self.by_row((v**2).sum(1))

    def slope(self, d: np.ndarray, s: np.ndarray, v: np.ndarray) -> list[np.ndarray]:
        """Gradient by bias, linear weights and factors, from the rows' slopes ``d`` and sums of factors ``s``."""
        once = self.by_feature(d)
        return [np.array([d.sum()]), once, np.stack([self.by_feature(d * part) for part in s.T], 1) - v * once[:, None]]


def score_toxicity(df: DataFrame, model: FactorizationMachine, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """Add score (0 to 1) and predicted (1 where score >= 0.5) to every row, from its whole text.

    A null or empty text has no terms and gets the score of the bias alone.  Repeated rows score
    alike; an empty table stays empty; columns of the added names are replaced.
    """
    names = ["score", "predicted"]
    df = without(df, [n for n in names if n != text_col])
    shared = df.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in df.schema.fields if keep_text or f.name != text_col]
    schema = T.StructType(kept + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            buf, offsets = text_buffer(batch.column(batch.schema.get_field_index(text_col)))
            parts = [model.scores(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in slices(offsets)]
            score = np.concatenate(parts) if parts else np.empty(0)
            rest = [(f.name, batch.column(batch.schema.get_field_index(f.name))) for f in kept]
            yield pa.RecordBatch.from_arrays([*(c for _, c in rest), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], [*(n for n, _ in rest), *names])

    return df.mapInArrow(scored, schema)
