"""Language identification with error-correcting output codes.

Each language gets a codeword of bits.  Every bit has a binary classifier over hashed byte n-grams:
a linear function of a text's n-gram frequencies, which starts from the log ratio of the
frequencies in the languages whose bit is 1 to those in the others and is then fitted to the bit
by descent on its logistic loss.  Bits weigh in the decoding by how seldom their classifier errs on
the training rows; the codeword with the least weighted loss wins, and a small gap to the second
marks the text as ambiguous.

The training rows are a bounded, hash-chosen sample; their n-grams stay in the executors, and a step
of the descent is one Spark job that brings only sums of fixed size (bits x buckets) to the driver.
The model is broadcast; scoring is one pass over all whole texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, materialize, slices, text_buffer, without

BUCKET_BITS = 15
GRAMS = (2, 3, 4)
UNKNOWN = "und"
#: Lower case, and every byte that is no letter as a space.
FOLD = LOWER.copy()
FOLD[[b for b in range(128) if not (65 <= b <= 90 or 97 <= b <= 122)]] = 32


def gram_buckets(buf: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram length: bucket of the n-gram at each byte, and which of them lie inside one row and aren't all spaces."""
    b = FOLD[buf].astype(np.uint32)
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(b))  # bytes to the row's end
    value = b.copy()
    for n in range(2, max(GRAMS) + 1):
        value[: len(b) - n + 1] = (value[: len(b) - n + 1] << np.uint32(8)) | b[n - 1 :]
        if n in GRAMS:
            hashed = (value ^ np.uint32(n * 0x1F123BB5)) * np.uint32(0x9E3779B1)
            hashed ^= hashed >> np.uint32(15)
            hashed *= np.uint32(0x85EBCA77)
            yield hashed >> np.uint32(32 - BUCKET_BITS), (left >= n) & ~((b == 32) & (np.append(b[1:], np.uint32(32)) == 32))


def codewords(k: int, seed: int = 5) -> np.ndarray:
    """k codewords of +1 and -1: every split of the classes up to 7 of them, else the best of random dense codes."""
    if k <= 7:
        splits = [[(s >> i & 1) for i in range(k)] for s in range(1, 1 << max(k - 1, 0))]
        return np.array(splits, np.int8).reshape(-1, k).T * 2 - 1 if k > 1 else np.ones((k, 1), np.int8)
    rng, bits = np.random.default_rng(seed), int(np.ceil(10 * np.log2(k)))
    tries = [rng.integers(0, 2, (k, bits)) * 2 - 1 for _ in range(50)]
    apart = lambda c: (bits - (c @ c.T))[~np.eye(k, dtype=bool)].min()
    return max(tries, key=apart).astype(np.int8)


@dataclass(frozen=True)
class LanguageModel:
    langs: list[str]
    codes: np.ndarray  # languages x bits
    weights: np.ndarray  # bits x buckets
    trust: np.ndarray  # weight of each bit in the decoding

    def margins(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean log ratio of each row and bit, and the rows' n-gram counts."""
        rows = len(offsets) - 1
        total, grams = np.zeros((rows, len(self.weights))), np.zeros(rows)
        full = np.flatnonzero(np.diff(offsets))
        if not len(full):
            return total, grams
        for bucket, valid in gram_buckets(buf, offsets):
            at = np.where(valid, bucket, 1 << BUCKET_BITS)
            grams[full] += np.add.reduceat(valid.astype(np.float64), offsets[:-1][full])
            for bit, w in enumerate(self.weights):
                total[full, bit] += np.add.reduceat(w[at], offsets[:-1][full], dtype=np.float64)
        return total / np.maximum(grams, 1)[:, None], grams

    def decode(self, margins: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest codeword by weighted loss, its share of the weight in (0, 1], and the second's."""
        sure = margins * sureness(grams)[:, None]
        loss = np.stack([np.logaddexp(0, -sure * code) @ self.trust for code in self.codes.astype(np.float64)], 1)
        p = np.exp(loss.min(1, keepdims=True) - loss)
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        top = np.sort(p, 1)
        return best, top[:, -1], top[:, -2] if p.shape[1] > 1 else np.zeros(len(p))


def sureness(grams: np.ndarray) -> np.ndarray:
    """How much a mean over so many n-grams counts: texts of a few letters say little."""
    return 4.0 * np.minimum(grams, 30) / 30


def sample(df: DataFrame, text_col: str, lang_col: str, train: Column, max_rows: int, least_rows: int, max_langs: int) -> DataFrame:
    """(text, lang) of the training rows, or where they are more, of about ``max_rows`` and of each language about
    ``least_rows`` or all it has.

    Every row is chosen by itself, by a hash of its number in the scan: columns of any type may stand
    beside, and a text that stands in very many rows is chosen as often as its share says.  More
    than ``max_langs`` language values are refused, as the model grows with them.
    """
    pick = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1_000_003))
    rows = df.where(train & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    by_lang = {r.lang: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(max_langs + 1).collect()}
    if len(by_lang) > max_langs:
        raise ValueError(f"{lang_col} has more than max_langs = {max_langs} values")
    n = sum(by_lang.values())
    if n > max_rows:
        cuts = df.sparkSession.createDataFrame([(lang, int(1_000_003 * min(1, max(max_rows / n, least_rows / m)))) for lang, m in by_lang.items()], "lang string, cut int")
        rows = rows.withColumn("pick", pick).join(F.broadcast(cuts), "lang").where("pick < cut")
    return rows.select("text", "lang")


def _grams_of(rows: DataFrame) -> DataFrame:
    """(lang, n, buckets, counts): the number of n-grams of each row, its distinct buckets and how often it has each."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = text_buffer(batch.column(0))
            n, buckets, counts = [], [], []
            for i, j in slices(offsets, 500_000):
                part, at = buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                row = np.repeat(np.arange(j - i, dtype=np.uint32 if j - i < 1 << 32 - BUCKET_BITS else np.uint64) << BUCKET_BITS, np.diff(at))
                keys = [(row | bucket)[valid] for bucket, valid in gram_buckets(part, at)]
                keys, times = np.unique(np.concatenate(keys), return_counts=True)
                cut = np.searchsorted(keys, np.arange(j - i + 1, dtype=np.uint64) << np.uint64(BUCKET_BITS))
                for a, b in zip(cut[:-1], cut[1:], strict=True):
                    n.append(int(times[a:b].sum()))
                    buckets.append((keys[a:b] & ((1 << BUCKET_BITS) - 1)).astype("<u2").tobytes())
                    counts.append(times[a:b].astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(n, pa.int64()), pa.array(buckets, pa.binary()), pa.array(counts, pa.binary())], ["lang", "n", "buckets", "counts"])

    return rows.mapInArrow(counted, "lang string, n long, buckets binary, counts binary")


def _blocks(batch: pa.RecordBatch, rows: int = 128) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of up to ``rows`` rows of ``_grams_of``: first and last row, their n-gram counts, and their frequencies by bucket."""
    n, buckets, counts = batch.column(1).to_numpy().astype(np.float32), batch.column(2).to_pylist(), batch.column(3).to_pylist()
    for i in range(0, len(n), rows):
        j = min(len(n), i + rows)
        x = np.zeros((j - i, 1 << BUCKET_BITS), np.float32)
        for k in range(i, j):
            x[k - i, np.frombuffer(buckets[k], "<u2")] = np.frombuffer(counts[k], "<u4") / max(n[k], 1)
        yield i, j, n[i:j], x


def _step(grams: DataFrame, langs: list[str], codes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic loss, number of errors and gradient of every bit's classifier over the training rows, in one job."""
    bits, size = weights.shape
    shared = grams.sparkSession.sparkContext.broadcast(weights)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, index = shared.value, {lang: i for i, lang in enumerate(langs)}
        loss, wrong, gradient = np.zeros(bits), np.zeros(bits), np.zeros((bits, size), np.float32)
        for batch in batches:
            code = codes[[index[lang] for lang in batch.column(0).to_pylist()]].astype(np.float32)
            for i, j, n, x in _blocks(batch):
                gain = code[i:j] * sureness(n)[:, None]
                z = (x @ w.T) * gain
                loss += np.logaddexp(0, -z).sum(0)
                wrong += (z <= 0).sum(0)
                gradient -= (gain / (1 + np.exp(np.clip(z, -50, 50)))).astype(np.float32).T @ x
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (loss, wrong, gradient)], ["loss", "wrong", "gradient"])

    parts = grams.mapInArrow(summed, "loss binary, wrong binary, gradient binary").collect()
    loss, wrong, gradient = np.zeros(bits), np.zeros(bits), np.zeros((bits, size))
    for part in parts:
        loss += np.frombuffer(part.loss)
        wrong += np.frombuffer(part.wrong)
        gradient += np.frombuffer(part.gradient, np.float32).reshape(bits, size)
    shared.destroy()
    return loss, wrong, gradient


def fit(df: DataFrame, text_col: str, lang_col: str, train: Column, max_rows: int = 6_000, least_rows: int = 200, steps: int = 4, max_langs: int = 1_000) -> LanguageModel:
    """Learn from the rows where ``train`` holds and the language isn't null, or a sample of them (see ``sample``).

    Each bit's classifier starts from log ratios of n-gram frequencies and takes ``steps`` steps down
    the gradient of its loss; a step that doesn't lower a bit's loss is taken back and halved.  A bit's
    weight in the decoding is the log odds of its classifier being right on the training rows, scaled
    to mean 1.  Without a labelled row the model knows no language.
    """
    # the sample is bounded: it is dealt to a few tasks once the scan of all rows is done
    grams = materialize(_grams_of(sample(df, text_col, lang_col, train, max_rows, least_rows, max_langs)).repartition(16))
    langs = sorted(r.lang for r in grams.select("lang").distinct().collect())
    codes, size = codewords(len(langs)), 1 << BUCKET_BITS
    if len(langs) < 2:
        return LanguageModel(langs, codes, np.zeros((codes.shape[1], size + 1), np.float32), np.ones(codes.shape[1]))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), object)
            for i, j, n, x in _blocks(batch):
                for lang in set(names[i:j].tolist()):
                    sums[lang] = sums.get(lang, 0.0) + (n * (names[i:j] == lang)) @ x.astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["lang", "sums"])

    counts = np.zeros((len(langs), size))
    for part in grams.mapInArrow(counted, "lang string, sums binary").collect():
        counts[langs.index(part.lang)] += np.frombuffer(part.sums)
    freq = (counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * size)
    start = [np.clip(np.log(freq[c > 0].mean(0) / freq[c <= 0].mean(0)), -4, 4) for c in codes.T]
    weights, pace = np.array(start, np.float32), np.full((codes.shape[1], 1), 0.5)
    loss, wrong, gradient = _step(grams, langs, codes, weights)
    for _ in range(steps):
        tried = (weights - pace * gradient / np.maximum(np.abs(gradient).max(1, keepdims=True), 1e-12)).astype(np.float32)
        new_loss, new_wrong, new_gradient = _step(grams, langs, codes, tried)
        better = new_loss < loss
        weights[better], gradient[better] = tried[better], new_gradient[better]
        loss, wrong = np.where(better, new_loss, loss), np.where(better, new_wrong, wrong)
        pace[~better] /= 2
    n = grams.count()
    trust = np.log((n - wrong + 0.5) / (wrong + 0.5)).clip(0.05)
    return LanguageModel(langs, codes, np.pad(weights, ((0, 0), (0, 1))), trust / trust.mean())


def _lettered(column: pa.Array) -> np.ndarray:
    return np.array([bool(x) and (any(map(str.isalpha, x))) for x in column.to_pylist()], bool)


def identify(df: DataFrame, model: LanguageModel, text_col: str = "text", keep_text: bool = False, ambiguous_gap: float = 0.2) -> DataFrame:
    """Add lang_pred, score (0 to 1) and ambiguous to every row, judged by its whole text.

    ``und`` with score 0 where the text is null, has no letter, or nothing was learned.
    ambiguous: the best codeword's share exceeds the second's by less than ``ambiguous_gap``.
    Ties go to the language that sorts first.  Columns of the added names are replaced.
    """
    names = ["lang_pred", "score", "ambiguous"]
    df = without(df, [n for n in names if n != text_col])
    shared = df.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in df.schema.fields if keep_text or f.name != text_col]
    schema = T.StructType(kept + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text_col))
            buf, offsets = text_buffer(column)
            known = _lettered(column) & bool(model.langs)
            pred, score, close = np.full(len(column), UNKNOWN, object), np.zeros(len(column)), np.zeros(len(column), bool)
            for i, j in slices(offsets, 1_000_000) if model.langs else ():
                best, top, second = model.decode(*model.margins(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
                at = np.flatnonzero(known[i:j])
                pred[i + at] = np.array(model.langs, object)[best[at]]
                score[i + at], close[i + at] = top[at], (top - second)[at] < ambiguous_gap
            rest = [(f.name, batch.column(batch.schema.get_field_index(f.name))) for f in kept]
            yield pa.RecordBatch.from_arrays([*(c for _, c in rest), pa.array(pred, pa.string()), pa.array(score), pa.array(close)], [*(n for n, _ in rest), *names])

    return df.mapInArrow(judged, schema)
