"""Quality rules as a short-circuit cascade.

Each rule is a predicate over per-document statistics.  On a bounded sample of the documents that
the base lets through, tasks measure what each rule costs and which documents it rejects.  The
cascade takes the rule that rejects most per second, then the one that rejects most per second of
what the first leaves, and so on.  In the pass over all documents a later rule computes its statistics only for
the documents that every earlier rule let through.  The verdict does not depend on the order.
One pass, no shuffle; the statistics are numpy sums over slices of a few megabytes of text.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import NON_SPACE, mix, ranges, range_hash, row_sums, slices, text_buffer, window_hashes, without, word_bounds, word_hashes


def _members(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


SYMBOLS = _members(b"#*$%&|<>")
UPPER = _members(bytes(range(65, 91)))
LOWERS = _members(bytes(range(97, 123)))
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


class Stats:
    """Per-row statistics of a slice of texts, each computed when first asked for."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        self.buf, self.offsets, self.known = buf, offsets, {}

    def __getitem__(self, name: str) -> np.ndarray:
        if name not in self.known:
            self.known[name] = getattr(self, "_" + name)()
        return self.known[name]

    def subset(self, rows: np.ndarray) -> Stats:
        """The same for some rows; what is known of all rows is carried over."""
        lengths = np.diff(self.offsets)[rows]
        sub = Stats(self.buf[ranges(self.offsets[:-1][rows], lengths)], np.concatenate([[0], np.cumsum(lengths)]))
        sub.known = {k: v[rows] for k, v in self.known.items() if k[0] != "#"}
        return sub

    def _bounds(self):
        if "#bounds" not in self.known:
            self.known["#bounds"] = word_bounds(self.buf, self.offsets, NON_SPACE)
        return self.known["#bounds"]

    def _count(self, table: np.ndarray) -> np.ndarray:
        return row_sums(table[self.buf], self.offsets)

    def _n_words(self):
        return np.diff(self._bounds()[2])

    def _word_chars(self):
        return row_sums(NON_SPACE[self.buf] & ((self.buf & 0xC0) != 0x80), self.offsets)

    def _n_symbols(self):
        return self._count(SYMBOLS)

    def _n_upper(self):
        return self._count(UPPER)

    def _n_lower(self):
        return self._count(LOWERS)

    def _n_exclaim(self):
        return self._count(_members(b"!"))

    def _lines(self):
        """Start and end of each line that holds a word, and the row it is in."""
        if "#lines" not in self.known:
            cuts = np.unique(np.concatenate([np.flatnonzero(self.buf == 10) + 1, self.offsets]))
            starts, ends = cuts[:-1], cuts[1:]
            ends = ends - (self.buf[ends - 1] == 10) if len(ends) else ends
            words = self._bounds()[0]
            some = np.searchsorted(words, ends) > np.searchsorted(words, starts)
            starts, ends = starts[some], ends[some]
            self.known["#lines"] = starts, ends, np.searchsorted(self.offsets, starts, "right") - 1
        return self.known["#lines"]

    def _n_lines(self):
        return np.bincount(self._lines()[2], minlength=len(self.offsets) - 1)

    def _n_dup_lines(self):
        starts, ends, row = self._lines()
        key = mix(range_hash(self.buf.astype(np.uint64) + np.uint64(1), starts, ends) + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, first = np.unique(key, return_index=True)
        return self["n_lines"] - np.bincount(row[first], minlength=len(self.offsets) - 1)

    def _n_repeat_words(self):
        starts, ends, offsets = self._bounds()
        counts = np.maximum(np.diff(offsets) - 2, 0)
        at = ranges(offsets[:-1], counts)
        if not len(at):
            return np.zeros(len(self.offsets) - 1, np.int64)
        row = np.repeat(np.arange(len(counts)), counts)
        key = mix(window_hashes(word_hashes(self.buf, starts, ends), at, 3) + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        again = np.zeros(len(at), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        hit = np.zeros(len(starts) + 3, bool)
        for k in range(3):
            hit[at[again] + k] = True
        return row_sums(hit[: len(starts)], offsets)


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Stats], np.ndarray]


#: The shipped rules: what marks boilerplate, shouting, tables and symbol noise.
RULES = (
    Rule("symbols", lambda s: 10 * s["n_symbols"] > s["n_words"]),
    Rule("shouting", lambda s: s["n_upper"] > s["n_lower"]),
    Rule("exclamation", lambda s: 2 * s["n_exclaim"] > s["n_words"]),
    Rule("duplicate_lines", lambda s: 10 * s["n_dup_lines"] > 4 * s["n_lines"]),
    Rule("word_length", lambda s: (s["word_chars"] < 3 * s["n_words"]) | (s["word_chars"] > 12 * s["n_words"])),
)


def base_failed(s: Stats) -> np.ndarray:
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


def cascade(names: list[str], seconds: list[float], patterns: dict[int, int]) -> list[int]:
    """Order of the rules: each the one with the most rejections per second among the documents that
    those before it leave (ties by name).  ``patterns``: documents by the set of rules, as bits, that
    reject them."""
    left, order = dict(patterns), []
    rest = sorted(range(len(names)), key=lambda k: names[k])
    while rest:
        rejected = {k: sum(n for bits, n in left.items() if bits >> k & 1) for k in rest}
        best = max(rest, key=lambda k: (rejected[k] / max(seconds[k], 1e-9), -rest.index(k)))
        order.append(best)
        rest.remove(best)
        left = {bits: n for bits, n in left.items() if not bits >> best & 1}
    return order


def order_rules(df: DataFrame, text_col: str, rules=RULES, sample_rows: int = 2000, report: list[str] = BASE, seed: int = 7) -> list[Rule]:
    """The rules in the order of ``cascade``, from about ``sample_rows`` rows.

    Each task times the rules on its own share of the sample, which stays where it is; seconds and
    counts by pattern of rejections are all that leaves it.  Statistics that every row reports
    anyway cost a rule nothing.
    """
    total = df.count()
    sample = df.select(text_col).sample(min(1.0, sample_rows / max(total, 1)), seed)

    def timed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seconds, patterns = np.zeros(len(rules)), {}
        for batch in batches:
            buf, offsets = text_buffer(batch.column(0))
            for i, j in slices(offsets):
                stats = Stats(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                for name in report:
                    stats[name]
                passed, bits = stats.subset(np.flatnonzero(~base_failed(stats))), 0
                for k, rule in enumerate(rules):
                    alone = passed.subset(np.arange(len(passed.offsets) - 1))
                    began = time.perf_counter()
                    bits = bits | rule.rejects(alone).astype(np.int64) << k
                    seconds[k] += time.perf_counter() - began
                for pattern, n in zip(*np.unique(bits, return_counts=True), strict=True):
                    patterns[int(pattern)] = patterns.get(int(pattern), 0) + int(n)
        rows = [(k, s, 0, 0) for k, s in enumerate(seconds)] + [(-1, 0.0, bits, n) for bits, n in patterns.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.float64(), pa.int64(), pa.int64()), strict=True)], ["rule", "seconds", "pattern", "n"])

    found = sample.mapInArrow(timed, "rule int, seconds double, pattern long, n long").groupBy("rule", "pattern").agg(F.sum("seconds").alias("seconds"), F.sum("n").alias("n")).collect()
    spent = {r.rule: r.seconds for r in found}
    return [rules[k] for k in cascade([r.name for r in rules], [spent.get(k, 0.0) for k in range(len(rules))], {r.pattern: r.n for r in found if r.rule < 0})]


def apply_rules(df: DataFrame, text_col: str = "text", rules=RULES, sample_rows: int = 2000) -> DataFrame:
    """Add the base statistics, base_failed and kept to every row.

    kept is false where the base fails or any rule rejects.  A null or empty text has no words:
    all counts 0, base_failed true.  Repeated rows are judged each; an empty table stays empty;
    columns of the added names are replaced, others pass through.
    """
    names = [*BASE, "base_failed", "kept"]
    df = without(df, [n for n in names if n != text_col])
    ordered = order_rules(df, text_col, rules, sample_rows)
    schema = T.StructType([f for f in df.schema.fields if f.name != text_col] + [T.StructField(n, T.LongType()) for n in BASE] + [T.StructField(n, T.BooleanType()) for n in names[-2:]])

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = text_buffer(batch.column(batch.schema.get_field_index(text_col)))
            out: list[list[np.ndarray]] = [[] for _ in names]
            for i, j in slices(offsets):
                stats = Stats(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                base = [stats[n] for n in BASE]
                failed = base_failed(stats)
                alive = np.flatnonzero(~failed)
                rest = stats.subset(alive)
                for rule in ordered:
                    passed = np.flatnonzero(~rule.rejects(rest))
                    if len(passed) < len(alive):
                        alive, rest = alive[passed], rest.subset(passed)
                kept = np.zeros(j - i, bool)
                kept[alive] = True
                for column, values in zip(out, [*base, failed, kept], strict=True):
                    column.append(values)
            rows = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != text_col]
            added = [pa.array(np.concatenate(x) if x else np.empty(0), pa.bool_() if n in names[-2:] else pa.int64()) for n, x in zip(names, out, strict=True)]
            yield pa.RecordBatch.from_arrays([*(c for _, c in rows), *added], [*(n for n, _ in rows), *names])

    return df.mapInArrow(judged, schema)
