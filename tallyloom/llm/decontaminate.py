"""Benchmark decontamination with training suffix arrays.

Every task builds suffix arrays over the words of its shard of the training text and
binary-searches all test suffixes in them.  A test window (``window`` consecutive words of an
item, or the whole of a shorter item) is the head of one test suffix, so its interval in the
suffix array lists every place where it occurs.  Places that follow each other in the document and
in the item are one match; its two ends are extended to the longest verbatim match by bisecting
the length on prefix hashes, so a match costs the logarithm of its length.  Suffixes whose first words include one that no test item holds can't
match and are left out of the arrays, and suffixes are sorted by as many words as a window
has, so a shard is small and its memory bounded by ``SLICE_BYTES`` of text.

The test items are broadcast in blocks of a checked size.  One block needs one pass without a
shuffle; for more blocks each pass writes the documents it touches, and the parts are merged
by document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, LOWER, U64, fresh, materialize, mix, prefix_hash, prefix_sums, ranges, row_sums, slices, text_buffer, without, word_bounds, word_hashes

ADDED = ["n_words", "n_hit", "n_items", "items", "matches", "longest_match", "longest_item"]
MATCHES = "array<struct<item: string, doc_word: long, item_word: long, words: long>>"
SCHEMA = f"n_words long, n_hit long, n_items long, items array<string>, matches {MATCHES}, longest_match long, longest_item string"
PARTS = f"n_words long, hits array<int>, items array<string>, matches {MATCHES}, longest_match long, longest_item string"


KIND = pa.list_(pa.struct([("item", pa.string()), ("doc_word", pa.int64()), ("item_word", pa.int64()), ("words", pa.int64())]))


def words_of(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word (letters and digits, A-Z lower-cased) and the rows' word offsets."""
    low = LOWER[buf]
    starts, ends, at = word_bounds(low, offsets, ALNUM)
    return word_hashes(low, starts, ends), at


class TestSuffixes:
    """The words of test items as small integers, their distinct windows, and the items of each window."""

    __test__ = False

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        self.names = [str(name) for name, _ in items]
        texts = pa.array([text for _, text in items], pa.string())
        hashes, at = words_of(*text_buffer(texts))
        self.vocabulary, ids = np.unique(hashes, return_inverse=True)
        # one border after each item, so that no match runs from one item into the next
        lengths = np.diff(at)
        self.ids = np.full(len(ids) + len(lengths) + window, -2, np.int32)
        self.starts = at[:-1] + np.arange(len(lengths))
        self.ids[ranges(self.starts, lengths)] = ids
        by_words: dict[bytes, list[int]] = {}
        heads: list[tuple[int, int]] = []
        self.owners: list[list[int]] = []
        for item, (start, n) in enumerate(zip(self.starts, lengths, strict=True)):
            m = min(window, n)
            for p in range(start, start + n - m + 1) if n else ():
                key = self.ids[p : p + m].tobytes()
                k = by_words.setdefault(key, [len(heads)])[0]
                if k == len(heads):
                    heads.append((p, m))
                    self.owners.append([])
                if not self.owners[k] or self.owners[k][-1] != item:
                    self.owners[k].append(item)
        self.heads = np.array(heads, np.int64).reshape(-1, 2)
        self.depth = int(self.heads[:, 1].max(initial=0))
        self.least = int(self.heads[:, 1].min(initial=0))
        self.prefix = prefix_sums(mix(self.ids.astype(np.int64).view(U64)))
        bits = min(22, max(10, int(len(self.vocabulary) * 8).bit_length()))
        self.shift = np.uint64(64 - bits)
        slot = (self.vocabulary >> self.shift).astype(np.int64)
        self.table = np.searchsorted(slot, np.arange((1 << bits) + 1)).astype(np.int32)
        self.probes = int(np.bincount(slot, minlength=1).max(initial=0))

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each training word, -1 for words that no item holds."""
        out = np.full(len(hashes), -1, np.int32)
        if not len(self.vocabulary):
            return out
        slot = (hashes >> self.shift).astype(np.int64)
        low, high = self.table[slot], self.table[slot + 1]
        at = np.flatnonzero(high > low)
        low, high, hashes = low[at], high[at], hashes[at]
        for probe in range(self.probes):
            here = low + probe
            hit = (here < high) & (self.vocabulary[np.minimum(here, len(self.vocabulary) - 1)] == hashes)
            out[at[hit]] = here[hit]
        return out


def _keys(ids: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The next ``depth`` word numbers from each place as one string that sorts like the words."""
    pieces = (ids[at[:, None] + np.arange(depth)] + 3).astype(">u4")
    return np.ascontiguousarray(pieces).view(f"S{4 * depth}").ravel()


def search(hashes: np.ndarray, at: np.ndarray, test: TestSuffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What of the test stands in a shard: word and window number of each place where a test window begins,
    and the longest matches around them as rows of (word, place in the test, length), sorted."""
    none = np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, 3), np.int64)
    if not len(test.heads) or not len(hashes):
        return none
    # the shard's words, a border after each document, and room for the last suffixes
    rows = len(at) - 1
    ids = np.full(len(hashes) + rows + test.depth + 1, -3, np.int32)
    place = np.arange(len(hashes)) + np.repeat(np.arange(rows), np.diff(at))
    ids[place] = test.numbers(hashes)
    bad = np.flatnonzero(ids < 0)
    start = place[ids[place] >= 0]
    start = start[bad[np.searchsorted(bad, start)] - start >= test.least]
    if not len(start):
        return none
    keys = _keys(ids, start, test.depth)
    order = np.argsort(keys, kind="stable")
    suffixes, keys = start[order], keys[order]
    # lower and upper bound of each test suffix's window: the rest of the key lowest, then highest
    heads = test.heads
    low = (test.ids[np.minimum(heads[:, :1] + np.arange(test.depth), len(test.ids) - 1)] + 3).astype(">u4")
    beyond = np.arange(test.depth) >= heads[:, 1:]
    low[beyond] = 0
    high = low.copy()
    high[beyond] = 0xFFFFFFFF
    as_key = lambda x: np.ascontiguousarray(x).view(keys.dtype).ravel()
    first, last = np.searchsorted(keys, as_key(low), "left"), np.searchsorted(keys, as_key(high), "right")
    counts = last - first
    which = np.repeat(np.arange(len(heads)), counts)
    found = suffixes[ranges(first, counts)]
    if not len(found):
        return none
    word = np.searchsorted(place, found)
    # places one after the other in both texts are one match; what follows its last window and precedes its first is looked up
    p, q, m = found, heads[which, 0], heads[which, 1]
    order = np.lexsort((p, p - q))
    p, q, m = p[order], q[order], m[order]
    begins = np.ones(len(p), bool)
    begins[1:] = (p[1:] - q[1:] != p[:-1] - q[:-1]) | (p[1:] != p[:-1] + 1)
    ends = np.append(begins[1:], True)
    borders, prefix = np.flatnonzero(test.ids < 0), prefix_sums(mix(ids.astype(np.int64).view(U64)))
    a, b, size = p[begins], q[begins], (p[ends] + m[ends]) - p[begins]
    room = np.minimum(bad[np.searchsorted(bad, a)] - a, borders[np.searchsorted(borders, b)] - b)
    size = _longest(lambda n: prefix_hash(prefix, a, a + n) == prefix_hash(test.prefix, b, b + n), size, room)
    before = lambda edges, x: x - 1 - np.append(-1, edges)[np.searchsorted(edges, x)]
    room = np.minimum(before(bad, a), before(borders, b))
    back = _longest(lambda n: prefix_hash(prefix, a - n, a) == prefix_hash(test.prefix, b - n, b), np.zeros_like(a), room)
    return word, which, np.unique(np.stack([np.searchsorted(place, a - back), b - back, size + back], 1), axis=0)


def _longest(agree: Callable[[np.ndarray], np.ndarray], least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Largest length from ``least`` to ``most`` at which each pair still agrees, by bisection."""
    least, most = least.copy(), np.maximum(least, most)
    while (least < most).any():
        middle = (least + most + 1) // 2
        yes = agree(middle)
        least, most = np.where(yes, middle, least), np.where(yes, most, middle - 1)
    return least


def _overlap(df: DataFrame, keep: list[str], text_col: str, test, window: int, hits_only: bool) -> DataFrame:
    """One pass against one broadcast block; ``hits_only`` returns the hit words of touched rows instead of their number."""
    added = T.StructType.fromDDL(PARTS if hits_only else SCHEMA)
    schema = T.StructType([df.schema[c] for c in keep] + added.fields)

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = test.value
        for batch in batches:
            buf, offsets = text_buffer(batch.column(batch.schema.get_field_index(text_col)))
            n_words, n_hit, hits, items, matches, longest, longest_item = [], [], [], [], [], [], []
            for i, j in slices(offsets):
                hashes, at = words_of(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                word, which, longer = search(hashes, at, block)
                cover = np.zeros(len(hashes) + 1, np.int64)
                np.add.at(cover, word, 1)
                np.add.at(cover, word + block.heads[which, 1], -1)
                hit = np.cumsum(cover[:-1]) > 0
                n_words.append(np.diff(at))
                n_hit.append(row_sums(hit, at))
                row = np.searchsorted(at, word, "right") - 1
                names: list[set[int]] = [set() for _ in range(j - i)]
                for r, w in np.unique(np.stack([row, which], 1), axis=0) if len(row) else ():
                    names[r].update(block.owners[w])
                places: list[list[dict]] = [[] for _ in range(j - i)]
                own = np.searchsorted(block.starts, longer[:, 1], "right") - 1
                of = np.searchsorted(at, longer[:, 0], "right") - 1
                for r, item, w, q, n in zip(of.tolist(), own.tolist(), (longer[:, 0] - at[of]).tolist(), (longer[:, 1] - block.starts[own]).tolist(), longer[:, 2].tolist(), strict=True) if len(longer) else ():
                    places[r].append({"item": block.names[item], "doc_word": w, "item_word": q, "words": n})
                best = [min(x, key=lambda m: (-m["words"], m["item"], m["doc_word"])) if x else {"words": 0, "item": None} for x in places]
                items += [sorted({block.names[x] for x in s}) for s in names]
                matches += places
                longest.append(np.array([x["words"] for x in best], np.int64))
                longest_item += [x["item"] for x in best]
                if hits_only:
                    hits += [np.flatnonzero(hit[a:b]).astype(np.int32) for a, b in zip(at[:-1], at[1:], strict=True)]
            cat = lambda x: pa.array(np.concatenate(x) if x else np.empty(0, np.int64), pa.int64())
            listed = pa.array(items, pa.list_(pa.string()))
            kept = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            middle = [pa.array(hits, pa.list_(pa.int32()))] if hits_only else [cat(n_hit), pa.array([len(x) for x in items], pa.int64())]
            out = pa.RecordBatch.from_arrays([*kept, cat(n_words), *middle, listed, pa.array(matches, KIND), cat(longest), pa.array(longest_item, pa.string())], schema.names)
            yield out.filter(pa.array([bool(x) for x in items], pa.bool_())) if hits_only else out

    return df.mapInArrow(passed, schema)


def benchmark_overlap(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "doc_id", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, keep: list[str] | None = None, block_bytes: int = 8_000_000) -> DataFrame:
    """The columns ``keep`` (all by default) of every document and its overlap with the benchmark.

    n_words; n_hit, the words inside any occurrence of a window; n_items and items (sorted, as
    strings), the items with an occurring window; matches, the longest verbatim matches that hold a
    window, as (item, doc_word, item_word, words): word positions from 0 in both texts (a passage of
    several items is listed where its windows stand first); longest_match in words and longest_item
    (null without a match; ties go to the item that sorts first).  A null or empty text has no words
    and no hits; an item without words has no window; with an empty benchmark nothing is hit.
    Repeated documents or items count like any other.  Columns of the added names are replaced.
    """
    keep = [c for c in (keep or docs.columns) if c not in ADDED]
    docs = docs.select(*dict.fromkeys([*keep, text_col])) if text_col not in ADDED else docs
    tested = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text")).where("text is not null")
    size = tested.agg(F.sum(F.octet_length("text")).alias("bytes"), F.max(F.octet_length("text")).alias("most")).first()
    blocks = max(1, -(-int(size.bytes or 0) // block_bytes))
    spark = docs.sparkSession
    if blocks == 1:
        test = spark.sparkContext.broadcast(TestSuffixes([tuple(r) for r in tested.orderBy("item", "text").collect()], window))
        return _overlap(docs, keep, text_col, test, window, False)
    # Items go to blocks by hash; rows are told apart by a number, which a written table keeps.
    tested = tested.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)))
    key = fresh(docs, "_row")
    keyed = materialize(docs.withColumn(key, F.monotonically_increasing_id()))
    parts = []
    for k in range(blocks):
        test = spark.sparkContext.broadcast(TestSuffixes([tuple(r) for r in tested.where(F.col("block") == k).drop("block").orderBy("item", "text").collect()], window))
        parts.append(materialize(_overlap(keyed.select(key, text_col), [key], text_col, test, window, True)))
        test.destroy()
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    merged = merged.groupBy(key).agg(F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("matches")).alias("matches"), F.min(F.struct((-F.col("longest_match")).alias("least"), "longest_item")).alias("_best"))
    merged = merged.select(key, "hits", "items", "matches", (-F.col("_best.least")).alias("longest_match"), F.col("_best.longest_item").alias("longest_item"))
    none = spark.sparkContext.broadcast(TestSuffixes([], window))
    base = _overlap(keyed, [*keep, key], text_col, none, window, False).select(*keep, key, "n_words").join(merged, key, "left")
    zero = F.array().cast("array<string>")
    return base.select(*keep, "n_words", F.coalesce(F.size("hits").cast("long"), F.lit(0).cast("long")).alias("n_hit"), F.coalesce(F.size("items").cast("long"), F.lit(0).cast("long")).alias("n_items"), F.coalesce("items", zero).alias("items"), F.coalesce("matches", F.array().cast(MATCHES.lower())).alias("matches"), F.coalesce("longest_match", F.lit(0).cast("long")).alias("longest_match"), "longest_item")


def is_contaminated(share: int = 20):
    """n_hit > 0 and at least one word in ``share`` is hit."""
    return (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that aren't contaminated, with their own columns only."""
    return benchmark_overlap(docs, benchmark, **options).where(~is_contaminated()).select(*[c for c in docs.columns if c not in ADDED])
