"""SimHash near-dedup: fingerprints, a tiled exact comparison, and connected components.

Texts with one fingerprint collapse to a class first.  Classes are dealt into tiles by the
population counts of the four 16-bit quarters of their fingerprints, and large tiles are cut by
hash.  Two fingerprints within the radius differ by no more than the radius in the sum of the
quarters' count differences, so all other tile pairs are skipped; the rest (about 1 in 80) are
compared exactly with numpy exclusive-or and bit counts.  There are at most 83,521 tile
signatures whatever the input, so their table is broadcast; tiles meet by an equi-join and
only links and components, never pairs of copies, are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER_TABLE, fresh, materialize, without

#: Fingerprints in a tile.
TILE = 16_384


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Majority of the bits of the XXH64 of all word shingles, repeats included; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER_TABLE).split()
    n = len(words) - shingle + 1
    if not words:
        return 0
    if n <= 1:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[: n - 1]]).tolist()
    pieces = [joined[a:b] for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(seed)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 15):
        bits = np.unpackbits(hashes[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.uint32)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text_col: str = "text", name: str = "fp", keep_text: bool = False) -> DataFrame:
    """Add the fingerprint as a signed long."""
    kept = [f for f in without(df, [name]).schema.fields if keep_text or f.name != text_col]
    schema = T.StructType(kept + [T.StructField(name, T.LongType())])

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            found = np.array([fingerprint(t.as_py()) for t in texts], np.uint64)
            rest = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(found.view(np.int64))], schema.names)

    return df.mapInArrow(mapped, schema)


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links with the same components, at most one fewer than there are ends: each end to the least of its component."""
    ends, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inverse[: len(a)], inverse[len(a) :]
    label = np.arange(len(ends))
    while True:
        p, q = label[x], label[y]
        if (p == q).all():
            break
        least = np.minimum(p, q)
        np.minimum.at(label, p, least)
        np.minimum.at(label, q, least)
        while (label[label] != label).any():
            label = label[label]
    far = np.flatnonzero(label != np.arange(len(ends)))
    return ends[far], ends[label[far]]


def close_pairs(left: np.ndarray, right: np.ndarray, radius: int, own: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links between two tiles, or inside one (``own``), thinned to a spanning forest."""
    a, b, step = [], [], max(1, (1 << 20) // max(1, len(right)))
    for i in range(0, len(left), step):
        near = np.bitwise_count(left[i : i + step, None] ^ right[None, :]) <= radius
        x, y = np.nonzero(near)
        if own:
            x, y = x[(ok := y > x + i)], y[ok]
        if len(x):
            s, t = _forest(left[x + i], right[y])
            a.append(s)
            b.append(t)
    none = np.empty(0, np.uint64)
    return _forest(np.concatenate(a), np.concatenate(b)) if a else (none, none)


def links(classes: DataFrame, radius: int = 2, tile: int = TILE) -> DataFrame:
    """Links (a, b) that connect all fingerprints ``fp`` within the radius of each other."""
    quarter = [F.bit_count(F.shiftrightunsigned("fp", 16 * q).bitwiseAND(F.lit(0xFFFF).cast("long"))) for q in range(4)]
    sig = sum((c * F.lit(32**q) for q, c in enumerate(quarter[1:], 1)), quarter[0])
    signed = classes.select("fp", sig.cast("int").alias("sig"))
    parts = F.ceil(F.count("*") / tile).cast("int")
    counts = materialize(signed.groupBy("sig").agg(parts.alias("parts")))  # at most 17^4 rows
    packed = signed.join(F.broadcast(counts), "sig").withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts").cast("long")).cast("int"))
    tiles = materialize(packed.groupBy("sig", "part").agg(F.sort_array(F.collect_list("fp")).alias("fps")))
    # tile pairs: own signature and those above it within the radius, as far as they exist
    steps = [sum(s * 32**q for q, s in enumerate(d)) for d in product(range(-radius, radius + 1), repeat=4) if sum(map(abs, d)) <= radius]
    ahead = F.explode(F.array(*[F.lit(s) for s in sorted(steps) if s >= 0]))
    other = F.broadcast(counts.select(F.col("sig").alias("other"), F.col("parts").alias("n")))
    pairs = tiles.select("sig", "part", F.col("fps").alias("left"), ahead.alias("step")).withColumn("other", F.col("sig") + F.col("step")).join(other, "other")
    pairs = pairs.select("sig", "part", "left", "other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("at")).where("other > sig or at >= part")
    right = tiles.select(F.col("sig").alias("other"), F.col("part").alias("at"), F.col("fps").alias("right"))
    met = pairs.join(right, ["other", "at"]).select("left", "right", ((F.col("sig") == F.col("other")) & (F.col("part") == F.col("at"))).alias("own"))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_a, out_b = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
            values = [(np.asarray(c.flatten()).astype(np.int64).view(np.uint64), np.asarray(c.offsets).astype(np.int64) - c.offsets[0].as_py()) for c in (batch.column(0), batch.column(1))]
            (lv, lo), (rv, ro) = values
            for k, own in enumerate(batch.column(2).to_pylist()):
                a, b = close_pairs(lv[lo[k] : lo[k + 1]], rv[ro[k] : ro[k + 1]], radius, own)
                if len(a):
                    out_a.append(a)
                    out_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (out_a, out_b)], ["a", "b"])

    return met.mapInArrow(compared, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """Smallest reachable node of every node that has a link: (node, root).

    Large-star and small-star rounds; minima are aggregated before the shuffle and joined back,
    so a node with very many links is split like any skewed join.  Every round is written to the
    shared folder.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    state = None
    while True:
        if (seen := tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())) == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = seen
        if not seen[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        # large star: every larger neighbour of a node is linked to the node's smallest neighbour
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: the smaller neighbours of a node, and the node, are linked to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        now = materialize(small)


def _rooted(rows: DataFrame, radius: int, best: Column) -> DataFrame:
    """(fp, best, root) of every fingerprint of ``rows``: the least ``best`` of its rows and the component."""
    classes = materialize(rows.groupBy("fp").agg(F.min(best).alias("best")))
    roots = components(links(classes, radius))
    return materialize(classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "best", F.coalesce("root", "fp").alias("root")))


def near_duplicates(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", radius: int = 2) -> DataFrame:
    """(id, fp, component_id) of every row: fingerprint, and the smallest id reachable over links.

    A null or empty text has fingerprint 0 and is linked like any other.  A null id never names a
    component (the id is null only if no row of the component has one).  Repeated rows share a
    component; an empty table stays empty.
    """
    rows = materialize(fingerprints(df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_text"))
    placed = _rooted(rows, radius, F.col("_id"))
    named = placed.join(placed.groupBy("root").agg(F.min("best").alias("component_id")), "root").select("fp", "component_id")
    return rows.join(named, "fp").select(F.col("_id").alias(id_col), "fp", "component_id")


def keep_one(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", radius: int = 2, broadcast_limit: int = 250_000) -> DataFrame:
    """One row of each component of near-duplicates, with the columns of ``df``.

    Rows are told apart by a number of their own, not by their id: of each component the row with
    the smallest id stays (null counts as larger than any; of equal ids the smaller fingerprint,
    then the first row).  So a text without a near-duplicate always stays, whatever ids it shares.
    Up to ``broadcast_limit`` rows to drop are broadcast, so that no text is shuffled; more are
    joined by row number.  An empty table stays empty.
    """
    row, fp = fresh(df, "_row"), fresh(df, "_fp")
    rows = materialize(fingerprints(df.withColumn(row, F.monotonically_increasing_id()), text_col, fp, keep_text=True))
    prints = rows.select(F.col(id_col).alias("id"), F.col(fp).alias("fp"), F.col(row).alias("row"))
    placed = _rooted(prints, radius, F.struct(F.col("id").isNull().alias("no_id"), "id", "fp", "row"))
    winners = placed.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.row").alias(row))
    dropped = materialize(rows.select(row).join(winners, row, "left_anti"))
    few = dropped.count() <= broadcast_limit
    return rows.join(F.broadcast(dropped) if few else dropped, row, "left_anti").select(df.columns)
