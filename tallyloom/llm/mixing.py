"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every source's target of words is met exactly.  The source's documents are dealt by hash into
blocks, the blocks are permuted, and so are the documents in each; read one after the other,
again and again, they form the source's stream, and the mix takes its first ``target`` words
(the last document may be taken in part).  A unit is one block in one reading.

Which output shard gets which units is drawn by a tree over the shards: at each node the
numbers of units by source are split between its two halves by a multivariate hypergeometric
draw, so every shard ends up with a random composition whose sums over all shards are the exact
quotas.  A shard takes its numbers as disjoint runs of the permuted units, and its documents
are ordered by a hash.  Only one row per source reaches the driver.  ``mix_sources`` makes the
draws, from ids and sizes alone; ``draw_mixture`` joins them to the texts, cuts what is taken in
part, and brings each shard together in its order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from .common import NON_SPACE, materialize, slices, text_buffer, without, word_bounds

MAX_SOURCES = 100_000
#: Words of the mixture in a shard, where the number of shards isn't given.
SHARD_WORDS = 16_000_000


def word_counts(df: DataFrame, text_col: str = "text", name: str = "size", keep_text: bool = False) -> DataFrame:
    """Add the number of words between white space (null: 0)."""
    kept = [f for f in without(df, [name]).schema.fields if keep_text or f.name != text_col]
    schema = T.StructType(kept + [T.StructField(name, T.LongType())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = text_buffer(batch.column(batch.schema.get_field_index(text_col)))
            parts = [np.diff(word_bounds(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], NON_SPACE)[2]) for i, j in slices(offsets)]
            rest = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(np.concatenate(parts) if parts else np.empty(0, np.int64))], schema.names)

    return df.mapInArrow(counted, schema)


def water_fill(sizes: list[int], weights: list[float], share: float = 1.5, most: float = 2.0) -> list[float]:
    """Targets: ``share`` times all sizes by weight, none above ``most`` times its source; the excess is shared again by weight."""
    target, total, open_ = [0.0] * len(sizes), share * sum(sizes), {i for i, s in enumerate(sizes) if s}
    while open_:
        unit = total / sum(weights[i] for i in open_)
        full = {i for i in open_ if unit * weights[i] >= most * sizes[i]}
        for i in full or open_:
            target[i] = float(most * sizes[i]) if full else unit * weights[i]
            total -= target[i] if full else 0
        open_ -= full or open_
    return target


def splitting_tree(units: list[int], shards: int, seed: int) -> np.ndarray:
    """Units of each source (rows) in each shard (columns), drawn by halving the range of shards."""
    rng = np.random.default_rng(seed)
    out = np.zeros((len(units), shards), np.int64)
    total = int(sum(units))
    # the shards' sizes differ by one unit at most
    edges = [total * k // shards for k in range(shards + 1)]
    todo = [(0, shards, np.array(units, np.int64))]
    while todo:
        low, high, have = todo.pop()
        if high - low == 1:
            out[:, low] = have
            continue
        middle = (low + high) // 2
        left = edges[middle] - edges[low]
        part = np.zeros_like(have)
        rest = int(have.sum())
        for i, n in enumerate(have):  # one source after the other, given what the earlier ones took
            part[i] = rng.hypergeometric(n, rest - n, left) if n and left and rest - n else min(int(n), left)
            rest -= int(n)
            left -= int(part[i])
        todo += [(low, middle, part), (middle, high, have - part)]
    return out


def default_weights(names: list[str | None]) -> list[float]:
    return [(3, 1, 2)[i % 3] for i in range(len(names))]


def mix_sources(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", weights: Callable[[list], list[float]] = default_weights, share: float = 1.5, most: float = 2.0, shards: int | None = None, block_rows: int = 4096, seed: int = 11, keep: Sequence[str] = ()) -> DataFrame:
    """One row per document: id, source, size, source_size, target, taken, and draws.

    draws: an array of (copy, shard, order, words), one for each time the mix takes the document;
    ``order`` is its place in the shuffled shard.  Sources are ordered by code point, null last,
    and ``weights`` gives each a weight.  The sum of taken over a source is its target rounded
    down; no document is taken more than ceil(``most``) times.  Documents without words are never
    drawn.  Repeated rows are documents of their own.  Reruns agree, as all choices are hashes
    or seeded; an empty table gives an empty table.  More than 100,000 sources are refused.
    Columns named in ``keep`` are carried along, after the others.  ``shards`` is by default one for
    each ``SHARD_WORDS`` words of the mixture, but 64 at least; it doesn't change what is taken.
    """
    return _mix(df, text_col, id_col, source_col, weights, share, most, shards, block_rows, seed, keep)[0]


def _mix(df: DataFrame, text_col: str, id_col: str, source_col: str, weights: Callable[[list], list[float]], share: float, most: float, shards: int | None, block_rows: int, seed: int, keep: Sequence[str]) -> tuple[DataFrame, int]:
    """The rows of ``mix_sources`` and the number of shards."""
    sized = materialize(word_counts(df.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("_text"), *keep), "_text"))
    spark = df.sparkSession
    stats = sized.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("rows")).limit(MAX_SOURCES + 1).collect()
    if len(stats) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    stats.sort(key=lambda r: (r.source is None, (r.source or "").encode("utf-8", "surrogatepass")))
    sizes = [int(r.words) for r in stats]
    targets = water_fill(sizes, weights([r.source for r in stats]), share, most)
    shards = shards or max(64, -int(-sum(targets) // SHARD_WORDS))
    blocks = [max(1, -(-r.rows // block_rows)) for r in stats]
    plan = spark.createDataFrame([(i, r.source, r.words, t, b) for i, (r, t, b) in enumerate(zip(stats, targets, blocks, strict=True))], "sid int, source string, source_size long, target double, blocks int")
    keyed = sized.join(F.broadcast(plan.withColumnRenamed("source", "_source")), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    keyed = keyed.withColumn("key", F.xxhash64(F.lit(seed), F.col("id"))).withColumn("block", F.pmod(F.xxhash64(F.lit(seed + 1), F.col("id"), F.col("size")), F.col("blocks").cast("long")).cast("int"))
    totals = keyed.groupBy("sid", "block").agg(F.sum("size").alias("block_size"))
    order = Window.partitionBy("sid").orderBy(F.xxhash64(F.lit(seed + 2), F.col("sid"), F.col("block")), "block")
    placed = materialize(totals.select("sid", "block", (F.row_number().over(order) - 1).alias("rank"), (F.sum("block_size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("block_size")).alias("begin"), "block_size"))
    # units: blocks the stream reaches, by reading; a block that starts at or after the target isn't drawn
    reach = placed.join(F.broadcast(plan.select("sid", "source_size", F.floor("target").alias("quota"))), "sid")
    copies = int(np.ceil(most))
    drawn = [F.count(F.when((F.col("begin") + k * F.col("source_size") < F.col("quota")) & (F.col("block_size") > 0), 1)) for k in range(copies)]
    quota = {r.sid: [int(x) for x in r.units] for r in reach.groupBy("sid").agg(F.array(*drawn).alias("units")).collect()}
    # blocks without words rank among the others; units count ranks, so take the last drawn rank of each reading
    deals = splitting_tree([sum(quota.get(i, [0])) for i in range(len(stats))], shards, seed)
    cuts = spark.createDataFrame([(i, quota.get(i, [0] * copies), np.cumsum(row).tolist()) for i, row in enumerate(deals)], "sid int, per_reading array<long>, cuts array<long>")
    in_block = Window.partitionBy("sid", "block").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    nonempty = Window.partitionBy("sid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    ranked = placed.withColumn("unit", F.sum((F.col("block_size") > 0).cast("long")).over(nonempty) - 1).select("sid", "block", "begin", "unit")
    at = keyed.withColumn("_end", F.sum("size").over(in_block)).join(ranked, ["sid", "block"]).join(F.broadcast(cuts), "sid").withColumn("_at", F.col("begin") + F.col("_end") - F.col("size"))
    quota_col = F.floor("target")

    def draw(k: int):
        start = F.col("_at") + k * F.col("source_size")
        words = F.greatest(F.lit(0), F.least(F.col("size"), quota_col - start)).cast("long")
        unit = F.col("unit") + (F.col("per_reading")[0] * k if k else F.lit(0))
        shard = F.size(F.filter("cuts", lambda c: c <= unit))
        return F.when(words > 0, F.struct(F.lit(k).alias("copy"), shard.alias("shard"), F.xxhash64(F.lit(seed + 3), F.lit(k), F.col("id")).alias("order"), words.alias("words")))

    draws = F.array_compact(F.array(*[draw(k) for k in range(copies)]))
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["words"])
    return at.withColumn("draws", draws).select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", taken.alias("taken"), "draws", *keep), shards


def first_words(text: Column, words: Column) -> Column:
    """The text up to the end of its ``words``-th word."""
    pieces = F.split(text, r"(?<=[ \t-\r])(?=[^ \t-\r])")  # each word with the white space after it
    leading = text.rlike(r"\A[ \t-\r]").cast("int")
    return F.regexp_replace(F.array_join(F.slice(pieces, F.lit(1), words.cast("int") + leading), ""), r"[ \t-\r]+\z", "")


def draw_mixture(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", weights: Callable[[list], list[float]] = default_weights, share: float = 1.5, most: float = 2.0, shards: int | None = None, block_rows: int = 4096, seed: int = 11) -> DataFrame:
    """The mixture itself: one row per draw of ``mix_sources``, in one partition per shard, sorted by order.

    id, source, text, shard, order, copy, words, then size, source_size, target and taken of the
    document.  A document drawn twice is there twice; a text that is taken in part ends after its
    ``words``-th word.  Draws find their texts by id, source and 128 bits of the text's hash: rows equal
    in these are the same to the mixture, so their draws are listed together and their text moves
    once.  A text moves once to its draws and once, with each draw, to its shard.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    parts = [F.col("id").isNull(), F.col("id"), F.col("source").isNull(), F.col("source"), F.col("text")]
    rows = rows.withColumn("k1", F.xxhash64(*parts)).withColumn("k2", F.xxhash64(F.lit(seed), *parts))
    drawn, shards = _mix(rows, "text", "id", "source", weights, share, most, shards, block_rows, seed, ["k1", "k2"])
    listed = drawn.where(F.size("draws") > 0).groupBy("k1", "k2").agg(F.collect_list(F.struct("draws", "taken")).alias("rows"), *[F.max(c).alias(c) for c in ("size", "source_size", "target")])
    texts = rows.groupBy("k1", "k2").agg(*[F.first(c).alias(c) for c in ("id", "source", "text")])
    each = texts.join(listed, ["k1", "k2"]).withColumn("r", F.explode("rows")).select("*", F.col("r.taken").alias("taken"), F.explode("r.draws").alias("draw")).select("*", "draw.*")
    text = F.when(F.col("words") < F.col("size"), first_words(F.col("text"), F.col("words"))).otherwise(F.col("text"))
    mixed = each.select(F.col("id").alias(id_col), F.col("source").alias(source_col), text.alias(text_col), "shard", "order", "copy", "words", "size", "source_size", "target", "taken")
    return mixed.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "order", "copy", "words")


def manifest(mixed: DataFrame, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """One row per draw: id, source, shard, order in the shard, copy, words."""
    return mixed.select(id_col, source_col, "size", F.explode("draws").alias("d")).select(id_col, source_col, F.col("d.shard").alias("shard"), F.col("d.order").alias("order"), F.col("d.copy").alias("copy"), F.col("d.words").alias("words"))
