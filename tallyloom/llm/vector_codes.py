"""Vector codes: each part of a vector becomes the number of its nearest codebook entry.

Components are whole numbers.  In a block of rows every dimension gets a dictionary of its distinct
values; for each dictionary entry the squared differences to all codebook entries are tabulated
once, and the distances of all parts are gathers of table rows by dictionary code, added over the
part's dimensions.  All arithmetic is exact.

The scaled vectors are written once; a round reads them, sums the parts of each entry inside the
tasks, combines the sums by a shuffle, and brings one row per entry to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, without

#: Rows of a block, and of the stretches in which its distances are added.
BLOCK, STRETCH = 8192, 1024
#: Scaled components beyond this are taken as this, so that errors stay within 64 bits.
LIMIT = 1 << 26
#: Up to so many label sums are broadcast; more are joined.
BROADCAST_LABELS = 250_000


def dictionary(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, ascending, and each value's place among them."""
    low = int(values.min())
    width = int(values.max()) - low + 1
    if width > 8 * len(values) + 65_536:
        return np.unique(values, return_inverse=True)
    seen = np.zeros(width, bool)
    seen[values - low] = True
    return np.flatnonzero(seen) + low, (np.cumsum(seen) - 1)[values - low]


def part_distances(values: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of each row's part (rows x dimensions) to all codebook entries (entries x dimensions)."""
    span = max(int(values.max()), int(entries.max())) - min(int(values.min()), int(entries.min()))
    kind = np.int32 if values.shape[1] * span * span < 1 << 31 else np.int64
    total = np.zeros((len(values), len(entries)), kind)
    gathered = np.empty((min(STRETCH, len(values)), len(entries)), kind)
    for d in range(values.shape[1]):
        distinct, code = dictionary(values[:, d])
        squares = (distinct[:, None] - entries[None, :, d]).astype(kind)
        squares *= squares
        for i in range(0, len(values), STRETCH):
            stretch = code[i : i + STRETCH]
            total[i : i + STRETCH] += np.take(squares, stretch, axis=0, out=gathered[: len(stretch)], mode="clip")
    return total


def bounds(dims: int, parts: int) -> list[tuple[int, int]]:
    """Consecutive parts, equal, or the first ones longer by one where they can't be."""
    size, more = divmod(dims, parts)
    ends = [size * (p + 1) + min(p + 1, more) for p in range(parts)]
    return list(zip([0, *ends[:-1]], ends, strict=True))


def _scaled(df: DataFrame, vector_col: str, scale: int) -> DataFrame:
    """``df`` without the vector and with packed (int32 components floor(scale * x), end to end); unusable vectors go."""
    kept = [f for f in df.schema.fields if f.name not in (vector_col, "packed")]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.names.index(vector_col))
            values = column.flatten()
            numbers = values.cast(pa.float64()).to_numpy(zero_copy_only=False)
            bad = ~np.isfinite(numbers)  # a null component becomes NaN
            length = np.where(column.is_null().to_numpy(zero_copy_only=False), 0, np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))
            ends = np.cumsum(length)
            wrong = np.concatenate([[0], np.cumsum(bad)])
            good = np.flatnonzero((length > 0) & (wrong[ends] == wrong[ends - length]))
            whole = np.clip(np.floor(np.where(bad, 0, numbers) * scale), -LIMIT, LIMIT).astype("<i4")
            cells = [whole[ends[i] - length[i] : ends[i]].tobytes() for i in good]
            rows = batch.take(pa.array(good))
            yield pa.RecordBatch.from_arrays([*(rows.column(rows.schema.names.index(f.name)) for f in kept), pa.array(cells, pa.binary())], [*(f.name for f in kept), "packed"])

    return df.mapInArrow(packed, T.StructType(kept + [T.StructField("packed", T.BinaryType())]))


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Blocks of up to ``BLOCK`` rows and more only within one batch, with their components as rows x dims."""
    held: list[pa.RecordBatch] = []

    def block() -> tuple[pa.Table, np.ndarray]:
        rows = pa.Table.from_batches(held)
        return rows, np.frombuffer(b"".join(rows.column("packed").to_pylist()), "<i4").astype(np.int64).reshape(-1, dims)

    for batch in batches:
        for i in range(0, batch.num_rows, BLOCK):
            piece = batch.slice(i, BLOCK)
            if held and sum(b.num_rows for b in held) + piece.num_rows > BLOCK:
                yield block()
                held = []
            held.append(piece)
    if held:
        yield block()


def _entry_sums(vectors: DataFrame, books: list[np.ndarray], cuts: list[tuple[int, int]]) -> list:
    """(part, entry, rows, sums of their components) over all vectors, for entries that some part is nearest to."""
    shared, widest = vectors.sparkSession.sparkContext.broadcast(books), max(b - a for a, b in cuts)
    names = [f"s{i}" for i in range(widest)]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        sums = [np.zeros((len(book), widest + 1), np.int64) for book in books]
        for _, values in _blocks(batches, cuts[-1][1]):
            for total, book, (a, b) in zip(sums, books, cuts, strict=True):
                nearest = part_distances(values[:, a:b], book).argmin(1)
                order = np.argsort(nearest, kind="stable")
                entries, first = np.unique(nearest[order], return_index=True)
                total[entries, 0] += np.diff([*first, len(order)])
                total[entries, 1 : b - a + 1] += np.add.reduceat(values[order, a:b], first)
        for part, total in enumerate(sums):
            used = np.flatnonzero(total[:, 0])
            columns = [pa.array(np.full(len(used), part, np.int32)), pa.array(used.astype(np.int32)), *(pa.array(total[used, i]) for i in range(widest + 1))]
            yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "rows", *names])

    schema = "part int, entry int, rows long, " + ", ".join(f"{n} long" for n in names)
    found = vectors.select("packed").mapInArrow(summed, schema).groupBy("part", "entry").agg(*[F.sum(n).alias(n) for n in ("rows", *names)])
    return [(r[0], r[1], r[2], r[3:]) for r in found.collect()]  # at most entries x parts rows


def learn_codebooks(vectors: DataFrame, id_col: str, dims: int, parts: int, entries: int, rounds: int) -> list[np.ndarray]:
    """Codebooks (entries x dimensions of the part): first the parts of the rows with the smallest ids, then ``rounds`` means."""
    first = vectors.orderBy(F.asc_nulls_last(id_col), "packed").limit(entries).select("packed").collect()
    start, cuts = np.array([np.frombuffer(r[0], "<i4") for r in first], np.int64).reshape(-1, dims), bounds(dims, parts)
    books = [start[:, a:b].copy() for a, b in cuts]
    for _ in range(rounds):
        for part, entry, n, sums in _entry_sums(vectors, books, cuts):
            a, b = cuts[part]
            books[part][entry] = np.array(sums[: b - a], np.int64) // n
    return books


def compress(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", scale: int = 1024, parts: int = 4, entries: int = 256, rounds: int = 4) -> tuple[DataFrame, list[np.ndarray]]:
    """Coded rows, and the codebooks.

    Rows: all columns of ``df`` but the vector, code (hex, two digits per part), error (squared distance
    to the coded vector), and with a ``label_col`` label_error (error summed over equal labels, nulls
    together).  Columns of these names are replaced.

    Rows whose vector is null, empty, or holds null or non-finite components go; so do rows whose length
    isn't the table's, the one that most rows have (the longest among equals).  Components are
    floor(scale * x), and beyond 2^26 taken as 2^26.  Ties go to the lower index; repeated rows count
    each; with fewer rows than ``entries`` there are fewer entries.  Equal and null ids (last) are
    ordered by their vectors.  An empty table gives an empty one and empty codebooks.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits a part: 1 to 256 entries")
    df = without(df, [c for c in ("code", "error", "label_error") if c not in (id_col, vector_col, label_col)])
    scaled = materialize(_scaled(df, vector_col, scale))
    lengths = scaled.groupBy((F.octet_length("packed") / 4).cast("int").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    dims = lengths.dims if lengths else parts
    vectors = scaled.where(F.octet_length("packed") == 4 * dims)
    books, cuts = learn_codebooks(vectors, id_col, dims, parts, entries, rounds), bounds(dims, parts)
    shared = df.sparkSession.sparkContext.broadcast(books)
    kept = [f for f in vectors.schema.fields if f.name != "packed"]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, values in _blocks(batches, dims):
            codes, error = np.empty((len(values), parts), np.uint8), np.zeros(len(values), np.int64)
            for part, (a, b) in enumerate(cuts):
                distances = part_distances(values[:, a:b], shared.value[part])
                nearest = distances.argmin(1)
                codes[:, part] = nearest
                error += distances[np.arange(len(values)), nearest]
            done = rows.drop_columns(["packed"]).append_column("code", pa.array([c.tobytes().hex() for c in codes])).append_column("error", pa.array(error))
            yield from done.to_batches()

    out = vectors.mapInArrow(coded, T.StructType(kept + [T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]))
    if label_col is None:
        return out, books
    out = materialize(out)
    sums = materialize(out.groupBy(F.col(label_col).alias("_label")).agg(F.sum("error").alias("label_error")))
    few = sums.count() <= BROADCAST_LABELS
    return out.join(F.broadcast(sums) if few else sums, F.col(label_col).eqNullSafe(F.col("_label"))).drop("_label"), books


def codebooks_digest(books: list[np.ndarray]) -> str:
    """Sha256 of all components as decimal numbers, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()
