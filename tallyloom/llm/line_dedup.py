"""Line dedup: drop lines whose key is found in many documents.

Tasks explode each text into lines, hash each line's key (128 bits) and count every key once per
document, summed within the task before the shuffle, so a line that stands in every document
costs one row per task and key.  Keys over the threshold are written to the shared folder.
Where they are few (a checked number) they are broadcast and each text is reassembled in
place; beyond that the exploded lines are joined with them by hash, and only line numbers go
back to their documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER_TABLE, fresh, materialize, without

EDGE = b" \t\n\x0b\x0c\r"
ADDED = ["n_lines", "n_dropped"]


def line_keys(text: str | None) -> list[bytes]:
    """128-bit hash of each line's key, b"" for an empty key; null is one empty line."""
    digest = xxhash.xxh3_128_digest
    return [digest(k) if (k := line.strip(EDGE)) else b"" for line in (text or "").encode("utf-8", "surrogatepass").translate(LOWER_TABLE).split(b"\n")]


def _halves(keys: list[bytes]) -> tuple[pa.Array, pa.Array]:
    both = np.frombuffer(b"".join(keys), ">i8").reshape(-1, 2).astype(np.int64)
    return pa.array(both[:, 0]), pa.array(both[:, 1])


def frequent_lines(df: DataFrame, text_col: str = "text", min_docs: int = 10) -> DataFrame:
    """Hashes (h1, h2) of the keys of at least one code point that at least ``min_docs`` rows hold."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        for batch in batches:
            for text in batch.column(0):
                for key in set(line_keys(text.as_py())):
                    if key:
                        seen[key] = seen.get(key, 0) + 1
            if len(seen) > 200_000:
                yield flush(seen)
                seen = {}
        if seen:
            yield flush(seen)

    def flush(seen: dict[bytes, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*_halves(list(seen)), pa.array(list(seen.values()), pa.int64())], ["h1", "h2", "n"])

    return df.select(text_col).mapInArrow(counted, "h1 long, h2 long, n long").groupBy("h1", "h2").agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs).select("h1", "h2")


def dedup_lines(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_docs: int = 10, broadcast_limit: int = 250_000) -> DataFrame:
    """Each row with its text less the lines that ``min_docs`` or more rows share, plus n_lines and n_dropped.

    Every row is a document, repeated rows too.  Lines are split at \\n; keys are stripped of
    ASCII white space and A-Z is lower-cased; empty keys always stay.  A null text counts as
    one empty line and stays null.  Kept lines are joined by \\n.  An empty table stays empty;
    columns named n_lines or n_dropped are replaced.
    """
    df = without(df, ADDED)
    frequent = materialize(frequent_lines(df, text_col, min_docs))
    if frequent.count() <= broadcast_limit:
        return _in_place(df, text_col, frequent)
    return _by_join(df, text_col, id_col, frequent)


def _rebuilt(df: DataFrame, text_col: str, dropped, extra: list[str]) -> DataFrame:
    """``dropped(batch)`` yields, for each row, the lines to drop as a list of booleans or None."""
    schema = T.StructType([f for f in df.schema.fields if f.name not in extra] + [T.StructField(n, T.LongType()) for n in ADDED])
    names = [f.name for f in schema.fields[:-2]]

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lines, gone = [], [], []
            for text, flags in zip(batch.column(batch.schema.get_field_index(text_col)), dropped(batch), strict=True):
                text = text.as_py()
                n = sum(flags)
                texts.append("\n".join([x for x, f in zip(text.split("\n"), flags, strict=True) if not f]) if n else text)
                lines.append(len(flags))
                gone.append(n)
            columns = [pa.array(texts, pa.string()) if n == text_col else batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lines, pa.int64()), pa.array(gone, pa.int64())], [*names, *ADDED])

    return df.mapInArrow(rebuild, schema)


def _in_place(df: DataFrame, text_col: str, frequent: DataFrame) -> DataFrame:
    both = np.array([(r.h1, r.h2) for r in frequent.collect()], ">i8").tobytes()
    shared = df.sparkSession.sparkContext.broadcast(frozenset(both[i : i + 16] for i in range(0, len(both), 16)))

    def dropped(batch: pa.RecordBatch) -> Iterator[list[bool]]:
        hot = shared.value
        for text in batch.column(batch.schema.get_field_index(text_col)):
            yield [k in hot for k in line_keys(text.as_py())]

    return _rebuilt(df, text_col, dropped, [])


def _by_join(df: DataFrame, text_col: str, id_col: str, frequent: DataFrame) -> DataFrame:
    # Rows are told apart by a number, which a written table keeps.
    number, drop = fresh(df, "_row"), fresh(df, "_gone")
    keyed = materialize(df.withColumn(number, F.monotonically_increasing_id()))

    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, at, keys = [], [], []
            for r, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = [(i, k) for i, k in enumerate(line_keys(text.as_py())) if k]
                row += [r] * len(found)
                at += [i for i, _ in found]
                keys += [k for _, k in found]
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(at, pa.int32()), *_halves(keys)], ["_row", "_at", "h1", "h2"])

    lines = keyed.select(number, text_col).mapInArrow(exploded, "_row long, _at int, h1 long, h2 long")
    gone = lines.join(frequent, ["h1", "h2"], "left_semi").groupBy(F.col("_row").alias(number)).agg(F.collect_set("_at").alias(drop))

    def dropped(batch: pa.RecordBatch) -> Iterator[list[bool]]:
        texts, sets = (batch.column(batch.schema.get_field_index(n)) for n in (text_col, drop))
        for text, at in zip(texts, sets, strict=True):
            flags = [False] * (1 + (text.as_py() or "").count("\n"))
            for i in at.as_py() or ():
                flags[i] = True
            yield flags

    return _rebuilt(keyed.join(gone, number, "left"), text_col, dropped, [number, drop])
