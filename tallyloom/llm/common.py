"""Helpers that the corpus operators share: shared-folder tables, Arrow text buffers, vectorised words and hashes.

Word positions, lengths and hashes are computed with numpy on the UTF-8 bytes of an Arrow
batch, so a task never makes a Python object per word.  All functions are pure and keep no
state but the cached powers of the hash base.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
#: Bytes of UTF-8 text handled at once inside a task; bounds the numpy temporaries (about 60 bytes each).
SLICE_BYTES = 3_000_000


#: Paths of the tables that ``materialize`` wrote and nobody has removed.
_WRITTEN: list[str] = []


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.  Where none is set, a fresh temporary one on a
    local master; on a cluster an error, as executors don't share the driver's folders."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet below the shared checkpoint folder and read it again."""
    path = f"{checkpoint_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tables_written() -> int:
    """How many tables ``materialize`` has written and nobody has removed."""
    return len(_WRITTEN)


def remove_tables(spark: SparkSession, begin: int, end: int | None = None) -> None:
    """Remove the tables written from the ``begin``-th on, before the ``end``-th: only once nothing reads them any more."""
    jvm = spark.sparkContext._jvm
    for path in _WRITTEN[begin:end]:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    del _WRITTEN[begin:end]


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` is called so (names don't tell cases apart)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 16_000_000) -> None:
    """Let Arrow batches of this session hold at most ``rows`` rows and about ``size`` bytes (fewer stay fewer): texts and
    tiles make rows heavy, and a Python worker holds a batch and its result at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > rows:
        spark.conf.set(name, str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` without columns that an operator is about to add (an operator's own column wins a clash)."""
    return df.drop(*[c for c in df.columns if c in names])


# --- text buffers -----------------------------------------------------------------------------


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, end to end, and the n + 1 offsets of its rows (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = pc.fill_null(column, b"")
    _, offs, data = column.buffers()
    n = len(column)
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offs, np.int64, n + 1, column.offset * 8)
    if data is None or offsets[-1] == offsets[0]:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes of text; a longer row stands alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def string_array(pieces: list) -> pa.Array:
    return pa.array(pieces, pa.string())


# --- words ------------------------------------------------------------------------------------

#: Words between white space: not in [\x20\x09-\x0D].
NON_SPACE = np.ones(256, bool)
NON_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: ASCII letters and digits and all bytes of code points from U+0080 on.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: A-Z to a-z, all else unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER_TABLE = LOWER.tobytes()


def word_bounds(buf: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the n + 1 word offsets of the rows; words don't cross rows."""
    n = len(offsets) - 1
    if not len(buf):
        none = np.empty(0, np.int64)
        return none, none, np.zeros(n + 1, np.int64)
    inside = table[buf]
    edge = np.empty(len(buf) + 1, bool)
    edge[0] = edge[-1] = True
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[offsets] = True  # row borders: both sides count as edges
    at = np.flatnonzero(edge)
    keep = inside[at[:-1]]
    starts, ends = at[:-1][keep], at[1:][keep]
    return starts, ends, np.searchsorted(starts, offsets)


# --- hashes -----------------------------------------------------------------------------------

_BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)
_INVERSES = tuple(pow(b, -1, 1 << 64) for b in _BASES)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        full = np.full(max(n, 1 << 16), base, U64)
        full[0] = 1
        have = _POWERS[base] = np.cumprod(full, dtype=U64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_TABLES = [np.random.default_rng(71 + i).integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1) for i in range(2)]


def prefix_sums(values: np.ndarray, which: int = 0) -> np.ndarray:
    """Sums from which ``prefix_hash`` gets the hash of any range."""
    total = np.empty(len(values) + 1, U64)
    total[0] = 0
    np.cumsum(values * _powers(_BASES[which], len(values)), dtype=U64, out=total[1:])
    return total


def prefix_hash(total: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """Polynomial hash (mod 2^64, then mixed with the length) of the values in each range, from their prefix sums."""
    h = total[ends] - total[starts]
    h *= _powers(_INVERSES[which], len(total))[starts]
    return mix(h + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def range_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """Polynomial hash of values[start:end] for each range."""
    return prefix_hash(prefix_sums(values, which), starts, ends, which)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hash of each word's bytes."""
    return range_hash(_TABLES[which][buf], starts, ends, which)


def window_hashes(words: np.ndarray, at: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """64-bit hash of ``size`` consecutive word hashes from each position in ``at``."""
    return range_hash(words, at, at + size, which)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenated aranges: starts[i], starts[i] + 1, ... of counts[i] numbers each."""
    total = int(counts.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)


def row_sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` between consecutive offsets."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]
