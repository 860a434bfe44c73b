"""Substring dedup with difference-cover anchors.

A window is ``window`` consecutive words of one document.  A word goes if a window over it also
starts in a document with a smaller id.

Two windows that are equal but start anywhere share an anchor that is aligned in both: with a
difference cover D of the period v, some shift below v moves both starts onto positions whose
remainder is in D.  So only the ``window - v + 1`` words from cover positions (3 of 7) are
hashed and exchanged.  An anchor that a second document holds is then extended: the windows
that contain it, and only they, are hashed whole and get the smallest id they start in.

Exchanges are between chunks of documents (by hash of id and text, a few megabytes each) and
buckets of hashes.  A chunk sends a hash once, however often it holds it, and is answered
once, so a passage that stands in a third of all documents costs some bytes per chunk, and no
pair of documents is ever formed.  All messages are packed arrays in binary columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import NON_SPACE, fresh, materialize, ranges, row_sums, slices, text_buffer, window_hashes, without, word_bounds, word_hashes

#: Difference covers by period: every difference modulo the period is one between two members (fixed values).
COVERS = {1: [0], 2: [0, 1], 3: [0, 1], 4: [0, 1, 2], 5: [0, 1, 2], 6: [0, 1, 3], 7: [0, 1, 3]}
ADDED = ["n_words", "n_removed"]
NO_ID = np.iinfo(np.uint64).max
U64 = np.uint64
MESSAGE = "bucket long, chunk long, data binary"
ANSWER = "chunk long, data binary"
#: Receivers that a sender deals to at most; beyond, messages go over so many relays.
FAN = 4096


def _words(buf: np.ndarray, offsets: np.ndarray, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, at = word_bounds(buf, offsets, NON_SPACE)
    return word_hashes(buf, starts, ends, which), at


def cover_positions(at: np.ndarray, period: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Word positions of the anchors of ``size`` words (remainder within the document in the cover), and their rows."""
    counts = np.maximum(np.diff(at) - size + 1, 0)
    inner = ranges(np.zeros(len(counts), np.int64), counts)
    row = np.repeat(np.arange(len(counts)), counts)
    member = np.zeros(period, bool)
    member[COVERS[period]] = True
    chosen = member[inner % period]
    return (inner + at[row])[chosen], row[chosen]


#: Widths that a column of a message may have; the narrowest that holds its values is taken (fixed values).
WIDTHS = ["u1", "u2", "u4", "u8"]


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of unsigned integers as one message: the length, then each column's width and values."""
    n = len(columns[0])
    parts = [np.int64(n).tobytes()]
    for c in columns:
        most = int(c.max()) if n else 0
        width = next(i for i, k in enumerate(WIDTHS) if most < 1 << 8 * int(k[1]))
        parts += [bytes([width]), c.astype(WIDTHS[width]).tobytes()]
    return b"".join(parts)


def _length(data: pa.Scalar) -> int:
    return int(np.frombuffer(data.as_buffer(), np.int64, 1)[0])


def _unpack(data: pa.Scalar, columns: int) -> list[np.ndarray]:
    raw = data.as_buffer()
    n, at, out = _length(data), 8, []
    for _ in range(columns):
        kind = WIDTHS[raw[at]]
        out.append(np.frombuffer(raw, kind, n, at + 1).astype(U64))
        at += 1 + n * int(kind[1])
    return out


def _unpack_all(table: pa.Table, columns: int) -> list[np.ndarray]:
    parts = [_unpack(x, columns) for x in table.column("data")]
    return [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.empty(0, U64)] * columns


def _dealt(key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each value of an integer key that is present, with the positions that hold it."""
    order = np.argsort(key, kind="stable")
    own = key[order]
    cuts = np.flatnonzero(own[1:] != own[:-1]) + 1
    for part in np.split(order, cuts) if len(order) else ():
        yield int(key[part[0]]), part


def _messages(rows: list[tuple[int, int, bytes]]) -> list[pa.Array]:
    b, c, d = zip(*rows, strict=True) if rows else ((), (), ())
    return [pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.binary())]


def _routed(messages: DataFrame, to: str, n: int, columns: dict[bool, int], hold: int) -> DataFrame:
    """The messages, fewer and larger where receivers (column ``to``, below ``n``) outnumber ``FAN``.

    A sender's messages shrink to a few entries when there are very many receivers.  So they first go
    to ``FAN`` relays, each for a range of receivers; a relay streams what it gets, joins up to ``hold``
    bytes of messages with the same receiver and kind, and passes them on.  ``columns``: how many
    arrays the messages with a chunk of 0 or more (True) and below (False) hold.
    """
    if n <= FAN:
        return messages
    per = -(-n // FAN)
    names = messages.columns

    def merged(parts: dict[tuple, list[list[np.ndarray]]]) -> pa.RecordBatch:
        rows = [(*key, _pack(*[np.concatenate(c) for c in zip(*lists, strict=True)])) for key, lists in parts.items()]
        kinds = [pa.int64()] * (len(names) - 1) + [pa.binary()]
        found = zip(*rows, strict=True) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(found, kinds, strict=True)], names)

    def relay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0
        for batch in batches:
            keys = list(zip(*(c.to_pylist() for c in batch.columns[:-1]), strict=True))
            for key, data in zip(keys, batch.column(len(names) - 1), strict=True):
                held.setdefault(key, []).append(_unpack(data, columns[key[-1] >= 0]))
                size += len(data.as_buffer())
                if size > hold:
                    yield merged(held)
                    held, size = {}, 0
        yield merged(held)

    return messages.repartition(FAN, F.floor(F.col(to) / per)).mapInArrow(relay, messages.schema)


def _ids(column: pa.ChunkedArray | pa.Array, least: int) -> np.ndarray:
    """Ids as unsigned distances from the table's least; null is larger than any."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ids = pc.fill_null(column, least).to_numpy(zero_copy_only=False).astype(np.int64).view(U64) - np.array(least, np.int64).view(U64)
    ids[column.is_null().to_numpy(zero_copy_only=False)] = NO_ID
    return ids


def _numbered(df: DataFrame, id_col: str, name: str) -> DataFrame:
    """``df`` and the rank of each id in the order of all ids, as a long (null: null): ranges of ids get offsets, no task holds all."""
    ids = materialize(df.select(F.col(id_col).alias("id")).where("id is not null").distinct().repartitionByRange("id").sortWithinPartitions("id").withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    sizes = sorted((r.part, r.n) for r in ids.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    before, total = [], 0
    for p, n in sizes:
        before.append((p, total))
        total += n
    offsets = df.sparkSession.createDataFrame(before, "part long, before long")
    ranks = ids.withColumn("part", part).join(F.broadcast(offsets), "part").select(F.col("id").alias("_known"), (F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias(name))
    return df.join(ranks, F.col(id_col) == F.col("_known"), "left").drop("_known")


def remove_repeats(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", window: int = 13, chunk_bytes: int = 3_000_000, bucket_bytes: int = 16_000_000) -> DataFrame:
    """Each row with its kept words joined by one space, plus n_words and n_removed.

    Windows are judged on the input, not on what is left.  Rows with the same id are one
    document to each other: none removes the other's words.  Ids may be of any type that sorts
    (others than integers are ranked first).  A null id counts as larger than any other, so such
    rows lose words and never cost others any.  A null text has no words and stays null.  An empty
    table stays empty; columns n_words and n_removed are replaced.

    Rows are dealt to chunks by id and text.  Where a row is repeated so often that its copies alone
    would fill ten chunks, rows get a number first, and are dealt by that too.
    """
    df = without(df, ADDED)
    period = min(7, window)
    size = window - period + 1
    own, salt = fresh(df, "_own"), fresh(df, "_salt")
    whole = isinstance(df.schema[id_col].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType))
    spread = df.select(F.octet_length(text_col).alias("n"), F.xxhash64(id_col, text_col).alias("h"), *([F.col(id_col).cast("long").alias("id")] if whole else []))
    ends = [F.min("id").alias("least"), F.max("id").alias("most")] if whole else []
    by_row = spread.groupBy("h").agg(F.sum("n").alias("n"), *ends)
    ends = [F.min("least").alias("least"), F.max("most").alias("most")] if whole else []
    known = by_row.agg(F.sum("n").alias("total"), F.max("n").alias("hot"), *ends).first()
    total = int(known.total or 0)
    plain = df.columns
    if whole and (known.least is None or known.most - known.least < int(NO_ID)):
        base, df = known.least or 0, df.withColumn(own, F.col(id_col).cast("long"))
    else:
        base, df = 0, _numbered(df, id_col, own)
    if (known.hot or 0) > 10 * chunk_bytes:
        df = materialize(df.withColumn(salt, F.monotonically_increasing_id()))
    else:
        df = df.withColumn(salt, F.lit(0).cast("long"))
    chunks, buckets = max(1, -(-total // chunk_bytes)), max(1, -(-total // bucket_bytes))
    keyed = df.withColumn("_chunk", F.pmod(F.xxhash64(id_col, text_col, salt), F.lit(chunks)))

    def anchor_keys(h: np.ndarray) -> np.ndarray:
        """Bucket and upper half of a hash: 32 bits within a bucket of bounded size only ever let too many through."""
        return (h % U64(buckets)) << U64(32) | h >> U64(32)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Anchors to their buckets; those that two documents of a batch share are answered at once."""
        for batch in batches:
            buf, offsets = text_buffer(batch.column(0))
            chunk = batch.column(1).to_numpy()
            for i, j in slices(offsets):
                words, at = _words(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                pos, row = cover_positions(at, period, size)
                h = window_hashes(words, pos, size)
                order = np.lexsort((row, h))
                h, row = h[order], row[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                h, row = h[new], row[new]
                first = np.ones(len(h), bool)
                first[1:] = h[1:] != h[:-1]
                group = np.cumsum(first) - 1
                several = np.bincount(group, minlength=1)[group] > 1 if len(h) else first
                out = []
                # one entry for each anchor, with its chunk + 1, or 0 if its documents are answered here
                keys = anchor_keys(h)
                sent, to = keys[first], np.where(several[first], 0, chunk[i:j][row[first]] + 1)
                for b, at_b in _dealt((sent >> U64(32)).astype(np.int64)):
                    out.append((b, -1, _pack(sent[at_b] & U64(0xFFFFFFFF), to[at_b])))
                known, where = keys[several], chunk[i:j][row[several]]
                for c, at_c in _dealt(where):
                    out.append((c % buckets, c, _pack(np.unique(known[at_c]))))
                yield pa.RecordBatch.from_arrays(_messages(out), ["bucket", "chunk", "data"])

    def answer(table: pa.Table) -> pa.Table:
        """Of a bucket's anchors, those that more than one document holds, to the chunks that asked."""
        forward = table.filter(pc.greater_equal(table.column("chunk"), 0))
        low, to = _unpack_all(table.filter(pc.less(table.column("chunk"), 0)), 2)
        order = np.argsort(low)
        low, to = low[order], to[order].astype(np.int64)
        same = np.zeros(len(low) + 1, bool)
        same[1:-1] = low[1:] == low[:-1]
        again = (same[1:] | same[:-1]) & (to > 0)
        keys, to = low[again] | U64(table.column("bucket")[0].as_py() << 32), to[again] - 1
        _, c, d = _messages([(0, c, _pack(keys[at])) for c, at in _dealt(to)])
        return pa.concat_tables([forward.select(["chunk", "data"]), pa.table([c, d], ["chunk", "data"])])

    def extend(docs: pa.Table, anchors: pa.Table) -> pa.Table:
        """The whole windows around a chunk's repeated anchors, each with the chunk's smallest id, to their buckets."""
        out = []
        if docs.num_rows and anchors.num_rows:
            chunk = docs.column("_chunk")[0].as_py()
            ids = _ids(docs.column(own), base)
            buf, offsets = text_buffer(docs.column(text_col))
            words, at = _words(buf, offsets)
            pos, row = cover_positions(at, period, size)
            pos = pos[np.isin(anchor_keys(window_hashes(words, pos, size)), _unpack_all(anchors, 1)[0])]
            near = np.zeros(len(words) + 1, np.int64)
            np.add.at(near, np.maximum(pos - period + 1, 0), 1)
            np.add.at(near, pos + 1, -1)
            counts = np.maximum(np.diff(at) - window + 1, 0)
            starts = ranges(at[:-1], counts)
            owner = np.repeat(np.arange(len(counts)), counts)
            take = np.cumsum(near)[starts] > 0
            starts, owner = starts[take], ids[owner[take]]
            h = window_hashes(words, starts, window)
            order = np.lexsort((owner, h))
            h, owner, starts = h[order], owner[order], starts[order]
            first = np.ones(len(h), bool)
            first[1:] = h[1:] != h[:-1]
            several = np.zeros(len(h), bool)
            several[1:] = ~first[1:] & (owner[1:] != owner[:-1])
            group = np.cumsum(first) - 1
            local = np.zeros(int(first.sum()), bool)
            local[group[several]] = True
            h, owner, starts = h[first], owner[first], starts[first]
            if local.any():
                out.append((chunk % buckets, chunk, _pack(h[local], owner[local])))
            # the bucket comes from a second hash, so equal windows agree in more than 64 bits
            second, _ = _words(buf, offsets, 1)
            to = (window_hashes(second, starts, window, 1) % U64(buckets)).astype(np.int64)
            for b, at_b in _dealt(to):
                out.append((b, -1 - chunk, _pack(h[at_b], owner[at_b])))
        return pa.table(_messages(out), ["bucket", "chunk", "data"])

    def smallest(table: pa.Table) -> pa.Table:
        """The smallest id of each of a bucket's windows, to the chunks whose own smallest is larger."""
        forward = table.filter(pc.greater_equal(table.column("chunk"), 0)).select(["chunk", "data"])
        asked = table.filter(pc.less(table.column("chunk"), 0))
        h, owner = _unpack_all(asked, 2)
        sizes = [_length(x) for x in asked.column("data")]
        chunk = np.repeat(-1 - asked.column("chunk").to_numpy().astype(np.int64), sizes)
        order = np.lexsort((owner, h))
        h, owner, chunk = h[order], owner[order], chunk[order]
        first = np.ones(len(h), bool)
        first[1:] = h[1:] != h[:-1]
        least = owner[first][np.cumsum(first) - 1] if len(h) else owner
        tell = least < owner
        h, least, chunk = h[tell], least[tell], chunk[tell]
        _, c, d = _messages([(0, c, _pack(h[at], least[at])) for c, at in _dealt(chunk)])
        return pa.concat_tables([forward, pa.table([c, d], ["chunk", "data"])])

    kept = [df.schema[c] for c in plain]
    schema = T.StructType(kept + [T.StructField(n, T.LongType()) for n in ADDED])

    def rebuild(docs: pa.Table, answers: pa.Table) -> pa.Table:
        ids = _ids(docs.column(own), base)
        texts = docs.column(text_col)
        buf, offsets = text_buffer(texts)
        words, at = _words(buf, offsets)
        gone = np.zeros(len(words), bool)
        if answers.num_rows:
            h, least = _unpack_all(answers, 2)
            order = np.lexsort((least, h))
            h, least = h[order], least[order]
            first = np.ones(len(h), bool)
            first[1:] = h[1:] != h[:-1]
            h, least = h[first], least[first]
            counts = np.maximum(np.diff(at) - window + 1, 0)
            starts, owner = ranges(at[:-1], counts), np.repeat(ids, counts)
            mine = window_hashes(words, starts, window)
            maybe = np.zeros(1 << 22, bool)  # quick test by the low bits
            maybe[(h & U64((1 << 22) - 1)).astype(np.int64)] = True
            some = np.flatnonzero(maybe[(mine & U64((1 << 22) - 1)).astype(np.int64)])
            at_h = np.minimum(np.searchsorted(h, mine[some]), len(h) - 1)
            hit = (h[at_h] == mine[some]) & (least[at_h] < owner[some])
            cover = np.zeros(len(words) + 1, np.int64)
            np.add.at(cover, starts[some[hit]], 1)
            np.add.at(cover, starts[some[hit]] + window, -1)
            gone = np.cumsum(cover[:-1]) > 0
        removed = row_sums(gone, at)
        out = []
        for k, text in enumerate(texts):
            text = text.as_py()
            if text is not None:
                pieces = text.encode("utf-8", "surrogatepass").split()
                if removed[k]:
                    pieces = [p for p, g in zip(pieces, gone[at[k] : at[k + 1]].tolist(), strict=True) if not g]
                text = b" ".join(pieces).decode("utf-8", "surrogatepass")
            out.append(text)
        columns = [pa.array(out, pa.string()) if f.name == text_col else docs.column(f.name) for f in kept]
        return pa.table([*columns, pa.array(np.diff(at)), pa.array(removed)], schema.names)

    hold = 4 * bucket_bytes
    asked = _routed(keyed.select(text_col, "_chunk").mapInArrow(ask, MESSAGE), "bucket", buckets, {False: 2, True: 1}, hold)
    answers = _routed(asked.groupBy("bucket").applyInArrow(answer, ANSWER), "chunk", chunks, {True: 1}, hold)
    by_chunk = keyed.groupBy("_chunk")
    windows = _routed(by_chunk.cogroup(answers.groupBy("chunk")).applyInArrow(extend, MESSAGE), "bucket", buckets, {False: 2, True: 2}, hold)
    found = _routed(windows.groupBy("bucket").applyInArrow(smallest, ANSWER), "chunk", chunks, {True: 2}, hold)
    return by_chunk.cogroup(found.groupBy("chunk")).applyInArrow(rebuild, schema)
