"""Byte-level BPE encoding and decoding as a tree reduction over a monoid.

The elements are token sequences that are the encoding of their own bytes; the product of two
neighbours is the encoding of their bytes together.  A pre-token is halved down to a few bytes, the
halves are encoded, and neighbours are joined: where the tokens at the seam don't fit, a window
around it is encoded anew and grows until it does.

Why a join is right.  Call two tokens a pair that *fits* if their bytes together encode to just
these two.  Greedy merging takes the lowest rank, leftmost first; until a merge crosses the border
of a stretch of bytes, what happens inside the stretch depends on the stretch alone.  So (a) in an
encoding every two neighbours fit, and (b) a sequence in which every two neighbours fit is the
encoding of its bytes: the first merge across a border would have happened in the two tokens beside
it as well.  A window's own tokens fit by (a); with both of its borders fitting the whole sequence
is the encoding by (b), and the tokens outside are proven stable.

Decoding is a homomorphism to bytes: blocks of tokens are looked up and concatenated up the tree.
Encoding and decoding are one pass each over whole texts, without a shuffle.
"""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import without
from .token_counts import PRE_TOKEN

#: Entries of a memo before it is emptied, and the longest key that enters one.
MEMO, MEMO_KEY = 500_000, 64
#: Bytes that are merged without a tree, and bytes up to which pairs are scanned rather than kept in a heap.
LEAF, SHORT = 8, 48
NEVER = 1 << 60
#: Tokens that are looked up at once when decoding.
BLOCK = 4096


class _Memo(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        if len(self) >= MEMO:
            self.clear()
        value = self.make(key)
        if len(key) <= MEMO_KEY:
            self[key] = value
        return value


class Codec:
    """Encodes and decodes by one rank file (lines of a token in base64 and its rank) and one pre-token pattern."""

    def __init__(self, ranks: bytes, pattern: str):
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, ranks.splitlines()))}
        self.token = {rank: token for token, rank in self.ranks.items()}
        self.code = {token: rank.to_bytes(4, "little") for token, rank in self.ranks.items()}
        self.byte = [bytes([i]) for i in range(256)]
        # white space is the Unicode property, without the separators U+001C to U+001F
        self.split = regex.compile(pattern.replace(r"\s", r"\p{White_Space}")).findall
        self.words = _Memo(lambda word: self.packed(word.encode("utf-8")))
        self.pairs = _Memo(self.merged)

    # --- encoding: the monoid

    def merged(self, raw: bytes) -> list[bytes]:
        """Tokens of a stretch by merging: the lowest rank first, leftmost among equals."""
        n, ranks = len(raw), self.ranks
        if n <= SHORT:
            get, parts = ranks.get, [self.byte[b] for b in raw]
            rank = [get(raw[i : i + 2], NEVER) for i in range(n - 1)]
            while rank and (least := min(rank)) < NEVER:
                i = rank.index(least)
                parts[i] += parts.pop(i + 1)
                del rank[i]
                if i < len(rank):
                    rank[i] = get(parts[i] + parts[i + 1], NEVER)
                if i:
                    rank[i - 1] = get(parts[i - 1] + parts[i], NEVER)
            return parts
        after, before, end = [*range(1, n), -1], [-1, *range(n - 1)], list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = after[i]
            if j < 0 or end[i] < 0 or end[j] != stop:
                continue  # one side has been merged meanwhile
            end[i], end[j], k, h = stop, -1, after[j], before[i]
            after[i] = k
            if k >= 0:
                before[k] = i
                if (r := ranks.get(raw[i : end[k]])) is not None:
                    heapq.heappush(heap, (r, i, end[k]))
            if h >= 0 and (r := ranks.get(raw[h:stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        return [raw[i : end[i]] for i in range(n) if end[i] > 0]

    def fits(self, left: bytes, right: bytes) -> bool:
        """Whether two neighbouring tokens stay as they are."""
        return self.pairs[left + right] == [left, right]

    def join(self, left: list[bytes], right: list[bytes]) -> list[bytes]:
        """The product of two encodings: that of their bytes together."""
        if not left or not right:
            return left or right
        a = b = 1  # tokens of the window on each side of the seam
        window = self.pairs[left[-1] + right[0]]
        while True:
            stable_left = a >= len(left) or window[0] == left[-a] or self.fits(left[-a - 1], window[0])
            stable_right = b >= len(right) or window[-1] == right[b - 1] or self.fits(window[-1], right[b])
            if stable_left and stable_right:
                return left[:-a] + window + right[b:]
            a, b = (a if stable_left else min(2 * a, len(left))), (b if stable_right else min(2 * b, len(right)))
            window = self.merged(b"".join(left[-a:] + right[:b]))

    def tree(self, raw: bytes) -> list[bytes]:
        """Tokens of one pre-token: its halves' tokens, joined."""
        if len(raw) <= LEAF:
            return self.merged(raw)
        half = len(raw) // 2
        return self.join(self.tree(raw[:half]), self.tree(raw[half:]))

    def packed(self, raw: bytes) -> bytes:
        """Ids of one pre-token as little-endian unsigned 32-bit integers; one that is a token itself is that token."""
        return self.code.get(raw) or b"".join(map(self.code.__getitem__, self.tree(raw)))

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, packed.  No special strings: they are ordinary text."""
        return b"".join(map(self.words.__getitem__, self.split(text)))

    # --- decoding

    def decode(self, ids: memoryview) -> bytes:
        """Bytes of a sequence of ids, concatenated up the tree.  An id that the ranks don't hold is a ValueError."""
        if len(ids) > BLOCK:
            half = len(ids) // 2
            return self.decode(ids[:half]) + self.decode(ids[half:])
        try:
            return b"".join(map(self.token.__getitem__, ids.tolist()))
        except KeyError as e:
            raise ValueError(f"no token has the id {e.args[0]}") from None


@functools.lru_cache(maxsize=1)
def worker_codec(ranks: bytes, pattern: str) -> Codec:
    """One codec in each Python worker, so later tasks find its memos filled."""
    return Codec(ranks, pattern)


def _mapped(df: DataFrame, column: str, added: list[T.StructField], keep: bool, ranks_path: str, pattern: str, values) -> DataFrame:
    """``df`` with ``added`` columns made by ``values(codec, cells of column)``; without ``column`` unless ``keep``."""
    with open(ranks_path, "rb") as file:
        ranks = df.sparkSession.sparkContext.broadcast(file.read())
    df = without(df, [f.name for f in added if f.name != column])
    kept = [f for f in df.schema.fields if (keep or f.name != column) and f.name not in {a.name for a in added}]
    names = [f.name for f in kept] + [f.name for f in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(ranks.value, pattern)
        for batch in batches:
            at = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            yield pa.RecordBatch.from_arrays([*(at[f.name] for f in kept), *values(codec, at[column])], names)

    return df.mapInArrow(run, T.StructType(kept + added))


def encode_texts(df: DataFrame, ranks_path: str, pattern: str = PRE_TOKEN, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """Add ids (binary: little-endian unsigned 32-bit integers) and n_tokens to every row, from its whole text.

    ``ranks_path``: a rank file, read on the driver and broadcast (its size is fixed by the
    vocabulary; it must hold every single byte).  Each match of ``pattern`` is encoded by itself.  A
    null or empty text has no tokens.  Columns of the added names are replaced; all others pass
    through.  An empty table stays empty; repeated rows are encoded each.
    """

    def values(codec: Codec, texts: pa.Array) -> list[pa.Array]:
        ids = [codec.encode(x.as_py() or "") for x in texts]
        return [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]

    return _mapped(df, text_col, [T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())], keep_text, ranks_path, pattern, values)


def decode_ids(df: DataFrame, ranks_path: str, ids_col: str = "ids", keep_ids: bool = True) -> DataFrame:
    """Add decoded (binary: the tokens' bytes, end to end) to every row.  Null ids give no bytes; ids outside the
    vocabulary or a length that is no multiple of four fail with a ValueError.  Bytes that are no UTF-8
    text (tokens cut out of a sequence) are returned as they are."""

    def values(codec: Codec, packed: pa.Array) -> list[pa.Array]:
        cells = (x.as_py() or b"" for x in packed)
        return [pa.array([codec.decode(_numbers(x)) for x in cells], pa.binary())]

    return _mapped(df, ids_col, [T.StructField("decoded", T.BinaryType())], keep_ids, ranks_path, PRE_TOKEN, values)


def _numbers(packed: bytes) -> memoryview:
    if len(packed) % 4:
        raise ValueError("packed ids take four bytes each")
    return memoryview(packed).cast("I")
