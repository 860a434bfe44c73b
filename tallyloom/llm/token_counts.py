"""Token counts by heap-and-linked-list byte-pair merging.

A text is cut at special strings, then into pre-tokens, and each pre-token into bytes.  A heap
holds the adjacent pairs by merge rank; the lowest is popped, its two symbols become one in a
doubly linked list, and the two new neighbouring pairs are pushed.  The count of a pre-token
is its bytes minus its merges; no identifier is ever made.

Counts of pre-tokens (and of pieces between single spaces) are remembered per task in
dictionaries that are emptied at ``MEMO`` entries, so memory is bounded and every text is
counted whole.  No shuffle: one pass over the text.
"""

from __future__ import annotations

import functools
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_buffer, without

#: Entries of a memo before it is emptied.
MEMO = 600_000
#: White space other than the space, and the byte-level pre-token pattern of the vocabulary file (fixed values).
WHITE = [chr(c) for c in (*range(9, 14), *range(28, 32), 133, 160, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary, back to the byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PairMerger:
    """Counts tokens for one byte-level BPE vocabulary (the text of its .json file)."""

    def __init__(self, vocabulary: str):
        spec = json.loads(vocabulary)
        merges = [m if isinstance(m, list) else m.split(" ", 1) for m in spec["model"]["merges"]]
        symbols: dict[str, int] = {}
        number = lambda s: symbols.setdefault(s, len(symbols))
        alphabet = byte_alphabet()
        self.first = [0] * 256
        for char, byte in alphabet.items():
            self.first[byte] = number(char)
        #: rank by pair (left * 2^20 + right), and both symbols and their merger by rank
        self.ranks: dict[int, int] = {}
        self.parts: list[tuple[int, int, int]] = []
        for rank, (a, b) in enumerate(merges):
            left, right = number(a), number(b)
            self.parts.append((left, right, number(a + b)))
            self.ranks.setdefault(left << 20 | right, rank)
        specials = [x["content"] for x in spec.get("added_tokens", [])]
        self.special = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self.probe = specials
        self.split = regex.compile(PRE_TOKEN).findall
        self.words = _Memo(self.merged)
        #: by piece without the space before it
        self.pieces = _Memo(lambda piece: sum(map(self.words.__getitem__, self.split(" " + piece))))

    def merged(self, text: str) -> int:
        """Bytes of one pre-token minus the merges that its heap of pairs allows."""
        raw = text.encode("utf-8", "surrogatepass")
        n = len(raw)
        if n < 2:
            return n
        rank_of, parts, first = self.ranks.get, self.parts, self.first
        sym = [first[b] for b in raw]
        heap = [r << 32 | i for i in range(n - 1) if (r := rank_of(sym[i] << 20 | sym[i + 1], -1)) >= 0]
        if not heap:
            return n
        heapq.heapify(heap)
        after, before, alive = [*range(1, n), -1], [-1, *range(n - 1)], n
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            entry = pop(heap)
            i = entry & 0xFFFFFFFF
            left, right, new = parts[entry >> 32]
            j = after[i]
            if j < 0 or sym[i] != left or sym[j] != right:
                continue  # one side has been merged meanwhile
            sym[i], sym[j] = new, -1
            k = after[i] = after[j]
            alive -= 1
            if k >= 0:
                before[k] = i
                if (r := rank_of(new << 20 | sym[k], -1)) >= 0:
                    push(heap, r << 32 | i)
            h = before[i]
            if h >= 0 and (r := rank_of(sym[h] << 20 | new, -1)) >= 0:
                push(heap, r << 32 | h)
        return alive

    def count(self, text: str) -> int:
        """Tokens of a whole text; each special string in it is one token."""
        if self.special is not None and any(s in text for s in self.probe):
            parts = self.special.split(text)
            return len(parts) - 1 + sum(map(self.plain, parts))
        return self.plain(text)

    def plain(self, text: str) -> int:
        if not text:
            return 0
        # Between two non-space characters a single space starts a pre-token, so such pieces are independent.
        if text[0] == " " or text[-1] == " " or crowded(text):
            return sum(map(self.words.__getitem__, self.split(text)))
        first, *rest = text.split(" ")
        return sum(map(self.words.__getitem__, self.split(first))) + sum(map(self.pieces.__getitem__, rest))


def crowded(text: str) -> bool:
    """Whether a space stands beside another white-space character."""
    return "  " in text or any(c in text and (" " + c in text or c + " " in text) for c in WHITE)


class _Memo(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        if len(self) >= MEMO:
            self.clear()
        value = self.make(key)
        if len(key) <= 64:
            self[key] = value
        return value


@functools.lru_cache(maxsize=1)
def worker_merger(vocabulary: str) -> PairMerger:
    """One merger in each Python worker, so later tasks find its memos filled."""
    return PairMerger(vocabulary)


def count_tokens(df: DataFrame, vocabulary_path: str, text_col: str = "text", limit: int = 1024) -> DataFrame:
    """Add n_bytes, n_tokens and over_limit (n_tokens > ``limit``) to every row.

    ``vocabulary_path``: a byte-level BPE file of the tokenizers library, read on the driver and
    broadcast (its size is fixed by the vocabulary).  A null or empty text has 0 bytes and 0
    tokens.  Columns of these three names are replaced; all others pass through.  An empty
    table gives an empty table; repeated rows are counted each.
    """
    spark = df.sparkSession
    with open(vocabulary_path, encoding="utf-8") as file:
        vocabulary = spark.sparkContext.broadcast(file.read())
    df = without(df, ["n_bytes", "n_tokens", "over_limit"]) if text_col not in ("n_bytes", "n_tokens") else df
    schema = T.StructType([f for f in df.schema.fields if f.name != text_col] + [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = worker_merger(vocabulary.value)
        for batch in batches:
            i = batch.schema.get_field_index(text_col)
            _, offsets = text_buffer(batch.column(i))
            tokens = [merger.count(x.as_py() or "") for x in batch.column(i)]
            rest = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != text_col]
            yield pa.RecordBatch.from_arrays([*(c for _, c in rest), pa.array(np.diff(offsets)), pa.array(tokens, pa.int64())], [*(n for n, _ in rest), "n_bytes", "n_tokens"])

    return df.mapInArrow(counted, schema).withColumn("over_limit", F.col("n_tokens") > limit)
