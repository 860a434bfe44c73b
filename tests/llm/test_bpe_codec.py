import base64
import hashlib
import random
import struct

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom.llm.bpe_codec import Codec, decode_ids, encode_texts
from tallyloom.llm.queries import QUERIES

from .conftest import SF

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
CODEC = Codec(open(PATH, "rb").read(), public_tokenizers.PATTERN)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=CODEC.ranks, special_tokens={})


def ids(packed):
    return list(struct.unpack(f"<{len(packed) // 4}I", packed))


@pytest.mark.parametrize("text", ["", " ", "   x ", "a" * 5000, "ab" * 999, "é" * 700, "中文" * 500, " " * 400, "=-" * 300, "<|endoftext|>", "\x1c x\x85y　 z", "I'll don't 'S 12,5 \n\n \t x"])
def test_texts_as_the_library_gives_them(text):
    assert ids(CODEC.encode(text)) == LIBRARY.encode_ordinary(text)


@given(st.text(st.sampled_from("ab \n\t\x1c\x85　é中😀1²'st!#‍"), max_size=60) | st.text(max_size=40))
@settings(max_examples=400, deadline=None)
def test_any_text(text):
    assert ids(CODEC.encode(text)) == LIBRARY.encode_ordinary(text)
    assert CODEC.decode(memoryview(CODEC.encode(text)).cast("I")) == text.encode()


def greedy(ranks, raw):
    parts = [raw[i : i + 1] for i in range(len(raw))]
    while len(parts) > 1:
        rank, i = min((ranks.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank == 1 << 40:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), max_size=25), st.binary(max_size=0) | st.lists(st.sampled_from(b"abc"), max_size=80).map(bytes), st.integers(0, 80))
@settings(max_examples=300, deadline=None)
def test_any_merges_and_any_cut(pairs, raw, cut):
    """Vocabularies of random merges: tree, merging and the product at any cut equal greedy merging."""
    tokens = [b"a", b"b", b"c"]
    for i, j in pairs:
        new = tokens[i % len(tokens)] + tokens[j % len(tokens)]
        if new not in tokens and len(new) < 20:
            tokens.append(new)
    codec = Codec(b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(tokens)), r".+")
    want = greedy(codec.ranks, raw)
    assert codec.merged(raw) == want and codec.tree(raw) == want
    assert codec.join(codec.merged(raw[:cut]), codec.merged(raw[cut:])) == want


def test_windows_grow_at_the_seam():
    codec = Codec(b"\n".join(base64.b64encode(b"a" * n) + b" %d" % i for i, n in enumerate((1, 2, 4, 8))), r".+")
    seen = []
    merged = codec.merged
    codec.merged = lambda raw: seen.append(len(raw)) or merged(raw)
    assert codec.join(merged(b"a" * 13), merged(b"a" * 11)) == [b"a" * 8] * 3
    assert len(seen) > 1


def test_query_against_the_library(spark, small):
    got = {r.doc_id: r for r in QUERIES["op12_bpe_codec"](spark, SF).collect()}
    docs = small("documents").collect()
    assert len(got) == len(docs)
    for r in docs:
        want = LIBRARY.encode_ordinary(r.text or "")
        row = got[r.doc_id]
        assert row.n_tokens == len(want)
        assert row.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(want)}I", *want)).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_odd_rows(odd_docs, no_docs):
    clash = odd_docs.withColumn("ids", F.lit("mine")).withColumn("decoded", F.lit(1)).withColumn("n_tokens", F.lit(None).cast("map<string,int>"))
    found = decode_ids(encode_texts(clash, PATH, keep_text=True), PATH)
    assert sorted(found.columns) == sorted(["doc_id", "text", "lang", "source", "n_chars", "n_words", "extra", "ids", "n_tokens", "decoded"])
    rows = found.collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        assert bytes(r.decoded) == (r.text or "").encode() and r.n_tokens == len(r.ids) // 4
    assert encode_texts(no_docs, PATH).count() == 0 and decode_ids(encode_texts(no_docs, PATH), PATH).count() == 0


def test_long_words_and_ids_outside_the_vocabulary():
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefgh") for _ in range(30_000))
    assert ids(CODEC.encode(text)) == LIBRARY.encode_ordinary(text)
    with pytest.raises(ValueError):
        CODEC.decode(memoryview(struct.pack("<I", 4_000_000)).cast("I"))
