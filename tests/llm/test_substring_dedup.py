import hashlib
import re
from collections import defaultdict

import pytest

from tallyloom.llm import substring_dedup
from tallyloom.llm.queries import QUERIES
from tallyloom.llm.substring_dedup import COVERS, remove_repeats

from .conftest import SF
from .test_lines_tokens_rules import rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def expected(docs, window=13):
    big = float("inf")
    least = defaultdict(lambda: big)
    split = [((big if i is None else i), WORD.findall(t or "")) for i, t in docs]
    for i, w in split:
        for p in range(len(w) - window + 1):
            k = tuple(w[p : p + window])
            least[k] = min(least[k], i)
    out = []
    for (i, w), (doc, text) in zip(split, docs):
        gone = set()
        for p in range(len(w) - window + 1):
            if least[tuple(w[p : p + window])] < i:
                gone.update(range(p, p + window))
        out.append((doc, len(w), len(gone), None if text is None else " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in df.collect()), key=repr)


def test_covers_hold_every_difference():
    for v, d in COVERS.items():
        assert {(a - b) % v for a in d for b in d} == set(range(v))


@pytest.mark.parametrize("window", [13, 3, 7, 20])
@pytest.mark.parametrize("small_parts", [False, True])
def test_windows(odd_docs, window, small_parts):
    want = expected([(r.doc_id, r.text) for r in odd_docs.collect()], window)
    assert any(x[2] for x in want)
    options = {"chunk_bytes": 3000, "bucket_bytes": 2000} if small_parts else {}
    assert got(remove_repeats(odd_docs, window=window, **options)) == want


def test_matches_of_exactly_one_window_at_every_shift(spark):
    common = [f"c{i}" for i in range(13)]
    docs = [(k, " ".join([f"a{k}_{i}" for i in range(k)] + common + [f"b{k}"])) for k in range(20)]
    found = remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), chunk_bytes=100, bucket_bytes=100)
    assert {r.doc_id: r.n_removed for r in found.collect()} == {k: 13 * (k > 0) for k in range(20)}


def test_more_receivers_than_a_sender_deals_to(odd_docs, monkeypatch):
    monkeypatch.setattr(substring_dedup, "FAN", 3)
    want = expected([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert got(remove_repeats(odd_docs, chunk_bytes=3000, bucket_bytes=2000)) == want


@pytest.mark.parametrize("ids", [["b", "a", "", None, "ä", "a"], [2**63 - 1, None, -(2**63), 0, 5, 5], [7, None, 2**63 - 1, 3, 3, None], [None] * 6])
def test_ids_of_other_kinds(spark, ids):
    texts = [" ".join(f"w{i}" for i in range(a, a + 30)) for a in (0, 5, 10, 0, 20, 8)]
    order = {x: k for k, x in enumerate(sorted((x for x in set(ids) if x is not None), key=lambda x: x.encode() if isinstance(x, str) else x))}
    ranked = [(None if i is None else order[i], t) for i, t in zip(ids, texts, strict=True)]
    want = [(n, g, t) for _, n, g, t in expected(ranked)]
    found = remove_repeats(spark.createDataFrame(list(zip(ids, texts, strict=True)), f"doc_id {'string' if 'a' in ids else 'long'}, text string"))
    assert sorted((r.n_words, r.n_removed, r.text) for r in found.collect()) == sorted(want)


def test_very_many_copies_of_a_row(spark):
    text = " ".join(f"w{i}" for i in range(20))
    rows = [(1, text)] * 10_000 + [(0, text + " more"), (2, "so " + text)]
    found = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), chunk_bytes=50_000, bucket_bytes=50_000)
    assert {(r.doc_id, r.n_removed, r.text): r["count"] for r in found.groupBy("doc_id", "n_removed", "text").count().collect()} == {(1, 20, ""): 10_000, (0, 0, text + " more"): 1, (2, 20, "so"): 1}


def test_empty_table(no_docs):
    assert remove_repeats(no_docs).count() == 0


def test_query(spark, small):
    want = [(i, n, g, hashlib.sha256((t or "").encode()).hexdigest()) for i, n, g, t in expected([(r.doc_id, r.text) for r in small("documents").collect()])]
    assert rows(QUERIES["op7_substring_dedup"](spark, SF), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(want, key=repr)
