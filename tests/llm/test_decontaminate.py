import hashlib
import random
import re
import time

import pyarrow as pa

from tallyloom.llm import decontaminate as decontaminate_module
from tallyloom.llm.common import text_buffer
from tallyloom.llm.decontaminate import benchmark_overlap, decontaminate
from tallyloom.llm.queries import QUERIES

from .conftest import SF
from .test_lines_tokens_rules import ascii_lower, rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(ascii_lower(t or ""))


def expected(docs, items, window=13):
    heads = {}
    for name, text in items:
        w = words(text)
        m = min(window, len(w))
        for p in range(len(w) - m + 1) if w else ():
            heads.setdefault(tuple(w[p : p + m]), set()).add(str(name))
    sizes = {len(h) for h in heads}
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for m in sizes:
            for p in range(len(w) - m + 1):
                if (k := tuple(w[p : p + m])) in heads:
                    hit.update(range(p, p + m))
                    found |= heads[k]
        out.append((i, len(w), len(hit), len(found), ",".join(sorted(found))))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, ",".join(r["items"])) for r in df.collect()), key=repr)


def test_overlap_in_one_block_and_in_many(spark, odd_docs, no_docs):
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    long = [t for _, t in docs if t and len(t) > 150]
    items = [(1, long[0][:150]), (2, "The Cat"), (3, None), (4, "..."), (5, "a1"), (10, long[1][20:140]), (11, long[1][20:140]), (12, long[2] + " tail"), (2, "sat on é")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for window in (13, 4):
        want = expected(docs, items, window)
        assert any(x[2] for x in want)
        assert got(benchmark_overlap(odd_docs, bench, window=window)) == want
        assert got(benchmark_overlap(odd_docs, bench, window=window, block_bytes=100)) == want
    assert benchmark_overlap(no_docs, bench).count() == 0
    assert all(r.n_hit == 0 for r in benchmark_overlap(odd_docs, bench.limit(0)).collect())


def test_longest_match(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, "x y " + text + " z"), (2, text[:100])], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "q " + " ".join(f"w{i}" for i in range(5, 40)))], "item_id long, text string")
    found = {r.doc_id: (r.longest_match, r.longest_item) for r in benchmark_overlap(docs, bench).collect()}
    assert found == {1: (35, "7"), 2: (len(words(text[:100])) - 5 - (0 if text[100] == " " else 1), "7")}


def all_matches(doc, items, window):
    """Maximal verbatim matches of at least a window (or a whole shorter item) as (item, doc word, item word, words)."""
    w, out = words(doc), set()
    for name, text in items:
        v = words(text)
        least = min(window, len(v))
        for p in range(len(w)):
            for q in range(len(v)):
                if w[p] == v[q] and (p == 0 or q == 0 or w[p - 1] != v[q - 1]):
                    n = 0
                    while p + n < len(w) and q + n < len(v) and w[p + n] == v[q + n]:
                        n += 1
                    if n >= least:
                        out.add((str(name), p, q, n))
    return out


def test_places_of_matches_against_brute_force(spark):
    rng = random.Random(7)
    items = [(k, " ".join(f"{k}x{rng.randrange(9)}" for _ in range(rng.choice([3, 20, 40])))) for k in range(6)]  # words of an item repeat, no two items share one
    docs = []
    for i in range(40):
        parts = []
        for _ in range(rng.randrange(4)):
            w = rng.choice(items)[1].split()
            a = rng.randrange(len(w))
            parts += w[a : a + rng.randrange(1, 40)] + rng.choice([[], ["-"], ["other"]])
        docs.append((i, " ".join(parts)))
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for window, block in ((5, 8_000_000), (13, 8_000_000), (5, 100)):
        seen = 0
        for r in benchmark_overlap(frame, bench, window=window, block_bytes=block).collect():
            want = all_matches(docs[r.doc_id][1], items, window)
            found = [tuple(m) for m in r.matches]
            # a window that an item repeats is listed at its first place, so later places may be missing
            assert len(found) == len(set(found)) and set(found) <= want
            assert r.longest_match == max((m[3] for m in found), default=0)
            covered = {(m[0], x) for m in found for x in range(m[1], m[1] + m[3])}
            assert covered == {(m[0], x) for m in want for x in range(m[1], m[1] + m[3])}
            seen += len(found)
        assert seen > 20


def test_long_matches_cost_little():
    text = " ".join(f"w{i}" for i in range(20_000))
    test = decontaminate_module.TestSuffixes([("a", text)], 13)
    hashes, at = decontaminate_module.words_of(*text_buffer(pa.array(["x " + text + " y"])))
    began = time.perf_counter()
    word, which, longest = decontaminate_module.search(hashes, at, test)
    assert time.perf_counter() - began < 1
    assert len(word) == 20_000 - 12 and longest.tolist() == [[1, 0, 20_000]]


def test_query_and_removal(spark, small):
    docs, items = ([(r[0], r[1]) for r in small(t).select(c, "text").collect()] for t, c in (("documents", "doc_id"), ("benchmark", "item_id")))
    want = [(i, n, h, k, hashlib.sha256(s.encode()).hexdigest(), h > 0 and 20 * h >= n) for i, n, h, k, s in expected(docs, items)]
    assert any(x[-1] for x in want)
    assert rows(QUERIES["op1_decontaminate"](spark, SF), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted(want, key=repr)
    kept = {r.doc_id for r in decontaminate(small("documents"), small("benchmark")).collect()}
    assert kept == {x[0] for x in want if not x[-1]}
