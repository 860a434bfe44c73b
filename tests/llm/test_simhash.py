import random
import re

import xxhash

from tallyloom.llm import simhash
from tallyloom.llm.queries import QUERIES

from .conftest import SF
from .test_lines_tokens_rules import ascii_lower, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def print_of(text):
    w = WORD.findall(ascii_lower(text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(prints, radius=2):
    """Smallest id reachable, for (id, fingerprint) rows."""
    nodes = sorted(set(p for _, p in prints))
    parent = {p: p for p in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                parent[root(a)] = root(b)
    least = {}
    for i, p in prints:
        if i is not None:
            least[root(p)] = min(least.get(root(p), i), i)
    return sorted(((i, f"{p:016x}", least.get(root(p))) for i, p in prints), key=repr)


def got(df):
    return sorted(((r.doc_id, f"{r.fp & (2**64 - 1):016x}", r.component_id) for r in df.collect()), key=repr)


def test_odd_documents(odd_docs, no_docs):
    want = groups([(r.doc_id, print_of(r.text)) for r in odd_docs.collect()])
    assert got(simhash.near_duplicates(odd_docs)) == want
    assert simhash.near_duplicates(no_docs).count() == 0


def test_links_in_small_tiles_and_long_chains(spark):
    rng = random.Random(2)
    prints = [rng.getrandbits(64) for _ in range(300)]
    for start in prints[:12]:  # chains and clusters of near values
        x = start
        for _ in range(15):
            x ^= 1 << rng.randrange(64)
            x ^= 1 << rng.randrange(64)
            prints.append(x)
            prints.append(start ^ 1 << rng.randrange(64))
    prints = [*dict.fromkeys(prints), 0, 1, 2**64 - 1, 2**64 - 4]
    signed = [(i, p - 2**64 if p >= 2**63 else p) for i, p in enumerate(prints)]
    classes = spark.createDataFrame([(p,) for _, p in signed], "fp long")
    for tile in (4, 16384):
        roots = dict(map(tuple, simhash.components(simhash.links(classes, 2, tile)).collect()))
        label = {i: roots.get(p, p) for i, p in signed}
        want = {i: c for i, _, c in groups(list(enumerate(prints)))}
        same = {}
        for i in label:
            same.setdefault(label[i], set()).add(want[i])
        assert all(len(s) == 1 for s in same.values()) and len(same) == len(set(want.values()))


def test_query_and_one_of_each_group(spark, small):
    want = groups([(r.doc_id, print_of(r.text)) for r in small("documents").collect()])
    assert any(i != c for i, _, c in want)
    assert rows(QUERIES["op5_simhash_near_dedup"](spark, SF), "doc_id", "fingerprint", "component_id") == want
    kept = [r.doc_id for r in simhash.keep_one(small("documents")).collect()]
    assert sorted(kept) == sorted({c for _, _, c in want})


def kept_by_brute_force(rows):
    """The (id, text) kept of each component of rows: smallest id, null last."""
    by = {}
    for k, (i, t) in enumerate(rows):
        by[k] = (i, t)
    roots = {k: c for k, _, c in groups([(k, print_of(t)) for k, (_, t) in by.items()])}
    first = {}
    for k, (i, t) in by.items():
        first.setdefault(roots[k], []).append((i is None, i or 0, print_of(t)))
    return sorted(min(v)[:2] for v in first.values())


def test_keep_one_of_odd_rows(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    for limit in (250_000, -1):  # broadcast and join
        kept = simhash.keep_one(odd_docs, broadcast_limit=limit)
        assert kept.columns == odd_docs.columns
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == kept_by_brute_force(rows)
    assert simhash.keep_one(no_docs).count() == 0


def test_keep_one_where_ids_repeat_with_other_texts(spark):
    a, b = "one two three four five six seven", "quite another text that is like no other here"
    rows = [(3, a), (5, a), (5, b), (None, a), (None, b + " with a different end of its own"), (7, b), (7, b)]
    docs = spark.createDataFrame([(i, t, k, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, _row int, _fp int")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 99, r.text, r._row) for r in kept.collect()) == [(3, a, 0), (5, b, 2), (99, rows[4][1], 4)]
