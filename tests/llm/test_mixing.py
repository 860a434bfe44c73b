import re
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyloom.llm.mixing import draw_mixture, manifest, mix_sources, splitting_tree, water_fill
from tallyloom.llm.queries import QUERIES

from .conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@given(st.lists(st.integers(0, 1000), min_size=1, max_size=12))
@settings(max_examples=200, deadline=None)
def test_targets(sizes):
    weights = [(3, 1, 2)[i % 3] for i in range(len(sizes))]
    t = water_fill(sizes, weights)
    assert abs(sum(t) - 1.5 * sum(sizes)) < 1e-6
    assert all(x <= 2 * s + 1e-9 for x, s in zip(t, sizes))
    free = [x / w for x, s, w in zip(t, sizes, weights) if x < 2 * s - 1e-9]
    assert max(free, default=0) - min(free, default=0) < 1e-6
    assert all(2 * s / w <= min(free, default=1e18) + 1e-6 for x, s, w in zip(t, sizes, weights) if s and x >= 2 * s - 1e-9)


@given(st.lists(st.integers(0, 40), min_size=1, max_size=6), st.integers(1, 9), st.integers(0, 5))
@settings(max_examples=200, deadline=None)
def test_tree_keeps_quotas_and_shard_sizes(units, shards, seed):
    m = splitting_tree(units, shards, seed)
    assert m.sum(1).tolist() == units and (m >= 0).all()
    assert m.sum(0).max() - m.sum(0).min() <= 1


def test_tree_splits_like_random_deals():
    draws = np.array([splitting_tree([30, 10], 4, s)[1, 0] for s in range(3000)])
    assert abs(draws.mean() - 2.5) < 0.1  # hypergeometric: 10 of 40 into a shard of 10
    assert abs(draws.var() - 10 * 0.25 * 0.75 * 30 / 39) < 0.15


def check(docs, got):
    sizes = Counter()
    for i, s, t in docs:
        sizes[s] += len(WORD.findall(t or ""))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = dict(zip(names, water_fill([sizes[s] for s in names], [(3, 1, 2)[k % 3] for k in range(len(names))])))
    assert sorted((repr(i), len(WORD.findall(t or ""))) for i, _, t in docs) == sorted((repr(r.doc_id), r["size"]) for r in got)
    taken = defaultdict(int)
    for r in got:
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r["size"] and r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6
    for s in names:
        assert abs(taken[s] - target[s]) < 1 + 1e-6


def test_odd_documents(odd_docs, no_docs):
    docs = [(r.doc_id, r.source, r.text) for r in odd_docs.collect()]
    for rows in (4096, 5):
        mixed = mix_sources(odd_docs, block_rows=rows, shards=4)
        got = mixed.collect()
        check(docs, got)
        assert Counter(map(repr, got)) == Counter(map(repr, mix_sources(odd_docs.repartition(2), block_rows=rows, shards=4).collect()))
        shards = Counter()
        for r in got:
            assert sum(d.words for d in r.draws) == r.taken and len({d["copy"] for d in r.draws}) == len(r.draws)
            shards.update(d.shard for d in r.draws)
        assert all(0 <= s < 4 for s in shards)
        assert manifest(mixed).count() == sum(len(r.draws) for r in got)
    assert len(shards) == 4
    assert mix_sources(no_docs).count() == 0


def test_mixture_has_the_texts(odd_docs, no_docs):
    texts = defaultdict(set)
    for r in odd_docs.collect():
        texts[r.doc_id, r.source].add(r.text)
    mixed = draw_mixture(odd_docs, block_rows=5, shards=4)
    assert mixed.columns[:3] == ["doc_id", "source", "text"]
    cut = 0
    for r in mixed.collect():
        whole = [t for t in texts[r.doc_id, r.source] if t and t.startswith(r.text)]
        assert whole and len(WORD.findall(r.text)) == r.words
        if r.words < r["size"]:
            cut += 1
            assert WORD.search(r.text[-1]) and r.text not in texts[r.doc_id, r.source]
        else:
            assert r.text in whole
    assert cut
    row = lambda r: (repr(r.doc_id), r.source, r.shard, r.order, r["copy"], r.words)
    assert Counter(map(row, mixed.collect())) == Counter(map(row, manifest(mix_sources(odd_docs, block_rows=5, shards=4)).collect()))
    parts = mixed.select("shard", "order").rdd.glom().collect()
    assert len(parts) == 4
    for k, part in enumerate(parts):
        assert {r.shard for r in part} == {k} and [r.order for r in part] == sorted(r.order for r in part)
    assert draw_mixture(no_docs).count() == 0


def test_query(spark, small):
    got = QUERIES["op2_mix_sources"](spark, SF).collect()
    check([(r.doc_id, r.source, r.text) for r in small("documents").collect()], got)
