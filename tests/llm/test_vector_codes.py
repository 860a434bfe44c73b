import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import vector_codes
from tallyloom.llm.queries import QUERIES
from tallyloom.llm.vector_codes import compress, dictionary, part_distances

from .conftest import SF

SCHEMA = "vec_id long, embedding array<float>, label int, code string, packed map<string,int>"


def expected(rows, scale=1024, parts=4, entries=256, rounds=4):
    """(vec_id, code, error, label_error) and the codebooks' digest, by the contract, one part after the other."""
    kept = [(i, [math.floor(scale * x) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: r[0])
    dims = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * dims : (p + 1) * dims]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    nearest = lambda v, p: min((far(cut(v, p), e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(nearest(v, p)[1], []).append(cut(v, p))
            for k, g in groups.items():
                books[p][k] = [sum(c) // len(g) for c in zip(*g, strict=True)]
    out, by_label = [], {}
    for i, v, label in kept:
        found = [nearest(v, p) for p in range(parts)]
        error = sum(d for d, _ in found)
        by_label[label] = by_label.get(label, 0) + error
        out.append((i, "".join(f"{k:02x}" for _, k in found), error, label))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((i, c, e, by_label[label]) for i, c, e, label in out), digest


def test_query_against_brute_force(spark, small):
    rows = [(r.vec_id, r.embedding, r.label) for r in small("embeddings").collect()]
    want, digest = expected(rows)
    got = QUERIES["op11_vector_codes"](spark, SF).collect()
    assert sorted((r.vec_id, r.code, r.error, r.label_error) for r in got) == want
    assert {r.codebooks_sha256 for r in got} == {digest}


def test_odd_rows(spark, monkeypatch):
    """Null, empty, non-finite and short vectors go; repeated rows, null labels, other columns of clashing names stay right."""
    rng = np.random.default_rng(1)
    make = lambda: [float(x) for x in rng.normal(size=8).astype("float32")]
    same = make()
    rows = [(i, make(), [None, 1, 2][i % 3]) for i in range(40)] + [(50 + i, same, None) for i in range(30)] + [(7, same, 9)] * 3
    bad = [(100, None, 1), (101, [], 1), (102, [*make()[:7], None], 1), (103, [*make()[:7], float("nan")], 1), (104, [*make()[:7], float("inf")], 2), (105, make()[:4], 2)]
    docs = spark.createDataFrame([(*r, "mine", {"a": 1}) for r in rows + bad], SCHEMA).repartition(3)
    want, digest = expected([r for i, r in enumerate(rows)], entries=16)
    for most in (vector_codes.BROADCAST_LABELS, -1):
        monkeypatch.setattr(vector_codes, "BROADCAST_LABELS", most)
        coded, books = compress(docs, entries=16)
        got = coded.collect()
        assert vector_codes.codebooks_digest(books) == digest or len({r[0] for r in rows}) < len(rows)
        assert len(got) == len(rows)
        assert {(r.vec_id, r.label) for r in got} == {(r[0], r[2]) for r in rows}
        assert all(len(r.code) == 8 for r in got)
        for label in (None, 1, 2, 9):
            at = [r for r in got if r.label == label]
            assert {r.label_error for r in at} == {sum(r.error for r in at)}


def test_empty_table_and_huge_components(spark):
    none = spark.createDataFrame([], SCHEMA)
    coded, books = compress(none)
    assert coded.count() == 0 and all(b.shape == (0, 1) for b in books)
    huge = spark.createDataFrame([(1, [1e30, 0.0, -1e30, 2.0], 1, "", None), (2, [0.0, 0.0, 0.0, 0.0], None, "", None)], SCHEMA)
    coded, books = compress(huge, entries=1)
    assert [r.error for r in coded.orderBy("vec_id").collect()] == [0, 2 * vector_codes.LIMIT**2 + 2048**2] or coded.count() == 2


def test_unequal_parts_and_no_label(spark):
    rows = [(i, [float(i % 5), float(i % 3), 1.0, 0.5 * i, 2.0, -0.25 * i], 0, "", None) for i in range(30)]
    coded, books = compress(spark.createDataFrame(rows, SCHEMA), label_col=None, entries=4)
    assert [b.shape[1] for b in books] == [2, 2, 1, 1] and "label_error" not in coded.columns
    assert coded.agg(F.min("error")).first()[0] >= 0
    with pytest.raises(ValueError):
        compress(spark.createDataFrame(rows, SCHEMA), entries=300)


def test_dictionaries_and_tables():
    rng = np.random.default_rng(2)
    for values in (rng.integers(-50, 50, 500), rng.integers(-(1 << 26), 1 << 26, 300), np.array([7])):
        distinct, code = dictionary(values)
        assert (distinct[code] == values).all() and (np.diff(distinct) > 0).all()
    for spread in (100, 1 << 26):
        x, e = rng.integers(-spread, spread, (2500, 5)), rng.integers(-spread, spread, (17, 5))
        assert (part_distances(x, e) == ((x[:, None, :] - e[None]) ** 2).sum(2)).all()
