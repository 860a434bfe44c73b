import hashlib
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from tallyloom.llm import merkle
from tallyloom.llm.queries import QUERIES

from .conftest import SF


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels_of(nodes, fanout=16):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def steps_of(levels, pos, fanout=16):
    steps = []
    for level in levels[:-1]:
        run = level[pos // fanout * fanout :][:fanout]
        steps.append(("".join(run[: pos % fanout]), "".join(run[pos % fanout + 1 :])))
        pos //= fanout
    return steps


def lowered(s):
    return s and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def expected(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of (doc_id, source, lang, n_chars, text) rows, by the contract."""
    by_source = defaultdict(list)
    for r in rows:
        by_source[r[1]].append((r[0] is not None, r[0] or 0, sha(*map(field, r)), r))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels_of([x[2] for x in sorted(by_source[s], key=lambda x: x[:3])]) for s in order}
    top = levels_of([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for pos, (_, _, leaf, r) in enumerate(sorted(by_source[s], key=lambda x: x[:3])):
            steps = steps_of(trees[s], pos) + steps_of(top, k)
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            node = sha(*map(field, (*r[:4], lowered(r[4])))) if hit else leaf
            for left, right in steps:
                node = sha(left, node, right)
            out.append((r[0], leaf, trees[s][-1][0], top[-1][0], sha(*(a + b for a, b in steps)), node, node == top[-1][0]))
    return out


NAMES = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_query_against_brute_force(spark, small):
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in small("documents").collect()]
    want, got = expected(rows), QUERIES["op13_merkle_manifest"](spark, SF).select(*NAMES).collect()
    assert sorted(want, key=repr) == sorted(map(tuple, got), key=repr)
    assert {r.verified for r in got} == {True, False}


def manifest(docs, fanout=16):
    leaf = merkle.digest(*[merkle.field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars", "text")])
    found = merkle.merkle_manifest(docs, leaf, "source", "doc_id", {"doc_id": F.col("doc_id")}, fanout)
    return found.withColumn("folded", merkle.fold(F.col("leaf"), F.col("steps")))


def test_odd_rows(odd_docs, no_docs):
    """Repeated rows, null and equal ids, null sources, and columns named like the operator's own."""
    docs = odd_docs.withColumns({"key": F.lit(1), "pos": F.lit("x"), "hash": F.lit(None).cast("map<string,int>"), "leaf": F.lit(2)})
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in odd_docs.collect()]
    got = manifest(docs).collect()
    assert all(r.folded == r.root for r in got)
    assert sorted((repr(x[0]), x[1], x[2], x[3]) for x in expected(rows)) == sorted((repr(r.doc_id), r.leaf, r.subroot, r.root) for r in got)
    assert manifest(no_docs).count() == 0


def test_sizes_around_a_run_and_narrow_trees(spark):
    """Groups of 1 to 17 and of 256 and 257 rows, and one tree of each fanout."""
    sizes = {"a": 1, "b": 15, "c": 16, "d": 17, "e": 256, "f": 257, None: 2}
    rows = [(i, s, None, i, f"t{i}") for s, n in sizes.items() for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    want = sorted((s[1:5]) for s in expected(rows))
    got = manifest(docs)
    got = got.withColumn("proof", F.sha2(merkle.siblings(F.col("steps")).cast("binary"), 256)).collect()
    assert sorted((r.leaf, r.subroot, r.root, r.proof) for r in got) == want
    assert {r.group for r in got} == set(sizes)
    few = docs.where("doc_id < 9")
    for fanout in (2, 3):
        found = manifest(few, fanout).collect()
        assert all(r.folded == r.root for r in found) and len({r.root for r in found}) == 1


def test_one_row_is_its_own_root(spark):
    docs = spark.createDataFrame([(1, "s", "en", 1, "x")], "doc_id long, source string, lang string, n_chars long, text string")
    r = manifest(docs).first()
    assert r.leaf == r.subroot == r.root == r.folded and r.steps == []


def test_offsets_without_broadcast(small, monkeypatch):
    want = sorted((r.doc_id, r.root) for r in manifest(small("documents")).collect())
    monkeypatch.setattr(merkle, "BROADCAST_SPANS", -1)
    assert sorted((r.doc_id, r.root) for r in manifest(small("documents")).collect()) == want
