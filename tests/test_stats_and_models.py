import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom.operators import modeling as ml
from tallyloom.operators import retrieval as rt
from tallyloom.operators import stats as ts
from tallyloom.operators import vectors as em
from tallyloom.operators import windows as wn


def ranks(values):
    order = sorted(values)
    return [np.mean([i + 1 for i, x in enumerate(order) if x == v]) for v in values]


@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 6)), min_size=4, max_size=40))
@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_rank_sums(spark, rows):
    rows = [*rows, ("a", 1), ("b", 2)]
    r = ranks([v for _, v in rows])
    n1, n2 = sum(g == "a" for g, _ in rows), sum(g == "b" for g, _ in rows)
    u = sum(x for x, (g, _) in zip(r, rows) if g == "a") - n1 * (n1 + 1) / 2
    got = ts.compare_two(spark.createDataFrame(rows, "g string, v int"), "g", "a", "b", "v").first()
    assert (got.n1, got.n2, got.u) == (n1, n2, u) and 0 <= got.p_value <= 1
    assert got.rank_biserial == pytest.approx(1 - 2 * u / (n1 * n2))


def test_before_counts_is_exact_in_any_number_of_ranges(spark):
    rng = random.Random(1)
    cells = [(g, float(v), rng.randint(1, 5)) for g in ("a", "b", None) for v in rng.sample(range(1000), 200)]
    df = spark.createDataFrame(cells, "g string, v double, n int")
    for buckets in (2, 7, 200):
        for r in ts.before_counts(df, ["g"], "v", "n", "b", buckets).collect():
            assert r.b == sum(n for g, v, n in cells if g == r.g and v < r.v)


def test_adjusted_p_is_monotone(spark):
    p = [0.01, 0.04, 0.03, 0.2, None]
    got = {r.p: r.p_adj for r in ts.adjust(spark.createDataFrame([(x,) for x in p], "p double"), "p").collect()}
    assert got[0.01] == pytest.approx(0.04) and got[0.03] == got[0.04] == pytest.approx(0.16 / 3) and got[0.2] == pytest.approx(0.2) and got[None] is None


def test_p_value_near_the_exact_one(spark):
    rows = [("a", float(i)) for i in range(30)] + [("b", float(i) + 10.5) for i in range(30)]
    assert ts.compare_two(spark.createDataFrame(rows, "g string, v double"), "g", "a", "b", "v").first().p_value < 1e-3


def test_stratified_sample_is_exact(spark):
    df = spark.createDataFrame([(i, "a" if i % 10 else None) for i in range(1000)], "i int, s string")
    got = ts.stratified_sample(df, "s", 101, "i").collect()
    assert len(got) == 101 and sum(r.s is None for r in got) == 10
    assert ts.stratified_sample(df.limit(5), "s", 101, "i").count() == 5


def test_top_percent(spark):
    df = spark.createDataFrame([(float(v),) for v in (5, 4, 4, 1)] + [(None,)], "v double")
    assert sorted((r.v or 0, r.top_percent) for r in wn.top_percent(df, "v").collect()) == [(0, None), (1, 100), (4, 50), (4, 50), (5, 25)]


@given(st.lists(st.tuples(st.integers(0, 5), st.booleans()), min_size=3, max_size=30))
@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_lift_and_auc(spark, rows):
    df = spark.createDataFrame([(i, float(s), int(y)) for i, (s, y) in enumerate([*rows, (3, True), (2, False)])], "video_id int, score double, y int")
    data = sorted(df.collect(), key=lambda r: (-r.score, r.video_id))
    n, base = len(data), np.mean([r.y for r in data])
    for r in ml.lift_at(df, [0.1, 0.5, 1.0]).collect():
        m = max(1, round(n * r.fraction))
        assert r.m == m and r.precision == pytest.approx(np.mean([x.y for x in data[:m]])) and r.lift == pytest.approx(r.precision / base)
    a, b = [r.score for r in data if r.y], [r.score for r in data if not r.y]
    assert ml.auc(df).first().auc == pytest.approx(np.mean([(x > y) + 0.5 * (x == y) for x in a for y in b]))


def test_threshold_rules(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 1), (0.7, 0), (0.6, 1), (0.1, 0)], "score double, y int")
    r = ml.best_threshold(df, 0.7).first()
    assert (r.threshold, r.recall, r.reached) == (0.6, 1.0, True)
    low = ml.best_threshold(df.where("score < 0.75"), 0.9).first()
    assert not low.reached and low.threshold == 0.6


def test_no_author_in_two_folds_and_leakage_guard(spark):
    df = spark.createDataFrame([(i, f"a{i % 17}") for i in range(200)] + [(999, None)], "i int, author_id string")
    per = ml.author_folds(df).groupBy("author_id").agg(F.count_distinct("fold").alias("n")).collect()
    assert all(r.n == 1 for r in per)
    for bad in ("wer", "view_count", "wer_log"):
        with pytest.raises(ValueError):
            ml.check_leakage(["post_hour", bad])


def test_fold_features_see_training_rows_only(spark):
    train = spark.createDataFrame([(1.0, ["a"] * 1, "x", [1.0, 0.0])] * 6, "n double, l array<string>, c string, v array<double>")
    test = spark.createDataFrame([(None, ["zzz"], "unseen", None)], train.schema)
    built = ml.FoldFeatures(numbers=["n"], lists=["l"], categories=["c"], vectors={"v": 1}).fit(train)
    a, b = built.transform(train).first().features, built.transform(test).first().features
    assert len(a) == len(b) and -1.0 in b.toArray().tolist()


def test_shared_vectors_give_the_features_of_row_vectors(spark):
    rng = random.Random(9)
    vectors = spark.createDataFrame([(i, [rng.gauss(0, 1 + 3 * (j == i % 2)) for j in range(5)]) for i in range(12)] + [(12, [float("nan")] * 5)], "key long, vector array<double>")
    rows = spark.createDataFrame([(i, i * i % 14 if i % 5 else None, float(i), "xyz"[i % 3], "pq"[i % 2]) for i in range(200)], "id int, k long, n double, c string, d string")
    wide = rows.join(vectors.withColumnsRenamed({"key": "k", "vector": "v"}), "k", "left")
    kinds = {"numbers": ["n"], "categories": ["c", "d"], "vectors": {"v": 2}}
    one = ml.FoldFeatures(**kinds).fit(wide.where("id >= 40"))
    two = ml.FoldFeatures(**kinds, shared={"v": ("k", vectors)}).fit(rows.where("id >= 40"))
    a, b = one.transform(wide), two.transform(rows)
    assert one.names(a) == two.names(b)
    a, b = ({r.id: r.features.toArray() for r in d.collect()} for d in (a, b))
    assert a.keys() == b.keys() == set(range(200))
    signs = [1 if a[1][i] * b[1][i] > 0 else -1 for i in range(2)]  # of a component's axis
    for i in a:
        assert list(a[i][:2]) == pytest.approx([s * x for s, x in zip(signs, b[i][:2])]) and list(a[i][2:]) == list(b[i][2:])


def test_priors_leave_the_row_out(spark):
    train = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "g string, v double")
    test = spark.createDataFrame([("a", 0.0), ("new", 0.0)], "g string, v double")
    a, b = ml.target_prior(train, test, "g", "v", "p")
    assert sorted((r.g, r.v, r.p) for r in a.collect()) == [("a", 1.0, 3.0), ("a", 3.0, 1.0), ("b", 5.0, 3.0)]
    assert sorted((r.g, r.p) for r in b.collect()) == [("a", 2.0), ("new", 3.0)]


def test_random_scores_lift_is_about_one(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([(i, rng.random(), int(rng.random() < 0.3)) for i in range(20000)], "video_id int, score double, y int")
    assert ml.lift_at(df, [0.5]).first().lift == pytest.approx(1, abs=0.05)


def test_zero_shot_and_status(spark):
    frames = spark.createDataFrame([("v1", [2.0, 0.0]), ("v1", [float("nan"), 1.0])], "video_id string, vec array<double>")
    prompts = spark.createDataFrame([("format", "a", [1.0, 0.0]), ("format", "b", [0.0, 1.0])], "axis string, label string, vec array<double>")
    videos = spark.createDataFrame([("v1",), ("v2",)], "video_id string")
    texts = spark.createDataFrame([("v1", [1.0, 0.0])], "video_id string, text_vec array<double>")
    got = {r.video_id: r for r in em.visual_features(videos, frames, texts, prompts).collect()}
    assert (got["v1"].status, got["v1"].format_top, got["v1"].format_margin, got["v1"].visual_embedding) == ("partial", "a", 1.0, [1.0, 0.0])
    assert (got["v2"].status, got["v2"].n_frames, got["v2"].format_top) == ("unknown", 0, None)


def test_only_long_texts_are_embedded(spark):
    df = spark.createDataFrame([("",), ("ab",), ("fifteen letters",), (None,)], "t string")
    got = em.embed_text(df, "t", em.hashing_encoder(8), "h").collect()
    assert [r.text_embedding_status for r in got] == ["too_short", "too_short", "embedded", "too_short"]
    assert len(got[2].text_embedding) == 8 and got[0].text_embedding is None and got[0].text_embedding_model is None


def test_similar_drops_missing_parts_and_keeps_one_per_author(spark):
    schema = "video_id string, author_id string, text_vec array<double>, visual_vec array<double>, strategy array<string>, categories array<string>"
    q = spark.createDataFrame([("q", "me", [1.0, 0.0], None, ["s"], ["shoes"])], schema)
    pool = spark.createDataFrame([("a1", "a", [1.0, 0.0], [1.0, 0.0], ["s"], ["shoes"]), ("a2", "a", [1.0, 0.0], None, [], ["shoes"]), ("b", "b", None, None, ["s"], ["bags"]), ("q", "me", [1.0, 0.0], None, None, None)], schema)
    for block in (20_000, 1):
        got = {r.video_id: (r["rank"], round(r.score, 6), r.visual_sim) for r in rt.similar(q, pool, block_rows=block).collect()}
        assert got == {"a1": (1, 0.5, None), "b": (2, 0.0, None)}


def test_assessment(spark):
    rows = [("q", i + 1, f"v{i}", rel) for i, rel in enumerate([True, False, True, False, True])]
    r = rt.assess(spark.createDataFrame(rows, "query_id string, rank int, video_id string, relevant boolean"), 2).first()
    assert (r.picks, r.excluded, r.relevant, r.pattern_allowed) == (["v0", "v2"], 1, 2, True)


def test_streaming_upsert_is_idempotent(spark, tmp_path):
    from tallyloom.streaming import upsert

    target = str(tmp_path / "t")
    make = lambda rows: spark.createDataFrame(rows, "k string, at long, v string")
    upsert.merge(make([("a", 1, "old"), ("b", 5, "b"), (None, 1, "x")]), 0, target, "k", "at", 4)
    for _ in range(2):  # a replayed batch changes nothing
        upsert.merge(make([("a", 2, "new"), ("b", 3, "late"), ("c", 1, "c")]), 1, target, "k", "at", 4)
    assert {(r.k, r.v) for r in upsert.current(spark, target).collect()} == {("a", "new"), ("b", "b"), ("c", "c")}
    assert upsert.current(spark, str(tmp_path / "none")) is None


def by_brute_force(queries, pool, k):
    """Ranked (query, key, rounded score) by the definition, pair by pair."""
    unit = lambda v: None if v is None else [x / sum(y * y for y in v) ** 0.5 for x in v]
    out = {}
    for q in queries:
        best = {}
        for c in pool:
            if c[0] is None or q[0] is None or c[0] == q[0]:
                continue
            parts = []
            for i, w in ((2, 0.4), (3, 0.4)):
                if q[i] is not None:
                    parts.append(w * sum(x * y for x, y in zip(unit(q[i]), unit(c[i]))) if c[i] is not None else 0.0)
            a, b = set(q[4] or []), set(c[4] or [])
            if a:
                parts.append(0.2 * len(a & b) / (len(a | b) + 1))
            if not parts:
                continue
            conflict = bool(q[5]) and bool(c[5]) and not set(q[5]) & set(c[5])
            score = round(sum(parts) - 0.1 * conflict, 9)
            if c[1] not in best or (score, c[0]) > best[c[1]]:
                best[c[1]] = (score, c[0])
        ranked = sorted(best.values(), key=lambda x: (-x[0], x[1]))[:k]
        out[q[0]] = [(key, round(score, 6)) for score, key in ranked]
    return out


@pytest.mark.parametrize("cells, block", [(4096, 2000), (6, 7), (1, 50)])
def test_similarity_index_against_brute_force(spark, cells, block):
    """Copies of one vector in a third of the pool, missing vectors and labels, repeated rows, null keys and authors."""
    rng = random.Random(8)
    vec = lambda: [rng.gauss(0, 1) for _ in range(6)] if rng.random() < 0.8 else None
    hot, labels = [1.0, 2.0, 0.0, 0.5, -1.0, 0.0], lambda: rng.choice([None, [], ["a"], ["a", "b"], ["c", "d", "a"], ["e"]])
    pool = [(f"p{i}", rng.choice([*"uvwxyz", None]) if i % 3 else f"w{i}", hot if i % 3 == 0 else vec(), hot if i % 3 == 0 else vec(), labels(), rng.choice([None, ["s"], ["t"]])) for i in range(180)]
    queries = [(f"q{i}" if i else "p5", None, vec(), vec(), labels(), rng.choice([None, ["s"]])) for i in range(25)]
    pool += [pool[7], (None, "u", hot, hot, ["a"], None)]
    schema = "video_id string, author_id string, text_vec array<double>, visual_vec array<double>, strategy array<string>, categories array<string>"
    got = {}
    for r in rt.similar(spark.createDataFrame(queries, schema), spark.createDataFrame(pool, schema).repartition(3), 5, cells=cells, block_rows=block).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.video_id, round(r.score, 6)))
    want = {q: rows for q, rows in by_brute_force(queries, pool, 5).items() if rows}
    assert got.keys() == want.keys()
    for q in want:
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], abs=1e-6)
        assert got[q] == want[q] or len({s for _, s in want[q]}) < len(want[q])


def test_few_cells_are_visited(spark):
    """Where vectors lie in groups, queries visit a few cells; the bound of every cell holds for all of its rows."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    make = lambda n, tag: [(f"{tag}{i}", f"a{i}", [float(x) for x in centres[i % 40] + rng.normal(0, 0.02, 16)], None, ["l"], None) for i in range(n)]
    schema = "video_id string, author_id string, text_vec array<double>, visual_vec array<double>, strategy array<string>, categories array<string>"
    pool, queries = spark.createDataFrame(make(1200, "p"), schema), spark.createDataFrame(make(30, "q"), schema)
    index = rt.SimilarityIndex(pool, cells=60)
    q = index._numbered(queries)
    first = index.visits(q, 5).count()
    late = index.visits(q.withColumn("least", F.lit(0.4)), 5).count()
    assert (first + late) / (30 * len(index.cells)) < 0.2
    bound = rt._upper_bounds(q.toPandas(), index.shared.value, index.cells)
    rows, cell_at = index.rows.toPandas(), {c: i for i, c in enumerate(index.cells["cell"])}
    for i, r in enumerate(q.collect()):
        scores = np.array([np.dot(r.text, t) for t in rows["text"]]) * 0.4 + 0.2 / 2
        assert (scores <= bound[i][[cell_at[c] for c in rows["cell"]]] + 1e-9).all()


def test_similarity_of_nothing(spark):
    schema = "video_id string, author_id string, text_vec array<double>, visual_vec array<double>, strategy array<string>, categories array<string>"
    none, one = spark.createDataFrame([], schema), spark.createDataFrame([("q", "a", [1.0], None, None, None)], schema)
    assert rt.similar(one, none).count() == 0 and rt.similar(none, one).count() == 0


def test_exact_p_by_enumeration(spark):
    """All orders of small groups; a tied or larger group keeps the normal p."""
    from itertools import combinations

    for n1, n2 in ((1, 1), (2, 3), (3, 4), (4, 4), (5, 3)):
        us = [sum(c) - n1 * (n1 + 1) / 2 for c in combinations(range(1, n1 + n2 + 1), n1)]
        tail = ts.u_tail(n1, n2)
        assert tail == pytest.approx([np.mean([u >= x for u in us]) for x in range(n1 * n2 + 1)])
    assert ts.u_tail(8, 900)[0] == pytest.approx(1) and (np.diff(ts.u_tail(8, 900)) <= 1e-12).all()
    rows = [("a", float(x), True) for x in (1, 2, 3)] + [("a", float(x), False) for x in (4, 5, 6, 7)] + [("b", 1.0, True), ("b", 1.0, False), ("b", 2.0, False)]
    got = {r.g: r for r in ts.rank_sums(spark.createDataFrame(rows, "g string, x double, inside boolean"), ["g"], "x", "inside").collect()}
    assert got["a"].p_value == pytest.approx(2 / 35) and got["a"].u == 0
    assert 0 < got["b"].p_value <= 1


def test_learners_share_fold_features_and_thresholds(spark):
    rows = [(str(i), f"a{i % 9}", float(i % 10), (i * 7 % 13) / 13.0 + (i % 10) / 5.0, i % 2) for i in range(160)]
    df = spark.createDataFrame(rows, "video_id string, author_id string, x double, wer double, fold int")
    fitted = []

    def features():
        fitted.append(1)
        return ml.FoldFeatures(numbers=["x"])

    got = ml.compare(df, "wer", 2, {"a": (features, "logistic"), "b|c": (features, "forest")}, 0.75).orderBy("ord").collect()
    assert len(fitted) == 2  # once a fold, not once a fold and learner
    for r, model in zip(got, ("logistic", "forest"), strict=True):
        want = ml.screening_summary(ml.screening_cv(df, "wer", 2, features, 0.75, model, ["video_id"]))
        assert {c: r[c] for c in ("lift_5", "lift_10", "lift_20", "precision_10", "auc", "spearman")} == pytest.approx({c: want[c] for c in ("lift_5", "lift_10", "lift_20", "precision_10", "auc", "spearman")})
    assert [r.name for r in got] == ["a", "b|c"]


@pytest.mark.parametrize("block", [None, 40, 9])
def test_tiles_against_brute_force(spark, block):
    """Queries that stand in the pool, many ties, queries with labels only, one author with a third of the pool."""
    rng = random.Random(5)
    some = [[rng.gauss(0, 1) for _ in range(5)] for _ in range(4)]
    vec, labels = lambda: rng.choice([None, *some]), lambda: rng.choice([None, [], ["a"], ["a", "b"], ["c", "a"]])
    pool = [(f"p{i:03d}", "big" if i % 3 == 0 else rng.choice([*"uvwxyz", None]) if i % 3 == 1 else f"w{i % 40}", vec(), vec(), labels(), rng.choice([None, ["s"], ["t"]])) for i in range(240)]
    queries = pool[::6] + [(f"q{i}", None, None, None, labels(), None) for i in range(9)]
    pool += [pool[7], (None, "u", some[0], None, ["a"], None)]
    schema = "video_id string, author_id string, text_vec array<double>, visual_vec array<double>, strategy array<string>, categories array<string>"
    got = {}
    for r in rt.similar(spark.createDataFrame(queries, schema), spark.createDataFrame(pool, schema).repartition(3), 4, block_rows=block).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.video_id, round(r.score, 6)))
    assert got == {q: rows for q, rows in by_brute_force(queries, pool, 4).items() if rows}


def test_a_tile_holds_no_row_per_pair(monkeypatch):
    """Copies of one query share a comparison: a tile's ties are held once for all of them."""
    import pandas as pd

    row = lambda n, author: pd.DataFrame({"id": [f"{author}{i:04d}" for i in range(n)], "author_id": [f"{author}{i}" for i in range(n)], "text": None, "visual": None, "strategy": [["a"]] * n, "categories": [["s"]] * n})
    scored, seen = rt._scored, []
    monkeypatch.setattr(rt, "_scored", lambda i, *rest: seen.append(len(i)) or scored(i, *rest))
    got = rt._best_of_tile(row(600, "q"), row(900, "c"), 3)
    assert sum(seen) == 900 and len(got) == 1800 and set(got["c_id"]) == {"c0000", "c0001", "c0002"}
