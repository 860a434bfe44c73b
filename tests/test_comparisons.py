import random
from copy import copy

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import comparisons as cmp
from tallyloom.operators import modeling as ml


@pytest.fixture(scope="module")
def rows(spark):
    """The value follows from ``good`` and the label ``hot``; ``idle`` says nothing."""
    rng = random.Random(3)
    out = []
    for i in range(900):
        good, hot, idle = rng.random() * 10, rng.random() < 0.4, rng.random() * 10
        out.append((f"v{i}", f"a{i % 90}", ["north", "south", None][i % 3], i % 2, good, idle, ["hot"] if hot else ["cold", "new"], ["x", "y"][i % 3 % 2], 1 + good + 6 * hot + rng.random() * 0.1))
    return spark.createDataFrame(out, "video_id string, author_id string, brand string, fold int, good double, idle double, tags array<string>, kind string, wer_like double")


@pytest.fixture(scope="module")
def cache(rows):
    return cmp.FoldCache(rows, 2, lambda: ml.FoldFeatures(numbers=["good", "idle"], lists=["tags"], categories=["kind"]), ["video_id", "author_id", "brand", "wer_like"])


def test_names_follow_the_vector(cache):
    for fold in cache.folds:
        names = [n for _, n in fold.names]
        assert names[:2] == ["good", "idle"] and {"tags=hot", "tags=cold", "tags=new", "kind=x", "kind=y"} <= set(names)
        assert fold.train.first().features.size == len(names)
        assert {r.fold for r in fold.test.select("fold").distinct().collect()} == {fold.number}


def test_places_of_a_variant(cache):
    train, test = cache.rows(cache.folds[0], ["good", "tags"], [cmp.author_prior("wer_like", "author_id")])
    want = sum(s in ("good", "tags") for s, _ in cache.folds[0].names) + 1
    assert train.first().features.size == test.first().features.size == want and train.count() + test.count() == 900


def test_rows_with_priors_are_joined_once(cache):
    """Learners that share priors read the same written rows; other priors make other rows."""
    prior, other = cmp.author_prior("wer_like", "author_id"), cmp.author_prior("wer_like", "brand")
    made = [cache.rows(cache.folds[0], ["good"], [p]) for p in (prior, prior, other)]
    assert made[0][0].inputFiles() == made[1][0].inputFiles() != made[2][0].inputFiles()
    lazy = cache._rows(cache.folds[0], ["good"], [prior])
    for written, joined in zip(made[0], lazy):
        assert "Join" not in written._jdf.queryExecution().optimizedPlan().toString()
        assert {r.video_id: r.features for r in written.collect()} == {r.video_id: r.features for r in joined.collect()}


def test_importances_find_what_matters(cache):
    gains = {r.feature: r.importance for r in cmp.gain_importances(cache, "wer_like", "gbt", "raw").collect()}
    assert sum(gains.values()) == pytest.approx(1) and gains["idle"] < 0.05
    assert gains["good"] + gains.get("tags=hot", 0) + gains.get("tags=cold", 0) + gains.get("tags=new", 0) > 0.9
    moved = {r.source: r for r in cmp.permutation_importances(cache, "wer_like", "video_id", "gbt", "raw").collect()}
    assert abs(moved["idle"].importance) < 0.1 * moved["good"].importance and moved["tags"].importance > 1
    assert abs(moved["kind"].importance) < 0.1


def test_shuffle_deals_all_values_again(cache):
    test = cache.folds[0].test
    out = cmp.shuffled(test, [0], "video_id", 5)
    before, after = ({r.video_id: r.features.toArray() for r in d.collect()} for d in (test, out))
    assert before.keys() == after.keys()
    assert all((before[k][1:] == after[k][1:]).all() for k in before)
    assert sorted(v[0] for v in before.values()) == sorted(v[0] for v in after.values())
    assert sum(before[k][0] != after[k][0] for k in before) > 0.9 * len(before)


def test_metrics_of_a_long_table(spark, cache):
    scored = cmp.screened(cache, "wer_like", "video_id", {"good": (["good"], "logistic"), "idle": (["idle"], "logistic")}, 0.75)
    got = {r.label: r for r in cmp.screening_metrics(scored, "video_id").collect()}
    assert got["good"].auc > 0.7 > got["idle"].auc > 0.3 and got["good"].lift_10 > 1.5
    for label in got:
        parts = []
        for f in (0, 1):
            part = scored.where((F.col("label") == label) & (F.col("fold") == f))
            parts.append(ml.auc(part).first().auc)
        assert got[label].auc == pytest.approx(np.mean(parts))
    best = cmp.by_protocol(cmp.screening_metrics(scored, "video_id")).orderBy("place").first()
    assert best.label == "good"


def test_pooling_by_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(50):
        n = rng.integers(1, 9, 12)
        hits = np.array([rng.integers(0, m + 1) for m in n])
        got = ml.pool_adjacent(hits, n)
        # max-min formula of isotonic regression
        want = [max(min(hits[a : b + 1].sum() / n[a : b + 1].sum() for b in range(i, 12)) for a in range(i + 1)) for i in range(12)]
        assert got == pytest.approx(want)
        assert (got * n).sum() == pytest.approx(hits.sum())


def test_calibration_uses_other_folds_only(spark):
    rng = random.Random(1)
    rows = [(f, int(rng.random() < s), [1 - s, s]) for f in (0, 1) for s in [rng.random() for _ in range(3000)]]
    # fold 2 turns the scores around: its own map must not show it
    rows += [(2, int(rng.random() < 1 - s), [1 - s, s]) for s in [rng.random() for _ in range(300)]]
    df = spark.createDataFrame(rows, "fold int, y int, p array<double>")
    got = ml.calibrate(df, 2, bins=64).where("fold = 2").collect()
    assert len(got) == 300 and all(sum(r.calibrated) == pytest.approx(1) for r in got)
    assert np.mean([abs(r.calibrated[1] - r.p[1]) for r in got]) < 0.06


def test_balanced_folds_of_skewed_authors(spark):
    sizes = [4000, 2500, 1500] + [int(3000 / (i + 1)) + 1 for i in range(1500)]
    rows = [(f"a{i}",) for i, n in enumerate(sizes) for _ in range(n)] + [(None,)] * 50
    df = spark.createDataFrame(rows, "author_id string")
    for largest, apart in ((1_000, 1.05), (5, 1.2)):
        out = ml.author_folds(df, 5, largest=largest)
        n = [r.n for r in out.groupBy("fold").agg(F.count("*").alias("n")).collect()]
        assert sum(n) == len(rows) and len(n) == 5 and max(n) <= apart * min(n)
        assert out.groupBy(F.coalesce("author_id", F.lit(""))).agg(F.count_distinct("fold").alias("k")).where("k > 1").count() == 0
    assert ml.author_folds(df.limit(0), 3).count() == 0


def test_halving_and_its_stop_rule():
    seen = []

    def rated(alive, effort):
        seen.append((list(alive), effort))
        return {t: t * effort for t in alive}

    rows = cmp.halving(20, rated)
    assert [(len(a), e) for a, e in seen] == [(20, 1), (10, 2), (5, 4), (2, 8), (1, 16)] and seen[-1][0] == [19]
    assert [r[1] for r in rows if r[5]] == [19] * 5
    seen.clear()
    rows = cmp.halving(20, lambda alive, effort: rated(alive, 1))
    assert [len(a) for a, _ in seen] == [20, 10, 5]  # two rungs without a gain
    assert sum(r[5] for r in rows) == 1


def test_search_over_the_cache(cache):
    rows = cmp.search(cache, "wer_like", "video_id", 3, ["good", "tags"], 0.75).collect()
    assert {r.trial for r in rows if r.rung == 0} == {0, 1, 2} and max(r.rounds for r in rows) >= 2
    assert max(r.lift_10 for r in rows) > 1.5


def test_naive_baseline_fits_no_model(spark, monkeypatch):
    """The query of the brand medians asks for no features and no other recipe."""
    from tallyloom.plans import q_modeling

    monkeypatch.setattr(q_modeling, "cached", lambda *_: 1 / 0)
    r = q_modeling.QUERIES["ml21_naive_baseline"](spark, "/root/testdata/sf0.001").first()
    assert r.n > 0 and 0 <= r.mae <= r.rmse


def test_rows_are_dealt_once_for_all_columns(spark, cache, monkeypatch):
    """The importances are those of dealing the rows anew for every column, from one deal a fold."""
    calls, deal = [], cmp.dealt
    monkeypatch.setattr(cmp, "dealt", lambda *a: calls.append(1) or deal(*a))
    got = {r.source: r for r in cmp.permutation_importances(cache, "wer_like", "video_id", "forest", "raw").collect()}
    assert len(calls) == len(cache.folds)
    grown, base, n = dict.fromkeys(got, 0.0), 0.0, 0
    for fold in cache.folds:
        fitted = ml.REGRESSORS["forest"]().fit(fold.train.withColumn("label", F.col("wer_like")))
        wrong = lambda d: sum(abs(r.wer_like - max(0.0, r.prediction)) for r in fitted.transform(d).select("wer_like", "prediction").collect())  # noqa: B023, E731
        mine = wrong(fold.test)
        base, n = base + mine, n + fold.test.count()
        for source in got:
            grown[source] += wrong(cmp.shuffled(fold.test, [i for i, (s, _) in enumerate(fold.names) if s == source], "video_id", 11)) - mine
    for source, r in got.items():
        assert (r.base, r.importance, r.mae) == pytest.approx((base / n, grown[source] / n, (base + grown[source]) / n), abs=1e-9)


def test_names_of_columns_that_begin_alike(spark):
    rows = spark.createDataFrame([(i, i % 2, "ab"[i % 2], "pq"[i % 3 % 2], float(i)) for i in range(40)], "video_id int, fold int, brand string, brand_x_kind string, n double")
    cache = cmp.FoldCache(rows, 2, lambda: ml.FoldFeatures(numbers=["n"], categories=["brand", "brand_x_kind"]), ["video_id"])
    assert {s for s, _ in cache.folds[0].names} == {"n", "brand", "brand_x_kind"}
    alone, both = (sum(s in c for s, _ in cache.folds[0].names) for c in (["brand"], ["brand", "brand_x_kind"]))
    assert cache.rows(cache.folds[0], ["brand"])[0].first().features.size == alone < both


def test_features_by_brute_force(spark):
    """Labels that repeat, are null, rare or unknown; categories that are null or unknown."""
    rng = random.Random(2)
    rows = [(i, None if i % 11 == 0 else [rng.choice(["u", "v", "w", None]) for _ in range(i % 5)], rng.choice(["x", "y", "z", None]), i % 3 == 0, None if i % 7 == 0 else float(i % 4)) for i in range(120)]
    rows += [(200, ["rare", "u", "u"], "new", None, 0.0), (201, [], None, True, None)]
    df = spark.createDataFrame(rows, "id int, tags array<string>, kind string, flag boolean, n double").repartition(3)
    built = ml.FoldFeatures(numbers=["n"], flags=["flag"], lists=["tags"], categories=["kind"]).fit(df.where("id < 200"))
    out = built.transform(df, ["id"])
    assert out.columns == ["id", "features"] and "Arrow" not in out._jdf.queryExecution().toString()
    names = [n for _, n in built.names()]
    attributes = out.schema["features"].metadata["ml_attr"]["attrs"]
    assert [a["name"] for a in sorted(attributes["numeric"] + attributes["binary"], key=lambda a: a["idx"])] == names
    got = {r.id: r.features for r in out.collect()}
    assert got.keys() == {r[0] for r in rows}
    for i, tags, kind, flag, n in rows:
        want = {"n": -1.0 if n is None else float(np.log1p(n)), "flag": float(bool(flag))}
        want |= {f"tags={t}": 1.0 for t in tags or [] if t in ("u", "v", "w")}
        want[f"kind={kind or '__MISSING__'}" if kind != "new" else "kind=__unknown"] = 1.0
        assert dict(zip(names, got[i].toArray())) == pytest.approx({x: want.get(x, 0.0) for x in names})
        assert 0.0 not in got[i].values.tolist()


def test_learners_without_vectors_write_none(spark, monkeypatch):
    """A learner that reads no vectors doesn't carry them, and fold rows hold no raw column beside the features."""
    from tallyloom.plans import q_modeling

    written, fold_rows = [], ml.fold_rows
    monkeypatch.setattr(ml, "fold_rows", lambda df, *a: written.append((df.columns, fold_rows(df, *a))) or written[-1][1])
    assert q_modeling.QUERIES["ml09_regression_cv"](spark, "/root/testdata/sf0.001").count() == 3
    columns, folds = written[0]
    assert not {"text_vec", "visual_vec"} & set(columns)
    assert all(set(part.columns) == {"video_id", "wer", "fold", "features"} for fold in folds for part in fold)


def test_search_rates_by_lift_alone(spark, cache, monkeypatch):
    """The trials' lifts are those of the whole table of metrics, but no other metric is computed, and the features of the
    searched columns are written once."""
    scored = cmp.screened(cache, "wer_like", "video_id", {"a|b": (["good"], "logistic"), "idle": (["idle"], "logistic")}, 0.75)
    whole = {r.label: r.lift_10 for r in cmp.screening_metrics(scored, "video_id").collect()}
    assert cmp.mean_lifts(scored, "video_id", 0.10) == pytest.approx(whole) and len(whole) == 2
    narrow = cache.narrowed(["good", "tags"])
    for wide, fold in zip(cache.folds, narrow.folds, strict=True):
        for all_, part in zip(cache.rows(wide, ["good", "tags"]), (fold.train, fold.test), strict=True):
            assert "UDF" not in part._jdf.queryExecution().optimizedPlan().toString()
            assert {r.video_id: r.features for r in part.collect()} == {r.video_id: r.features for r in all_.collect()}
            assert part.first().features.size == len(fold.names)
    monkeypatch.setattr(ml, "auc", lambda *a, **k: 1 / 0)
    monkeypatch.setattr(cmp, "spearman", lambda *a, **k: 1 / 0)
    found = cmp.search(cache, "wer_like", "video_id", 2, ["good", "tags"], 0.75).collect()
    assert max(r.lift_10 for r in found) > 1.5


def test_recipes_join_medians_not_rows(spark, rows, cache, monkeypatch):
    """Every recipe's rows get their fold's and brand's training median without being dealt by their keys."""
    some = rows.where("brand is null or brand <> 'south' or fold = 0")  # fold 0 has a brand that fold 1 lacks
    part = copy(cache)
    part.folds = [cmp.Fold(i, some.where(F.col("fold") != i), some.where(F.col("fold") == i), []) for i in range(2)]
    fake = lambda *a, **k: lambda train, test: test.select("video_id", "brand", "fold", F.col("wer_like").alias("y"), F.lit(1.0).alias("pred"), F.lit(0.5).alias("p"), F.lit(0).alias("list"), F.lit(0).alias("score"))
    plain = lambda *a, **k: lambda train, test: fake(0)(train, test).drop("p", "list", "score")
    monkeypatch.setattr(ml, "regression", plain)
    monkeypatch.setattr(ml, "two_stage", lambda *a, **k: lambda train, test: fake(0)(train, test).drop("list", "score"))
    monkeypatch.setattr(ml, "ranking", lambda *a, **k: lambda train, test: fake(0)(train, test).drop("p"))
    monkeypatch.setattr(part, "out_of_fold", lambda run, columns=None, priors=(): run(None, some))
    out = cmp.recipes(part, "wer_like", "video_id", "brand", "author_id", "brand")
    assert set(out.columns) == {"video_id", "fold", "y", "pred", "label", "baseline"}
    assert "hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
    data = some.collect()
    known = {r.video_id: r for r in data}
    values = {}
    for r in data:
        for at in ((1 - r.fold, r.brand), (1 - r.fold, "all")):
            values.setdefault(at, []).append(r.wer_like)
    got = out.collect()
    assert len(got) == 9 * len(data)
    for r in got:
        want = values.get((r.fold, known[r.video_id].brand)) or values[(r.fold, "all")]
        assert r.baseline == pytest.approx(np.median(want)) and (r.label != "naive brand median" or r.pred == r.baseline)
