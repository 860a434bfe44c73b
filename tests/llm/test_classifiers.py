import dataclasses

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import language_id, toxicity
from tallyloom.llm.common import text_buffer
from tallyloom.llm.queries import QUERIES, fold

from .conftest import SF


def test_codewords_are_apart():
    for k in (2, 3, 4, 6, 7, 12):
        c = language_id.codewords(k).astype(int)
        far = (c.shape[1] - c @ c.T) // 2
        least = far[~np.eye(k, dtype=bool)].min()
        assert least >= max(1, c.shape[1] // 3)


def test_language_of_odd_documents(odd_docs, no_docs, small):
    model = language_id.fit(small("documents"), "text", "lang", fold(3) != 1)
    got = language_id.identify(odd_docs, model, keep_text=True).collect()
    assert len(got) == odd_docs.count()
    for r in got:
        assert 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(map(str.isalpha, r.text or "")))
    assert language_id.identify(no_docs, model).count() == 0
    empty = language_id.fit(no_docs, "text", "lang", F.lit(True))
    assert {r.lang_pred for r in language_id.identify(odd_docs, empty).collect()} == {"und"}
    one = language_id.fit(small("documents").where("lang = 'de'"), "text", "lang", F.lit(True))
    assert {r.lang_pred for r in language_id.identify(small("documents"), one).collect()} == {"de"}


def test_language_held_out_accuracy(spark, small):
    got = QUERIES["op10_language_id"](spark, SF).join(small("documents").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 40 and np.mean([r.lang == r.lang_pred for r in got]) >= 0.97


def test_rare_languages_are_learned(spark):
    rows = [(k, f"the cat number {k} sat on the mat", "en") for k in range(3000)] + [(9000 + k, f"il gatto {k} siede", "it") for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert language_id.fit(docs, "text", "lang", F.lit(True), max_rows=30).langs == ["en", "it"]


def test_pairs_of_terms_that_weigh_only_together():
    """Insult with group mention: each alone is harmless, so additive weights can't tell."""
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(1200):
        a, b = rng.integers(0, 2, 2)
        noise = rng.integers(100, 400, 20)
        rows.append((int(a & b), np.unique([*([5] * a), *([6] * b), *noise]).astype("<i4").tobytes()))
    model = toxicity.fit(rows)
    assert {5, 6} <= set(np.flatnonzero(model.feature_of >= 0))
    f = model.feature_of[[5, 6]]
    z = lambda s: model.bias + model.linear[s].sum() + 0.5 * ((model.factors[s].sum(0) ** 2) - (model.factors[s] ** 2).sum(0)).sum()
    assert z(f) > 0 > max(z(f[:1]), z(f[1:]), z(f[:0]))
    assert model.factors[f[0]] @ model.factors[f[1]] > 0.5


def test_toxicity_of_odd_documents(odd_docs, no_docs, small):
    rows = toxicity.labelled_terms(small("documents"), small("labels"), "doc_id", "text", "toxic", 20_000)
    model = toxicity.fit(rows)
    got = toxicity.score_toxicity(odd_docs, model, keep_text=True).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    blank = {r.score for r in got if not (r.text or "").strip()}
    assert len(blank) == 1
    assert toxicity.score_toxicity(no_docs, model).count() == 0
    assert toxicity.fit([]).scores(np.empty(0, np.uint8), np.zeros(2, np.int64)) == pytest.approx(0.5)


def test_neutral_terms_that_weigh_only_together():
    """The label is the product of two terms that say nothing alone: no linear weight can tell."""
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(1500):
        a, b = rng.integers(0, 2, 2)
        rows.append((int(a == b), np.unique([*([5] * a), *([6] * b), *rng.integers(100, 400, 20)]).astype("<i4").tobytes()))
    model = toxicity.fit(rows[:1000])
    assert {5, 6} <= set(np.flatnonzero(model.feature_of >= 0))
    right = []
    for label, terms in rows[1000:]:
        f = model.feature_of[np.frombuffer(terms, "<i4")]
        right.append((by_pairs(model, f[f >= 0]) > 0) == label)
    assert np.mean(right) > 0.95


def marked(terms, times, clean=20_000):
    """Rows of which the toxic ones hold one of many terms that never stand in a clean one, and all hold common words."""
    rng = np.random.default_rng(4)
    make = lambda *own: np.unique([*own, *rng.integers(0, 300, 12)]).astype("<i4").tobytes()
    return [(1, make(1000 + t)) for t in range(terms) for _ in range(times)] + [(0, make()) for _ in range(clean)]


@pytest.mark.parametrize("terms, times", [(1000, 20), (1500, 6)])
def test_no_bound_on_terms(terms, times):
    """Every one of 1,000 or 1,500 markers counts, frequent or in six rows, and clean texts stay clean."""
    rows = marked(terms, times, terms * times)
    model = toxicity.fit(rows)
    z = np.array([by_pairs(model, f[f >= 0]) for f in (model.feature_of[np.frombuffer(t, "<i4")] for _, t in rows[::7])])
    y = np.array([label for label, _ in rows[::7]])
    assert (z[y == 1] > 0).mean() >= 0.95 and (z[y == 0] <= 0).mean() >= 0.95


def test_slope_by_differences():
    rng = np.random.default_rng(5)
    cells = toxicity._Cells([rng.choice(9, rng.integers(1, 6), replace=False) for _ in range(20)], 9)
    y, theta = rng.integers(0, 2, 20), [np.array([0.2]), rng.normal(size=9), rng.normal(size=(9, 3))]

    def z(t):
        s, q = cells.factor_sums(t[2])
        return t[0][0] + cells.by_row(t[1]) + 0.5 * ((s**2).sum(1) - q)

    loss = lambda t: (np.logaddexp(0, z(t)) - y * z(t)).sum()
    grads = cells.slope(1 / (1 + np.exp(-z(theta))) - y, cells.factor_sums(theta[2])[0], theta[2])
    for j, g in enumerate(grads):
        for i in np.ndindex(g.shape):
            up = [x.copy() for x in theta]
            up[j][i] += 1e-6
            assert (loss(up) - loss(theta)) / 1e-6 == pytest.approx(g[i], abs=1e-4)


def by_pairs(model, features):
    """The machine's sum, pair by pair."""
    z = model.bias + sum(model.linear[f] for f in features)
    return z + sum(model.factors[f] @ model.factors[g] for i, f in enumerate(features) for g in features[:i])


def test_scores_are_sums_over_pairs():
    rng = np.random.default_rng(2)
    model = toxicity.FactorizationMachine(-0.3, rng.normal(size=50), rng.normal(size=(50, 3)), np.arange(1 << toxicity.TERM_BITS, dtype=np.int32) % 997)
    model.feature_of[model.feature_of >= 50] = -1
    texts = ["", "one", *[" ".join(f"w{x}" for x in rng.integers(0, 400, n)) for n in (5, 60, 300)], None]
    buf, offsets = text_buffer(pa.array(texts, pa.string()))
    buckets, at = toxicity.term_buckets(buf, offsets)
    for a, b, score in zip(at[:-1], at[1:], model.scores(buf, offsets), strict=True):
        f = np.unique(model.feature_of[buckets[a:b]])
        assert score == pytest.approx(1 / (1 + np.exp(-np.clip(by_pairs(model, f[f >= 0]), -30, 30))))


def test_bounded_training_rows(small):
    rows = toxicity.labelled_terms(small("documents"), small("labels"), "doc_id", "text", "toxic", 20_000)
    few = toxicity.labelled_terms(small("documents"), small("labels"), "doc_id", "text", "toxic", 20_000, max_terms=sum(len(r[1]) // 4 for r in rows) // 4)
    assert 0 < len(few) < 0.6 * len(rows)


def area(s, y):
    ranks = np.searchsorted(np.sort(s), s, "left") + np.searchsorted(np.sort(s), s, "right")
    n1 = y.sum()
    return (ranks[y == 1].sum() / 2 + n1 / 2 - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


def test_toxicity_held_out_and_without_its_pairs(spark):
    """Labels of quality 0 are noise (half of their toxic rows have no toxic word), so recall is held to 0.9 on the others,
    and to what the noise leaves on all."""
    sf = SF.replace("0.001", "0.1")
    labels, docs = spark.read.parquet(f"{sf}/labels.parquet"), spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    model = toxicity.fit(toxicity.labelled_terms(docs, labels.where(fold(5) != 0), "doc_id", "text", "toxic", 20_000))
    held = docs.join(labels.where((fold(5) == 0) & F.col("toxic").isNotNull()), "doc_id")
    areas = []
    for m in (model, dataclasses.replace(model, factors=np.zeros_like(model.factors))):
        got = toxicity.score_toxicity(held, m).collect()
        y, s, quality = (np.array([r[c] for r in got]) for c in ("toxic", "score", "quality"))
        areas.append(area(s, y))
        if m is model:
            print("recall of quality 1 and of all:", (s[(y == 1) & (quality == 1)] >= 0.5).mean(), (s[y == 1] >= 0.5).mean(), "area:", areas[0])
            assert (s[(y == 1) & (quality == 1)] >= 0.5).mean() >= 0.9 and (s[y == 0] < 0.5).mean() >= 0.99
            assert (s[y == 1] >= 0.5).mean() >= 0.7
    assert areas[0] >= 0.9 and areas[0] - areas[1] >= 0.03


def test_decoding_by_brute_force():
    rng = np.random.default_rng(3)
    codes = language_id.codewords(5)
    model = language_id.LanguageModel(list("abcde"), codes, np.zeros((codes.shape[1], 1)), rng.uniform(0.1, 2, codes.shape[1]))
    margins, grams = rng.normal(size=(40, codes.shape[1])), rng.integers(0, 80, 40)
    best, top, second = model.decode(margins, grams)
    for i in range(40):
        loss = [sum(model.trust[b] * np.log1p(np.exp(-codes[c, b] * margins[i, b] * 4 * min(grams[i], 30) / 30)) for b in range(codes.shape[1])) for c in range(5)]
        p = np.exp(-np.array(loss)) / np.exp(-np.array(loss)).sum()
        assert best[i] == p.argmax() and sorted([top[i], second[i]]) == pytest.approx(sorted(p)[-2:])


def test_fitted_bits_lose_less_than_log_ratios(spark, small):
    start, fitted = (language_id.fit(small("documents"), "text", "lang", F.lit(True), steps=k) for k in (0, 4))
    grams = language_id._grams_of(small("documents").where("lang is not null").select("text", "lang"))
    loss = [language_id._step(grams, m.langs, m.codes, m.weights[:, :-1])[0] for m in (start, fitted)]
    assert (loss[1] <= loss[0] * (1 + 1e-6)).all() and loss[1].sum() < loss[0].sum()


def test_language_sample_binds(spark):
    """Equal rows are chosen one by one, beside columns of any type; languages with few rows keep all they have."""
    rows = [("same text again", "en", {"a": 1})] * 40_000 + [(f"autre texte {i}", "fr", None) for i in range(150)] + [(None, "de", None)] * 30
    df = spark.createDataFrame(rows, "text string, lang string, m map<string,int>").repartition(6)
    got = {r.lang: r["count"] for r in language_id.sample(df, "text", "lang", F.lit(True), 6_000, 200, 10).groupBy("lang").count().collect()}
    assert 5_000 < got["en"] < 7_000 and got["fr"] == 150 and got["de"] == 30
    with pytest.raises(ValueError):
        language_id.sample(df, "text", "lang", F.lit(True), 6_000, 200, 2)
    model = language_id.fit(df, "text", "lang", F.lit(True))
    assert [r.lang_pred for r in language_id.identify(df.where("lang = 'fr'").limit(3), model).collect()] == ["fr"] * 3


def test_language_scan_keeps_its_tasks(spark, small):
    rows = language_id.sample(small("documents").repartition(40), "text", "lang", F.lit(True), 10, 5, 100)
    assert language_id._grams_of(rows).rdd.getNumPartitions() >= 40
