import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import quantiles, stats, windows


@pytest.mark.parametrize("whole", [10, 1_000_000])
def test_quantiles_against_numpy(spark, monkeypatch, whole):
    # with 10 ranges are used, and ties stand at the wanted places
    monkeypatch.setattr(quantiles, "WHOLE", whole)
    rng = np.random.default_rng(3)
    rows = [("a", float(x)) for x in rng.normal(size=6000)] + [("b", float(x)) for x in rng.integers(0, 4, 5000)] + [(None, float(x)) for x in range(7)] + [("c", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    got = {r.g: r for r in quantiles.group_stats(df, ["g"], [F.count("*").alias("n")], {"m": ("x", 0.5), "p9": ("x", 0.9), "top": ("x", 1.0)}).collect()}
    assert set(got) == {"a", "b", "c", None} and got["c"].m is None and got["c"].n == 1
    for g in ("a", "b", None):
        x = [v for k, v in rows if k == g]
        assert got[g].n == len(x)
        assert [got[g].m, got[g].p9, got[g].top] == pytest.approx(list(np.quantile(x, [0.5, 0.9, 1.0])))
    x = [v for _, v in rows if v is not None]
    fractions = [i / 20 for i in range(21)]
    assert quantiles.table_quantiles(df, "x", fractions) == pytest.approx(list(np.quantile(x, fractions)))


def test_quantiles_of_nothing(spark):
    empty = spark.createDataFrame([], "g string, x double")
    assert quantiles.exact_quantiles(empty, {"g": "g"}, {"m": ("x", 0.5)}).count() == 0
    assert quantiles.exact_quantiles(empty, {}, {"m": ("x", 0.5)}).first().m is None
    with pytest.raises(ValueError):
        quantiles.table_quantiles(empty, "x", [0.5])


def test_adjusted_p_with_ties_and_nulls(spark):
    p = [0.01, 0.04, 0.04, 0.03, 0.5, 0.9, None]
    got = sorted((r.p, r.p_adj) for r in stats.adjust(spark.createDataFrame([(x,) for x in p], "p double"), "p").collect() if r.p is not None)
    known = sorted(x for x in p if x is not None)
    scaled = [x * len(known) / (i + 1) for i, x in enumerate(known)]
    want = [min(1.0, min(scaled[i:])) for i in range(len(known))]
    assert [a for _, a in got] == pytest.approx(want)


def test_stratified_sample_of_odd_rows(spark):
    rows = [("x", 1)] * 40 + [(None, i) for i in range(40)] + [("y", None)] * 20
    got = stats.stratified_sample(spark.createDataFrame(rows, "s string, i int"), "s", 10, "i").collect()
    assert sorted((r.s or "") for r in got) == [""] * 4 + ["x"] * 4 + ["y"] * 2


def test_diversified_pick_keeps_the_order_of_rounds(spark):
    rows = [(b, f"l{i % 3}", i) for b in "ab" for i in range(30)]
    got = windows.diversified(spark.createDataFrame(rows, "brand string, line string, i int"), 8, F.asc("i")).collect()
    assert [(r.brand, r.i) for r in got] == [("a", 0), ("b", 0), ("a", 1), ("b", 1), ("a", 2), ("b", 2), ("a", 3), ("b", 3)]


def test_cuts_that_differ_between_evaluations(spark, monkeypatch):
    # a sketch depends on the order in which parts arrive: here every evaluation of it gives other cuts
    noisy = F.udf(lambda m: sorted(m * random.SystemRandom().random() for _ in range(8)), "array<double>")

    def sketch(c, points, accuracy=0):
        return noisy(F.max(c))

    monkeypatch.setattr(quantiles.F, "percentile_approx", sketch)
    monkeypatch.setattr(quantiles, "WHOLE", 10)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # a reused broadcast would hide it
    x = np.random.default_rng(5).random(4000)
    df = spark.createDataFrame([(float(v),) for v in x], "x double").repartition(3)
    got = quantiles.exact_quantiles(df, {}, {"m": ("x", 0.5), "p9": ("x", 0.9)}).first()
    assert [got.m, got.p9] == pytest.approx(list(np.quantile(x, [0.5, 0.9])))
    cells = df.groupBy("x").agg(F.count("*").alias("n"))
    before = [r.before for r in stats.before_counts(cells, [], "x", "n").orderBy("x").collect()]
    assert before == list(range(4000))
    grouped = stats.before_counts(cells.withColumn("g", F.lit("a")), ["g"], "x", "n").orderBy("x").collect()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert [r.before for r in grouped] == list(range(4000))


def test_doubles_are_rounded_like_the_sql_does(spark):
    import duckdb

    from tallyloom.plans.common import tidy

    x = [3105 / 48000, 643 / 80000, 1581 / 20000 / 10, -3105 / 48000, 0.0646885, 1e300, 0.0]
    got = [r.x for r in tidy(spark.createDataFrame([(v,) for v in x], "x double").coalesce(1)).collect()]
    assert got == [duckdb.execute("SELECT round(?::DOUBLE, 6) + 0.0", [v]).fetchone()[0] for v in x]


def test_posts_are_not_dealt_by_brand(spark):
    from tallyloom.operators import features

    rows = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 2.0)], "brand string, wer double")
    out = features.with_bri(rows)
    assert sorted(r.bri for r in out.collect()) == [0.5, 1.0, 1.5]
    assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()
