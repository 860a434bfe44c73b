import random

import pytest

from tallyloom.streaming import upsert

SCHEMA = "k string, at long, v string, day string"


def latest(batches):
    want = {}
    for i, rows in enumerate(batches):
        for k, at, v, _ in rows:
            if k is not None and (k not in want or (at, i) >= want[k][:2]):
                want[k] = (at, i, v)
    return {(k, v) for k, (_, _, v) in want.items()}


def make(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_fifty_batches_read_alike(spark, tmp_path):
    """A fixed set of keys: what a batch reads and how many folders there are stay level."""
    rng, target, batches, states = random.Random(1), str(tmp_path / "t"), [], []
    for i in range(50):
        rows = [(f"k{rng.randrange(300)}", rng.randrange(1000), f"{i}-{j}", None) for j in range(40)]
        batches.append(list({r[0]: r for r in rows}.values()))
        states.append(upsert.merge(make(spark, batches[-1]), i, target, "k", "at", buckets=4, most=3))
    assert {(r.k, r.v) for r in upsert.current(spark, target).select("k", "v").collect()} == latest(batches)
    read = [s.read_bytes for s in states]
    assert max(read[35:]) <= 1.3 * max(read[10:25]) and sum(map(bool, read)) > 20
    assert all(len(f) <= 8 for s in states for f in s.folders.values())
    assert len(list((tmp_path / "t" / "manifest").iterdir())) == 3
    named = {folder for s in states[-3:] for f in s.folders.values() for folder, _ in f}
    assert {p.name for p in (tmp_path / "t" / "data").iterdir()} == named


@pytest.mark.parametrize("broken", ["_commit", "_listed", "vacuum"])
def test_a_batch_that_breaks_off_is_made_again(spark, tmp_path, monkeypatch, broken):
    rng, target, batches = random.Random(2), str(tmp_path / "t"), []
    for i in range(9):
        rows = list({r[0]: r for r in [(f"k{rng.randrange(30)}", rng.randrange(100), f"{i}-{j}", None) for j in range(12)]}.values())
        batches.append(rows)
        if i % 2:
            with monkeypatch.context() as m:
                m.setattr(upsert, broken, lambda *a, **k: 1 / 0)
                with pytest.raises(ZeroDivisionError):
                    upsert.merge(make(spark, rows), i, target, "k", "at", buckets=3, most=2)
            seen = batches if broken == "vacuum" else batches[:-1]
            assert {(r.k, r.v) for r in upsert.current(spark, target).select("k", "v").collect()} == latest(seen)
        upsert.merge(make(spark, rows), i, target, "k", "at", buckets=3, most=2)
        # a replay after the end changes nothing
        assert upsert.merge(make(spark, [("k0", 10**9, "again", None)]), i, target, "k", "at", buckets=3, most=2).batch == i
        assert {(r.k, r.v) for r in upsert.current(spark, target).select("k", "v").collect()} == latest(batches)


def test_late_rows_go_aside(spark, tmp_path):
    target = str(tmp_path / "t")
    day = lambda d: f"2024-01-{d:02d} 00:00:00"
    first = upsert.merge(make(spark, [("a", 1, "a1", day(20)), ("b", 1, "b1", day(1)), (None, 1, "x", day(2))]), 0, target, "k", "at", 4, "day", "7 days")
    assert (first.rows, first.late_rows) == (2, 0)  # nothing came before the first batch
    second = upsert.merge(make(spark, [("a", 9, "late", day(12)), ("a", 8, "late too", day(12)), ("b", 2, "b2", day(13)), ("c", 1, "no day", None)]), 1, target, "k", "at", 4, "day", "7 days")
    assert (second.rows, second.late_rows) == (2, 2)
    assert {(r.k, r.v) for r in upsert.current(spark, target).select("k", "v").collect()} == {("a", "a1"), ("b", "b2"), ("c", "no day")}
    assert {(r.v, r.batch) for r in upsert.late_rows(spark, target).collect()} == {("late", 1), ("late too", 1)}
    assert upsert.late_rows(spark, str(tmp_path / "none")) is None


def test_empty_batches_and_new_columns(spark, tmp_path):
    target = str(tmp_path / "t")
    assert upsert.current(spark, target) is None
    upsert.merge(make(spark, []), 0, target, "k", "at", 2)
    assert upsert.current(spark, target) is None
    upsert.merge(make(spark, [("a", 1, "x", None)]), 1, target, "k", "at", 2, spread=3)
    upsert.merge(make(spark, [("b", 1, "y", None)]).selectExpr("*", "5 as extra"), 2, target, "k", "at", 2)
    assert {(r.k, r.extra) for r in upsert.current(spark, target).collect()} == {("a", None), ("b", 5)}
