import pytest
from pyspark.sql import functions as F

from tallyloom.operators import clean as cl
from tallyloom.operators import features as fe
from tallyloom.operators import quality as dq
from tallyloom.operators import tables as ag
from tallyloom.sources import landing


def one(df):
    return df.first().asDict()


def test_engagement_rows(spark):
    rows = [("nike", 100, 10, 2, 1, 0), ("nike", 0, 5, None, None, None), (None, None, 1, 1, 1, 1), (None, 50, 0, 0, 0, 5)]
    df = fe.with_bri(fe.with_engagement(spark.createDataFrame(rows, "brand string, view_count long, like_count long, comment_count long, share_count long, collect_count long")))
    got = {(r.brand, r.view_count): r for r in df.collect()}
    a = got[("nike", 100)]
    assert (a.engagement_count, a.engagement_rate, a.weighted_engagement_count, round(a.wer, 6), a.bri) == (13, 0.13, 1.8, 0.018, 1.0)
    assert got[("nike", 0)].wer is None and got[("nike", 0)].bri is None and got[("nike", 0)].engagement_count == 5
    assert got[(None, None)].wer is None and got[(None, 50)].bri == 1.0


def test_even_median(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", 3.0), ("a", 10.0), (None, 2.0)], "g string, v double")
    assert {r.g: r.m for r in fe.exact_median(df, ["g"], "v", "m").collect()} == {"a": 3.0, None: 2.0}


def test_tiers_are_left_closed(spark):
    df = spark.createDataFrame([(9_999,), (10_000,), (50_000,), (10_000_000,), (None,)], "f long")
    assert [r[0] for r in df.select(fe.creator_tier(F.col("f"))).collect()] == ["nano", "micro", "micro", "mega", None]


def test_silver_comments_keep_the_latest(spark):
    rows = [("v1", "c1", " love it ", 100, "x"), ("v1", "c1", "love it updated\t", 200, "y"), ("v2", "c2", None, 1, "z")]
    comments = spark.createDataFrame(rows, "video_id string, comment_id string, comment_text string, crawled_at_ts long, raw_payload string")
    videos = spark.createDataFrame([("v1", "nike", "hashtag", True)], "video_id string, brand string, source_type string, is_official_brand boolean")
    got = {r.comment_id: r.asDict() for r in cl.clean_comments(comments, videos).collect()}
    assert got["c1"]["comment_text"] == "love it updated" and got["c1"]["brand"] == "nike" and "raw_payload" not in got["c1"]
    assert got["c2"]["brand"] is None and len(got) == 2


def test_brand_inference(spark):
    df = spark.createDataFrame([(None, ["nikerun"]), ("  Nike ", ["adidasx"]), (None, ["nikea", "adidasb"]), ("", []), (None, None)], "b string, t array<string>")
    got = [r[0] for r in df.select(cl.infer_brand(F.col("b"), F.col("t"), {"nike": ["nike"], "adidas": ["adidas"]})).collect()]
    assert got == ["nike", "nike", "both", None, None]


def test_vendor_items(spark):
    item = '{"id": "1", "text": "hi", "createTime": 5, "authorMeta": {"id": "a", "name": " ", "nickName": "nick", "fans": 3}, "playCount": 55700, "collectCount": 291, "hashtags": [{"name": "#x"}, {"name": "y"}]}'
    df = spark.createDataFrame([(item,), ('{"id": "2", "text": "no"}',)], "j string").select(F.from_json("j", landing.ITEM).alias("i")).select("i.*")
    got = landing.flatten_items(df).collect()
    assert len(got) == 1 and (got[0].video_id, got[0].author_username, got[0].view_count, got[0].collect_count, got[0].hashtags, got[0].has_music) == ("1", "nick", 55700, 291, ["x", "y"], False)


def test_jsonl_keeps_broken_lines_and_skips_blank_ones(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"video_id": "1", "view_count": 3}\n\n{"video_id": \n{"video_id": "2"}\n')
    got = landing.read_jsonl(spark, str(tmp_path), landing.VIDEO).collect()
    assert sorted((r.video_id or "", r["_corrupt_record"] is not None) for r in got) == [("", True), ("1", False), ("2", False)]


def commerce(spark):
    rows = [(True, True, False, ["promo_not"], 1.0, 0.5), (None, True, False, None, 2.0, None), (False, False, False, [], None, 0.1), (True, False, False, ["promo"], 3.0, 0.9)]
    df = spark.createDataFrame(rows, "has_purchase_cta boolean, has_discovery_traffic_cta boolean, has_promo_language boolean, content_type array<string>, bri double, wer double")
    return ag.with_commerce(df)


def test_commerce_scores_and_trend(spark):
    df = commerce(spark)
    assert [r.commerce_score for r in df.collect()] == [2, 1, 0, 2]
    trend = {r.commerce_intensity: (r.n, r.top_rate) for r in ag.commerce_trend(df).collect()}
    assert {k: v[0] for k, v in trend.items()} == {"None": 1, "Low": 1, "Medium": 2, "High": 0}
    assert trend["Low"][1] == 0 and trend["High"][1] is None


def test_relative_performance(spark):
    rows = [("a", ["x", "y"], 1.0), ("a", ["x"], 3.0), ("a", [], 5.0), ("a", None, None), (None, ["x"], 9.0)]
    df = spark.createDataFrame(rows, "brand string, labels array<string>, v double")
    got = {r.category: r.asDict() for r in ag.relative_performance(df, "labels", "v", min_count=1).collect()}
    assert set(got) == {"x", "y"} and got["x"]["baseline"] == 3.0 and got["x"]["median_value"] == 2.0
    assert got["x"]["share"] == 0.5 and got["x"]["relative_index"] == pytest.approx(2 / 3) and got["x"]["small_n"]


def test_skewness_is_bias_adjusted(spark):
    r = one(ag.skewed_summary(spark.createDataFrame([(1.0,), (2.0,), (10.0,), (float("nan"),), (float("inf"),), (None,)], "v double"), "v"))
    assert (r["n"], r["max"]) == (3, 10.0) and r["skew"] == pytest.approx(1.6523, abs=1e-4)


def test_every_tier_is_emitted(spark):
    rows = [("nike", False, "u1", 5, 1, "v1"), ("nike", False, "u1", 5, 2, "v2"), ("nike", True, "o", 9, 3, "v3"), ("adidas", False, "u2", 20_000, 4, "v4")]
    df = spark.createDataFrame(rows, "brand string, is_official_brand boolean, author_id string, author_follower_count long, create_time_ts long, video_id string").withColumns({"content_type": F.array(F.lit("collab")), "bri": F.lit(1.0), "wer": F.lit(1.0)})
    mix = {(r.scope, r.creator_tier): (r.authors, r.videos) for r in ag.tier_mix(ag.with_creator_flags(df), ["nike", "adidas"]).collect()}
    assert len(mix) == 15 and mix[("all", "nano")] == (1, 2) and mix[("adidas", "micro")] == (1, 1) and mix[("nike", "mega")] == (0, 0)


def test_polarity(spark):
    df = spark.createDataFrame([(-0.5,), (0.0,), (0.5,), (None,)], "s double")
    assert [r[0] for r in df.select(ag.polarity(F.col("s"))).collect()] == ["negative", "neutral", "positive", None]


def test_empty_tables(spark):
    empty = commerce(spark).withColumn("brand", F.lit("a")).where("false")
    assert ag.distribution(empty, "content_type", "wer").count() == 0
    assert ag.relative_performance(empty, "content_type", "wer").count() == 0
    assert one(ag.coverage(empty, ["content_type"]))["rate"] is None
    assert sum(r.n for r in ag.commerce_trend(empty).collect()) == 0


def test_validation(spark):
    df = spark.createDataFrame([("a", 0.5, ["x"]), ("b", 1.5, []), (None, None, None)], "brand string, rate double, l array<string>")
    got = {r.rule: r.violations for r in dq.validate(df, ["brand", "gone"], {"brand": ["a"]}, {"rate": (0, 1)}, {"l": 0.5}, strict=True).collect()}
    assert got == {"required_gone": 1, "allowed_brand": 1, "range_rate": 1, "floor_l": 1}
    lenient = dq.validate(df, allowed={"brand": ["a"]}, floors={"l": 0.5})
    assert [r.rule for r in lenient.collect()] == ["allowed_brand"]
