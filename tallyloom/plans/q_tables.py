"""Queries of the group tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..operators import tables as ag
from ..operators.quantiles import group_stats
from .common import BRANDS, comments, duck, floats, measured, table, tidy

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = lambda spark, sf: tidy(f(spark, sf))
        if sql:
            SQL[name] = sql
        return f

    return add


COMMERCE = """c AS (SELECT *, CAST(has_purchase_cta AS INT) + CAST(COALESCE(has_discovery_traffic_cta, false) AS INT) + CAST(has_promo_language AS INT) + CAST(COALESCE(list_contains(content_type, 'promo'), false) AS INT) AS score FROM m),
cc AS (SELECT *, COALESCE(list_contains(content_type, 'promo'), false) AS is_promo, CASE WHEN score < 1 THEN 'None' WHEN score < 2 THEN 'Low' WHEN score < 3 THEN 'Medium' ELSE 'High' END AS level FROM c)"""
CREATORS = """k AS (SELECT *, CASE WHEN is_official_brand THEN 'official' ELSE 'ugc' END AS channel, COALESCE(list_contains(content_type, 'collab'), false) AS is_collab,
  CASE WHEN author_follower_count < 10000 THEN 'nano' WHEN author_follower_count < 100000 THEN 'micro' WHEN author_follower_count < 1000000 THEN 'mid' WHEN author_follower_count < 10000000 THEN 'macro' WHEN author_follower_count IS NOT NULL THEN 'mega' END AS tier FROM m)"""


def with_cte(cte: str, query: str, *columns: str) -> str:
    from .bindings import duck as raw

    return floats(raw("SELECT 1").rsplit("\n", 1)[0] + ",\n" + cte + "\n" + query, *columns)


REL = """SELECT brand, category, n, median_value, baseline, median_value / nullif(baseline, 0) AS relative_index, median_value / nullif(baseline, 0) - 1 AS relative_uplift, n / brand_n AS share, brand_n, n < 20 AS small_n FROM (
  SELECT brand, category, count(*) AS n, median({v}) AS median_value FROM (SELECT brand, {v}, unnest({l}) AS category FROM {t} WHERE brand IS NOT NULL) WHERE category <> '' GROUP BY ALL HAVING count(*) >= 5)
  JOIN (SELECT brand, median({v}) AS baseline, count(*) AS brand_n FROM {t} WHERE brand IS NOT NULL GROUP BY brand) USING (brand)"""
REL_FLOATS = ("median_value", "baseline", "relative_index", "relative_uplift", "share")
PARTS = "SELECT p_brand AS brand, string_split(p_name, ' ') AS labels, value FROM part JOIN (SELECT l_partkey, sum(l_quantity) AS value FROM lineitem GROUP BY l_partkey) ON p_partkey = l_partkey"


@query("ag09_relative_performance", floats(f"WITH parts AS ({PARTS})\n" + REL.format(v="value", l="labels", t="parts"), *REL_FLOATS))
def _(spark, sf):
    value = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("value"))
    parts = table(spark, sf, "part").join(value, F.col("p_partkey") == F.col("l_partkey")).select(F.col("p_brand").alias("brand"), F.split("p_name", " ").alias("labels"), "value")
    return ag.relative_performance(parts, "labels", "value")


@query("ag09_relative_performance_posts", duck(REL.format(v="wer", l="content_type", t="m"), *REL_FLOATS))
def relative(spark, sf):
    return ag.relative_performance(measured(spark, sf), "content_type", "wer")


@query("ag01_explode_labels", duck("SELECT label, count(*) AS n, count(DISTINCT video_id) AS videos FROM (SELECT video_id, unnest(content_type) AS label FROM posts) GROUP BY label"))
def _(spark, sf):
    return ag.explode_labels(measured(spark, sf), "content_type").groupBy(F.col("content_type").alias("label")).agg(F.count("*").alias("n"), F.count_distinct("video_id").alias("videos"))


COVER = ["content_type", "brand", "view_count", "music_id", "caption_raw"]
FILLED = {"content_type": "len(content_type) > 0", "brand": "trim(brand) <> ''", "view_count": "view_count IS NOT NULL", "music_id": "trim(music_id) <> ''", "caption_raw": "trim(caption_raw) <> ''"}


@query("ag02_coverage", duck(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n, count(*) FILTER ({f}) AS filled, count(*) FILTER ({f}) / count(*) AS rate FROM posts" for c, f in FILLED.items()), "rate"))
def _(spark, sf):
    return ag.coverage(measured(spark, sf), COVER)


@query("ag03_coverage_by_brand", duck(" UNION ALL ".join(f"SELECT brand, '{c}' AS \"column\", count(*) AS n, count(*) FILTER ({f}) AS filled, count(*) FILTER ({f}) / count(*) AS rate FROM posts GROUP BY brand" for c, f in FILLED.items() if c != "brand"), "rate"))
def _(spark, sf):
    return ag.coverage(measured(spark, sf), [c for c in COVER if c != "brand"], ["brand"])


@query("ag04_skewed_summary", duck("SELECT brand, count(v) AS n, avg(v) AS mean, median(v) AS median, stddev_samp(v) AS std, quantile_cont(v, 0.9) AS p90, quantile_cont(v, 0.99) AS p99, max(v) AS max, skewness(v) AS skew, avg(v) / nullif(median(v), 0) AS mean_over_median FROM (SELECT brand, view_count / 1000 AS v FROM posts) GROUP BY brand", "mean", "median", "std", "p90", "p99", '"max"', "skew", "mean_over_median").replace('round("max", 6) + 0.0 AS "max"', 'round("max", 6) + 0.0 AS max'))
def _(spark, sf):
    return ag.skewed_summary(measured(spark, sf).withColumn("v", F.col("view_count") / 1000), "v", ["brand"])


@query("ag05_distribution", duck("SELECT level, count(*) AS n, median(wer) AS median_value, CAST(sum(count(*)) OVER () AS BIGINT) AS coverage_n, count(*) / sum(count(*)) OVER () AS pct FROM (SELECT wer, unnest(content_type) AS level FROM m) GROUP BY level", "median_value", "pct"))
def _(spark, sf):
    return ag.distribution(measured(spark, sf), "content_type", "wer")


for how, part in (("row", 'PARTITION BY "row"'), ("col", 'PARTITION BY "col"'), ("all", "")):

    @query(f"ag06_crosstab_{how}", duck(f'SELECT * FROM (SELECT *, n / sum(n) OVER ({part}) AS pct FROM (SELECT "row", "col", count(*) AS n, median(wer) AS median_value FROM (SELECT wer, "row", unnest(product_lines) AS "col" FROM (SELECT wer, product_lines, unnest(content_type) AS "row" FROM m)) GROUP BY ALL)) WHERE n >= 10', "median_value", "pct"))
    def _(spark, sf, how=how):
        return ag.crosstab(measured(spark, sf), "content_type", "product_lines", "wer", how, 10)


@query("ag07_brand_counts", duck("SELECT brand, count(*) AS n, count(DISTINCT author_id) AS authors, median(view_count) AS median_views FROM posts GROUP BY brand", "median_views"))
def _(spark, sf):
    return group_stats(measured(spark, sf), ["brand"], [F.count("*").alias("n"), F.count_distinct("author_id").alias("authors")], {"median_views": ("view_count", 0.5)})


@query("ag08_brand_baseline", floats("SELECT c_mktsegment AS brand, median(o_totalprice) AS baseline, count(*) AS brand_n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1", "baseline"))
def _(spark, sf):
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("brand")), F.col("o_custkey") == F.col("c_custkey"))
    return ag.brand_baseline(rows, "o_totalprice")


def commerce(spark, sf):
    return ag.with_commerce(measured(spark, sf))


@query("ag10_commerce_levels", with_cte(COMMERCE, "SELECT video_id, CAST(score AS BIGINT) AS commerce_score, level AS commerce_intensity, CAST(CASE level WHEN 'None' THEN 0 WHEN 'Low' THEN 1 WHEN 'Medium' THEN 2 ELSE 3 END AS BIGINT) AS commerce_level FROM cc"))
def _(spark, sf):
    return commerce(spark, sf).select("video_id", "commerce_score", "commerce_intensity", "commerce_level")


RATES = "count(*) AS n, avg(score) AS mean_score, avg(CAST(level IN ('Medium', 'High') AS INT)) AS high_share, avg(CAST(has_purchase_cta AS INT)) AS rate_has_purchase_cta, avg(CAST(COALESCE(has_discovery_traffic_cta, false) AS INT)) AS rate_has_discovery_traffic_cta, avg(CAST(has_promo_language AS INT)) AS rate_has_promo_language, avg(CAST(is_promo AS INT)) AS rate_is_promo_content"
MIX = ", ".join(f"CASE WHEN {{d}} IS NOT NULL THEN avg(CAST(level = '{x}' AS INT)) END AS mix_{x.lower()}" for x in ag.LEVELS)
MIX_F = ("mean_score", "high_share", "rate_has_purchase_cta", "rate_has_discovery_traffic_cta", "rate_has_promo_language", "rate_is_promo_content", *[f"mix_{x.lower()}" for x in ag.LEVELS])


@query("ag11_commerce_by_format", with_cte(COMMERCE, f"SELECT visual_format, {RATES}, {MIX.format(d='visual_format')} FROM cc GROUP BY visual_format HAVING count(*) >= 5", *MIX_F))
def _(spark, sf):
    return ag.commerce_by(commerce(spark, sf), ["visual_format"], 5)


@query("ag12_commerce_by_brand", with_cte(COMMERCE, f"SELECT brand, {RATES}, {MIX.format(d='brand')} FROM cc GROUP BY brand", *MIX_F))
def _(spark, sf):
    return ag.commerce_by(commerce(spark, sf), ["brand"])


@query("ag13_level_shares", with_cte(COMMERCE, "SELECT brand, level AS commerce_intensity, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY brand) AS share FROM cc GROUP BY brand, level", "share"))
def _(spark, sf):
    return ag.level_shares(commerce(spark, sf))


@query("ag14_commerce_trend", with_cte(COMMERCE, "SELECT commerce_intensity, level_no AS level, count(video_id) AS n, median(bri) AS median_bri, median(wer) AS median_wer, avg(CASE WHEN video_id IS NOT NULL THEN CAST(COALESCE(wer >= (SELECT quantile_cont(wer, 0.9) FROM m), false) AS INT) END) AS top_rate FROM (VALUES ('None', 0), ('Low', 1), ('Medium', 2), ('High', 3)) AS l(commerce_intensity, level_no) LEFT JOIN cc ON level = commerce_intensity GROUP BY ALL", "median_bri", "median_wer", "top_rate"))
def _(spark, sf):
    return ag.commerce_trend(commerce(spark, sf))


@query("ag15_bubble", with_cte(COMMERCE, "SELECT level, count(*) AS n, avg(score) AS mean_score, median(bri) AS median_bri FROM (SELECT score, bri, unnest(brand_styles) AS level FROM cc) GROUP BY level", "mean_score", "median_bri"))
def _(spark, sf):
    return group_stats(ag.levels_of(commerce(spark, sf), "brand_styles"), {"level": "brand_styles"}, [F.count("*").alias("n"), F.avg("commerce_score").alias("mean_score")], {"median_bri": ("bri", 0.5)})


@query("ag16_commerce_by_brand_and_line", with_cte(COMMERCE, f"SELECT brand, product_lines, {RATES}, {MIX.format(d='product_lines')} FROM (SELECT * EXCLUDE (product_lines), unnest(product_lines) AS product_lines FROM cc) GROUP BY brand, product_lines", *MIX_F))
def _(spark, sf):
    return ag.commerce_by(commerce(spark, sf), ["brand", "product_lines"])


@query("ag17_brand_pivot", with_cte(COMMERCE, "SELECT *, greatest(mean_north, mean_south) AS max_mean, mean_north - mean_south AS gap FROM (SELECT level, count(*) FILTER (brand = 'north') AS n_north, count(*) FILTER (brand = 'south') AS n_south, avg(score) FILTER (brand = 'north') AS mean_north, avg(score) FILTER (brand = 'south') AS mean_south FROM (SELECT score, brand, unnest(content_type) AS level FROM cc) GROUP BY level) WHERE (n_north >= 5 AND mean_north > 0.1) OR (n_south >= 5 AND mean_south > 0.1)", "mean_north", "mean_south", "max_mean", "gap"))
def _(spark, sf):
    return ag.brand_pivot(commerce(spark, sf), "content_type", BRANDS, 5, 0.1)


@query("ag43_quadrants", with_cte(COMMERCE + ", q AS (SELECT level, count(*) AS n, avg(score) AS x, median(bri) AS y FROM (SELECT score, bri, unnest(product_lines) AS level FROM cc) GROUP BY level)", "SELECT *, (CASE WHEN x >= (SELECT median(x) FROM q) THEN 'high' ELSE 'low' END) || '_' || (CASE WHEN y >= (SELECT median(y) FROM q) THEN 'high' ELSE 'low' END) AS quadrant FROM q", "x", "y"))
def _(spark, sf):
    return ag.quadrants(commerce(spark, sf), "product_lines")


def creators(spark, sf):
    return ag.with_creator_flags(measured(spark, sf))


@query("ag18_creator_flags", with_cte(CREATORS, "SELECT video_id, channel, is_collab, tier AS creator_tier, CAST(CASE tier WHEN 'nano' THEN 0 WHEN 'micro' THEN 1 WHEN 'mid' THEN 2 WHEN 'macro' THEN 3 WHEN 'mega' THEN 4 END AS BIGINT) AS tier_order FROM k"))
def _(spark, sf):
    return creators(spark, sf).select("video_id", "channel", "is_collab", "creator_tier", "tier_order")


@query("ag19_ugc_subset", with_cte(CREATORS, "SELECT video_id, author_id FROM k WHERE channel = 'ugc'"))
def _(spark, sf):
    return creators(spark, sf).where("channel = 'ugc'").select("video_id", "author_id")


@query("ag20_follower_quartile", duck("SELECT video_id, CAST(CASE WHEN f IS NULL THEN NULL ELSE 1 + CAST(f > e1 AS INT) + CAST(f > e2 AS INT) + CAST(f > e3 AS INT) END AS BIGINT) AS follower_quartile FROM (SELECT video_id, author_follower_count AS f FROM posts) CROSS JOIN (SELECT quantile_cont(f, 0.25) AS e1, quantile_cont(f, 0.5) AS e2, quantile_cont(f, 0.75) AS e3 FROM (SELECT DISTINCT author_id, author_follower_count AS f FROM posts WHERE author_follower_count IS NOT NULL))"))
def _(spark, sf):
    return ag.follower_quartile(measured(spark, sf)).select("video_id", "follower_quartile")


@query("ag21_channel_mix", with_cte(CREATORS, "SELECT brand, channel, count(*) AS n, count(DISTINCT author_id) AS authors, avg(CAST(is_collab AS INT)) AS collab_rate, count(*) / sum(count(*)) OVER (PARTITION BY brand) AS share FROM k GROUP BY brand, channel", "collab_rate", "share"))
def _(spark, sf):
    return ag.channel_mix(creators(spark, sf))


@query("ag22_tier_mix", with_cte(CREATORS + ", s AS (SELECT 'all' AS scope, * FROM k WHERE channel = 'ugc' UNION ALL SELECT brand, * FROM k WHERE channel = 'ugc' AND brand IS NOT NULL), g AS (SELECT scope, tier, count(DISTINCT author_id) AS authors, count(*) AS videos FROM s WHERE tier IS NOT NULL GROUP BY ALL)", "SELECT scope, creator_tier, COALESCE(authors, 0) AS authors, COALESCE(videos, 0) AS videos, COALESCE(authors, 0) / nullif(sum(authors) OVER (PARTITION BY scope), 0) AS author_share, COALESCE(videos, 0) / nullif(sum(videos) OVER (PARTITION BY scope), 0) AS video_share FROM (SELECT s.*, t.* FROM (VALUES ('all'), ('north'), ('south')) AS s(scope), (VALUES ('nano'), ('micro'), ('mid'), ('macro'), ('mega')) AS t(creator_tier)) LEFT JOIN (SELECT scope, tier AS creator_tier, authors, videos FROM g) USING (scope, creator_tier)", "author_share", "video_share"))
def _(spark, sf):
    return ag.tier_mix(creators(spark, sf), BRANDS)


SCALE = "SELECT tier AS scale, level, count(*) AS n, median(bri) AS median_bri, median(wer) AS median_wer FROM (SELECT tier, bri, wer, unnest(content_type) AS level FROM k WHERE channel = 'ugc' AND tier IS NOT NULL) GROUP BY ALL"


@query("ag23_scale_by_label", with_cte(CREATORS, SCALE, "median_bri", "median_wer"))
def _(spark, sf):
    return ag.scale_by(creators(spark, sf), "content_type")


@query("ag24_scale_pivot", with_cte(CREATORS, f"SELECT scale, {', '.join(f"max(CASE WHEN level = '{x}' THEN {c} END) AS {p}_{x}" for x in ('promo', 'collab') for p, c in (('value', 'median_bri'), ('n', 'n')))} FROM ({SCALE}) GROUP BY scale", "value_promo", "value_collab"))
def _(spark, sf):
    return ag.scale_pivot(ag.scale_by(creators(spark, sf), "content_type"), ["promo", "collab"])


@query("ag25_collab_cells", with_cte(CREATORS, "SELECT brand, channel, count(video_id) AS n, median(bri) AS median_bri, median(wer) AS median_wer FROM (SELECT * FROM (VALUES ('north'), ('south')) AS b(brand), (VALUES ('official'), ('ugc')) AS c(channel)) LEFT JOIN (SELECT * FROM k WHERE is_collab) USING (brand, channel) GROUP BY brand, channel", "median_bri", "median_wer"))
def _(spark, sf):
    return ag.collab_cells(creators(spark, sf), BRANDS)


@query("ag26_collab_versus_rest", with_cte(CREATORS, "SELECT is_collab, count(*) AS n, median(bri) AS median_bri, median(wer) AS median_wer, count(wer) / count(*) AS coverage FROM k GROUP BY is_collab", "median_bri", "median_wer", "coverage"))
def _(spark, sf):
    return ag.collab_versus_rest(creators(spark, sf))


@query("ag27_co_labels", duck("SELECT label, count(*) AS n, median(bri) AS median_bri, count(*) / (SELECT count(*) FROM m WHERE list_contains(content_type, 'collab')) AS share FROM (SELECT bri, unnest(content_type) AS label FROM m WHERE list_contains(content_type, 'collab')) WHERE label <> 'collab' GROUP BY label", "median_bri", "share"))
def _(spark, sf):
    return ag.co_labels(measured(spark, sf))


@query("ag28_partner_mix", with_cte(CREATORS, "SELECT visual_format AS partner, count(*) AS n, median(bri) AS median_bri FROM k WHERE is_collab GROUP BY 1", "median_bri"))
def _(spark, sf):
    return group_stats(creators(spark, sf).where("is_collab"), {"partner": "visual_format"}, [F.count("*").alias("n")], {"median_bri": ("bri", 0.5)})


PERCEPTION = "count(*) AS n, count(DISTINCT video_id) AS videos, median(sentiment_score) AS median_score, avg(sentiment_score) AS mean_score, avg(CAST(sentiment_score >= 0.05 AS INT)) AS positive, avg(CAST(sentiment_score > -0.05 AND sentiment_score < 0.05 AS INT)) AS neutral, avg(CAST(sentiment_score <= -0.05 AS INT)) AS negative, avg(CAST(sentiment_score >= 0.05 AS INT)) - avg(CAST(sentiment_score <= -0.05 AS INT)) AS net"
PERCEPTION_F = ("median_score", "mean_score", "positive", "neutral", "negative", "net")


@query("ag29_perception", duck(f"SELECT brand, {PERCEPTION} FROM comments WHERE sentiment_score IS NOT NULL GROUP BY brand", *PERCEPTION_F))
def _(spark, sf):
    return ag.perception(comments(spark, sf), ["brand"])


JOINED = "SELECT c.*, p.brand AS video_brand, unnest(p.{l}) AS level FROM comments c JOIN posts p USING (video_id) WHERE sentiment_score IS NOT NULL"


@query("ag30_sentiment_by_label", duck(f"SELECT video_brand, level, {PERCEPTION} FROM ({JOINED.format(l='content_type')}) GROUP BY ALL HAVING count(*) >= 5", *PERCEPTION_F))
def _(spark, sf):
    return ag.sentiment_by_label(comments(spark, sf), measured(spark, sf), "content_type")


@query("ag31_sentiment_by_line", duck(f"SELECT video_brand, level, {PERCEPTION} FROM ({JOINED.format(l='product_lines')}) GROUP BY ALL HAVING count(*) >= 4000 OR level IN ('gazelle')", *PERCEPTION_F))
def _(spark, sf):
    return ag.sentiment_by_label(comments(spark, sf), measured(spark, sf), "product_lines", 4000, ["gazelle"])


@query("ag32_topic_by_line", duck(f"SELECT topic, video_brand, level, {PERCEPTION} FROM ({JOINED.format(l='product_lines')}) GROUP BY ALL HAVING count(*) >= 5", *PERCEPTION_F))
def _(spark, sf):
    return ag.sentiment_by_label(comments(spark, sf), measured(spark, sf), "product_lines", by=["topic"])


@query("ag33_on_every_brand", "SELECT p_name AS level, count(DISTINCT p_type) AS n_groups FROM part GROUP BY p_name HAVING count(DISTINCT p_type) = (SELECT count(DISTINCT p_type) FROM part)")
def _(spark, sf):
    return ag.on_every_group(table(spark, sf, "part").select(F.col("p_name").alias("level"), "p_type"), "level", "p_type")


LAYER = "CASE WHEN topic IN ('price_value', 'fit_comfort', 'availability') THEN 'substantive' ELSE 'social' END"


@query("ag34_topic_volume", duck(f"SELECT topic, count(*) AS n, count(*) FILTER (brand = 'north') AS n_north, count(*) FILTER (brand = 'south') AS n_south, count(*) / sum(count(*)) OVER () AS share FROM comments WHERE {LAYER} = 'substantive' GROUP BY topic", "share"))
def _(spark, sf):
    return ag.topic_volume(comments(spark, sf), rules.topic_table(spark), ["substantive"], BRANDS)


@query("ag35_layer_mix", duck(f"SELECT layer, ord, COALESCE(n, 0) AS n, COALESCE(n, 0) / sum(n) OVER () AS share FROM (VALUES ('substantive', 0), ('product_reaction', 1), ('social', 2), ('residual', 3)) AS l(layer, ord) LEFT JOIN (SELECT {LAYER} AS layer, count(*) AS n FROM comments GROUP BY 1) USING (layer)", "share"))
def _(spark, sf):
    return ag.layer_mix(comments(spark, sf), rules.topic_table(spark), rules.load("topics")["layers"])


WIDE = ", ".join(f"count(*) FILTER (brand = '{b}') AS n_{b}, median(sentiment_score) FILTER (brand = '{b}') AS median_{b}, avg(CAST(sentiment_score >= 0.05 AS INT)) FILTER (brand = '{b}') AS positive_{b}, avg(CAST(sentiment_score <= -0.05 AS INT)) FILTER (brand = '{b}') AS negative_{b}" for b in BRANDS)


@query("ag36_ag37_topic_sentiment_gap", duck(f"SELECT *, net_north - net_south AS gap, CASE WHEN net_north > net_south THEN 'north' WHEN net_north < net_south THEN 'south' ELSE 'tie' END AS lead FROM (SELECT *, positive_north - negative_north AS net_north, positive_south - negative_south AS net_south FROM (SELECT topic, count(*) AS n, {WIDE} FROM comments WHERE sentiment_score IS NOT NULL GROUP BY topic))", *[f"{c}_{b}" for c in ("median", "positive", "negative", "net") for b in BRANDS], "gap"))
def _(spark, sf):
    return ag.topic_sentiment(comments(spark, sf), BRANDS)


BUCKET = "CASE WHEN relative_uplift IS NULL THEN 'other' WHEN relative_uplift >= 0.10 AND n < 20 THEN 'A_niche_high' WHEN relative_uplift >= 0.10 AND (share >= 0.05 OR n >= 50) THEN 'B_scalable_winner' WHEN relative_uplift >= 0.10 THEN 'B_reliable_winner' WHEN relative_uplift < 0 AND share >= 0.05 AND n >= 20 THEN 'C_high_volume_under' ELSE 'other' END"


def parts_relative(spark, sf):
    value = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("value"))
    parts = table(spark, sf, "part").join(value, F.col("p_partkey") == F.col("l_partkey")).select(F.col("p_brand").alias("brand"), F.split("p_name", " ").alias("labels"), "value")
    return ag.relative_performance(parts, "labels", "value")


RELP = f"WITH parts AS ({PARTS}), r AS ({REL.format(v='value', l='labels', t='parts')})"


@query("ag38_strategic_bucket", f"{RELP} SELECT brand, category, n, {BUCKET} AS bucket FROM r")
def _(spark, sf):
    return parts_relative(spark, sf).select("brand", "category", "n", ag.strategic_bucket(F.col("relative_uplift"), F.col("share"), F.col("n")).alias("bucket"))


@query("ag39_auto_findings", f"{RELP}, t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY relative_uplift DESC, category) AS rank FROM r WHERE relative_uplift > 0) WHERE rank <= 3), b AS (SELECT category, count(DISTINCT brand) AS k FROM t GROUP BY category) SELECT brand, string_agg(category, ', ' ORDER BY rank) AS top, COALESCE(string_agg(category, ', ' ORDER BY rank) FILTER (k > 1), '') AS shared, COALESCE(string_agg(category, ', ' ORDER BY rank) FILTER (k = 1), '') AS only_here, COALESCE(string_agg(category, ', ' ORDER BY rank) FILTER (small_n), '') AS caution FROM t JOIN b USING (category) GROUP BY brand")
def _(spark, sf):
    return ag.auto_findings(parts_relative(spark, sf))


@query("ag40_channel_snapshot", with_cte(CREATORS, "SELECT channel, count(*) AS n, median(wer) AS median_wer, CAST(sum(view_count) AS BIGINT) AS views, count(*) / sum(count(*)) OVER () AS share FROM k GROUP BY channel", "median_wer", "share"))
def _(spark, sf):
    return ag.channel_snapshot(creators(spark, sf))


@query("ag40_executive_summary", duck("SELECT count(*) AS videos, count(wer) AS with_wer, count(DISTINCT author_id) AS authors, count(*) FILTER (len(content_type) > 0) AS labelled, quantile_cont(wer, 0.9) AS top_threshold FROM m", "top_threshold"))
def _(spark, sf):
    return ag.executive_summary(measured(spark, sf))


@query("ag41_display_pivot", duck(f"SELECT category, max(CASE WHEN brand = 'north' THEN n END) AS north, max(CASE WHEN brand = 'south' THEN n END) AS south, CAST(sum(n) AS BIGINT) AS total FROM ({REL.format(v='wer', l='content_type', t='m')}) GROUP BY category"))
def _(spark, sf):
    return ag.wide(relative(spark, sf), "category", BRANDS, "brand", "n")


@query("ag42_histogram", duck("SELECT brand, CAST(CASE WHEN ln(1 + view_count) < 0 THEN 0 WHEN ln(1 + view_count) >= 15 THEN 31 ELSE floor(ln(1 + view_count) / 0.5) + 1 END AS BIGINT) AS bucket, count(*) AS n FROM posts WHERE view_count IS NOT NULL GROUP BY ALL"))
def _(spark, sf):
    return ag.histogram(measured(spark, sf), "view_count", 0.0, 15.0, 30, log=True)


@query("ag42_box", duck("SELECT brand, count(*) AS n, quantile_cont(view_count, 0.25) AS q1, quantile_cont(view_count, 0.5) AS q2, quantile_cont(view_count, 0.75) AS q3 FROM posts WHERE view_count IS NOT NULL GROUP BY brand", "q1", "q2", "q3"))
def _(spark, sf):
    return ag.box(measured(spark, sf), "view_count")


@query("ag44_notable_points", f"{RELP}, z AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY n DESC, category) AS size_rank FROM r) SELECT brand, category, n, size_rank FROM z WHERE abs(relative_uplift) >= 0.08 OR share >= 0.05 OR size_rank <= 2")
def _(spark, sf):
    return ag.notable_points(parts_relative(spark, sf)).select("brand", "category", "n", "size_rank")


TAG_MAPS = {"seeds": ["nikerunning", "niketech"], "lines": ["niketech", "airmax"], "categories": ["sneakers", "jacket"]}


@query("ag45_unmapped_tags", duck("SELECT *, CASE WHEN in_seeds AND in_lines AND in_categories THEN 'mapped' ELSE 'add to ' || concat_ws(', ', CASE WHEN NOT in_seeds THEN 'seeds' END, CASE WHEN NOT in_lines THEN 'lines' END, CASE WHEN NOT in_categories THEN 'categories' END) END AS suggestion FROM (SELECT tag, count(*) AS n, count(*) FILTER (brand = 'north') AS n_north, count(*) FILTER (brand = 'south') AS n_south, tag IN ('nikerunning', 'niketech') AS in_seeds, tag IN ('niketech', 'airmax') AS in_lines, tag IN ('sneakers', 'jacket') AS in_categories FROM (SELECT brand, unnest(list_distinct(hashtags)) AS tag FROM posts) GROUP BY tag)"))
def _(spark, sf):
    return ag.unmapped_tags(measured(spark, sf), TAG_MAPS, BRANDS)


@query("ag46_phrase_evidence", duck("SELECT 'content' AS axis, label, lower(trim(phrase)) AS phrase, count(*) AS n FROM (SELECT visual_format AS label, unnest(hashtags) AS phrase FROM posts) WHERE label IN ('Topic1', 'Topic2') GROUP BY ALL"))
def _(spark, sf):
    votes = F.array(F.struct(F.lit("content").alias("axis"), F.col("visual_format").alias("label"), F.col("hashtags").alias("phrases")), F.struct(F.lit("other").alias("axis"), F.lit("x").alias("label"), F.col("hashtags").alias("phrases")))
    return ag.phrase_evidence(measured(spark, sf).withColumn("votes", votes), {"content": ["Topic1", "Topic2"]})


@query("ag47_facet_options", duck("SELECT value, count(*) AS n FROM (SELECT unnest(content_type) AS value FROM posts) GROUP BY value HAVING count(*) >= 20"))
def _(spark, sf):
    return ag.facet_options(measured(spark, sf), "content_type")


@query("ag47_facet_combinations", duck("SELECT DISTINCT brand, array_to_string(list_sort(content_type), '|') AS content_type FROM posts"))
def _(spark, sf):
    return ag.facet_combinations(measured(spark, sf), ["brand", "content_type"])
