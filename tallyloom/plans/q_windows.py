"""Queries of joins, windows, rankings, sets, tests and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stats as ts
from ..operators import windows as wn
from .common import comments, duck, floats, measured, posts, table, tidy

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = lambda spark, sf: tidy(f(spark, sf))
        if sql:
            SQL[name] = sql
        return f

    return add


# --- joins ------------------------------------------------------------------------------------


@query("jn01_left_join", duck("SELECT comment_id, source_type FROM comments LEFT JOIN posts USING (video_id)"))
def _(spark, sf):
    return comments(spark, sf).join(posts(spark, sf).select("video_id", "source_type"), "video_id", "left").select("comment_id", "source_type")


@query("jn02_inner_to_deduped", duck("SELECT p.brand, count(*) AS n FROM comments JOIN posts p USING (video_id) GROUP BY p.brand"))
def _(spark, sf):
    dim = posts(spark, sf).dropDuplicates(["video_id"]).select("video_id", F.col("brand").alias("b"))
    return comments(spark, sf).join(dim, "video_id").groupBy(F.col("b").alias("brand")).agg(F.count("*").alias("n"))


@query("jn03_jn04_merged_metrics", duck("SELECT topic, n, scored FROM (SELECT topic, count(*) AS n FROM comments GROUP BY topic) LEFT JOIN (SELECT topic, count(*) AS scored FROM comments WHERE sentiment_score > 0.9 AND topic <> 'fit_comfort' GROUP BY topic) USING (topic)"))
def _(spark, sf):
    c = comments(spark, sf)
    some = c.where("sentiment_score > 0.9 and topic <> 'fit_comfort'").groupBy("topic").agg(F.count("*").alias("scored"))
    return c.groupBy("topic").agg(F.count("*").alias("n")).join(some, "topic", "left")


@query("jn05_dictionary_lookup", "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '5-LOW' THEN 5 END::BIGINT AS level FROM orders")
def _(spark, sf):
    names = F.create_map(F.lit("1-URGENT"), F.lit(1), F.lit("5-LOW"), F.lit(5))
    return table(spark, sf, "orders").select("o_orderkey", F.try_element_at(names, F.col("o_orderpriority")).alias("level"))


@query("jn06_align_to_keys", "SELECT c_custkey, n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) ON c_custkey = o_custkey")
def _(spark, sf):
    n = table(spark, sf, "orders").where("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return table(spark, sf, "customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "n")


@query("jn08_semi_and_anti", duck("SELECT 'with' AS kind, count(*) AS n FROM posts WHERE video_id IN (SELECT video_id FROM comments WHERE sentiment_score > 0.95) UNION ALL SELECT 'without', count(*) FROM posts WHERE video_id NOT IN (SELECT video_id FROM comments WHERE sentiment_score > 0.95)"))
def _(spark, sf):
    p, hot = posts(spark, sf).select("video_id"), comments(spark, sf).where("sentiment_score > 0.95").select("video_id")
    return p.join(hot, "video_id", "left_semi").agg(F.lit("with").alias("kind"), F.count("*").alias("n")).unionByName(p.join(hot, "video_id", "left_anti").agg(F.lit("without").alias("kind"), F.count("*").alias("n")))


# --- windows ----------------------------------------------------------------------------------


@query("wn01_latest_event", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def _(spark, sf):
    return wn.first_per_group(table(spark, sf, "events"), ["user_id"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_id")


@query("wn02_group_median", floats("SELECT event_id, median(value) OVER (PARTITION BY event_type) AS m FROM events", "m"))
def _(spark, sf):
    return wn.group_median(table(spark, sf, "events"), "event_type", "value", "m").select("event_id", "m")


@query("wn03_group_total", floats("SELECT o_orderkey, o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey) AS share FROM orders", "share"))
def _(spark, sf):
    return wn.group_total(table(spark, sf, "orders"), "o_custkey", "o_totalprice", "t").select("o_orderkey", (F.col("o_totalprice") / F.col("t")).alias("share"))


@query("wn04_top_percent", duck("SELECT video_id, CASE WHEN wer IS NOT NULL THEN greatest(1, CAST(ceil(rank() OVER (ORDER BY wer DESC NULLS LAST) * 100 / (SELECT count(wer) FROM m)) AS BIGINT)) END AS top_percent FROM m"))
def _(spark, sf):
    return wn.top_percent(measured(spark, sf), "wer").select("video_id", "top_percent")


@query("wn05_group_distinct", "SELECT o_orderkey, n FROM orders JOIN (SELECT o_custkey AS k, count(DISTINCT o_orderstatus) AS n FROM orders GROUP BY 1) ON o_custkey = k")
def _(spark, sf):
    return wn.group_distinct(table(spark, sf, "orders"), "o_custkey", "o_orderstatus", "n").select("o_orderkey", "n")


@query("wn06_suffix_minimum", "SELECT event_id, min(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS least FROM events")
def _(spark, sf):
    return wn.suffix_minimum(table(spark, sf, "events"), "value", "user_id", ["ts", "event_id"], "least").select("event_id", "least")


@query("wn07_leave_one_out", floats("SELECT event_id, COALESCE((sum(value) OVER w - value) / nullif(count(*) OVER w - 1, 0), -1) AS others FROM events WINDOW w AS (PARTITION BY user_id, event_type)", "others"))
def _(spark, sf):
    from ..operators.features import leave_one_out

    e = table(spark, sf, "events").withColumn("k", F.concat_ws("|", F.col("user_id").cast("string"), "event_type"))
    return leave_one_out(e, "k", "value", F.lit(-1.0), "others").select("event_id", "others")


@query("wn08_graded_relevance", "SELECT o_orderkey, CAST(CASE WHEN n >= 5 THEN CAST(v > e[1] AS INT) + CAST(v > e[2] AS INT) + CAST(v > e[3] AS INT) + CAST(v > e[4] AS INT) ELSE dense_rank() OVER (PARTITION BY k ORDER BY v) - 1 END AS BIGINT) AS relevance FROM (SELECT o_orderkey, o_custkey AS k, o_totalprice AS v FROM orders) JOIN (SELECT o_custkey AS k, count(*) AS n, quantile_cont(o_totalprice, [0.2, 0.4, 0.6, 0.8]) AS e FROM orders GROUP BY 1) USING (k)")
def _(spark, sf):
    return wn.graded_relevance(table(spark, sf, "orders"), "o_custkey", "o_totalprice").select("o_orderkey", "relevance")


@query("wn09_first_per_author", duck("SELECT author_id, video_id FROM (SELECT *, row_number() OVER (PARTITION BY author_id ORDER BY wer DESC NULLS LAST, video_id) AS r FROM m) WHERE r = 1"))
def _(spark, sf):
    return wn.first_per_group(measured(spark, sf), ["author_id"], F.desc_nulls_last("wer"), F.asc("video_id")).select("author_id", "video_id")


# --- sorts and limits -------------------------------------------------------------------------


@query("sl01_sorted_page", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 50")
def _(spark, sf):
    return table(spark, sf, "orders").orderBy(F.desc_nulls_last("o_totalprice"), "o_orderkey").limit(50).select("o_orderkey", "o_custkey")


@query("sl02_tiered_sort", duck("SELECT video_id FROM m ORDER BY CAST(is_official_brand AS INT) DESC, CAST(COALESCE(view_count >= 100000, false) AS INT) DESC, wer DESC NULLS LAST, view_count DESC NULLS LAST, video_id LIMIT 40"))
def _(spark, sf):
    df = measured(spark, sf)
    return df.orderBy(*wn.tiered_order(df, F.col("is_official_brand"))).limit(40).select("video_id")


@query("sl03_top_ids", duck("SELECT video_id, max(view_count) AS metric FROM posts GROUP BY video_id ORDER BY metric DESC NULLS LAST, video_id LIMIT 30"))
def _(spark, sf):
    return wn.top_ids(posts(spark, sf), "no_such_metric", 30)


@query("sl04_top_per_group", "SELECT p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r <= 3")
def _(spark, sf):
    return wn.top_k(table(spark, sf, "part"), ["p_brand"], 3, F.desc("p_retailprice"), F.asc("p_partkey")).select("p_brand", "p_partkey")


@query("sl05_diversified_pick", "SELECT p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY lr, p_retailprice DESC, p_partkey) AS rnd FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_retailprice DESC, p_partkey) AS lr FROM part)) ORDER BY rnd, p_brand, p_retailprice DESC, p_partkey LIMIT 60")
def _(spark, sf):
    return wn.diversified(table(spark, sf, "part"), 60, F.desc("p_retailprice"), F.asc("p_partkey"), group="p_brand", line="p_type").select("p_partkey")


@query("sl07_pools", duck("SELECT video_id, CASE WHEN list_contains(content_type, 'collab') THEN 'collaboration' WHEN CAST(video_id AS BIGINT) % 12 = 8 THEN 'mention' END AS pool FROM posts WHERE (list_contains(content_type, 'collab') OR CAST(video_id AS BIGINT) % 12 = 8) AND length(trim(caption_raw)) >= 20"))
def _(spark, sf):
    c = {"collaboration": F.coalesce(F.array_contains("content_type", "collab"), F.lit(False)), "mention": F.coalesce(F.col("caption_raw").contains("@"), F.lit(False))}
    return wn.pools(posts(spark, sf), c, F.col("caption_raw"), 20).select("video_id", "pool")


@query("sl08_budgeted_items", "SELECT user_id, event_id, place, greatest(n - 3, 0) AS trimmed FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 END NULLS LAST, ts, event_id) AS place, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE place <= 3")
def _(spark, sf):
    return wn.budgeted(table(spark, sf, "events"), "user_id", "event_type", ["purchase", "click"], 3, F.asc("ts"), F.asc("event_id")).select("user_id", "event_id", "place", "trimmed")


@query("sl09_parents_with_children", duck("SELECT video_id FROM (SELECT video_id, view_count FROM posts ORDER BY view_count DESC NULLS LAST, video_id LIMIT 120) WHERE video_id IN (SELECT video_id FROM comments) ORDER BY view_count DESC, video_id LIMIT 105"))
def _(spark, sf):
    return wn.parents_with_children(posts(spark, sf), comments(spark, sf), "video_id", "view_count", 120, 105).select("video_id")


# --- sets -------------------------------------------------------------------------------------


@query("so01_union_all", "SELECT p_brand AS name FROM part UNION ALL SELECT c_mktsegment FROM customer")
def _(spark, sf):
    return table(spark, sf, "part").select(F.col("p_brand").alias("name")).unionByName(table(spark, sf, "customer").select(F.col("c_mktsegment").alias("name")))


@query("so02_intersect_and_difference", "SELECT 'both' AS kind, o_custkey FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') UNION ALL SELECT 'first', o_custkey FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')")
def _(spark, sf):
    of = lambda s: table(spark, sf, "orders").where(F.col("o_orderstatus") == s).select("o_custkey")
    return of("F").intersect(of("O")).select(F.lit("both").alias("kind"), "o_custkey").unionByName(of("F").subtract(of("O")).select(F.lit("first").alias("kind"), "o_custkey"))


@query("so03_smoothed_overlap", duck("SELECT video_id, len(list_intersect(content_type, ['promo', 'collab'])) / (len(list_distinct(list_concat(content_type, ['promo', 'collab']))) + 1) AS overlap FROM posts WHERE content_type IS NOT NULL", "overlap"))
def _(spark, sf):
    return posts(spark, sf).where("content_type is not null").select("video_id", wn.smoothed_overlap(F.col("content_type"), F.array(F.lit("promo"), F.lit("collab"))).alias("overlap"))


@query("so04_distinct", "SELECT DISTINCT p_brand, p_type FROM part")
def _(spark, sf):
    return table(spark, sf, "part").dropDuplicates(["p_brand", "p_type"]).select("p_brand", "p_type")


# --- tests and samples ------------------------------------------------------------------------

RANKS = "avg(r0) OVER (PARTITION BY {g} wer)"


@query("ts01_rank_test", duck("SELECT count(*) FILTER (b = 'north') AS n1, count(*) FILTER (b = 'south') AS n2, median(wer) FILTER (b = 'north') AS median_in, median(wer) FILTER (b = 'south') AS median_out, sum(rk) FILTER (b = 'north') - count(*) FILTER (b = 'north') * (count(*) FILTER (b = 'north') + 1) / 2 AS u, 1 - 2 * (sum(rk) FILTER (b = 'north') - count(*) FILTER (b = 'north') * (count(*) FILTER (b = 'north') + 1) / 2) / (count(*) FILTER (b = 'north') * count(*) FILTER (b = 'south')) AS rank_biserial FROM (SELECT brand AS b, wer, avg(r0) OVER (PARTITION BY wer) AS rk FROM (SELECT brand, wer, row_number() OVER (ORDER BY wer) AS r0 FROM m WHERE brand IS NOT NULL AND wer IS NOT NULL))", "median_in", "median_out", "u", "rank_biserial"))
def _(spark, sf):
    return ts.compare_two(measured(spark, sf), "brand", "north", "south", "wer").drop("p_value")


@query("ts02_category_tests", duck("SELECT brand, category, n_category, n_other, median_category, s - n_category * (n_category + 1) / 2 AS u, 1 - 2 * (s - n_category * (n_category + 1) / 2) / (n_category * n_other) AS rank_biserial FROM (SELECT brand, category, count(*) AS n_category, any_value(total) - count(*) AS n_other, median(wer) AS median_category, sum(rk) AS s FROM (SELECT brand, wer, rk, total, unnest(content_type) AS category FROM (SELECT *, avg(r0) OVER (PARTITION BY brand, wer) AS rk FROM (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY wer) AS r0, count(*) OVER (PARTITION BY brand) AS total FROM m WHERE brand IS NOT NULL AND wer IS NOT NULL))) GROUP BY brand, category) WHERE n_category >= 20 AND n_other >= 5", "median_category", "u", "rank_biserial"))
def _(spark, sf):
    return ts.category_tests(measured(spark, sf), "content_type", "wer").drop("p_value", "p_adj")


@query("ts03_adjusted_p", floats("SELECT p_partkey, least(1, min(s) OVER (ORDER BY p, p_partkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS p_adj FROM (SELECT p_partkey, p, p * (SELECT count(*) FROM part) / row_number() OVER (ORDER BY p, p_partkey) AS s FROM (SELECT p_partkey, ((p_partkey * 7919) % 1009) / 1009 AS p FROM part))", "p_adj"))
def _(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", ((F.col("p_partkey") * 7919) % 1009 / 1009).alias("p"))
    return ts.adjust(p, "p", "p_adj").select("p_partkey", "p_adj")


@query("ts04_spearman", floats("SELECT count(*) AS n, corr(a, b) AS rho FROM (SELECT avg(ra) OVER (PARTITION BY n_chars) AS a, avg(rb) OVER (PARTITION BY quality) AS b FROM (SELECT *, row_number() OVER (ORDER BY n_chars) AS ra, row_number() OVER (ORDER BY quality) AS rb FROM documents JOIN labels USING (doc_id)))", "rho"))
def _(spark, sf):
    return ts.spearman(table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id"), "n_chars", "quality")


QUOTA = "SELECT s, f + CAST(row_number() OVER (ORDER BY e - f DESC, s) <= 500 - sum(f) OVER () AS BIGINT) AS q FROM (SELECT o_orderpriority AS s, 500 * count(*) / (SELECT count(*) FROM orders) AS e, CAST(floor(500 * count(*) / (SELECT count(*) FROM orders)) AS BIGINT) AS f FROM orders GROUP BY 1)"


@query("ts05_stratified_sample", f"SELECT o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '-7'), o_orderkey) AS r FROM orders) JOIN ({QUOTA}) ON o_orderpriority = s WHERE r <= q")
def _(spark, sf):
    return ts.stratified_sample(table(spark, sf, "orders"), "o_orderpriority", 500, "o_orderkey").select("o_orderkey", "o_orderpriority")


@query("ts06_capped_sample", "SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY md5(CAST(event_id AS VARCHAR) || '-7'), event_id) AS r FROM events) WHERE r <= 40")
def _(spark, sf):
    return ts.capped_sample(table(spark, sf, "events"), "event_type", 40, "event_id").select("event_id")
