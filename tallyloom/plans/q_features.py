"""Queries of sources, cleaning and scalar features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as tx
from ..functions.numbers import number
from ..operators import clean as cl
from ..operators import features as fe
from ..sources import landing as io
from .common import comments, duck, floats, measured, posts, table, tidy

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = lambda spark, sf: tidy(f(spark, sf))
        if sql:
            SQL[name] = sql
        return f

    return add


# --- sources and sinks ------------------------------------------------------------------------


@query("io01_io04_jsonl_round_trip", duck("SELECT video_id, caption_raw, view_count, brand, false AS broken FROM posts"))
def _(spark, sf):
    path = io.work_dir(spark)
    io.write_jsonl(posts(spark, sf), path)
    return io.read_jsonl(spark, path, io.VIDEO).select("video_id", "caption_raw", "view_count", "brand", F.col("_corrupt_record").isNotNull().alias("broken"))


@query("io02_route_files", duck("SELECT 'comment' AS kind, count(*) AS n, count(DISTINCT comment_id) AS ids FROM comments UNION ALL SELECT 'video', count(*), count(DISTINCT video_id) FROM posts"))
def _(spark, sf):
    path = io.work_dir(spark)
    io.write_jsonl(posts(spark, sf), f"{path}/videos")
    io.write_jsonl(comments(spark, sf), f"{path}/raw_comments")
    named = F.regexp_extract("_metadata.file_path", "/([^/]+)/[^/]+$", 1).contains("comment")
    read = lambda schema: spark.read.schema(schema).json([f"{path}/videos", f"{path}/raw_comments"])
    return (
        read(io.COMMENT).where(named).agg(F.lit("comment").alias("kind"), F.count("*").alias("n"), F.count_distinct("comment_id").alias("ids"))
        .unionByName(read(io.VIDEO).where(~named).agg(F.lit("video").alias("kind"), F.count("*").alias("n"), F.count_distinct("video_id").alias("ids")))
    )


@query("io03_union_drifting", duck("SELECT video_id, brand, NULL::BIGINT AS comment_like_count FROM posts UNION ALL SELECT video_id, NULL, comment_like_count FROM comments"))
def _(spark, sf):
    return io.union_drifting(posts(spark, sf).select("video_id", "brand"), comments(spark, sf).select("video_id", "comment_like_count"))


def items(spark, sf):
    p = posts(spark, sf)
    author = F.when(F.col("author_id").cast("long") % 3 != 0, F.struct(F.col("author_id").alias("id"), F.when(F.col("author_id").cast("long") % 5 != 0, F.col("author_username")).otherwise(" ").alias("name"), F.lit("nick").alias("nickName"), F.col("is_official_brand").alias("verified"), F.col("author_signature").alias("signature"), F.col("author_follower_count").alias("fans")))
    body = F.struct(F.col("video_id").alias("id"), F.col("caption_raw").alias("text"), F.col("create_time_ts").alias("createTime"), author.alias("authorMeta"), F.struct(F.col("music_id").alias("musicId")).alias("musicMeta"), F.col("view_count").alias("playCount"), F.col("like_count").alias("diggCount"), F.transform("hashtags", lambda t: F.struct(F.concat(F.lit("#"), t).alias("name"))).alias("hashtags"))
    return p.select(F.from_json(F.to_json(body), io.ITEM).alias("i")).select("i.*")


@query("io05_io06_flatten_items", duck("SELECT video_id, caption_raw, CASE WHEN CAST(author_id AS BIGINT) % 3 <> 0 THEN CASE WHEN CAST(author_id AS BIGINT) % 5 <> 0 THEN author_username ELSE 'nick' END END AS author_username, music_id IS NOT NULL AS has_music, view_count, like_count, CASE WHEN CAST(author_id AS BIGINT) % 3 <> 0 THEN is_official_brand ELSE false END AS author_verified, array_to_string(list_transform(hashtags, lambda t: ltrim(t, '#')), ',') AS tags FROM posts WHERE view_count IS NOT NULL OR CAST(author_id AS BIGINT) % 3 <> 0"))
def _(spark, sf):
    return io.flatten_items(items(spark, sf)).select("video_id", "caption_raw", "author_username", "has_music", "view_count", "like_count", "author_verified", F.array_join("hashtags", ",").alias("tags"))


@query("io07_io08_flatten_comments", duck("SELECT comment_id, comment_text, comment_like_count, video_id FROM (SELECT comment_id, CASE WHEN trim(comment_text) = '' THEN NULL ELSE trim(comment_text) END AS comment_text, comment_like_count, video_id FROM comments)"))
def _(spark, sf):
    c = comments(spark, sf)
    odd = F.col("comment_like_count") % 2 == 1
    raw = c.select(F.when(odd, F.col("comment_id")).alias("cid"), F.when(~odd, F.col("comment_id")).otherwise(" ").alias("comment_id"), F.col("comment_text").alias("text"), F.col("comment_like_count").cast("double").cast("string").alias("digg_count"), F.concat(F.lit("https://ex.am/@a/video/"), F.col("video_id"), F.lit("?x=1")).alias("videoWebUrl"))
    return io.flatten_comments(raw).select("comment_id", "comment_text", "comment_like_count", "video_id")


@query("io09_first_per_id", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY CAST(user_id AS VARCHAR) || event_type ORDER BY ts, event_id) AS r FROM events WHERE event_type <> 'error') WHERE r = 1")
def _(spark, sf):
    e = table(spark, sf, "events").withColumn("id", F.when(F.col("event_type") != "error", F.concat(F.col("user_id").cast("string"), F.col("event_type"))))
    return io.first_per_id(e, "id", "ts", "event_id").select("user_id", "event_type", "event_id")


@query("io10_pruned_read", "SELECT p_brand, count(*) AS n, max(p_size)::BIGINT AS largest FROM part GROUP BY p_brand")
def _(spark, sf):
    return io.read_features(spark, f"{sf}/part.parquet", ["p_brand", "p_size"]).groupBy("p_brand").agg(F.count("*").alias("n"), F.max("p_size").alias("largest"))


@query("io11_partitioned_sink", duck("SELECT COALESCE(brand, '__unknown__') AS brand, count(*) AS n, CAST(sum(view_count) AS BIGINT) AS views FROM posts GROUP BY 1"))
def _(spark, sf):
    path = io.work_dir(spark)
    io.write_partitioned(posts(spark, sf), path)
    return spark.read.parquet(path).groupBy("brand").agg(F.count("*").alias("n"), F.sum("view_count").alias("views"))


@query("io12_flat_sink", duck("SELECT count(*) AS n, count(DISTINCT comment_id) AS ids FROM comments"))
def _(spark, sf):
    path = io.work_dir(spark)
    io.write_flat(comments(spark, sf), path)
    return spark.read.parquet(path).agg(F.count("*").alias("n"), F.count_distinct("comment_id").alias("ids"))


@query("io13_publish", "SELECT user_id, CAST(date_trunc('day', ts) AS VARCHAR)[1:10] AS day, count(*) AS n FROM events GROUP BY ALL")
def _(spark, sf):
    path = io.work_dir(spark)
    io.publish(table(spark, sf, "events"), path, ["user_id", "ts", "event_type", "missing"], "ts")
    return spark.read.parquet(path).groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


@query("io14_export_aggregates", duck("SELECT brand, count(*) AS n, CAST((SELECT count(*) FROM posts) AS BIGINT) AS videos FROM posts WHERE brand IS NOT NULL GROUP BY brand"))
def _(spark, sf):
    path, p = io.work_dir(spark), posts(spark, sf)
    io.export_tables({"brands": p.where("brand is not null").groupBy("brand").agg(F.count("*").alias("n"))}, p.agg(F.count("*").alias("videos")), path)
    summary = spark.read.schema("videos long").json(f"{path}/summary")
    return spark.read.schema("brand string, n long").option("header", True).csv(f"{path}/brands").crossJoin(F.broadcast(summary))  # one row


def _phrase_rows():
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    rows = [(label, kind, p) for label, rule in rules.load("content")["labels"].items() for kind in ("strong", "weak") for p in rule.get(kind, [])]
    rows += [(label, "pair", p) for label, rule in rules.load("content")["labels"].items() for pair in rule.get("pairs", []) for p in pair]
    return ", ".join("(" + ", ".join(map(quote, (*r, tx.phrase_regex(r[2])))) + ")" for r in rows)


@query("io15_phrase_use", duck(f"SELECT label, kind, phrase, CAST(sum(n) AS BIGINT) AS n FROM (SELECT lower(COALESCE(caption_raw, '')) AS t, count(*) AS n FROM posts GROUP BY 1) JOIN (VALUES {_phrase_rows()}) AS p(label, kind, phrase, pattern) ON regexp_matches(t, pattern) GROUP BY ALL"))
def _(spark, sf):
    """How many captions use each phrase of the rule file; phrases of several words are found as the rules find them."""
    phrases = rules.phrase_table(spark)
    every = [p for rule in rules.load("content")["labels"].values() for kind in ("strong", "weak") for p in rule.get(kind, [])] + [p for rule in rules.load("content")["labels"].values() for pair in rule.get("pairs", []) for p in pair]
    found = posts(spark, sf).select(F.lower(F.coalesce("caption_raw", F.lit(""))).alias("text")).groupBy("text").agg(F.count("*").alias("n"))
    used = found.select("n", F.explode(tx.phrases_found(F.col("text"), every)).alias("phrase"))
    return used.join(F.broadcast(phrases), "phrase").groupBy("label", "kind", "phrase").agg(F.sum("n").alias("n"))  # phrases: a rule file


@query("io16_cluster_map", "SELECT topic, count(*) AS n FROM (SELECT CASE label WHEN 0 THEN 'price_value' WHEN 1 THEN 'fit_comfort' ELSE 'other_unclear' END AS topic FROM embeddings) GROUP BY topic")
def _(spark, sf):
    names = io.cluster_map(spark, [{"cluster_id": 0, "topic": "price_value"}, {"cluster_id": 1, "topic": "fit_comfort"}])
    rows = table(spark, sf, "embeddings").join(F.broadcast(names), F.col("label") == F.col("cluster_id"), "left")
    return rows.groupBy(F.coalesce("topic", F.lit("other_unclear")).alias("topic")).agg(F.count("*").alias("n"))


# --- cleaning ---------------------------------------------------------------------------------

PREFIX = {"north": ["nike"], "south": ["adidas"]}


@query("cl01_aliases", "SELECT CAST(event_id AS VARCHAR) AS video_id, CASE WHEN event_type = 'view' THEN CAST(floor(value) AS BIGINT) ELSE user_id END AS collect_count FROM events")
def _(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").cast("string").alias("id"), F.when(F.col("event_type") == "view", F.floor("value").cast("long")).alias("collect_count"), F.col("user_id").alias("save_count"))
    return cl.with_aliases(e).select("video_id", "collect_count")


STRIPPED = r"regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '')"


@query("cl02_cl03_trim_and_tags", rf"SELECT doc_id, length({STRIPPED}) AS n, array_to_string(list_transform(regexp_extract_all(text, '#([\p{{L}}\p{{N}}_]+)', 1), lambda t: lower(t)), ',') AS tags FROM documents")
def _(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.length(tx.strip(F.col("text"))).alias("n"), F.array_join(tx.hashtags_in(F.col("text")), ",").alias("tags"))


CLEAN = "list_filter(list_transform(COALESCE(hashtags, []), lambda t: lower(ltrim(trim(t), '#'))), lambda t: t <> '')"


@query("cl04_cl05_clean_and_map_tags", duck(f"SELECT video_id, array_to_string(CASE author WHEN 1 THEN ['nikerunning', 'ootd'] WHEN 2 THEN ['adidassamba', 'sneakers'] WHEN 3 THEN ['niketech', 'nikeshoes'] WHEN 4 THEN ['jacket', 'fashion'] WHEN 6 THEN ['adidasoriginals', 'airmax'] ELSE [] END, ',') AS tags, replace(replace(array_to_string(CASE author WHEN 1 THEN ['nikerunning', 'ootd'] WHEN 2 THEN ['adidassamba', 'sneakers'] WHEN 3 THEN ['niketech', 'nikeshoes'] WHEN 4 THEN ['jacket', 'fashion'] WHEN 6 THEN ['adidasoriginals', 'airmax'] ELSE [] END, ','), 'nikeshoes', 'shoes'), 'sneakers', 'shoes') AS normal FROM (SELECT *, CASE WHEN CAST(author_id AS BIGINT) % 7 < 4 THEN CAST(author_id AS BIGINT) % 7 + 1 WHEN CAST(author_id AS BIGINT) % 7 = 5 THEN 6 ELSE 5 END AS author FROM posts)"))
def _(spark, sf):
    p = posts(spark, sf).withColumn("hashtags", F.coalesce("hashtags", F.array().cast("array<string>")))
    tags, normal = cl.tags_of(F.col("caption_raw"), F.col("hashtags"), {"nikeshoes": "shoes", "sneakers": "shoes"})
    return p.select("video_id", F.array_join(tags, ",").alias("tags"), F.array_join(normal, ",").alias("normal"))


@query("cl06_infer_brand", duck("SELECT video_id, COALESCE(brand, CASE CAST(author_id AS BIGINT) % 7 WHEN 0 THEN 'north' WHEN 1 THEN 'south' WHEN 2 THEN 'north' WHEN 5 THEN 'south' END) AS brand FROM posts"))
def _(spark, sf):
    p = posts(spark, sf)
    return p.select("video_id", cl.infer_brand(F.concat(F.lit(" "), F.upper("brand")), tx.clean_tags(F.col("hashtags")), PREFIX).alias("brand"))


@query("cl07_cl08_lineage_and_official", duck("SELECT video_id, CASE WHEN source_type = 'hashtag' THEN source_query END AS seed_hashtag, author_username IN ('user_1', 'user_51') AS is_official FROM posts"))
def _(spark, sf):
    p = posts(spark, sf)
    return p.select("video_id", F.when(F.col("source_type") == "hashtag", F.col("source_query")).alias("seed_hashtag"), F.coalesce(F.lower("author_username"), F.lit("")).isin("user_1", "user_51").alias("is_official"))


@query("cl09_iso_time", duck("SELECT video_id, strftime(to_timestamp(create_time_ts), '%Y-%m-%dT%H:%M:%S') || '+00:00' AS create_time FROM posts"))
def _(spark, sf):
    return posts(spark, sf).select("video_id", cl.iso_time(F.col("create_time_ts")).alias("create_time"))


@query("cl10_latest_per_key", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def _(spark, sf):
    e = table(spark, sf, "events").withColumn("key", F.concat_ws("|", F.col("user_id").cast("string"), "event_type"))
    return cl.latest(e, "key", "ts", "event_id").select("user_id", "event_type", "event_id")


@query("cl11_silver_posts", duck("SELECT video_id, brand, source_type FROM posts"))
def _(spark, sf):
    raw = posts(spark, sf).withColumns({"crawled_at_ts": F.col("create_time_ts"), "raw_payload": F.lit("x"), "brand": F.coalesce("brand", F.lit(" "))}).withColumn("hashtags", F.array().cast("array<string>"))
    twice = raw.unionByName(raw.withColumn("crawled_at_ts", F.col("crawled_at_ts") - 5).withColumn("source_type", F.lit("old")))
    return cl.clean_posts(twice, PREFIX).select("video_id", "brand", "source_type")


@query("cl12_numbers", "SELECT event_id, TRY_CAST(CASE WHEN event_type = 'view' THEN 'n/a' WHEN event_type = 'click' THEN ' ' ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS v FROM events")
def _(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", number(F.when(F.col("event_type") == "view", "n/a").when(F.col("event_type") == "click", " ").otherwise(F.col("value").cast("string"))).alias("v"))


@query("cl13_comment_lineage", duck("SELECT comment_id, c.brand, p.brand AS brand_video, source_type, author_username FROM comments c LEFT JOIN posts p USING (video_id)"))
def _(spark, sf):
    return cl.with_lineage(comments(spark, sf), posts(spark, sf)).select("comment_id", "brand", "brand_video", "source_type", "author_username")


# --- features ---------------------------------------------------------------------------------


@query("fe01_urls", duck("SELECT video_id, 'https://www.example.com/@' || author_username || '/video/' || video_id AS video_url, 'https://www.example.com/@' || author_username AS author_url FROM posts"))
def _(spark, sf):
    return fe.with_urls(posts(spark, sf)).select("video_id", "video_url", "author_url")


@query("fe02_time_parts", duck("SELECT video_id, strftime(t, '%Y-%m-%d') AS post_date, hour(t) AS post_hour, (isodow(t) - 1) AS post_weekday FROM (SELECT video_id, to_timestamp(create_time_ts) AT TIME ZONE 'UTC' AS t FROM posts)"))
def _(spark, sf):
    return fe.with_time_parts(posts(spark, sf)).select("video_id", "post_date", "post_hour", "post_weekday")


@query("fe03_fe04_fe05_engagement", duck("SELECT video_id, CAST(engagement_count AS BIGINT) AS engagement_count, CASE WHEN view_count > 0 THEN engagement_count / view_count END AS engagement_rate, wer, bri FROM m", "engagement_rate", "wer", "bri"))
def _(spark, sf):
    return measured(spark, sf).select("video_id", "engagement_count", "engagement_rate", "wer", "bri")


@query("fe06_ratios", duck("SELECT video_id, like_count / nullif(view_count, 0) AS like_per_view, comment_count / nullif(view_count, 0) AS comment_per_view, share_count / nullif(view_count, 0) AS share_per_view, engagement_count / nullif(view_count, 0) AS engagement_per_view, comment_count / nullif(like_count, 0) AS comment_per_like FROM m", "like_per_view", "comment_per_view", "share_per_view", "engagement_per_view", "comment_per_like"))
def _(spark, sf):
    return fe.with_ratios(measured(spark, sf)).select("video_id", "like_per_view", "comment_per_view", "share_per_view", "engagement_per_view", "comment_per_like")


CAPTION = r"trim(regexp_replace(lower(regexp_replace(regexp_replace(COALESCE(caption_raw, ''), 'https?://\S+|www\.\S+', ' ', 'g'), '#[\p{L}\p{N}_]+', ' ', 'g')), '\s+', ' ', 'g'))"


@query("fe07_clean_caption", duck(f"SELECT video_id, {CAPTION} AS caption_clean FROM posts"))
def _(spark, sf):
    return posts(spark, sf).select("video_id", tx.clean_caption(F.col("caption_raw")).alias("caption_clean"))


@query("fe08_fe09_split_tags", "SELECT p_partkey, trim(regexp_replace(lower(translate(regexp_replace(t, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '_-', '  ')), '\\s+', ' ', 'g')) AS words FROM (SELECT p_partkey, replace(p_brand, '#', '') || 'Item' || replace(p_name, ' ', '_') AS t FROM part)")
def _(spark, sf):
    t = F.concat(F.replace(F.col("p_brand"), F.lit("#"), F.lit("")), F.lit("Item"), F.replace(F.col("p_name"), F.lit(" "), F.lit("_")))
    return table(spark, sf, "part").select("p_partkey", tx.split_token(t).alias("words"))


@query("fe10_embedding_text", duck(f"SELECT video_id, CASE WHEN c <> '' AND t <> '' THEN c || ' [HASHTAGS] ' || t WHEN c <> '' THEN c ELSE t END AS embedding_text FROM (SELECT video_id, {CAPTION} AS c, CASE CAST(author_id AS BIGINT) % 7 WHEN 0 THEN 'nikerunning nikerunning ootd ootd' WHEN 1 THEN 'adidassamba adidassamba sneakers sneakers' WHEN 2 THEN 'niketech niketech nikeshoes nikeshoes' WHEN 3 THEN 'jacket jacket fashion fashion' WHEN 5 THEN 'adidasoriginals adidasoriginals airmax airmax' ELSE '' END AS t FROM posts)"))
def _(spark, sf):
    return posts(spark, sf).select("video_id", tx.embedding_text(F.col("caption_raw"), tx.clean_tags(F.col("hashtags"))).alias("embedding_text"))


@query("fe11_cluster_text", None)
def _(spark, sf):
    brands, stop = ["north", "nike", "adidas"], ["fyp", "the", "this", "is", "to"]
    return posts(spark, sf).select("video_id", tx.scrub_for_clusters(F.col("caption_raw"), brands, stop).alias("text"), tx.cluster_tags(F.col("hashtags"), brands, stop).alias("tags"))


@query("fe12_counts", r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[ \t\n\f\r\v]+'), lambda w: w <> '')) AS words, len(regexp_extract_all(text, '#[\p{L}\p{N}_]+')) AS tags, len(regexp_extract_all(text, '@[\p{L}\p{N}_]+')) AS mentions FROM documents")
def _(spark, sf):
    d, c = table(spark, sf, "documents"), F.col("text")
    return d.select("doc_id", tx.word_count(c).alias("words"), F.size(tx.hashtags_in(c)).alias("tags"), tx.mention_count(c).alias("mentions"))


def _either(family):
    return "|".join(rules.load("cta")[family]).replace("'", "''")


CTA = ", ".join(f"regexp_matches(lower(COALESCE(caption_raw, '')), '{_either(f)}') AS has_{f}" for f in rules.load("cta"))


@query("fe13_cta_flags", duck(f"SELECT *, has_purchase OR has_engagement OR has_discovery AS has_cta FROM (SELECT video_id, {CTA} FROM posts)"))
def _(spark, sf):
    return fe.with_cta(posts(spark, sf)).select("video_id", *[f"has_{f}" for f in rules.load("cta")], "has_cta")


@query("fe14_fe15_creator_type_and_tier", duck("SELECT video_id, CASE WHEN is_official_brand THEN 'brand' WHEN author_signature = 'Running and gym' THEN 'sports' WHEN author_signature = 'daily vlog and style' THEN 'lifestyle' WHEN author_signature = 'makeup artist' THEN 'beauty' ELSE 'other' END AS creator_type, CASE WHEN author_follower_count < 10000 THEN 'nano' WHEN author_follower_count < 100000 THEN 'micro' WHEN author_follower_count < 1000000 THEN 'mid' WHEN author_follower_count < 10000000 THEN 'macro' WHEN author_follower_count IS NOT NULL THEN 'mega' END AS creator_tier FROM posts"))
def _(spark, sf):
    return posts(spark, sf).select("video_id", fe.creator_type(F.col("is_official_brand"), F.col("author_signature"), fe.CREATOR_FAMILIES).alias("creator_type"), fe.creator_tier(F.col("author_follower_count")).alias("creator_tier"))


@query("fe16_trending_audio", duck("SELECT video_id, COALESCE(music_id IN (SELECT music_id FROM (SELECT music_id, count(*) AS n FROM posts WHERE music_id IS NOT NULL GROUP BY music_id HAVING count(*) >= 3) WHERE n >= (SELECT quantile_cont(n, 0.9) FROM (SELECT count(*) AS n FROM posts WHERE music_id IS NOT NULL GROUP BY music_id HAVING count(*) >= 3))), false) AS is_trending_audio FROM posts"))
def _(spark, sf):
    return fe.with_trending_audio(posts(spark, sf)).select("video_id", "is_trending_audio")


@query("fe17_comment_features", duck(r"SELECT comment_id, length(comment_text) AS text_length, len(regexp_extract_all(COALESCE(comment_text, ''), '@[\p{L}\p{N}_]+')) AS mentions, len(list_filter(regexp_split_to_array(COALESCE(comment_text, ''), '\s+'), lambda w: w <> '')) AS words, " + CAPTION.replace("caption_raw", "comment_text") + " AS clean FROM comments"))
def _(spark, sf):
    c = F.col("comment_text")
    return comments(spark, sf).select("comment_id", F.length(c).alias("text_length"), tx.mention_count(c).alias("mentions"), tx.word_count(c).alias("words"), tx.clean_caption(c).alias("clean"))


@query("fe18_structure", duck(r"SELECT video_id, len(regexp_extract_all(c, '!')) AS n_exclaim, len(regexp_extract_all(c, '\?')) AS n_question, length(c) AS caption_length, regexp_matches(lower(c), '^\s*(?:pov|wait|stop|how to|why|this is)(?:$|[^a-z])') AS has_hook, regexp_matches(lower(c), '(?:what|which|who|how|would you)[^?]{0,80}\?') AS asks_question FROM (SELECT video_id, COALESCE(caption_raw, '') AS c FROM posts)"))
def _(spark, sf):
    return fe.with_structure(posts(spark, sf)).select("video_id", "n_exclaim", "n_question", "caption_length", "has_hook", "asks_question")


@query("fe19_crosses", duck("SELECT video_id, COALESCE(content_type[1], '__MISSING__') AS first_content, CASE WHEN video_duration_sec <= 15 THEN '0-15' WHEN video_duration_sec <= 30 THEN '15-30' WHEN video_duration_sec <= 45 THEN '30-45' ELSE '45+' END AS duration_bucket, CASE WHEN hour(t) <= 5 THEN 'night' WHEN hour(t) <= 11 THEN 'morning' WHEN hour(t) <= 17 THEN 'afternoon' ELSE 'evening' END AS hour_bucket, isodow(t) >= 6 AS is_weekend, strftime(date_trunc('week', t), '%Y-%m-%d') AS week_start, strftime(t, '%Y-%m') AS month, COALESCE(brand, '__MISSING__') || '|' || COALESCE(content_type[1], '__MISSING__') AS brand_x_content FROM (SELECT *, to_timestamp(create_time_ts) AT TIME ZONE 'UTC' AS t FROM posts)"))
def _(spark, sf):
    return fe.with_crosses(posts(spark, sf)).select("video_id", "first_content", "duration_bucket", "hour_bucket", "is_weekend", "week_start", "month", "brand_x_content")


@query("fe20_placeholders", duck("SELECT video_id, 'b1' AS crawl_batch_id, NULL::DOUBLE AS visual_score, NULL::VARCHAR AS crawl_at FROM posts"))
def _(spark, sf):
    out = fe.with_placeholders(posts(spark, sf).withColumn("crawled_at", F.lit("bad")), "b1", {"visual_score": "double", "video_id": "string"})
    return out.select("video_id", "crawl_batch_id", "visual_score", F.col("crawl_at").cast("string").alias("crawl_at"))


@query("fe21_display_text", duck(r"SELECT video_id, regexp_replace(regexp_replace(regexp_replace(caption_raw, '(?:\s*#\S+)+\s*$', ''), '^\s+', ''), '\s+$', '') AS display, CASE WHEN len(string_split(c, ' ')) >= 2 THEN c END AS title FROM (SELECT *, CASE WHEN length(t) <= 34 THEN t ELSE trim(regexp_extract(t[1:35], '^(.*)\s\S*$', 1)) END AS c FROM (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(COALESCE(caption_raw, ''), 'https?://\S+|www\.\S+', ' ', 'g'), '[#@]\S+', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM posts))"))
def _(spark, sf):
    c = F.col("caption_raw")
    return posts(spark, sf).select("video_id", tx.display_caption(c).alias("display"), tx.short_title(c).alias("title"))


@query("gold_feature_table", None)
def _(spark, sf):
    return fe.feature_table(posts(spark, sf)).drop("hashtags", "content_type", "product_lines", "brand_styles")
