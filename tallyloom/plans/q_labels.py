"""Queries of labels, language and sentiment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as tx
from ..operators import labels as lb
from ..operators import language as se
from ..operators import tables as ag
from ..sources.landing import cluster_map
from .common import comments, duck, floats, posts, table, tidy

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = lambda spark, sf: tidy(f(spark, sf))
        if sql:
            SQL[name] = sql
        return f

    return add


def _has(text, phrases):
    if not phrases:
        return "false"
    pattern = "|".join(map(tx.phrase_regex, phrases)).replace("'", "''")
    return f"regexp_matches({text}, '{pattern}')"


def _rule(text, rule, single=False):
    parts = [_has(text, rule.get("strong", []))]
    parts += ["(" + " AND ".join(_has(text, [p]) for p in pair) + ")" for pair in rule.get("pairs", [])]
    weak = rule.get("weak", [])
    if weak:
        n = " + ".join(f"CAST({_has(text, [p])} AS INT)" for p in weak)
        parts.append(f"({n}) >= 2")
        if single:
            one = " OR ".join(f"({_has(text, [p])} AND regexp_matches({text}, '{tx.tag_regex(p)}'))" for p in weak)
            parts.append(f"(({n}) = 1 AND ({one}))")
    return "(" + " OR ".join(parts) + ")"


def _labels_sql(rule_set, single=False):
    cases = []
    for label in rule_set["order"]:
        r = rule_set["labels"][label]
        match = _rule("t", r, single)
        if "triggers" in r:
            match = f"CASE WHEN {_has('t', r['strong'])} THEN true WHEN {_has('t', r['triggers'])} THEN {_has('t', r['context'])} ELSE {_rule('t', {k: r.get(k, []) for k in ('pairs', 'weak')})} END"
        if label == "collaboration":
            match = f"({match} OR t LIKE '%north x summit%')"
        cases.append(f"CASE WHEN {match} THEN '{label}' END")
    return "concat_ws(',', " + ", ".join(cases) + ")"


LOW = "SELECT video_id, lower(COALESCE(caption_raw, '')) AS t FROM posts"


@query("lb01_to_lb09_content_types", duck(f"SELECT video_id, {_labels_sql(rules.load('content'))} AS content_type FROM ({LOW})"))
def _(spark, sf):
    return posts(spark, sf).select("video_id", F.array_join(lb.content_types(F.col("caption_raw")), ",").alias("content_type"))


@query("lb10_social_mechanics", duck(f"SELECT video_id, {_labels_sql(rules.load('mechanics'), True)} AS social_mechanic FROM ({LOW})"))
def _(spark, sf):
    return posts(spark, sf).select("video_id", F.array_join(lb.social_mechanics(F.col("caption_raw")), ",").alias("social_mechanic"))


@query("lb02_phrase_as_tag", "SELECT doc_id, regexp_matches(lower(text), '" + tx.tag_regex("the tag") + "') AS as_tag, regexp_matches(lower(text), '" + tx.phrase_regex("all rights") + "') AS as_phrase FROM documents")
def _(spark, sf):
    low = F.lower("text")
    return table(spark, sf, "documents").select("doc_id", low.rlike(tx.tag_regex("the tag")).alias("as_tag"), tx.has_any(low, ["all rights"]).alias("as_phrase"))


@query("lb05_weak_hits", "SELECT doc_id, " + " + ".join(f"CAST(regexp_matches(lower(text), '{tx.phrase_regex(p)}') AS BIGINT)" for p in ("the", "with", "that", "this")) + " AS hits FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.hit_count(F.lower("text"), ["the", "with", "that", "this"]).alias("hits"))


WORDS_RULE = {"strong": ["licensed under", "idiot", "oron"], "pairs": [["the", "nicht"], ["that", "oution"]], "weak": ["for", "with the", "der", "la que", "ou"]}


@query("lb06_rule_over_texts", "SELECT doc_id, " + _rule("lower(COALESCE(text, ''))", WORDS_RULE, True) + " AS hit FROM documents")
def _(spark, sf):
    """Strong phrases, pairs and weak phrases over whole documents."""
    return table(spark, sf, "documents").select("doc_id", tx.once(F.lower(F.coalesce("text", F.lit(""))), lambda t: tx.match_rule(t, WORDS_RULE, True)).alias("hit"))


@query("lb11_one_hot", duck("SELECT video_id, COALESCE(list_contains(content_type, 'promo'), false) AS is_promo, COALESCE(list_contains(content_type, 'collab'), false) AS is_collab FROM posts"))
def _(spark, sf):
    return lb.one_hot(posts(spark, sf), "content_type", ["promo", "collab"], "is_").select("video_id", "is_promo", "is_collab")


def _tagged():
    return "CASE CAST(author_id AS BIGINT) % 7 WHEN 0 THEN ['nikerunning', 'ootd'] WHEN 1 THEN ['adidassamba', 'sneakers'] WHEN 2 THEN ['niketech', 'nikeshoes'] WHEN 3 THEN ['jacket', 'fashion'] WHEN 5 THEN ['adidasoriginals', 'airmax'] ELSE CAST([] AS VARCHAR[]) END"


@query("lb12_brand_styles", duck(f"SELECT video_id, concat_ws(',', CASE WHEN list_contains(tags, 'nikerunning') OR c = 7 THEN 'performance' END, CASE WHEN list_contains(tags, 'niketech') OR c = 7 THEN 'technical' END) AS styles FROM (SELECT video_id, {_tagged()} AS tags, CAST(video_id AS BIGINT) % 12 AS c FROM posts)"))
def _(spark, sf):
    return posts(spark, sf).select("video_id", F.array_join(lb.brand_styles(F.col("caption_raw"), tx.clean_tags(F.col("hashtags")), rules.load("taxonomy")), ",").alias("styles"))


@query("lb13_lb14_lines_and_categories", duck("SELECT video_id, CASE a WHEN 1 THEN 'samba' WHEN 2 THEN 'tech_fleece' WHEN 5 THEN 'air_max,originals_apparel' ELSE '' END AS lines, CASE WHEN a = 1 THEN 'shoes' WHEN a = 2 THEN 'apparel' WHEN a = 5 THEN 'shoes,apparel' WHEN a = 3 THEN 'apparel' WHEN c = 8 THEN 'shoes' ELSE 'uncategorized' END AS categories FROM (SELECT video_id, CAST(author_id AS BIGINT) % 7 AS a, CAST(video_id AS BIGINT) % 12 AS c FROM posts)"))
def _(spark, sf):
    tags, taxonomy = tx.clean_tags(F.col("hashtags")), rules.load("taxonomy")
    lines = lb.product_lines(tags, taxonomy)
    return posts(spark, sf).select("video_id", F.array_join(lines, ",").alias("lines"), F.array_join(lb.product_categories(lines, tags, F.col("caption_raw"), taxonomy), ",").alias("categories"))


@query("lb15_refresh_report", duck(f"SELECT \"column\", label, count(*) AS n, count(*) / (SELECT count(*) FROM posts) AS share FROM (SELECT 'content_type' AS \"column\", unnest(string_split({_labels_sql(rules.load('content'))}, ',')) AS label FROM ({LOW}) UNION ALL SELECT 'social_mechanic', unnest(string_split({_labels_sql(rules.load('mechanics'), True)}, ',')) FROM ({LOW})) WHERE label <> '' GROUP BY ALL", "share"))
def _(spark, sf):
    return lb.refresh_report(posts(spark, sf))


@query("lb16_display_lines", duck("SELECT video_id, array_to_string(list_filter(product_lines, lambda x: CASE x WHEN 'tech_fleece' THEN 'north' WHEN 'air_max' THEN 'north' ELSE 'south' END = brand), ',') AS lines FROM posts"))
def _(spark, sf):
    return posts(spark, sf).select("video_id", F.array_join(lb.display_lines(F.col("product_lines"), F.col("brand"), rules.load("taxonomy")), ",").alias("lines"))


@query("lb17_margin_gate", "SELECT event_id, CASE WHEN value >= 10 AND event_type <> 'error' THEN event_type END AS label, CASE WHEN event_type <> 'error' THEN event_type END AS label_likely, CASE WHEN event_type = 'error' THEN 'missing' WHEN value >= 10 THEN 'ok' ELSE 'low_confidence' END AS status FROM events")
def _(spark, sf):
    label = F.when(F.col("event_type") != "error", F.col("event_type"))
    return table(spark, sf, "events").select("event_id", *[c.alias(n) for n, c in lb.margin_gate(label, F.col("value"), 10).items()])


@query("lb18_humanize", duck("SELECT DISTINCT author_signature AS raw, COALESCE(CASE author_signature WHEN 'daily vlog and style' THEN 'Daily Vlog And Style' WHEN 'Running and gym' THEN 'Running And Gym' WHEN 'makeup artist' THEN 'Makeup Artist' END || ' POV', 'Unclassified') AS label FROM posts"))
def _(spark, sf):
    raw = F.col("author_signature")
    return posts(spark, sf).select(raw.alias("raw"), lb.humanize(F.concat(F.translate(raw, " ", "_"), F.lit("_pov"))).alias("label")).distinct()


TOPIC_OF = {0: ("price_value", "price_value,product_model,generic_positive"), 1: ("fit_comfort", "fit_comfort,product_model"), 2: ("meme_chatter", "meme_chatter"), 3: ("availability", "availability"), 4: ("design_aesthetics", "design_aesthetics"), 5: ("quality_performance", "quality_performance"), 6: ("generic_positive", "generic_positive"), 7: ("meme_chatter", "meme_chatter"), 8: ("meme_chatter", "meme_chatter"), 9: ("price_value", "price_value,generic_product_reaction"), 10: ("other_unclear", "other_unclear")}
_K = "(CASE comment_text " + " ".join("WHEN '" + t + f"' THEN {i}" for i, t in enumerate(["these sambas look fire but too expensive", "sambas are super comfy", "[sticker]", "where can i find them", "nike tech is so ugly", "not good at all, really bad quality", "love love love!!", "@friend look", "lol", "very nice shoes, best price", "hm interesting thing"])) + " ELSE 11 END)"


@query("lb19_lb20_comment_topics", duck(f"SELECT comment_id, CASE {_K} " + " ".join(f"WHEN {k} THEN '{a}'" for k, (a, _) in TOPIC_OF.items()) + f" ELSE 'other_unclear' END AS topic, CASE {_K} " + " ".join(f"WHEN {k} THEN '{b}'" for k, (_, b) in TOPIC_OF.items()) + " ELSE 'other_unclear' END AS topics FROM comments"))
def _(spark, sf):
    found = comments(spark, sf).select("comment_id", lb.comment_topics(F.col("comment_text"), rules.load("topics")).alias("found"))
    return found.select("comment_id", F.col("found.topic").alias("topic"), F.array_join("found.topics", ",").alias("topics"))


@query("lb21_first_text", duck("SELECT comment_id, COALESCE(CASE WHEN comment_like_count > 40 THEN 'translated' END, trim(comment_text)) AS text FROM comments"))
def _(spark, sf):
    c = comments(spark, sf).withColumns({"en": F.when(F.col("comment_like_count") > 40, "translated"), "clean": F.lit("  ")})
    return c.select("comment_id", lb.comment_text(c, "en", "clean", "missing", "comment_text").alias("text"))


@query("lb22_map_clusters", "SELECT vec_id, CASE label WHEN 0 THEN 'price_value' WHEN 1 THEN 'fit_comfort' ELSE 'other_unclear' END AS topic FROM embeddings")
def _(spark, sf):
    names = cluster_map(spark, {"0": "Price", "1": "fit_comfort"})
    return lb.map_clusters(table(spark, sf, "embeddings"), names, {"price": "price_value"}, "label").select("vec_id", "topic")


def _topic_rows():
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    topics = rules.load("topics")
    layer = {t["id"]: t["layer"] for t in topics["topics"]}
    return ", ".join(f"({quote(t)}, {quote(layer[t])}, {quote(p)}, {i}, {quote(tx.phrase_regex(p))})" for t, ps in topics["words"].items() for i, p in enumerate(ps))


@query("lb23_lexicon_examples", duck(f"SELECT topic, layer, string_agg(phrase, ', ' ORDER BY rank) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY contains(phrase, ' ') DESC, ord) AS rank FROM (SELECT DISTINCT topic, layer, phrase, ord FROM (SELECT DISTINCT lower(comment_text) AS t FROM comments) JOIN (VALUES {_topic_rows()}) AS p(topic, layer, phrase, ord, pattern) ON regexp_matches(t, pattern)) WHERE contains(phrase, ' ') OR length(phrase) >= 3) WHERE rank <= 3 GROUP BY topic, layer"))
def _(spark, sf):
    """Examples of the shipped lexicon that the comments really use."""
    topics = rules.load("topics")
    phrases = spark.createDataFrame([(t, p, i) for t, ps in topics["words"].items() for i, p in enumerate(ps)], "topic string, phrase string, ord int").join(rules.topic_table(spark), "topic")
    every = [p for ps in topics["words"].values() for p in ps]
    found = comments(spark, sf).select(F.explode(tx.phrases_found(F.lower(F.coalesce("comment_text", F.lit(""))), every)).alias("phrase")).distinct()
    return lb.lexicon_examples(phrases.join(found, "phrase"))


@query("lb24_partner_rules", duck("SELECT video_id, CASE WHEN brand = 'north' THEN 'none' WHEN source_type = 'user' THEN 'other' ELSE 'hashtag' END AS partner_type, CASE WHEN is_official_brand THEN 'high' ELSE 'unclear' END AS confidence, CASE WHEN brand = 'south' THEN 'south' END AS partner_name FROM posts"))
def _(spark, sf):
    p = posts(spark, sf).select("video_id", F.upper("source_type").alias("partner_type"), F.when(F.col("is_official_brand"), " High ").otherwise("?").alias("confidence"), F.coalesce("brand", F.lit(" ")).alias("partner_name"))
    return lb.normalize_partner(p, ["hashtag", "none"], ["high"], {"north": "north"})


@query("lb25_drop_catch_all", duck("SELECT video_id, CASE WHEN CAST(author_id AS BIGINT) % 3 <> 0 THEN visual_format END AS label FROM posts"))
def _(spark, sf):
    raw = F.when(F.col("author_id").cast("long") % 3 == 0, F.lit(" Other ")).otherwise(F.col("visual_format"))
    return posts(spark, sf).select("video_id", lb.drop_catch_all(raw).alias("label"))


@query("lb26_topic_dimension", duck("SELECT topic, layer, count(*) AS n FROM (SELECT topic, CASE WHEN topic IN ('price_value', 'fit_comfort', 'availability') THEN 'substantive' ELSE 'social' END AS layer FROM comments) GROUP BY ALL"))
def _(spark, sf):
    return comments(spark, sf).join(rules.topic_table(spark), "topic").groupBy("topic", "layer").agg(F.count("*").alias("n"))


@query("lb27_rule_misses", duck("SELECT video_id FROM posts WHERE COALESCE(len(content_type), 0) = 0 AND length(trim(caption_raw)) >= 8"))
def _(spark, sf):
    return lb.rule_misses(posts(spark, sf)).select("video_id")


# --- language and sentiment -------------------------------------------------------------------


@query("se01_detection_text", r"SELECT doc_id, trim(regexp_replace(lower(regexp_replace(text, 'https?://\S+|www\.\S+|[@#][\p{L}\p{N}_]+', ' ', 'g')), '\s+', ' ', 'g')) AS t FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", se.detection_text(F.col("text")).alias("t"))


@query("se02_script_flags", None)
def _(spark, sf):
    flags = se.script_flags(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", *[c.alias(n) for n, c in flags.items()])


@query("se03_detect_language", None)
def _(spark, sf):
    docs = table(spark, sf, "documents")
    return se.detect_language(docs, "doc_id", "text", se.word_profiles(docs, "text", "lang"))


def routed(spark, sf):
    c = comments(spark, sf)
    lang = F.when(F.col("comment_text").isNull(), "und").when(F.col("comment_like_count") % 3 == 0, "de").otherwise("en")
    sure = F.when(F.col("comment_like_count") % 5 == 0, 0.5).otherwise(0.9)
    return c.select("comment_id", F.col("comment_text").alias("text"), lang.alias("lang"), sure.alias("confidence"))


ROUTE = "SELECT comment_id, CASE WHEN lang = 'und' OR text = '' THEN 'not_scored' WHEN lang = 'en' AND sure < 0.8 THEN 'not_scored' WHEN lang = 'en' THEN 'lexicon_en' {m} END AS sentiment_method, CASE WHEN lang <> 'de' THEN 'not_applicable' {s} END AS translation_status FROM (SELECT comment_id, comment_text AS text, CASE WHEN comment_text IS NULL THEN 'und' WHEN comment_like_count % 3 = 0 THEN 'de' ELSE 'en' END AS lang, CASE WHEN comment_like_count % 5 = 0 THEN 0.5 ELSE 0.9 END AS sure FROM comments)"


@query("se04_route_without_translation", duck(ROUTE.format(m="ELSE 'not_scored_non_en'", s="ELSE 'pending'")))
def _(spark, sf):
    route = se.route_sentiment(F.col("lang"), F.col("confidence"), F.col("text"), F.lit(False), False)
    return routed(spark, sf).withColumns(route).select("comment_id", "sentiment_method", "translation_status")


@query("se04_ud03_route_with_translation", duck(ROUTE.format(m="WHEN length(text) < 8 THEN 'not_scored_non_en' ELSE 'lexicon_via_mt'", s="WHEN length(text) < 8 THEN 'skipped' ELSE 'done'")))
def _(spark, sf):
    route = se.route_sentiment(F.col("lang"), F.col("confidence"), F.col("text"), F.lit(False), True, F.concat(F.lit("en: "), F.col("text")))
    return routed(spark, sf).withColumns(route).select("comment_id", "sentiment_method", "translation_status")


SCORES = {0: 1.4 - 1.1, 1: 1.6 + 0.293, 4: -2.3 - 0.293, 5: 1.9 * -0.74 - 2.5 - 0.293, 6: 9.6, 9: 1.8 + 0.293 + 3.2}


@query("se05_lexicon_score", duck(f"SELECT comment_id, s / sqrt(s * s + 15) AS score FROM (SELECT comment_id, CASE {_K} " + " ".join(f"WHEN {k} THEN CAST({v!r} AS DOUBLE)" for k, v in SCORES.items()) + " ELSE 0.0 END AS s FROM comments)", "score"))
def _(spark, sf):
    return comments(spark, sf).select("comment_id", se.lexicon_score(F.col("comment_text")).alias("score"))


@query("se06_rescore_backlog", duck("SELECT 'done' AS translation_status, count(*) FILTER (length(comment_text) >= 8) AS n FROM comments WHERE comment_like_count % 3 = 0 AND comment_text IS NOT NULL UNION ALL SELECT 'skipped', count(*) FILTER (length(comment_text) < 8) FROM comments WHERE comment_like_count % 3 = 0 AND comment_text IS NOT NULL"))
def _(spark, sf):
    route = se.route_sentiment(F.col("lang"), F.col("confidence"), F.col("text"), F.lit(False), False)
    df = routed(spark, sf).withColumns(route).withColumn("sentiment_score", F.lit(None).cast("double")).drop("scored_text")
    return se.rescore_backlog(df, lambda t, lang: F.concat(F.lit("en "), t), None)[1]


@query("se07_polarity", duck("SELECT comment_id, CASE WHEN sentiment_score <= -0.05 THEN 'negative' WHEN sentiment_score >= 0.05 THEN 'positive' WHEN sentiment_score IS NOT NULL THEN 'neutral' END AS polarity FROM comments"))
def _(spark, sf):
    return comments(spark, sf).select("comment_id", ag.polarity(F.col("sentiment_score")).alias("polarity"))


@query("se08_scored_rows", duck("SELECT comment_id FROM comments WHERE sentiment_score IS NOT NULL"))
def _(spark, sf):
    return comments(spark, sf).where(F.col("sentiment_score").isNotNull()).select("comment_id")


AUDIENCE = "SELECT video_id, count(*) AS scored, avg(CAST(sentiment_score >= 0.05 AS INT)) AS positive, avg(CAST(sentiment_score <= -0.05 AS INT)) AS negative, avg(CAST(sentiment_score >= 0.05 AS INT)) - avg(CAST(sentiment_score <= -0.05 AS INT)) AS net FROM comments WHERE sentiment_score IS NOT NULL GROUP BY video_id"


@query("se09_audience", duck(AUDIENCE, "positive", "negative", "net"))
def _(spark, sf):
    return se.audience(comments(spark, sf))


@query("se10_audience_of_posts", duck(f"SELECT video_id, scored, net FROM posts LEFT JOIN ({AUDIENCE}) USING (video_id)", "net"))
def _(spark, sf):
    return posts(spark, sf).select("video_id").join(se.audience(comments(spark, sf)), "video_id", "left").select("video_id", "scored", "net")


@query("se11_unusable_translation", duck("SELECT comment_id, comment_text IS NULL OR comment_like_count % 4 <> 3 AS bad FROM comments"))
def _(spark, sf):
    c = F.col("comment_text")
    k = F.col("comment_like_count") % 4
    out = F.when(k == 0, F.lit(" ")).when(k == 1, F.upper(c)).when(k == 2, F.lit("Error 503: too many requests")).otherwise(F.concat(F.lit("x "), c))
    return comments(spark, sf).select("comment_id", F.coalesce(se.unusable_translation(c, out), F.lit(True)).alias("bad"))
