"""Queries of search, retrieval, relevance and quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as fe
from ..operators import quality as dq
from ..operators import retrieval as rt
from . import bindings
from .common import comments, duck, floats, measured, posts, settled, table, tidy

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = lambda spark, sf: tidy(f(spark, sf))
        if sql:
            SQL[name] = sql
        return f

    return add


@query("rt01_library", duck("SELECT video_id, COALESCE(len(content_type), 0) AS n_types, COALESCE(has_discovery_traffic_cta, false) AS has_discovery_traffic_cta, CAST(view_count AS DOUBLE) AS view_count, NULL::VARCHAR AS cover FROM posts", "view_count"))
def _(spark, sf):
    out = rt.library(posts(spark, sf), ["content_type", "missing_list"], ["has_discovery_traffic_cta"], ["view_count"], {"cover": "string"})
    return out.select("video_id", F.size("content_type").alias("n_types"), "has_discovery_traffic_cta", "view_count", "cover")


SEARCH = "SELECT *, lower(concat_ws(' ', COALESCE(caption_raw, ''), COALESCE(author_username, ''), COALESCE(brand, ''), array_to_string(COALESCE(product_lines, []), ' '), array_to_string(list_transform(COALESCE(hashtags, []), lambda t: '#' || t), ' '))) AS search_text FROM m"


def searchable(spark, sf):
    return rt.search_text(measured(spark, sf), ["caption_raw", "author_username", "brand"], ["product_lines"])


@query("rt02_search_text", duck(f"SELECT video_id, search_text FROM ({SEARCH})"))
def _(spark, sf):
    return searchable(spark, sf).select("video_id", "search_text")


@query("rt03_search", duck(f"SELECT video_id, total FROM (SELECT *, count(*) OVER () AS total FROM ({SEARCH}) WHERE contains(search_text, 'shop') AND contains(search_text, '#nike') AND brand IN ('north') AND len(list_intersect(content_type, ['promo', 'collab'])) > 0) ORDER BY CAST(COALESCE(view_count >= 100000, false) AS INT) DESC, wer DESC NULLS LAST, view_count DESC NULLS LAST, video_id LIMIT 24"))
def _(spark, sf):
    return rt.search(searchable(spark, sf), "Shop #nike", {"brand": ["north"], "content_type": ["promo", "collab"], "source_type": []}).select("video_id", "total")


@query("rt04_facets", duck("SELECT video_id FROM posts WHERE brand IN ('north', 'south') AND len(list_intersect(product_lines, ['samba'])) > 0"))
def _(spark, sf):
    p = posts(spark, sf)
    return p.where(rt.facet(p, {"brand": ["north", "south"], "product_lines": ["samba"]})).select("video_id")


@query("rt05_high_performers", duck("SELECT video_id FROM m WHERE wer >= (SELECT quantile_cont(wer, 0.9) FROM m) AND view_count >= 10000"))
def _(spark, sf):
    return rt.high_performers(measured(spark, sf), views=10_000).select("video_id")


def with_vector_keys(spark, sf, p):
    """Each post with the keys of its text and visual vector; some lack one."""
    k, n = F.col("video_id").cast("long"), F.lit(table(spark, sf, "embeddings").count())
    return p.withColumns({"t_id": F.when(k % 7 != 0, k % n), "v_id": F.when(k % 5 != 0, (k * 3) % n)})


def with_vectors(spark, sf, p):
    """Each post with a text and a visual vector by its key; some lack one."""
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    p = with_vector_keys(spark, sf, p).withColumns({"strategy": F.concat(F.coalesce("content_type", F.array().cast("array<string>")), F.coalesce("brand_styles", F.array().cast("array<string>"))), "categories": F.col("product_lines")})
    p = p.join(e.withColumnsRenamed({"vec_id": "t_id", "embedding": "text_vec"}), "t_id", "left")
    return p.join(e.withColumnsRenamed({"vec_id": "v_id", "embedding": "visual_vec"}), "v_id", "left")


def vectors(spark, sf):
    return with_vectors(spark, sf, measured(spark, sf))


def compared(spark, sf):
    """What the searches read of the posts, without medians and vectors, written once."""
    p = fe.with_engagement(bindings.posts(spark, sf))
    return settled(p.select("video_id", "author_id", "wer", "view_count", "product_lines", "content_type", "brand_styles", "visual_format"))


def candidates(spark, sf, k=6, p=None):
    """Queries and pool are chosen before any vector is joined."""
    p = compared(spark, sf) if p is None else p
    chosen = p.where("cast(video_id as long) % 100 = 0"), rt.high_performers(p, views=10_000)
    return rt.similar(*[with_vectors(spark, sf, x) for x in chosen], k)


VEC = "v AS (SELECT m.*, t.u AS tv, w.u AS vv, list_distinct(list_concat(COALESCE(content_type, []), COALESCE(brand_styles, []))) AS strategy, CAST(video_id AS BIGINT) AS k FROM m LEFT JOIN (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS u FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)) t ON t.vec_id = CAST(video_id AS BIGINT) % (SELECT count(*) FROM embeddings) AND CAST(video_id AS BIGINT) % 7 <> 0 LEFT JOIN (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS u FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)) w ON w.vec_id = (CAST(video_id AS BIGINT) * 3) % (SELECT count(*) FROM embeddings) AND CAST(video_id AS BIGINT) % 5 <> 0)"
PAIRS = VEC + """, pairs AS (SELECT q.video_id AS query_id, c.video_id, c.author_id, CASE WHEN q.tv IS NOT NULL THEN COALESCE(list_dot_product(q.tv, c.tv), 0) END AS text_sim, CASE WHEN q.vv IS NOT NULL THEN COALESCE(list_dot_product(q.vv, c.vv), 0) END AS visual_sim,
  CASE WHEN len(q.strategy) > 0 THEN len(list_intersect(q.strategy, c.strategy)) / (len(list_distinct(list_concat(q.strategy, c.strategy))) + 1) END AS overlap, len(q.product_lines) > 0 AND len(c.product_lines) > 0 AND len(list_intersect(q.product_lines, c.product_lines)) = 0 AS category_conflict
  FROM (SELECT * FROM v WHERE k % 100 = 0) q CROSS JOIN (SELECT * FROM v WHERE wer >= (SELECT quantile_cont(wer, 0.9) FROM m) AND view_count >= 10000) c WHERE q.video_id <> c.video_id),
scored AS (SELECT *, round(COALESCE(text_sim, 0) * 0.4 + COALESCE(visual_sim, 0) * 0.4 + COALESCE(overlap, 0) * 0.2 - CASE WHEN category_conflict THEN 0.1 ELSE 0 END, 9) AS score FROM pairs WHERE text_sim IS NOT NULL OR visual_sim IS NOT NULL OR overlap IS NOT NULL),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, author_id ORDER BY score DESC, video_id DESC) AS a FROM scored) WHERE a = 1), ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, video_id) AS rank FROM one) WHERE rank <= 6)"""


def _cte(cte, q, *columns):
    from .q_tables import with_cte

    return with_cte(cte, q, *columns)


@query("rt06_rt07_jn07_similar", _cte(PAIRS, "SELECT query_id, rank, round(score, 4) AS score, category_conflict FROM ranked", "score"))
def _(spark, sf):
    return candidates(spark, sf).select("query_id", "rank", F.round("score", 4).alias("score"), "category_conflict")


@query("rt08_shared_labels", duck("SELECT a.video_id, array_to_string(list_filter(a.product_lines, lambda x: list_contains(b.product_lines, x)), ',') AS shared FROM posts a JOIN posts b ON CAST(b.video_id AS BIGINT) = CAST(a.video_id AS BIGINT) + 7 WHERE len(list_intersect(a.product_lines, b.product_lines)) > 0"))
def _(spark, sf):
    p = posts(spark, sf)
    other = p.select((F.col("video_id").cast("long") - 7).cast("string").alias("video_id"), F.col("product_lines").alias("other_lines"), F.lit(None).cast("array<string>").alias("nothing"))
    out = p.join(other, "video_id").withColumn("shared", rt.shared_labels([("product_lines", "other_lines"), ("content_type", "nothing")]))
    return out.where(F.size("shared") > 0).select("video_id", F.array_join("shared", ",").alias("shared"))


def judged(spark, sf):
    p = compared(spark, sf)
    v = p.select("video_id", "product_lines", "content_type", "brand_styles", "visual_format")
    q = v.where("cast(video_id as long) % 100 = 0").withColumnsRenamed({c: f"q_{c}" for c in v.columns})
    rows = candidates(spark, sf, p=p).join(v, "video_id").join(q, F.col("query_id") == F.col("q_video_id"))
    over = lambda c: F.coalesce(F.arrays_overlap(c, f"q_{c}"), F.lit(False))
    dims = rt.aligned_dimensions(F.col("text_sim"), F.col("visual_sim"), over("product_lines"), over("content_type"), over("content_type") | over("brand_styles"), F.coalesce(F.col("visual_format") == F.col("q_visual_format"), F.lit(False)), F.col("visual_sim").isNotNull() | (F.col("visual_format").isNotNull() & F.col("q_visual_format").isNotNull()))
    return rows.withColumn("dims", dims).withColumn("relevant", rt.is_relevant(F.col("dims")))


OVER = lambda c: f"COALESCE(len(list_intersect(a.{c}, b.{c})) > 0, false)"
JUDGED = PAIRS + f""", j0 AS (SELECT r.*, {OVER('product_lines')} AS sp, {OVER('content_type')} AS st, {OVER('brand_styles')} AS ss, COALESCE(a.visual_format = b.visual_format, false) AS sf, r.visual_sim IS NOT NULL OR (a.visual_format IS NOT NULL AND b.visual_format IS NOT NULL) AS vk, COALESCE(text_sim, 0) AS t, COALESCE(visual_sim, 0) AS vs FROM ranked r JOIN posts a ON a.video_id = r.video_id JOIN posts b ON b.video_id = r.query_id),
j AS (SELECT *, sp AND t >= 0.40 AS d1, t >= 0.55 OR (st AND t >= 0.40) AS d2, (vs >= 0.75 OR sf) AND vk AS d3, st OR ss AS d4, (CAST(sp AND t >= 0.40 AS INT) + CAST(t >= 0.55 OR (st AND t >= 0.40) AS INT) + CAST((vs >= 0.75 OR sf) AND vk AS INT) + CAST(st OR ss AS INT) >= 2) AND ((sp AND t >= 0.40) OR t >= 0.55 OR (st AND t >= 0.40)) AS relevant FROM j0)"""


@query("rt09_rt10_relevance", _cte(JUDGED, "SELECT query_id, rank, concat_ws(',', CASE WHEN d1 THEN 'subject_product' END, CASE WHEN d2 THEN 'narrative_intent' END, CASE WHEN d3 THEN 'visual_presentation' END, CASE WHEN d4 THEN 'creative_strategy' END) AS dims, relevant FROM j"))
def _(spark, sf):
    return judged(spark, sf).select("query_id", "rank", F.array_join("dims", ",").alias("dims"), "relevant")


@query("rt11_assess", _cte(JUDGED + ", b AS (SELECT *, COALESCE(sum(CAST(relevant AS INT)) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM j)", "SELECT query_id, count(*) FILTER (NOT relevant) AS excluded, count(*) FILTER (relevant) AS relevant, count(*) FILTER (relevant) >= 2 AS pattern_allowed FROM b WHERE before < 3 GROUP BY query_id"))
def _(spark, sf):
    return rt.assess(judged(spark, sf), 3).drop("picks")


@query("rt12_evidence", _cte(PAIRS, "SELECT v.video_id, COALESCE(n, 0) AS n FROM (SELECT video_id FROM v WHERE k % 100 = 0) v LEFT JOIN (SELECT query_id, count(*) AS n FROM ranked GROUP BY 1) ON query_id = v.video_id"))
def _(spark, sf):
    q = posts(spark, sf).where("cast(video_id as long) % 100 = 0").select("video_id", "brand", "caption_raw")
    out = rt.evidence(q, candidates(spark, sf), columns=["score", "text_sim"])
    return out.select("video_id", F.coalesce(F.json_array_length(F.get_json_object("record", "$.comparables")), F.lit(0)).alias("n"))


@query("rt13_coverage_profile", duck("SELECT 'content_type' AS facet, label, count(*) AS n, count(*) < 4000 AS is_gap FROM (SELECT unnest(content_type) AS label FROM posts) GROUP BY label UNION ALL SELECT 'brand', brand, count(*), count(*) < 4000 FROM posts WHERE brand IS NOT NULL GROUP BY brand"))
def _(spark, sf):
    return rt.coverage_profile(posts(spark, sf), ["content_type", "brand"], 4000)


@query("rt14_guard", duck("SELECT comment_id, concat_ws(',', CASE WHEN k = 0 THEN 'causal' END, CASE WHEN k = 1 THEN 'interpretive' END, CASE WHEN k <= 1 THEN 'speculative' END) AS problems, CASE k WHEN 0 THEN 'leads to' WHEN 1 THEN 'clearly' END AS first_hit FROM (SELECT comment_id, comment_like_count % 4 AS k FROM comments)"))
def _(spark, sf):
    k = F.col("comment_like_count") % 4
    text = F.when(k == 0, "It leads to sales and might grow").when(k == 1, "Clearly this may have worked").otherwise("Plain words")
    flags = rt.guard_flags(text)
    return comments(spark, sf).select("comment_id", F.array_join(flags["problems"], ",").alias("problems"), flags["first_hit"].alias("first_hit"))


@query("rt15_record_issues", duck("SELECT video_id, concat_ws(',', CASE WHEN len(hashtags) > 0 THEN NULL ELSE 'has_tags' END, CASE WHEN len(content_type) <= 2 THEN NULL ELSE 'few_labels' END, CASE WHEN view_count IS NOT NULL THEN NULL ELSE 'has_views' END) AS issues FROM posts"))
def _(spark, sf):
    return posts(spark, sf).select("video_id", F.array_join(rt.record_issues({"has_tags": F.size("hashtags") > 0, "few_labels": F.size("content_type") <= 2, "has_views": F.col("view_count").isNotNull()}), ",").alias("issues"))


@query("rt16_card", duck("SELECT video_id, brand, view_count FROM posts WHERE video_id = '1234'"))
def _(spark, sf):
    c = rt.card(posts(spark, sf), "video_id", "1234", ["brand", "view_count", "content_type"])
    return c.select("video_id", F.get_json_object("card", "$.brand").alias("brand"), F.get_json_object("card", "$.view_count").cast("long").alias("view_count"))


@query("rt17_leaf_paths", duck("SELECT video_id, concat_ws(',', 'video_id', CASE WHEN trim(brand) <> '' THEN 'n.brand' END, CASE WHEN len(content_type) > 0 THEN 'n.labels.content_type' END, CASE WHEN view_count IS NOT NULL THEN 'n.labels.view_count' END) AS paths FROM posts"))
def _(spark, sf):
    p = posts(spark, sf).select("video_id", F.struct("brand", F.struct("content_type", "view_count").alias("labels")).alias("n"))
    return p.select("video_id", F.array_join(rt.leaf_paths(p), ",").alias("paths"))


@query("rt18_unshared_citations", duck("SELECT video_id, peer, cited FROM (SELECT video_id, peer, unnest(content_type) AS cited, other FROM (SELECT a.video_id, b.video_id AS peer, a.content_type, COALESCE(b.content_type, []) AS other FROM posts a JOIN posts b ON CAST(b.video_id AS BIGINT) = CAST(a.video_id AS BIGINT) + 1)) WHERE NOT list_contains(other, cited)"))
def _(spark, sf):
    p = posts(spark, sf)
    peer = p.select((F.col("video_id").cast("long") - 1).cast("string").alias("video_id"), F.array(F.struct(F.col("video_id").alias("id"), F.col("content_type").alias("labels"))).alias("peers"))
    return rt.unshared_citations(p.join(peer, "video_id"), "content_type", "peers", "video_id")


# --- data quality -----------------------------------------------------------------------------


@query("dq01_validate", duck("SELECT 'allowed_brand' AS rule, CAST(count(*) FILTER (brand NOT IN ('north')) AS BIGINT) AS violations FROM m UNION ALL SELECT 'range_wer', count(*) FILTER (wer < 0 OR wer > 1) FROM m UNION ALL SELECT 'range_view_count', count(*) FILTER (view_count < 0) FROM m UNION ALL SELECT 'required_nothing', 1 UNION ALL SELECT 'floor_content_type', 0 UNION ALL SELECT 'floor_brand', 1"))
def _(spark, sf):
    return dq.validate(measured(spark, sf), required=["video_id", "nothing"], allowed={"brand": ["north"]}, ranges={"wer": (0, 1), "view_count": (0, None)}, floors={"content_type": 0.1, "brand": 0.99}, strict=True)


@query("dq02_filled_rates", duck("SELECT count(brand) / count(*) AS brand, count(*) FILTER (len(content_type) > 0) / count(*) AS content_type, count(*) FILTER (trim(caption_raw) <> '') / count(*) AS caption_raw FROM posts", "brand", "content_type", "caption_raw"))
def _(spark, sf):
    return dq.filled_rates(posts(spark, sf), ["brand", "content_type", "caption_raw"])


@query("dq03_coverage_note", duck("SELECT brand, printf('coverage: %d of %d (%.1f%%)', count(*) FILTER (len(content_type) > 0), count(*), count(*) FILTER (len(content_type) > 0) * 100.0 / count(*)) AS note FROM posts GROUP BY brand"))
def _(spark, sf):
    n = posts(spark, sf).groupBy("brand").agg(F.sum(F.coalesce(F.size("content_type") > 0, F.lit(False)).cast("long")).alias("a"), F.count("*").alias("n"))
    return n.select("brand", dq.coverage_note(F.col("a"), F.col("n")).alias("note"))
