"""Queries of vectors, clustering and topic discovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..functions.numbers import unit, valid_vector
from ..operators import vectors as em
from .common import BRANDS, comments, duck, floats, measured, posts, table, tidy

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = lambda spark, sf: tidy(f(spark, sf))
        if sql:
            SQL[name] = sql
        return f

    return add


@query("em01_ud01_embed_text", "SELECT doc_id, CASE WHEN length(trim(text)) >= 20 THEN 'embedded' ELSE 'too_short' END AS status, CASE WHEN length(trim(text)) >= 20 THEN 64 END::BIGINT AS size, CASE WHEN length(trim(text)) >= 20 THEN 1.0 END AS length FROM documents")
def _(spark, sf):
    out = em.embed_text(table(spark, sf, "documents").select("doc_id", "text"), "text", em.hashing_encoder(), "hashing-64", "v", min_chars=20)
    return out.select("doc_id", F.col("v_status").alias("status"), F.size("v").alias("size"), F.round(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))), 4).alias("length"))


@query("em02_embed_missing", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 64 END::BIGINT AS size FROM documents WHERE length(trim(text)) >= 3")
def _(spark, sf):
    docs = table(spark, sf, "documents").where("length(trim(text)) >= 3").select("doc_id", "text", F.when(F.col("doc_id") % 3 == 0, F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>")).alias("v"))
    return em.embed_missing(docs, "text", em.hashing_encoder(), "hashing-64", "v").select("doc_id", F.size("v").alias("size"))


def frames(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select(F.floor(F.col("vec_id") / 8).cast("string").alias("video_id"), "vec_id", F.col("embedding").alias("vec"))


E = "SELECT CAST(vec_id // 8 AS VARCHAR) AS video_id, vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings"
UNIT = "list_transform({v}, lambda x: x / sqrt(list_dot_product({v}, {v})))"


@query("em03_mean_pool", floats(f"WITH f AS ({E}), c AS (SELECT video_id, i, avg(v[i]) AS m FROM f, range(1, 65) AS r(i) GROUP BY ALL) SELECT video_id, max(m) / sqrt(sum(m * m)) AS largest, sum(m) / sqrt(sum(m * m)) AS total FROM c GROUP BY video_id", "largest", "total"))
def _(spark, sf):
    p = em.mean_pool(frames(spark, sf), ["video_id"], "vec")
    return p.select("video_id", F.array_max("vector").alias("largest"), F.aggregate("vector", F.lit(0.0), lambda s, x: s + x).alias("total"))


@query("em04_alignment", floats(f"WITH f AS (SELECT video_id, vec_id, {UNIT.format(v='v')} AS u FROM ({E})), t AS (SELECT video_id, u FROM f WHERE vec_id % 8 = 0) SELECT f.video_id, avg(list_dot_product(f.u, t.u)) AS align_mean, max(list_dot_product(f.u, t.u)) AS align_max, min(list_dot_product(f.u, t.u)) AS align_min, stddev_pop(list_dot_product(f.u, t.u)) AS align_std FROM f JOIN t ON f.video_id = t.video_id GROUP BY 1", "align_mean", "align_max", "align_min", "align_std"))
def _(spark, sf):
    f = frames(spark, sf)
    return em.alignment(f, f.where("vec_id % 8 = 0").select("video_id", F.col("vec").alias("text_vec")), "video_id", "vec", "text_vec")


def prompts(spark, sf):
    e = table(spark, sf, "embeddings").where("vec_id < 12")
    return e.select(F.when(F.col("vec_id") < 8, "format").otherwise("setting").alias("axis"), F.concat(F.lit("c"), (F.col("vec_id") % 4).cast("string")).alias("label"), F.col("embedding").alias("vec"))


ZERO = f"WITH f AS (SELECT video_id, {UNIT.format(v='v')} AS u FROM ({E})), p AS (SELECT CASE WHEN vec_id < 8 THEN 'format' ELSE 'setting' END AS axis, 'c' || (vec_id % 4) AS lab, {UNIT.format(v='v')} AS u FROM ({E}) WHERE vec_id < 12), s AS (SELECT video_id, axis, lab, avg(list_dot_product(f.u, p.u)) AS score FROM f CROSS JOIN p GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY video_id, axis ORDER BY score DESC, lab) AS k FROM s)"


@query("em05_zero_shot", floats(f"{ZERO} SELECT a.video_id, a.axis, a.lab AS top, a.score, b.lab AS runner_up, a.score - b.score AS margin FROM r a JOIN r b ON a.video_id = b.video_id AND a.axis = b.axis AND a.k = 1 AND b.k = 2", "score", "margin"))
def _(spark, sf):
    return em.zero_shot(frames(spark, sf), prompts(spark, sf), "video_id")


@query("em06_em07_visual_features", floats(f"{ZERO} SELECT v.video_id, n AS n_frames, CASE WHEN n = 0 THEN 'unknown' WHEN n < 6 THEN 'partial' ELSE 'ok' END AS status, t.lab AS format_top FROM (SELECT CAST(c_custkey AS VARCHAR) AS video_id, COALESCE(n, 0) AS n FROM customer LEFT JOIN (SELECT vec_id // 8 AS i, count(*) AS n FROM embeddings GROUP BY 1) ON i = c_custkey) v LEFT JOIN (SELECT * FROM r WHERE k = 1 AND axis = 'format') t USING (video_id)"))
def _(spark, sf):
    videos = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("video_id"))
    f = frames(spark, sf)
    out = em.visual_features(videos, f, f.where("vec_id % 8 = 0").select("video_id", F.col("vec").alias("text_vec")), prompts(spark, sf), expected=6)
    return out.select("video_id", "n_frames", "status", "format_top")


@query("em08_still_to_do", duck("SELECT video_id FROM posts WHERE video_id NOT IN (SELECT video_id FROM comments WHERE sentiment_score > 0)"))
def _(spark, sf):
    return em.still_to_do(posts(spark, sf).select("video_id"), comments(spark, sf).where("sentiment_score > 0").select("video_id").distinct(), "video_id")


@query("em09_valid_and_unit", floats("SELECT vec_id, true AS valid, list_max(list_transform(v, lambda x: x / sqrt(list_dot_product(v, v)))) AS largest FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)", "largest"))
def _(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", valid_vector(F.col("embedding")).alias("valid"), F.array_max(unit(F.col("embedding"))).alias("largest"))


@query("em10_pca", None)
def _(spark, sf):
    out, explained = em.project(table(spark, sf, "embeddings"), "embedding", 5)
    return out.select("vec_id", F.col("pca")[0].alias("pc1"), F.col("pca")[1].alias("pc2"), F.lit(sum(explained)).alias("explained"))


@query("em11_em12_em15_clusters", None)
def _(spark, sf):
    e = table(spark, sf, "embeddings")
    found, _ = em.cluster(e, "embedding", 8)
    return em.write_back(e, found, "vec_id").select("vec_id", "label", "cluster_id").withColumn("silhouette", F.lit(em.silhouette(found)))


@query("em13_sweep", None)
def _(spark, sf):
    return em.sweep(table(spark, sf, "embeddings"), "embedding", [4, 8])


@query("em14_sl06_profiles", None)
def _(spark, sf):
    e = table(spark, sf, "embeddings").join(table(spark, sf, "part"), F.col("vec_id") == F.col("p_partkey"), "left")
    found, model = em.cluster(e, "embedding", 6, 1)
    near = em.nearest_to_center(found, model, 3, "vec_id").groupBy("cluster_id").agg(F.sort_array(F.collect_list("vec_id")).alias("nearest"))
    return em.profiles(found, "p_brand", "p_retailprice", "p_name").join(near, "cluster_id").withColumn("mix", F.to_json("mix")).withColumn("nearest", F.to_json("nearest"))


@query("em16_discover_topics", None)
def _(spark, sf):
    found, terms = em.discover_topics(table(spark, sf, "documents").select("doc_id", "text"), "text", 4)
    top = terms.groupBy("topic_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), ", ").alias("terms"))
    return found.groupBy("topic_id").agg(F.count("*").alias("n")).join(top, "topic_id")


@query("em17_cluster_terms", floats("WITH w AS (SELECT p_size AS cluster_id, p_partkey, unnest(string_split(p_name, ' ')) AS term FROM part), tf AS (SELECT cluster_id, p_partkey, term, count(*) AS tf FROM w WHERE length(term) > 1 GROUP BY ALL), d AS (SELECT term, ln(((SELECT count(*) FROM part) + 1) / (count(*) + 1)) + 1 AS idf FROM tf GROUP BY term), s AS (SELECT cluster_id, term, sum(tf * idf) / any_value(size) AS weight FROM tf JOIN d USING (term) JOIN (SELECT p_size AS cluster_id, count(*) AS size FROM part GROUP BY 1) USING (cluster_id) GROUP BY cluster_id, term) SELECT * FROM (SELECT cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY round(weight, 9) DESC, term) AS rank, term, weight FROM s) WHERE rank <= 3", "weight"))
def _(spark, sf):
    parts = table(spark, sf, "part").withColumn("cluster_id", F.col("p_size"))
    return em.cluster_terms(parts, "p_name", "p_partkey", 3)


@query("em18_guess_topic", None)
def _(spark, sf):
    c = comments(spark, sf).withColumn("cluster_id", F.pmod(F.xxhash64("comment_text"), F.lit(6)).cast("int"))
    topics = rules.load("topics")["words"]
    phrases = spark.createDataFrame([(t, p) for t, ps in topics.items() for p in ps], "topic string, phrase string")
    return em.guess_topic(em.cluster_terms(c, "comment_text", "comment_id", 6), phrases)


@query("em19_cluster_cards", duck("SELECT label, n, n_north, n_south, examples FROM (SELECT label, count(*) AS n, count(*) FILTER (brand = 'north') AS n_north, count(*) FILTER (brand = 'south') AS n_south, string_agg(COALESCE(comment_text, ''), ' | ' ORDER BY r) FILTER (r <= 3) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY comment_id) AS r FROM (SELECT *, CASE WHEN comment_like_count % 2 = 0 THEN CAST(comment_like_count % 7 AS VARCHAR) ELSE topic END AS label FROM comments)) GROUP BY label)"))
def _(spark, sf):
    c = comments(spark, sf).withColumn("cluster_id", F.when(F.col("comment_like_count") % 2 == 0, F.col("comment_like_count") % 7))
    return em.cluster_cards(c, "cluster_id", "topic", "comment_text", "comment_id", BRANDS, 3)


@query("ud02_frame_encoder", "SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def _(spark, sf):
    """A plugged-in encoder over frame rows: here it reads the vectors that a camera table would hold."""
    from collections.abc import Iterator

    import pandas as pd

    def encode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame({"label": p["label"].astype("int32"), "norm": p["embedding"].map(lambda v: float((v * v).sum()))})

    return table(spark, sf, "embeddings").mapInPandas(encode, "label int, norm double").where("norm > 0").groupBy("label").agg(F.count("*").alias("n"))


@query("ud04_ud05_native_groups", duck("SELECT brand, count(*) AS n, avg(CAST(COALESCE(wer, 0) > 0.01 AS INT)) AS high FROM m GROUP BY brand", "high"))
def _(spark, sf):
    return measured(spark, sf).groupBy("brand").agg(F.count("*").alias("n"), F.avg((F.coalesce("wer", F.lit(0.0)) > 0.01).cast("int")).alias("high"))
