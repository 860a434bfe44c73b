"""Posts and comments derived from the star-schema tables, as one SQL text for Spark and for DuckDB.

A post is an order with its line items, an author a customer, a comment a line item.  The text
uses what both dialects share; ``{names}`` mark the few functions that they spell differently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.landing import settled

SPARK = {"arr": "array", "epoch": "unix_timestamp", "none": "cast(array() as array<string>)"}
DUCK = {"arr": "list_value", "epoch": "epoch", "none": "cast([] as varchar[])"}

CAPTIONS = [
    "Shop now! link in bio, 20% off today",
    "how to style these: tips and tricks  #HowTo",
    "bts workshop craftsmanship how it's made",
    "north x summit capsule drop #createdwith us",
    "this is viral",
    "check this #viral clip",
    "honest review: worth it? comment below",
    "new foam cushioning technology for race day https://ex.am/ple",
    "love this sneaker pair @north @friend_1",
    "ootd fit check POV: imagine",
    "box is 10 x 10 cm",
    "  ",
]
TAGS = [["nikerunning", "ootd"], ["AdidasSamba ", "#sneakers"], ["niketech", "nikeShoes", "niketech"], ["jacket", "fashion"], [], ["adidasoriginals", "airmax"], None]
COMMENTS = [
    "these sambas look fire but too expensive",
    "sambas are super comfy",
    "[sticker]",
    "where can i find them",
    "nike tech is so ugly",
    "not good at all, really bad quality",
    "love love love!!",
    "@friend look",
    "lol",
    "very nice shoes, best price",
    "hm interesting thing",
    None,
]


def _quote(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


def _pick(expr: str, values: list[str], n: int | None = None) -> str:
    return "CASE " + " ".join(f"WHEN {expr} = {i} THEN {v}" for i, v in enumerate(values)) + " END"


def _sql_quote(x: str | None) -> str:
    return "NULL" if x is None else '"' + x.replace('"', '\\"') + '"'


def _posts(quote) -> str:
    captions = _pick(f"o_orderkey % {len(CAPTIONS)}", [quote(c) for c in CAPTIONS])
    tags = _pick(f"o_custkey % {len(TAGS)}", ["NULL" if t is None else "{none}" if not t else "{arr}(" + ", ".join(map(quote, t)) + ")" for t in TAGS])
    labels = _pick("o_orderkey % 6", ["{arr}('tutorial', 'promo')", "{arr}('collab')", "{none}", "{arr}('promo')", "{arr}('vibe', 'collab', 'promo')", "NULL"])
    lines = _pick("o_custkey % 5", ["{arr}('samba')", "{arr}('air_max', 'samba')", "{none}", "{arr}('gazelle')", "{arr}('tech_fleece')"])
    styles = _pick("(o_orderkey + o_custkey) % 4", ["{arr}('retro')", "{arr}('technical', 'performance')", "{none}", "{arr}('lifestyle')"])
    return f"""SELECT CAST(o_orderkey AS STRING) AS video_id,
  CASE WHEN o_custkey % 11 = 0 THEN NULL WHEN o_custkey % 2 = 0 THEN 'north' ELSE 'south' END AS brand,
  CAST(o_custkey AS STRING) AS author_id, concat('user_', CAST(o_custkey AS STRING)) AS author_username,
  o_custkey % 50 = 1 AS is_official_brand,
  CASE WHEN o_custkey % 13 = 0 THEN NULL ELSE (o_custkey * o_custkey * 7) % 20000000 END AS author_follower_count,
  CASE WHEN o_custkey % 4 = 0 THEN 'daily vlog and style' WHEN o_custkey % 4 = 1 THEN 'Running and gym' WHEN o_custkey % 4 = 2 THEN 'makeup artist' END AS author_signature,
  CAST({{epoch}}(o_orderdate) AS BIGINT) + (o_orderkey * 3571) % 86400 AS create_time_ts,
  CASE WHEN o_orderkey % 97 = 0 THEN 0 WHEN o_orderkey % 101 = 0 THEN NULL ELSE CAST(floor(o_totalprice) AS BIGINT) END AS view_count,
  qty * 20 AS like_count, CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE n_lines * 3 END AS comment_count, n_returned * 5 AS share_count, n_final * 4 AS collect_count,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE concat('m', CAST((o_orderkey * o_orderkey) % 701 AS STRING)) END AS music_id,
  CASE WHEN o_orderkey % 3 = 0 THEN 'hashtag' ELSE 'user' END AS source_type, concat('#', lower(o_orderpriority)) AS source_query,
  CAST((o_orderkey * 7) % 61 AS DOUBLE) AS video_duration_sec,
  {captions} AS caption_raw, {tags} AS hashtags, {labels} AS content_type, {lines} AS product_lines, {styles} AS brand_styles,
  CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE concat('Topic', CAST(o_custkey % 4 AS STRING)) END AS visual_format,
  o_orderkey % 4 = 0 AS has_purchase_cta, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderkey % 7 = 0 END AS has_discovery_traffic_cta, o_orderkey % 12 = 0 AS has_promo_language
FROM {LINES}"""


LINES = """{orders} LEFT JOIN (SELECT l_orderkey, CAST(sum(l_quantity) AS BIGINT) AS qty, count(*) AS n_lines,
    sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS n_returned, sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS n_final FROM {lineitem} GROUP BY l_orderkey) ON o_orderkey = l_orderkey"""

#: What the posts take from an order and from the sums of its items.
ORDER, SUMS = "o_orderkey, o_custkey, o_orderdate, o_orderpriority, o_totalprice", "qty, n_lines, n_returned, n_final"


def _comments(quote) -> str:
    texts = _pick(f"(l_partkey + l_linenumber) % {len(COMMENTS)}", [quote(c) for c in COMMENTS])
    return f"""SELECT CAST(l_orderkey AS STRING) AS video_id, concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING)) AS comment_id,
  {texts} AS comment_text, CAST(l_quantity AS BIGINT) AS comment_like_count, CAST({{epoch}}(l_shipdate) AS BIGINT) AS crawled_at_ts,
  CASE WHEN l_suppkey % 6 = 0 THEN NULL ELSE ((l_partkey * 13 + l_suppkey * 7 + l_linenumber) % 201 - 100) / CAST(100.0 AS DOUBLE) END AS sentiment_score,
  CASE WHEN l_partkey % 3 = 0 THEN NULL WHEN l_partkey % 2 = 0 THEN 'north' ELSE 'south' END AS brand,
  {_pick("l_partkey % 5", ["'price_value'", "'fit_comfort'", "'generic_positive'", "'meme_chatter'", "'availability'"])} AS topic
FROM {{lineitem}}"""


METRICS = """SELECT *, COALESCE(like_count, 0) + COALESCE(comment_count, 0) + COALESCE(share_count, 0) + COALESCE(collect_count, 0) AS engagement_count,
  CASE WHEN view_count > 0 THEN (10 * COALESCE(like_count, 0) + 25 * COALESCE(comment_count, 0) + 30 * COALESCE(share_count, 0) + 35 * COALESCE(collect_count, 0)) / CAST(100.0 AS DOUBLE) / view_count END AS wer FROM posts"""


def posts(spark: SparkSession, sf_dir: str, once: bool = False) -> DataFrame:
    """``once``: the orders with their items' sums are written, narrow, for a query that reads the posts several times."""
    text = _posts(_sql_quote).replace("{arr}", SPARK["arr"]).replace("{epoch}", SPARK["epoch"]).replace("{none}", SPARK["none"])
    tables = {"orders": spark.read.parquet(f"{sf_dir}/orders.parquet"), "lineitem": spark.read.parquet(f"{sf_dir}/lineitem.parquet")}
    if once:
        tables = {"lines": settled(spark.sql(f"SELECT {ORDER}, {SUMS} FROM {LINES}", **tables))}
        text = text.replace(LINES, "{lines}")
    return spark.sql(text, **tables)


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = _comments(_sql_quote).replace("{epoch}", SPARK["epoch"])
    return spark.sql(text, lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def duck(query: str) -> str:
    """A DuckDB query over ``posts``, ``m`` (posts with metrics) and ``comments``."""
    fix = lambda t: t.replace("{arr}", DUCK["arr"]).replace("{epoch}", DUCK["epoch"]).replace("{none}", DUCK["none"]).replace("{orders}", "orders").replace("{lineitem}", "lineitem")
    parts = [f"posts AS ({fix(_posts(_quote))})", f"m0 AS ({METRICS})", "base AS (SELECT brand AS b_brand, median(wer) AS b_wer FROM m0 GROUP BY brand)", "m AS (SELECT m0.*, wer / nullif(b_wer, 0) AS bri FROM m0 JOIN base ON brand IS NOT DISTINCT FROM b_brand)", f"comments AS ({fix(_comments(_quote))})"]
    return "WITH " + ",\n".join(parts) + "\n" + query
