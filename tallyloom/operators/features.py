"""Gold features: engagement metrics, time parts, creator and caption features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as rule_files
from ..functions import text as tx
from ..functions.numbers import bins, ratio
from ..sources.landing import settled
from .quantiles import exact_quantiles

WEIGHTS = {"like_count": 10, "comment_count": 25, "share_count": 30, "collect_count": 35}
TIERS = ["nano", "micro", "mid", "macro", "mega"]
TIER_EDGES = [10_000, 100_000, 1_000_000, 10_000_000]
MISSING = "__MISSING__"


def exact_median(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Exact median per group that has a value, whatever the size of the group."""
    return exact_quantiles(df, {c: c for c in by}, {name: (value, 0.5)})


def with_engagement(df: DataFrame, weights: dict[str, int] = WEIGHTS) -> DataFrame:
    """engagement_count, engagement_rate, weighted_engagement_count and wer; rates are null without views."""
    filled = {c: F.coalesce(F.col(c), F.lit(0)) for c in weights}
    weighted = sum((w * filled[c] for c, w in weights.items()), F.lit(0)) / F.lit(100.0)
    views = F.when(F.col("view_count") > 0, F.col("view_count"))
    df = df.withColumn("engagement_count", sum(filled.values(), F.lit(0)).cast("long"))
    return df.withColumns({"engagement_rate": F.col("engagement_count") / views, "weighted_engagement_count": weighted, "wer": weighted / views})


def with_bri(df: DataFrame, brand: str = "brand", value: str = "wer", name: str = "bri") -> DataFrame:
    """value / median value of its brand; the null brand is a group of its own.

    There are few brands, so the medians' table is small whatever the input; it is written, so that Spark
    knows its size and doesn't deal all rows by brand to join it.
    """
    base = settled(exact_median(df, [brand], value, "_median").withColumnRenamed(brand, "_brand"))
    joined = df.join(base, F.col(brand).eqNullSafe(F.col("_brand")), "left")
    return joined.withColumn(name, ratio(F.col(value), F.col("_median"))).drop("_brand", "_median")


def with_ratios(df: DataFrame) -> DataFrame:
    pairs = {"like_per_view": ("like_count", "view_count"), "comment_per_view": ("comment_count", "view_count"), "share_per_view": ("share_count", "view_count"), "engagement_per_view": ("engagement_count", "view_count"), "comment_per_like": ("comment_count", "like_count")}
    return df.withColumns({n: ratio(F.col(a), F.col(b)) for n, (a, b) in pairs.items()})


def with_time_parts(df: DataFrame, tz: str = "UTC", ts: str = "create_time_ts") -> DataFrame:
    """post_date (text), post_hour and post_weekday (Monday 0) in local time."""
    local = F.from_utc_timestamp(F.timestamp_seconds(F.col(ts)), tz)
    return df.withColumns({"post_date": F.date_format(local, "yyyy-MM-dd"), "post_hour": F.hour(local), "post_weekday": F.weekday(local)})


def with_urls(df: DataFrame, base: str = "https://www.example.com") -> DataFrame:
    handle = F.regexp_replace("author_username", "^@+", "")
    video = F.when(F.col("video_id").isNotNull() & F.col("author_username").isNotNull(), F.concat(F.lit(f"{base}/@"), handle, F.lit("/video/"), F.col("video_id")))
    return df.withColumns({"video_url": video, "author_url": F.when(F.col("author_username").isNotNull(), F.concat(F.lit(f"{base}/@"), handle))})


def with_text(df: DataFrame, caption: str = "caption_raw", tags: str = "hashtags") -> DataFrame:
    c, t = F.col(caption), tx.clean_tags(F.col(tags))
    return df.withColumns({"caption_clean": tx.clean_caption(c), "embedding_text": tx.embedding_text(c, t), "caption_word_count": tx.word_count(c), "hashtag_count": F.size(t).cast("long"), "mention_count": tx.mention_count(c)})


def with_cta(df: DataFrame, caption: str = "caption_raw", families: dict[str, list[str]] | None = None) -> DataFrame:
    """One flag per pattern family; has_cta is purchase, engagement or discovery."""
    families = families or rule_files.load("cta")
    low = F.lower(F.coalesce(F.col(caption), F.lit("")))
    df = df.withColumns({f"has_{n}": low.rlike("|".join(p)) for n, p in families.items()})
    return df.withColumn("has_cta", F.col("has_purchase") | F.col("has_engagement") | F.col("has_discovery"))


def creator_type(official: Column, bio: Column, families: dict[str, list[str]]) -> Column:
    """brand for official accounts, else the first family with a keyword in the bio, else other."""
    low, out = F.lower(F.coalesce(bio, F.lit(""))), F.when(F.coalesce(official, F.lit(False)), "brand")
    for name, words in families.items():
        out = out.when(low.rlike("|".join(words)), name)
    return out.otherwise("other")


CREATOR_FAMILIES = {"sports": ["sport", "gym", "running", "training"], "lifestyle": ["daily", "vlog", "living"], "fashion": ["fashion", "style", "outfit"], "beauty": ["beauty", "makeup", "skincare"]}


def creator_tier(followers: Column) -> Column:
    return bins(followers, TIER_EDGES, TIERS)


def with_trending_audio(df: DataFrame, music: str = "music_id", least: int = 3, q: float = 0.9) -> DataFrame:
    """Flag of the audio ids used ``least`` times or more whose count reaches the quantile of such counts."""
    counts = df.where(F.col(music).isNotNull()).groupBy(music).agg(F.count("*").alias("_uses")).where(F.col("_uses") >= least)
    cut = counts.groupBy("_uses").agg(F.count("*").alias("_n")).agg(F.percentile("_uses", F.lit(q), F.col("_n")).alias("_cut"))
    hot = settled(counts.crossJoin(F.broadcast(cut)).where("_uses >= _cut").select(F.col(music).alias("_hot")))  # one row; its size is known to the join
    return df.join(hot, F.col(music) == F.col("_hot"), "left").withColumn("is_trending_audio", F.col("_hot").isNotNull()).drop("_hot")


def with_structure(df: DataFrame, caption: str = "caption_raw") -> DataFrame:
    """Punctuation, emoji, hook, question and giveaway features of a caption."""
    c = F.coalesce(F.col(caption), F.lit(""))
    low = F.lower(c)
    return df.withColumns(
        {
            "n_exclaim": F.regexp_count(c, F.lit("!")).cast("long"),
            "n_question": F.regexp_count(c, F.lit(r"\?")).cast("long"),
            "n_emoji": F.regexp_count(c, F.lit(r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]")).cast("long"),
            "caption_length": F.length(c).cast("long"),
            "has_hook": low.rlike(r"^\s*(?:pov|wait|stop|how to|why|this is)(?:$|[^a-z])"),
            "asks_question": low.rlike(r"(?:what|which|who|how|would you)[^?]{0,80}\?"),
            "is_giveaway": low.rlike(r"give ?away|enter to win"),
        }
    )


def first_label(c: Column) -> Column:
    return F.coalesce(F.try_element_at(c, F.lit(1)), F.lit(MISSING))


def with_crosses(df: DataFrame) -> DataFrame:
    """First labels, buckets of duration and hour, crossed categories, weekend, ISO week and month."""
    df = with_time_parts(df)
    day = F.timestamp_seconds("create_time_ts")
    df = df.withColumns(
        {
            "first_content": first_label(F.col("content_type")),
            "first_style": first_label(F.col("brand_styles")),
            "duration_bucket": bins(F.col("video_duration_sec"), [15, 30, 45], ["0-15", "15-30", "30-45", "45+"], right_closed=True),
            "hour_bucket": bins(F.col("post_hour"), [5, 11, 17], ["night", "morning", "afternoon", "evening"], right_closed=True),
            "is_weekend": F.col("post_weekday") >= 5,
            "week_start": F.date_format(F.date_trunc("week", day), "yyyy-MM-dd"),
            "month": F.date_format(day, "yyyy-MM"),
        }
    )
    cross = lambda a, b: F.concat_ws("|", F.coalesce(F.col(a).cast("string"), F.lit(MISSING)), F.coalesce(F.col(b).cast("string"), F.lit(MISSING)))
    return df.withColumns({"brand_x_content": cross("brand", "first_content"), "brand_x_style": cross("brand", "first_style"), "content_x_duration": cross("first_content", "duration_bucket"), "content_x_hour": cross("first_content", "hour_bucket"), "brand_x_hour": cross("brand", "hour_bucket"), "style_x_duration": cross("first_style", "duration_bucket")})


def with_placeholders(df: DataFrame, batch: str, defaults: dict[str, str]) -> DataFrame:
    """crawl_at parsed where possible, the batch id, and null columns (name -> type) that are missing."""
    if "crawled_at" in df.columns:
        df = df.withColumn("crawl_at", F.try_to_timestamp("crawled_at"))
    df = df.withColumn("crawl_batch_id", F.lit(batch))
    return df.withColumns({n: F.lit(None).cast(t) for n, t in defaults.items() if n not in df.columns})


def feature_table(df: DataFrame) -> DataFrame:
    """Silver posts to gold posts (labels, sentiment and vectors are added by their own operators)."""
    df = with_crosses(with_ratios(with_bri(with_engagement(df))))
    df = with_structure(with_cta(with_text(df)))
    df = df.withColumns({"creator_type": creator_type(F.col("is_official_brand"), F.col("author_signature"), CREATOR_FAMILIES), "creator_tier": creator_tier(F.col("author_follower_count"))})
    return with_trending_audio(with_urls(df))


def leave_one_out(df: DataFrame, by: str, value: str, fallback: Column, name: str) -> DataFrame:
    """Mean of the others in the group; the fallback where there is no other.

    Sums per group are combined before the shuffle and joined back, so no task holds a group.
    """
    sums = df.groupBy(F.col(by).alias("_g")).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    n = F.col("_n") - F.col(value).isNotNull().cast("int")
    rest = F.col("_s") - F.coalesce(F.col(value), F.lit(0.0))
    return df.join(sums, F.col(by).eqNullSafe(F.col("_g")), "left").withColumn(name, F.when(n > 0, rest / n).otherwise(fallback)).drop("_g", "_s", "_n")
