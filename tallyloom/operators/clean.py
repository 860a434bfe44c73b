"""Silver cleaning: column aliases, tags, brands, lineage and latest-record dedupe."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.numbers import number

ALIASES = {"collect_count": ["save_count"], "caption_raw": ["caption"], "video_id": ["id"]}


def with_aliases(df: DataFrame, aliases: dict[str, list[str]] = ALIASES) -> DataFrame:
    """Each wanted column from itself, else from the first alias that has a value; aliases are dropped."""
    for name, others in aliases.items():
        have = [c for c in (name, *others) if c in df.columns]
        if have:
            df = df.withColumn(name, F.coalesce(*[F.col(c) for c in have])).drop(*[c for c in have if c != name])
    return df


def tags_of(caption: Column, tags: Column, aliases: dict[str, str] | None = None) -> tuple[Column, Column]:
    """Cleaned tags (from the caption where there is no list) and their normalised form, not made distinct again."""
    cleaned = tx.clean_tags(F.coalesce(tags, tx.hashtags_in(caption)))
    if not aliases:
        return cleaned, cleaned
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return cleaned, F.transform(cleaned, lambda t: F.coalesce(F.try_element_at(table, t), t))


def infer_brand(given: Column, tags: Column, prefixes: dict[str, list[str]]) -> Column:
    """The given brand (trimmed, lower-cased), else the one whose tag prefix occurs, ``both`` for several, else null."""

    def begins(heads: list[str]) -> Column:
        return F.exists(tags, lambda t: t.rlike("^(?:" + "|".join(map(re.escape, heads)) + ")"))

    seen = {b: F.coalesce(begins(p), F.lit(False)) for b, p in prefixes.items()}
    count = sum((c.cast("int") for c in seen.values()), F.lit(0))
    found = F.when(count > 1, "both")
    for brand, c in seen.items():
        found = found.when(c, brand)
    return F.coalesce(F.nullif(F.lower(F.trim(given)), F.lit("")), found)


def latest(df: DataFrame, key: str, order: str, *ties: str) -> DataFrame:
    """The row with the largest ``order`` of each key (null keys are one); ties by the other columns, largest first."""
    w = Window.partitionBy(key).orderBy(F.desc_nulls_last(order), *[F.desc_nulls_last(t) for t in ties])
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def clean_posts(df: DataFrame, prefixes: dict[str, list[str]], tag_aliases: dict[str, str] | None = None, official: list[str] = (), tz: str = "UTC") -> DataFrame:
    """Bronze to silver posts; the payload column goes."""
    df = with_aliases(df)
    cleaned, normal = tags_of(F.col("caption_raw"), F.col("hashtags"), tag_aliases)
    df = df.withColumn("caption_raw", tx.strip(F.col("caption_raw"))).withColumn("hashtags", cleaned)
    df = df.withColumn("normalized_hashtags", tags_of(F.col("caption_raw"), F.col("hashtags"), tag_aliases)[1])
    df = df.withColumn("brand", infer_brand(F.col("brand"), F.col("normalized_hashtags"), prefixes))
    df = df.withColumn("seed_hashtag", F.when(F.col("source_type") == "hashtag", F.col("source_query")))
    df = df.withColumn("is_official_brand", F.coalesce(F.lower("author_username"), F.lit("")).isin([o.lower() for o in official]))
    df = df.withColumn("create_time", iso_time(F.col("create_time_ts"), tz))
    return latest(df, "video_id", "crawled_at_ts", "caption_raw").drop("raw_payload")


def iso_time(seconds: Column, tz: str = "UTC") -> Column:
    """Epoch seconds as ISO-8601 text in a time zone (of the session's zone UTC)."""
    local = F.from_utc_timestamp(F.timestamp_seconds(seconds), tz)
    return F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00" if tz == "UTC" else ""))


def clean_comments(df: DataFrame, videos: DataFrame | None = None) -> DataFrame:
    """Bronze to silver comments, with the lineage of their video."""
    df = df.withColumn("comment_text", tx.strip(F.col("comment_text")))
    for c in ("comment_like_count", "comment_reply_count"):
        if c in df.columns:
            df = df.withColumn(c, number(F.col(c).cast("string")))
    df = latest(df, "comment_id", "crawled_at_ts", "comment_text").drop("raw_payload")
    return df if videos is None else with_lineage(df, videos)


def with_lineage(comments: DataFrame, videos: DataFrame, columns: tuple[str, ...] = ("brand", "source_type", "source_query", "author_username", "is_official_brand", "create_time_ts", "caption_raw")) -> DataFrame:
    """Left join of each comment to its video's columns; a name that comments have too gets the suffix _video.

    The join is left to the optimiser: the dimension grows with the posts.
    """
    dim = videos.dropDuplicates(["video_id"]).select("video_id", *[F.col(c).alias(f"{c}_video" if c in comments.columns else c) for c in columns if c in videos.columns])
    return comments.join(dim, "video_id", "left")
