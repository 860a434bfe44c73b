"""Landing files, vendor items, Parquet sinks and exports."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as tx
from ..functions.numbers import number

VIDEO = (
    "platform string, source_type string, source_query string, brand string, video_id string, create_time_ts bigint, caption_raw string, hashtags array<string>, author_id string, author_username string, author_verified boolean, author_follower_count bigint, author_signature string, video_duration_sec double, music_id string, has_music boolean, view_count bigint, like_count bigint, comment_count bigint, share_count bigint, collect_count bigint, crawled_at string, crawled_at_ts bigint, raw_payload string"
)
COMMENT = (
    "platform string, video_id string, comment_id string, comment_text string, comment_like_count bigint, comment_reply_count bigint, comment_create_time string, comment_author_id string, comment_author_username string, comment_author_nickname string, region string, crawled_at string, crawled_at_ts bigint, raw_payload string"
)
ITEM = (
    "id string, text string, createTime bigint, authorMeta struct<id: string, name: string, nickName: string, verified: boolean, signature: string, fans: bigint>, videoMeta struct<duration: double>, musicMeta struct<musicId: string>, playCount bigint, diggCount bigint, commentCount bigint, shareCount bigint, collectCount bigint, hashtags array<struct<name: string>>, webVideoUrl string"
)
UNKNOWN = "__unknown__"


def work_dir(spark: SparkSession) -> str:
    """A fresh folder below the shared ``spark.checkpoint.dir`` (a temporary one only where none is set)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = base or tempfile.mkdtemp(prefix="spark-")
    return f"{base}/tables/{uuid.uuid4().hex}"


def settled(df: DataFrame, by: Sequence[str] = (), schema: StructType | None = None) -> DataFrame:
    """Written to the shared folder (in folders ``by`` these columns) and read again, for what several passes read;
    ``schema`` where it is to be read as other types of the same form."""
    path = work_dir(df.sparkSession)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(schema or df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the jobs inside go when their job ends, not when the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def removed(table: DataFrame) -> None:
    """Removes the files of a settled table that nothing reads any more."""
    spark = table.sparkSession
    for folder in {re.match(".*/tables/[0-9a-f]{32}", f)[0] for f in table.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """JSON lines under one explicit schema: missing keys are null, blank lines are skipped, broken ones keep their text."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def read_landing(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Files whose name has "comment" are comments, all others videos."""
    rows = read_jsonl(spark, path, COMMENT if kind == "comment" else VIDEO)
    named = F.lower(F.col("_metadata.file_name")).contains("comment")
    return rows.where(named if kind == "comment" else ~named)


def union_drifting(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def is_video_item(item: DataFrame) -> Column:
    return F.col("authorMeta").isNotNull() | F.col("playCount").isNotNull() | F.col("videoMeta").isNotNull()


def flatten_items(items: DataFrame) -> DataFrame:
    """Nested vendor items to the flat video record; other shapes are left out."""
    rows = items.where(is_video_item(items))
    return rows.select(
        F.col("id").alias("video_id"),
        F.col("text").alias("caption_raw"),
        F.col("createTime").alias("create_time_ts"),
        F.transform("hashtags", lambda h: F.regexp_replace(h["name"], "^#+", "")).alias("hashtags"),
        F.col("authorMeta.id").alias("author_id"),
        F.coalesce(tx.blank_to_null(F.col("authorMeta.name")), F.col("authorMeta.nickName")).alias("author_username"),
        F.coalesce("authorMeta.verified", F.lit(False)).alias("author_verified"),
        F.col("authorMeta.fans").alias("author_follower_count"),
        F.col("authorMeta.signature").alias("author_signature"),
        F.col("videoMeta.duration").alias("video_duration_sec"),
        F.col("musicMeta.musicId").alias("music_id"),
        F.col("musicMeta.musicId").isNotNull().alias("has_music"),
        F.col("playCount").alias("view_count"),
        F.col("diggCount").alias("like_count"),
        F.col("commentCount").alias("comment_count"),
        F.col("shareCount").alias("share_count"),
        F.col("collectCount").alias("collect_count"),
    )


COMMENT_ALIASES = {"comment_id": ["cid", "comment_id", "id"], "comment_text": ["text", "comment_text"], "comment_like_count": ["diggCount", "digg_count"], "comment_reply_count": ["replyCommentTotal", "reply_count"], "video_id": ["video_id", "videoId"], "comment_author_username": ["uniqueId", "unique_id"]}
COUNTS = {"comment_like_count", "comment_reply_count"}


def flatten_comments(df: DataFrame, url: str = "videoWebUrl") -> DataFrame:
    """Comment items whose fields have several names: first that isn't blank; counts through double to integer."""
    out = []
    for name, others in COMMENT_ALIASES.items():
        have = [tx.blank_to_null(F.col(c).cast("string")) for c in others if c in df.columns]
        c = F.coalesce(*have) if have else F.lit(None).cast("string")
        if name in COUNTS:
            c = number(c).cast("bigint")
        elif name == "video_id" and url in df.columns:
            c = F.coalesce(c, video_id_in(F.col(url)))
        out.append(c.alias(name))
    return df.select(*out)


def video_id_in(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"/video/(\d+)", 1), F.lit(""))


def first_per_id(df: DataFrame, key: str, *order: str) -> DataFrame:
    """Rows with an id, the first of each in arrival order."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.where(F.col(key).isNotNull() & (F.trim(key) != "")).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def read_features(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_partitioned(df: DataFrame, path: str, by: list[str] = ("brand",)) -> None:
    """Parquet by partition columns; null or missing values go to ``__unknown__``.  Every task writes the rows it
    holds, without a shuffle, so one large partition value is written by many tasks."""
    for c in by:
        df = df.withColumn(c, F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN)) if c in df.columns else F.lit(UNKNOWN))
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def write_flat(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def publish(df: DataFrame, path: str, columns: list[str], date_column: str | None = None) -> None:
    """Slim export: listed columns that exist, one time cut to its day, zstd."""
    df = df.select(*[c for c in columns if c in df.columns])
    if date_column in df.columns:
        df = df.withColumn(date_column, F.date_trunc("day", date_column))
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def export_tables(tables: dict[str, DataFrame], summary: DataFrame, path: str) -> None:
    """Small aggregates as one CSV file each, and the one-row summary as JSON."""
    for name, df in tables.items():
        df.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/{name}")
    summary.select(F.to_json(F.struct(*summary.columns)).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/summary")


def cluster_map(spark: SparkSession, entries: dict | list[dict]) -> DataFrame:
    """cluster_id -> topic from {"3": "x"} or [{"cluster_id": 3, "topic": "x"}]."""
    pairs = [(int(k), v) for k, v in entries.items()] if isinstance(entries, dict) else [(int(e["cluster_id"]), e.get("topic") or e.get("label")) for e in entries]
    return spark.createDataFrame(pairs, "cluster_id int, topic string")
