"""Group tables: distributions, cross-tabs, relative performance, commerce, creators, sentiment and topics.

Medians and other quantiles are exact, and no task holds a whole group for them (``quantiles``).  Label columns are arrays; ``null`` means not available and [] nothing found.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import bins, position, ratio, share
from ..sources.landing import settled
from .quantiles import exact_quantiles, group_stats

SMALL_N = 20
LEVELS = ["None", "Low", "Medium", "High"]


# --- labels and coverage ----------------------------------------------------------------------


def explode_labels(df: DataFrame, col: str, keep_empty: bool = False) -> DataFrame:
    """One row per element under the same name; rows without a label go, or stay as null."""
    out = df.withColumn(col, (F.explode_outer if keep_empty else F.explode)(F.col(col)))
    return out if keep_empty else out.where(F.col(col).isNotNull() & (F.length(F.col(col).cast("string")) > 0))


def levels_of(df: DataFrame, col: str) -> DataFrame:
    """Exploded for an array column, unchanged otherwise."""
    return explode_labels(df, col) if df.schema[col].dataType.typeName() == "array" else df


def _filled(df: DataFrame, c: str) -> Column:
    kind = df.schema[c].dataType.typeName()
    if kind == "array":
        return F.coalesce(F.size(c) > 0, F.lit(False))
    return F.coalesce(F.trim(F.col(c)) != "", F.lit(False)) if kind == "string" else F.col(c).isNotNull()


def coverage(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """(by...,) column, n, filled, rate: one pass, then unpivoted."""
    agg = df.groupBy(*(by or [])).agg(F.count("*").alias("n"), *[F.sum(_filled(df, c).cast("long")).alias(f"_{c}") for c in columns])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(f"_{c}"), F.lit(0)).alias("filled")) for c in columns]))
    return agg.select(*(by or []), "n", pairs.alias("p")).select(*(by or []), "p.column", "n", "p.filled", ratio(F.col("p.filled"), F.col("n")).alias("rate"))


def skewed_summary(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """n, mean, median, std, p90, p99, max, bias-adjusted skewness, mean over median; non-finite values are left out."""
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))).withColumn("_v", v)
    n = F.count("_v").cast("double")
    adjust = F.when(n > 2, F.sqrt(n * (n - 1)) / (n - 2))
    moments = [F.count("_v").alias("n"), F.avg("_v").alias("mean"), F.stddev_samp("_v").alias("std"), F.max("_v").alias("max"), (F.skewness("_v") * adjust).alias("skew")]
    out = group_stats(rows, by or [], moments, {"median": ("_v", 0.5), "p90": ("_v", 0.9), "p99": ("_v", 0.99)})
    return out.select(*(by or []), "n", "mean", "median", "std", "p90", "p99", "max", "skew", ratio(F.col("mean"), F.col("median")).alias("mean_over_median"))


# --- distributions and cross-tabs -------------------------------------------------------------


def distribution(df: DataFrame, col: str, value: str, min_count: int = 0, source_n: bool = True) -> DataFrame:
    """level, n, share of the (exploded) rows, median value; coverage_n counts the rows with a level."""
    rows = levels_of(df, col)
    out = group_stats(rows, {"level": col}, [F.count("*").alias("n")], {"median_value": (value, 0.5)})
    out = out.withColumn("coverage_n", F.sum("n").over(Window.partitionBy()))
    return out.withColumn("pct", F.col("n") / F.col("coverage_n")).where(F.col("n") >= min_count)


def crosstab(df: DataFrame, row: str, col: str, value: str, normalize: str = "row", min_count: int = 0) -> DataFrame:
    """Long cross-tab: n, share of the row, column or all, median value of the cell."""
    rows = levels_of(levels_of(df, row), col)
    cells = group_stats(rows, {"row": row, "col": col}, [F.count("*").alias("n")], {"median_value": (value, 0.5)})
    total = Window.partitionBy(*{"row": ["row"], "col": ["col"], "all": []}[normalize])
    return cells.withColumn("pct", F.col("n") / F.sum("n").over(total)).where(F.col("n") >= min_count)


def brand_baseline(df: DataFrame, value: str, brand: str = "brand") -> DataFrame:
    return group_stats(df, [brand], [F.count("*").alias("brand_n")], {"baseline": (value, 0.5)})


def relative_performance(df: DataFrame, label: str, value: str, brand: str = "brand", min_count: int = 5, small_n: int = SMALL_N) -> DataFrame:
    """Per brand and label: n, median, brand baseline, index, uplift, share of the brand's posts.

    Baseline and share use the table before labels are exploded; the null brand is left out.
    The baseline table has one row per brand, so the join needs no hint.
    """
    rows = settled(df.where(F.col(brand).isNotNull()).select(brand, label, value))
    cells = group_stats(levels_of(rows, label), {brand: brand, "category": label}, [F.count("*").alias("n")], {"median_value": (value, 0.5)}).where(F.col("n") >= min_count)
    out = cells.join(brand_baseline(rows, value, brand), brand)
    index = ratio(F.col("median_value"), F.col("baseline"))
    return out.select(F.col(brand).alias("brand"), "category", "n", "median_value", "baseline", index.alias("relative_index"), (index - 1).alias("relative_uplift"), (F.col("n") / F.col("brand_n")).alias("share"), "brand_n", (F.col("n") < small_n).alias("small_n"))


def strategic_bucket(uplift: Column, share_: Column, n: Column, uplift_cut: float = 0.10, share_cut: float = 0.05, small: int = SMALL_N) -> Column:
    high = uplift >= uplift_cut
    return F.when(uplift.isNull(), "other").when(high & (n < small), "A_niche_high").when(high & ((share_ >= share_cut) | (n >= 50)), "B_scalable_winner").when(high, "B_reliable_winner").when((uplift < 0) & (share_ >= share_cut) & (n >= small), "C_high_volume_under").otherwise("other")


def auto_findings(relative: DataFrame, k: int = 3) -> DataFrame:
    """Per brand the top-k labels above baseline, which of them other brands share, and the small-sample ones."""
    top = relative.where("relative_uplift > 0").withColumn("rank", F.row_number().over(Window.partitionBy("brand").orderBy(F.desc("relative_uplift"), "category"))).where(F.col("rank") <= k)
    brands = top.groupBy("category").agg(F.count_distinct("brand").alias("n_brands"))
    joined = top.join(brands, "category")
    named = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("rank", "category")))), lambda x: x["category"]), ", ")
    return joined.groupBy("brand").agg(named(F.lit(True)).alias("top"), named(F.col("n_brands") > 1).alias("shared"), named(F.col("n_brands") == 1).alias("only_here"), named(F.col("small_n")).alias("caution"))


def notable_points(relative: DataFrame, uplift: float = 0.08, share_: float = 0.05, k: int = 2) -> DataFrame:
    """Labels with a large uplift or share, and the k largest of each brand."""
    rank = F.row_number().over(Window.partitionBy("brand").orderBy(F.desc("n"), "category"))
    return relative.withColumn("size_rank", rank).where((F.abs("relative_uplift") >= uplift) | (F.col("share") >= share_) | (F.col("size_rank") <= k))


def on_every_group(df: DataFrame, level: str, group: str) -> DataFrame:
    """Levels that occur in every group (relational division)."""
    pairs = df.where(F.col(group).isNotNull()).select(level, group).distinct()
    need = pairs.select(group).distinct().agg(F.count("*").alias("_k"))
    return pairs.groupBy(level).agg(F.count("*").alias("n_groups")).crossJoin(F.broadcast(need)).where("n_groups = _k").drop("_k")  # one row


# --- commerce ---------------------------------------------------------------------------------

FLAGS = ["has_purchase_cta", "has_discovery_traffic_cta", "has_promo_language", "is_promo_content"]


def with_commerce(df: DataFrame, promo_label: str = "promo") -> DataFrame:
    """Score 0 to 4 (flags that hold) and its level; a null flag counts as not."""
    df = df.withColumn("is_promo_content", F.coalesce(F.array_contains("content_type", promo_label), F.lit(False)))
    score = sum((F.coalesce(F.col(f), F.lit(False)).cast("int") for f in FLAGS), F.lit(0))
    level = bins(score, [1, 2, 3], LEVELS)
    return df.withColumns({"commerce_score": score, "commerce_intensity": level, "commerce_level": position(level, LEVELS)})


def commerce_by(df: DataFrame, dims: list[str], min_count: int = 1) -> DataFrame:
    """n, mean score, high share, rate of each flag, and the mix of levels (null for the null level of the last dimension)."""
    rows = reduce(levels_of, dims, df)
    level = F.col("commerce_intensity")
    out = rows.groupBy(*dims).agg(F.count("*").alias("n"), F.avg("commerce_score").alias("mean_score"), share(level.isin("Medium", "High")).alias("high_share"), *[share(F.col(f)).alias(f"rate_{f}") for f in FLAGS], *[share(level == x).alias(f"mix_{x.lower()}") for x in LEVELS])
    known = F.col(dims[-1]).isNotNull()
    return out.withColumns({f"mix_{x.lower()}": F.when(known, F.col(f"mix_{x.lower()}")) for x in LEVELS}).where(F.col("n") >= min_count)


def level_shares(df: DataFrame, group: str = "brand", level: str = "commerce_intensity") -> DataFrame:
    cells = df.groupBy(group, level).agg(F.count("*").alias("n"))
    return cells.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(group)))


def commerce_trend(df: DataFrame, value: str = "wer", index: str = "bri", q: float = 0.9) -> DataFrame:
    """Every level with n, medians and the share of posts at or above the overall quantile (a null value isn't)."""
    df = settled(df.select("commerce_intensity", value, index))  # the narrow table, for its four passes
    cut = exact_quantiles(df, {}, {"_cut": (value, q)})
    rows = df.crossJoin(F.broadcast(cut))  # one row
    found = group_stats(rows, ["commerce_intensity"], [F.count("*").alias("_n"), share(F.col(value) >= F.col("_cut")).alias("top_rate")], {"median_bri": (index, 0.5), "median_wer": (value, 0.5)})
    every = df.sparkSession.createDataFrame([(x, i) for i, x in enumerate(LEVELS)], "commerce_intensity string, level int")
    return every.join(found, "commerce_intensity", "left").withColumn("n", F.coalesce("_n", F.lit(0)).cast("long")).drop("_n")


def brand_pivot(df: DataFrame, dim: str, brands: list[str], min_count: int = 5, signal: float = 0.0, both: bool = False) -> DataFrame:
    """n and mean score of each brand side by side, the largest mean, the gap of the first two, and the keep rules."""
    rows = levels_of(df, dim)
    cells = [F.count(F.when(F.col("brand") == b, 1)).alias(f"n_{b}") for b in brands] + [F.avg(F.when(F.col("brand") == b, F.col("commerce_score"))).alias(f"mean_{b}") for b in brands]
    out = rows.groupBy(F.col(dim).alias("level")).agg(*cells)
    out = out.withColumns({"max_mean": F.greatest(*[f"mean_{b}" for b in brands]), "gap": F.col(f"mean_{brands[0]}") - F.col(f"mean_{brands[1]}")})
    ok = [(F.col(f"n_{b}") >= min_count) & (F.col(f"mean_{b}") > signal) for b in brands]
    return out.where(reduce(lambda a, b: a & b if both else a | b, ok))


def quadrants(df: DataFrame, level: str, x: str = "commerce_score", y: str = "bri", min_count: int = 1) -> DataFrame:
    """Mean x and median y of each level, and the quadrant against the medians over the levels."""
    cells = group_stats(levels_of(df, level), {"level": level}, [F.count("*").alias("n"), F.avg(x).alias("x")], {"y": (y, 0.5)}).where(F.col("n") >= min_count)
    cells = settled(cells)  # a row a level
    mid = exact_quantiles(cells, {}, {"_x": ("x", 0.5), "_y": ("y", 0.5)})
    name = F.concat(F.when(F.col("x") >= F.col("_x"), "high").otherwise("low"), F.lit("_"), F.when(F.col("y") >= F.col("_y"), "high").otherwise("low"))
    return cells.crossJoin(F.broadcast(mid)).withColumn("quadrant", name).drop("_x", "_y")  # one row


# --- creators ---------------------------------------------------------------------------------


def with_creator_flags(df: DataFrame, collab: str = "collab") -> DataFrame:
    from .features import TIERS, creator_tier

    tier = creator_tier(F.col("author_follower_count"))
    channel = F.when(F.coalesce(F.col("is_official_brand"), F.lit(False)), "official").otherwise("ugc")
    return df.withColumns({"channel": channel, "is_collab": F.coalesce(F.array_contains("content_type", collab), F.lit(False)), "creator_tier": tier, "tier_order": position(tier, TIERS)})


def follower_quartile(df: DataFrame, author: str = "author_id", value: str = "author_follower_count") -> DataFrame:
    """Quartile of the author among authors (right-closed edges), on every post of the author; equal edges merge."""
    authors = df.where(F.col(value).isNotNull()).groupBy(author).agg(F.min(value).alias("_f"))
    edges = exact_quantiles(authors, {}, {f"_{q}": ("_f", q / 4) for q in (1, 2, 3)}).select(F.array_distinct(F.array("_1", "_2", "_3")).alias("_e"))
    placed = authors.crossJoin(F.broadcast(edges)).select(F.col(author).alias("_a"), (F.size(F.filter("_e", lambda e: e < F.col("_f"))) + 1).alias("follower_quartile"))  # one row
    return df.join(placed, F.col(author) == F.col("_a"), "left").drop("_a")


def channel_mix(df: DataFrame) -> DataFrame:
    cells = df.groupBy("brand", "channel").agg(F.count("*").alias("n"), F.count_distinct("author_id").alias("authors"), share(F.col("is_collab")).alias("collab_rate"))
    return cells.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("brand")))


def tier_mix(df: DataFrame, brands: list[str]) -> DataFrame:
    """Scopes all and each brand: authors and videos by tier with their shares; tiers without any are 0."""
    from .features import TIERS

    ugc = df.where("channel = 'ugc' and creator_tier is not null")
    scoped = ugc.withColumn("scope", F.explode(F.array(F.lit("all"), F.col("brand")))).where("scope is not null")
    first = scoped.withColumn("_r", F.row_number().over(Window.partitionBy("scope", "author_id").orderBy("create_time_ts", "video_id"))).where("_r = 1")
    authors = first.groupBy("scope", "creator_tier").agg(F.count("*").alias("a"))
    videos = scoped.groupBy("scope", "creator_tier").agg(F.count("*").alias("v"))
    spark = df.sparkSession
    every = spark.createDataFrame([(s, t, i) for s in ["all", *brands] for i, t in enumerate(TIERS)], "scope string, creator_tier string, tier_order int")
    out = every.join(authors, ["scope", "creator_tier"], "left").join(videos, ["scope", "creator_tier"], "left").fillna(0, ["a", "v"])
    w = Window.partitionBy("scope")
    return out.select("scope", "creator_tier", F.col("a").alias("authors"), F.col("v").alias("videos"), ratio(F.col("a"), F.sum("a").over(w)).alias("author_share"), ratio(F.col("v"), F.sum("v").over(w)).alias("video_share"))


def scale_by(df: DataFrame, dim: str, scale: str = "creator_tier", min_count: int = 1, ugc_only: bool = True) -> DataFrame:
    rows = levels_of(df.where("channel = 'ugc'") if ugc_only else df, dim)
    return group_stats(rows.where(F.col(scale).isNotNull()), {"scale": scale, "level": dim}, [F.count("*").alias("n")], {"median_bri": ("bri", 0.5), "median_wer": ("wer", 0.5)}).where(F.col("n") >= min_count)


def scale_pivot(long: DataFrame, levels: list[str], value: str = "median_bri") -> DataFrame:
    cells = [F.max(F.when(F.col("level") == x, F.col(c))).alias(f"{p}_{x}") for x in levels for p, c in (("value", value), ("n", "n"))]
    return long.groupBy("scale").agg(*cells)


def collab_cells(df: DataFrame, brands: list[str]) -> DataFrame:
    """Collaborations by brand and channel, empty cells too."""
    every = df.sparkSession.createDataFrame([(b, c) for b in brands for c in ("official", "ugc")], "brand string, channel string")
    found = group_stats(df.where("is_collab"), ["brand", "channel"], [F.count("*").alias("_n")], {"median_bri": ("bri", 0.5), "median_wer": ("wer", 0.5)})
    return every.join(found, ["brand", "channel"], "left").withColumn("n", F.coalesce("_n", F.lit(0)).cast("long")).drop("_n")


def collab_versus_rest(df: DataFrame) -> DataFrame:
    return group_stats(df, ["is_collab"], [F.count("*").alias("n"), share(F.col("wer").isNotNull()).alias("coverage")], {"median_bri": ("bri", 0.5), "median_wer": ("wer", 0.5)})


def co_labels(df: DataFrame, parent: str = "collab", col: str = "content_type") -> DataFrame:
    """Other labels of the rows with ``parent``: n, median index, share of those rows."""
    rows = df.where(F.array_contains(col, parent))
    total = rows.agg(F.count("*").alias("_t"))
    cells = group_stats(explode_labels(rows, col).where(F.col(col) != parent), {"label": col}, [F.count("*").alias("n")], {"median_bri": ("bri", 0.5)})
    return cells.crossJoin(F.broadcast(total)).withColumn("share", F.col("n") / F.col("_t")).drop("_t")  # one row


# --- sentiment and topics ---------------------------------------------------------------------


def polarity(score: Column) -> Column:
    return F.when(score <= -0.05, "negative").when(score >= 0.05, "positive").when(score.isNotNull(), "neutral")


def perception(df: DataFrame, by: list[str], score: str = "sentiment_score") -> DataFrame:
    """Scored comments, videos, median and mean score, shares of the polarities, net."""
    s = F.col(score)
    measures = [F.count("*").alias("n"), F.count_distinct("video_id").alias("videos"), F.avg(score).alias("mean_score"), share(s >= 0.05).alias("positive"), share((s > -0.05) & (s < 0.05)).alias("neutral"), share(s <= -0.05).alias("negative")]
    out = group_stats(df.where(s.isNotNull()), by, measures, {"median_score": (score, 0.5)})
    return out.withColumn("net", F.col("positive") - F.col("negative"))


def sentiment_by_label(comments: DataFrame, videos: DataFrame, label: str, min_count: int = 5, always: list[str] = (), by: list[str] = ()) -> DataFrame:
    """Comments joined to the labels of their video: perception by brand and label."""
    dim = videos.dropDuplicates(["video_id"]).select("video_id", F.col("brand").alias("video_brand"), F.col(label).alias("level"))
    rows = levels_of(comments.join(dim, "video_id"), "level")
    out = perception(rows, [*by, "video_brand", "level"])
    return out.where((F.col("n") >= min_count) | F.col("level").isin(list(always)))


def topic_volume(df: DataFrame, topics: DataFrame, layers: list[str], brands: list[str]) -> DataFrame:
    """n by topic and brand within the layers; share of all rows in those layers."""
    rows = df.join(topics, "topic").where(F.col("layer").isin(layers))
    out = rows.groupBy("topic").agg(F.count("*").alias("n"), *[F.count(F.when(F.col("brand") == b, 1)).alias(f"n_{b}") for b in brands])
    return out.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def layer_mix(df: DataFrame, topics: DataFrame, layers: list[str]) -> DataFrame:
    """Every layer in order, unexpected ones after them, with its share of all rows."""
    found = df.join(topics.select("topic", "layer"), "topic", "left").groupBy(F.coalesce("layer", F.lit("unknown")).alias("layer")).agg(F.count("*").alias("_n"))
    every = df.sparkSession.createDataFrame([(x, i) for i, x in enumerate(layers)], "layer string, ord int")
    out = every.join(found, "layer", "full").select("layer", F.coalesce("ord", F.lit(len(layers))).alias("ord"), F.coalesce("_n", F.lit(0)).cast("long").alias("n"))
    return out.withColumn("share", ratio(F.col("n"), F.sum("n").over(Window.partitionBy())))


def topic_sentiment(df: DataFrame, brands: list[str], least: int = 5) -> DataFrame:
    """Wide per topic: n, median, positive, negative and net of each brand; gap and lead of the first two."""
    s = F.col("sentiment_score")
    cells, medians = [], {}
    for b in brands:
        mine = F.col("brand") == b
        cells += [F.count(F.when(mine, 1)).alias(f"n_{b}"), F.avg(F.when(mine, (s >= 0.05).cast("int"))).alias(f"positive_{b}"), F.avg(F.when(mine, (s <= -0.05).cast("int"))).alias(f"negative_{b}")]
        medians[f"median_{b}"] = (F.when(mine, s), 0.5)
    out = group_stats(df.where(s.isNotNull()), ["topic"], [F.count("*").alias("n"), *cells], medians)
    out = out.where(reduce(lambda a, b: a | b, [F.col(f"n_{b}") >= least for b in brands]) | (F.col("n") >= least))
    out = out.withColumns({f"net_{b}": F.col(f"positive_{b}") - F.col(f"negative_{b}") for b in brands})
    gap = F.col(f"net_{brands[0]}") - F.col(f"net_{brands[1]}")
    return out.withColumn("gap", gap).withColumn("lead", F.when(F.col("gap") > 0, brands[0]).when(F.col("gap") < 0, brands[1]).when(F.col("gap").isNotNull(), "tie"))


# --- other tables -----------------------------------------------------------------------------


def channel_snapshot(df: DataFrame) -> DataFrame:
    cells = group_stats(df, ["channel"], [F.count("*").alias("n"), F.sum("view_count").alias("views")], {"median_wer": ("wer", 0.5)})
    return cells.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def executive_summary(df: DataFrame, label: str = "content_type", q: float = 0.9) -> DataFrame:
    """One row of scalars over the whole table."""
    counts = [F.count("*").alias("videos"), F.count("wer").alias("with_wer"), F.count_distinct("author_id").alias("authors"), F.sum((F.size(label) > 0).cast("long")).alias("labelled")]
    return group_stats(df, [], counts, {"top_threshold": ("wer", q)})


def wide(long: DataFrame, index: str, columns: list[str], key: str, value: str) -> DataFrame:
    """Pivot to one column per key, with the row total, for display."""
    return long.groupBy(index).agg(*[F.max(F.when(F.col(key) == c, F.col(value))).alias(c) for c in columns], F.sum(value).alias("total"))


def histogram(df: DataFrame, value: str, low: float, high: float, buckets: int, by: str = "brand", log: bool = False, cap: float | None = None) -> DataFrame:
    """Counts by bucket of the (log1p or clipped) value."""
    v = F.col(value).cast("double")
    v = F.log1p(v) if log else v
    v = F.least(v, F.lit(cap)) if cap is not None else v
    rows = df.where(F.col(value).isNotNull())
    return rows.groupBy(by, F.width_bucket(v, F.lit(low), F.lit(high), F.lit(buckets)).cast("int").alias("bucket")).agg(F.count("*").alias("n"))


def box(df: DataFrame, value: str, by: str = "brand") -> DataFrame:
    return group_stats(df.where(F.col(value).isNotNull()), [by], [F.count("*").alias("n")], {"q1": (value, 0.25), "q2": (value, 0.5), "q3": (value, 0.75)})


def unmapped_tags(df: DataFrame, known: dict[str, list[str]], brands: list[str], tags: str = "hashtags") -> DataFrame:
    """Tags by number of posts (once per post), by brand, which maps hold them, and what to do."""
    rows = df.select("brand", F.explode(F.array_distinct(tags)).alias("tag"))
    out = rows.groupBy("tag").agg(F.count("*").alias("n"), *[F.count(F.when(F.col("brand") == b, 1)).alias(f"n_{b}") for b in brands])
    out = out.withColumns({f"in_{m}": F.col("tag").isin(t) for m, t in known.items()})
    missing = F.array_join(F.array_compact(F.array(*[F.when(~F.col(f"in_{m}"), F.lit(m)) for m in known])), ", ")
    return out.withColumn("suggestion", F.when(missing == "", "mapped").otherwise(F.concat(F.lit("add to "), missing)))


def facet_options(df: DataFrame, col: str, least: int = 20) -> DataFrame:
    return levels_of(df, col).groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def facet_combinations(df: DataFrame, cols: list[str]) -> DataFrame:
    sort = lambda c: F.array_join(F.array_sort(c), "|") if df.schema[c].dataType.typeName() == "array" else F.col(c)
    return df.select(*[sort(c).alias(c) for c in cols]).distinct()


def phrase_evidence(df: DataFrame, allowed: dict[str, list[str]]) -> DataFrame:
    """Votes by (axis, label, phrase) from rows with an array ``votes`` of (axis, label, phrases)."""
    rows = df.select(F.explode("votes").alias("v")).select("v.axis", "v.label", F.explode("v.phrases").alias("phrase"))
    ok = reduce(lambda a, b: a | b, [(F.col("axis") == a) & F.col("label").isin(labels) for a, labels in allowed.items()])
    return rows.where(ok).groupBy("axis", "label", F.lower(F.trim("phrase")).alias("phrase")).agg(F.count("*").alias("n"))
