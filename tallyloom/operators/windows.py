"""Window, ranking, top-k and set operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import group_stats


def group_median(df: DataFrame, by: str, value: str, name: str) -> DataFrame:
    """Median of the group on every row: aggregated first and joined back, so rows of a hot group aren't gathered."""
    from .features import exact_median

    base = exact_median(df, [by], value, name).withColumnRenamed(by, "_by")
    return df.join(base, F.col(by).eqNullSafe(F.col("_by")), "left").drop("_by")


def group_total(df: DataFrame, by: str, value: str, name: str) -> DataFrame:
    base = df.groupBy(F.col(by).alias("_by")).agg(F.sum(value).alias(name))
    return df.join(base, F.col(by).eqNullSafe(F.col("_by")), "left").drop("_by")


def group_distinct(df: DataFrame, by: str, value: str, name: str) -> DataFrame:
    base = df.groupBy(F.col(by).alias("_by")).agg(F.count_distinct(value).alias(name))
    return df.join(base, F.col(by).eqNullSafe(F.col("_by")), "left").drop("_by")


def top_percent(df: DataFrame, value: str, name: str = "top_percent") -> DataFrame:
    """Place from the top in percent, rounded up, 1 at least; null for a null value.

    Ranks come from the histogram of values, ordered range by range, so no task sees all rows.
    """
    from .stats import before_counts

    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_t"))
    above = F.col("_t") - F.col("before") - F.col("_n")
    ranks = before_counts(counts, [], "_v", "_n").crossJoin(F.broadcast(total)).select("_v", F.greatest(F.lit(1), F.ceil((above + 1) * 100 / F.col("_t"))).cast("long").alias(name))  # one row
    return df.join(ranks, F.col(value) == F.col("_v"), "left").drop("_v")


def suffix_minimum(df: DataFrame, value: str, by: str, order: list[str], name: str, ranges: int = 64) -> DataFrame:
    """Smallest value of the row and the later ones of its group, in order of the columns (the first a number or time, nulls first).

    Groups are cut into ranges of the first order column: the minimum runs inside a range, and the
    minima of the later ranges (at most ``ranges`` of a group) are added.
    """
    first = F.col(order[0])
    if df.schema[order[0]].dataType.typeName().startswith("timestamp"):
        first = F.unix_micros(first.cast("timestamp"))
    first = first.cast("double")
    cuts = F.array_distinct(F.percentile_approx(first, F.array(*[F.lit(i / ranges) for i in range(1, ranges)]), 1000))
    edges = df.groupBy(F.col(by).alias("_g")).agg(cuts.alias("_e"))
    rows = df.join(edges, F.col(by).eqNullSafe(F.col("_g"))).withColumn("_range", F.coalesce(F.size(F.filter("_e", lambda e: e < first)), F.lit(-1))).drop("_e", "_g")
    least = rows.groupBy(F.col(by).alias("_g"), F.col("_range").alias("_r")).agg(F.min(value).alias("_m"))
    least = least.withColumn("_later", F.min("_m").over(Window.partitionBy("_g").orderBy("_r").rowsBetween(1, Window.unboundedFollowing))).drop("_m")
    inside = F.min(value).over(Window.partitionBy(by, "_range").orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rows = rows.withColumn("_in", inside).join(least, F.col(by).eqNullSafe(F.col("_g")) & (F.col("_range") == F.col("_r")))
    return rows.withColumn(name, F.least("_in", "_later")).drop("_range", "_in", "_g", "_r", "_later")


def graded_relevance(df: DataFrame, by: str, value: str, name: str = "relevance") -> DataFrame:
    """0 to 4 by quintile edges within lists of five rows or more, else the dense rank less one."""
    edges = group_stats(df, [by], [F.count(value).alias("_n")], {f"_{q}": (value, q / 5) for q in (1, 2, 3, 4)})
    edges = edges.select(by, "_n", F.array("_1", "_2", "_3", "_4").alias("_e"))
    spread = F.when(F.col("_n") >= 5, F.xxhash64(value))  # only short lists need the rank: long ones are dealt
    rank = F.dense_rank().over(Window.partitionBy(by, spread).orderBy(value)) - 1
    grade = F.size(F.filter("_e", lambda e: e < F.col(value)))
    return df.join(edges, by).withColumn("_rank", rank).withColumn(name, F.when(F.col("_n") >= 5, grade).otherwise(F.col("_rank"))).drop("_n", "_e", "_rank")


def first_per_group(df: DataFrame, by: list[str], *order: Column) -> DataFrame:
    return top_k(df, by, 1, *order)


def top_k(df: DataFrame, by: list[str], k: int, *order: Column) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= k).drop("_r")


def tiered_order(df: DataFrame, curated: Column, reach: int = 100_000) -> list[Column]:
    """Sort keys: curated first, then large reach, then wer, then views, then id."""
    return [F.desc(curated.cast("int")), F.desc(F.coalesce(F.col("view_count") >= reach, F.lit(False)).cast("int")), F.desc_nulls_last("wer"), F.desc_nulls_last("view_count"), F.asc("video_id")]


def top_ids(df: DataFrame, metric: str, n: int, key: str = "video_id", fallback: str = "view_count") -> DataFrame:
    """The n distinct, non-blank ids with the largest metric (an unknown metric falls back)."""
    metric = metric if metric in df.columns else fallback
    best = df.where(F.trim(key) != "").groupBy(key).agg(F.max(metric).alias("metric"))
    return best.orderBy(F.desc_nulls_last("metric"), key).limit(n)


def diversified(df: DataFrame, k: int, *order: Column, group: str = "brand", line: str = "line", pinned: str | None = None) -> DataFrame:
    """Round robin over groups, unseen lines of a group first; pinned rows lead.  The k first of each round order.

    Only the k first of a line, and of those the k first of a group, can be among the k first of all:
    both limits are constants, so they apply before the shuffles.  Pinned rows (a curated list) are
    ordered among themselves first.
    """

    def rounds(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("_line_round", F.row_number().over(Window.partitionBy(group, line).orderBy(*order))).where(F.col("_line_round") <= k)
        return rows.withColumn("_round", F.row_number().over(Window.partitionBy(group).orderBy("_line_round", *order))).where(F.col("_round") <= k)

    if pinned is None:
        return rounds(df).orderBy("_round", F.asc_nulls_last(group), *order).limit(k)
    first = F.coalesce(F.col(pinned), F.lit(False))
    rows = rounds(df.where(first)).unionByName(rounds(df.where(~first)))
    return rows.orderBy(F.desc(first.cast("int")), "_round", F.asc_nulls_last(group), *order).limit(k)


def pools(df: DataFrame, conditions: dict[str, Column], text: Column, least: int = 8) -> DataFrame:
    """Pool of each row, the first condition that holds; rows of none or with short text go."""
    c = F.lit(None).cast("string")
    for name, cond in reversed(list(conditions.items())):
        c = F.when(cond, name).otherwise(c)
    return df.withColumn("pool", c).where(F.col("pool").isNotNull() & (F.length(F.trim(text)) >= least))


def budgeted(df: DataFrame, parent: str, kind: str, priority: list[str], budget: int, *order: Column) -> DataFrame:
    """At most ``budget`` items of each parent in order of kind; trimmed counts what went."""
    from ..functions.numbers import position

    rank = F.row_number().over(Window.partitionBy(parent).orderBy(F.asc_nulls_last(position(F.col(kind), priority)), *order))
    n = df.groupBy(F.col(parent).alias("_p")).agg(F.count("*").alias("_n"))
    rows = df.withColumn("place", rank).where(F.col("place") <= budget)
    return rows.join(n, F.col(parent) == F.col("_p")).withColumn("trimmed", F.greatest(F.col("_n") - budget, F.lit(0))).drop("_p", "_n")


def parents_with_children(parents: DataFrame, children: DataFrame, key: str, metric: str, pool: int, n: int) -> DataFrame:
    """Of the ``pool`` largest parents the first n that have a child."""
    best = parents.orderBy(F.desc_nulls_last(metric), key).limit(pool)
    return best.join(children.select(key).distinct(), key, "left_semi").orderBy(F.desc_nulls_last(metric), key).limit(n)


def smoothed_overlap(a: Column, b: Column) -> Column:
    """|A and B| / (|A or B| + 1)."""
    return F.size(F.array_intersect(a, b)) / (F.size(F.array_union(a, b)) + 1)
