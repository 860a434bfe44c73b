"""Rank tests, false-discovery control, correlation, and stratified samples."""

from __future__ import annotations

from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.numbers import normal_tail
from ..sources.landing import settled
from .quantiles import exact_quantiles
from .tables import levels_of


def before_counts(cells: DataFrame, by: list[str], value: str, count: str, name: str = "before", buckets: int = 64, range_name: str | None = None) -> DataFrame:
    """Sum of ``count`` over the smaller values of the group, on every row; values are distinct per group.

    A global order without a single task: approximate quantiles cut each group into ranges, the
    running sum stays inside a range, and the ranges' totals (a few dozen rows a group) give
    the offsets.  The result is exact whatever the cuts are, as long as all who read them read the same:
    they depend on the order in which parts arrive, so cells and cuts are written once.  ``range_name``
    keeps the range's number.
    """
    cells = settled(cells)
    cuts = F.array_distinct(F.percentile_approx(value, F.array(*[F.lit(i / buckets) for i in range(1, buckets)]), 1000))
    if by:
        edges = settled(cells.groupBy(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)]).agg(cuts.alias("_e")))
        same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)]
        rows = cells.join(edges, reduce(lambda a, b: a & b, same)).drop(*[f"_k{i}" for i in range(len(by))])
    else:
        rows = cells.crossJoin(F.broadcast(settled(cells.agg(cuts.alias("_e")))))  # one row
    rows = rows.withColumn("_b", F.size(F.filter("_e", lambda e: e < F.col(value)))).drop("_e")
    totals = rows.groupBy(*by, "_b").agg(F.sum(count).alias("_t"))
    offset = F.coalesce(F.sum("_t").over(Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    keys = [F.col(c).alias(f"_k{i}") for i, c in enumerate([*by, "_b"])]
    offsets = totals.withColumn("_o", offset).select(*keys, "_o")
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate([*by, "_b"])]
    inside = F.coalesce(F.sum(count).over(Window.partitionBy(*by, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumn("_in", inside).join(offsets, reduce(lambda a, b: a & b, same))
    if range_name:
        placed = placed.withColumn(range_name, F.col("_b"))
    return placed.withColumn(name, F.col("_o") + F.col("_in")).drop("_b", "_o", "_in", *[f"_k{i}" for i in range(len(by) + 1)])


#: Without ties the exact distribution is used where the smaller side has at most ``SMALL`` rows and U at most ``MOST_U``.
SMALL, MOST_U = 8, 10_000


@lru_cache(4096)
def u_tail(n1: int, n2: int) -> np.ndarray:
    """P(U >= u) of the Mann-Whitney U of n1 and n2 rows without ties, for u = 0 .. n1 n2.

    The number of orders with a given U is a coefficient of a Gaussian binomial: factor by factor,
    multiplied by 1 - q^(n2 + i) and divided by 1 - q^i.
    """
    ways = np.zeros(n1 * n2 + 1)
    ways[0] = 1
    for i in range(1, n1 + 1):
        ways[n2 + i :] -= ways[: max(0, len(ways) - n2 - i)].copy()
        for k in range(i):
            ways[k::i] = np.cumsum(ways[k::i])
    return np.minimum(1.0, np.cumsum(ways[::-1])[::-1] / ways.sum())


@F.pandas_udf(DoubleType())
def exact_p(n1: pd.Series, n2: pd.Series, u: pd.Series) -> pd.Series:
    """Two-sided p of U without ties (a row per test, the smaller side first in the cache)."""
    both = zip(n1.astype(int), n2.astype(int), u.astype(int), strict=True)
    return pd.Series([min(1.0, 2 * u_tail(min(a, b), max(a, b))[max(x, a * b - x)]) for a, b, x in both], dtype=float)


def _two_sided(n1: Column, n2: Column, u: Column, ties: Column, z: Column) -> Column:
    """Exact p for small groups without ties, else that of the normal distribution; null where an order says nothing."""
    small = (ties == 0) & (F.least(n1, n2) <= SMALL) & (F.least(n1, n2) > 0) & (n1 * n2 <= MOST_U)
    at = lambda c: F.when(small, c).otherwise(0.0)
    return F.when(small, exact_p(at(n1), at(n2), at(u))).when(z.isNotNull(), F.least(F.lit(1.0), normal_tail(z)))


def rank_sums(df: DataFrame, by: list[str], value: str, inside: str) -> DataFrame:
    """Mann-Whitney of the rows inside against the rest, per group: n, medians, U, two-sided p (exact for small groups
    without ties, else the tie-corrected normal one), rank-biserial.

    Ranks come from counts per (group, value), ordered range by range.
    """
    rows = df.where(F.col(value).isNotNull())
    cells = rows.groupBy(*by, value).agg(F.sum(F.col(inside).cast("long")).alias("a"), F.count("*").alias("t"))
    cells = before_counts(cells, by, value, "t").withColumn("rank", F.col("before") + (F.col("t") + 1) / 2)
    t = F.col("t").cast("double")
    out = cells.groupBy(*by).agg(F.sum("a").alias("n1"), (F.sum("t") - F.sum("a")).alias("n2"), F.sum(F.col("a") * F.col("rank")).alias("r1"), F.sum(t * t * t - t).alias("ties"))
    medians = exact_quantiles(rows, {f"_m{i}": c for i, c in enumerate(by)}, {"median_in": (F.when(F.col(inside), F.col(value)), 0.5), "median_out": (F.when(~F.col(inside), F.col(value)), 0.5)})
    out = out.join(medians, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_m{i}")) for i, c in enumerate(by)]), "left")
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    u = F.col("r1") - n1 * (n1 + 1) / 2
    variance = n1 * n2 / 12 * (n + 1 - F.try_divide(F.col("ties"), n * (n - 1)))
    z = F.try_divide(F.greatest(F.abs(u - n1 * n2 / 2) - 0.5, F.lit(0.0)), F.nullif(F.sqrt(variance), F.lit(0.0)))
    return out.select(*by, "n1", "n2", "median_in", "median_out", u.alias("u"), _two_sided(n1, n2, u, F.col("ties"), z).alias("p_value"), (1 - F.try_divide(2 * u, F.nullif(n1 * n2, F.lit(0.0)))).alias("rank_biserial"))


def compare_two(df: DataFrame, group: str, a: str, b: str, value: str) -> DataFrame:
    """Mann-Whitney between two groups over the whole table."""
    rows = df.where(F.col(group).isin(a, b)).withColumn("_in", F.col(group) == a).withColumn("_all", F.lit(1))
    return rank_sums(rows, ["_all"], value, "_in").drop("_all")


def category_tests(df: DataFrame, label: str, value: str, brand: str = "brand", min_n: int = 20, key: str = "video_id") -> DataFrame:
    """Each label of a brand against the brand's other posts, with adjusted p.

    Membership is expanded as (brand, category) sums over distinct values: the category's own
    counts are subtracted from the brand's, so no row is repeated for every category.
    """
    rows = settled(df.where(F.col(brand).isNotNull() & F.col(value).isNotNull()).select(brand, label, value, key))
    whole = rows.groupBy(brand, value).agg(F.count("*").alias("t"))
    whole = before_counts(whole, [brand], value, "t").withColumn("rank", F.col("before") + (F.col("t") + 1) / 2)
    labelled = levels_of(rows, label)
    mine = labelled.groupBy(brand, F.col(label).alias("category"), value).agg(F.count_distinct(key).alias("a"))
    t = F.col("t").cast("double")
    totals = whole.groupBy(brand).agg(F.sum("t").alias("n"), F.sum(t * t * t - t).alias("ties"))
    sums = mine.join(whole, [brand, value]).groupBy(brand, "category").agg(F.sum("a").alias("n_category"), F.sum(F.col("a") * F.col("rank")).alias("r1"))
    medians = exact_quantiles(labelled.dropDuplicates([brand, label, key]), {brand: brand, "category": label}, {"median_category": (value, 0.5)})
    sums = sums.join(medians, [brand, "category"])
    out = sums.join(totals, brand).withColumn("n_other", F.col("n") - F.col("n_category")).where((F.col("n_category") >= min_n) & (F.col("n_other") >= 5))
    n1, n2, n = F.col("n_category").cast("double"), F.col("n_other").cast("double"), F.col("n").cast("double")
    u = F.col("r1") - n1 * (n1 + 1) / 2
    variance = n1 * n2 / 12 * (n + 1 - F.col("ties") / (n * (n - 1)))
    z = F.try_divide(F.greatest(F.abs(u - n1 * n2 / 2) - 0.5, F.lit(0.0)), F.nullif(F.sqrt(variance), F.lit(0.0)))
    out = out.select(F.col(brand).alias("brand"), "category", "n_category", "n_other", "median_category", u.alias("u"), _two_sided(n1, n2, u, F.col("ties"), z).alias("p_value"), (1 - 2 * u / (n1 * n2)).alias("rank_biserial"))
    # a row per test: written once, since the adjustment reads it several times
    return adjust(settled(out), "p_value")


def adjust(df: DataFrame, p: str, name: str = "p_adj") -> DataFrame:
    """Benjamini-Hochberg over a table of tests of any size; null p stays null, equal p are adjusted alike.

    Works on the distinct p with their counts, range by range: the smallest p * m / rank of the
    larger values is a minimum inside a range, and one over the ranges after it (some dozens).
    """
    tested = df.where(F.col(p).isNotNull())
    cells = before_counts(tested.groupBy(F.col(p).alias("_p")).agg(F.count("*").alias("_c")), [], "_p", "_c", "_before", range_name="_range")
    m = tested.agg(F.count("*").alias("_m"))
    cells = cells.crossJoin(F.broadcast(m)).withColumn("_s", F.col("_p") * F.col("_m") / (F.col("_before") + F.col("_c")))  # one row
    later = cells.groupBy(F.col("_range").alias("_r")).agg(F.min("_s").alias("_l"))
    later = later.withColumn("_later", F.min("_l").over(Window.orderBy("_r").rowsBetween(1, Window.unboundedFollowing)))  # a row a range
    inside = F.min("_s").over(Window.partitionBy("_range").orderBy("_p").rowsBetween(Window.currentRow, Window.unboundedFollowing))
    cells = cells.withColumn("_in", inside).join(F.broadcast(later), F.col("_range") == F.col("_r"))  # 64 rows at most
    done = tested.join(cells.select("_p", F.least(F.lit(1.0), "_in", "_later").alias(name)), F.col(p) == F.col("_p")).drop("_p")
    return done.unionByName(df.where(F.col(p).isNull()).withColumn(name, F.lit(None).cast("double")))


def average_ranks(df: DataFrame, value: str, name: str, by: list[str] = ()) -> DataFrame:
    cells = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_t"))
    ranks = before_counts(cells, list(by), value, "_t").withColumn(name, F.col("before") + (F.col("_t") + 1) / 2)
    return df.join(ranks.drop("_t", "before"), [*by, value], "left")


def spearman(df: DataFrame, x: str, y: str, by: list[str] = ()) -> DataFrame:
    """Rank correlation over rows with both values, per group; null below three rows."""
    by = list(by)
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).alias("_x"), F.col(y).alias("_y"))
    ranked = average_ranks(average_ranks(rows, "_x", "_rx", by), "_y", "_ry", by)
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), F.when(F.count("*") >= 3, F.corr("_rx", "_ry")).alias("rho"))


def stratified_sample(df: DataFrame, stratum: str, n: int, key: str, seed: int = 7) -> DataFrame:
    """Exactly n rows (all, if fewer), spread over the strata in proportion; the remainder by largest fraction."""
    counts = df.groupBy(stratum).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_t"))
    share = counts.crossJoin(F.broadcast(total)).withColumn("_exact", F.least(F.lit(n), F.col("_t")) * F.col("_n") / F.col("_t"))  # one row
    share = share.withColumn("_floor", F.floor("_exact"))
    left = share.agg((F.max(F.least(F.lit(n), F.col("_t"))) - F.sum("_floor")).alias("_left"))
    order = F.row_number().over(Window.orderBy(F.desc(F.col("_exact") - F.col("_floor")), F.asc_nulls_last(stratum)))
    quota = share.withColumn("_place", order).crossJoin(F.broadcast(left)).select(F.col(stratum).alias("_s"), (F.col("_floor") + (F.col("_place") <= F.col("_left")).cast("int")).alias("_q"))  # one row
    # rows of a stratum stand in the order of their md5: counts by its first 48 bits say how far the quota
    # reaches, and only rows at that very value are ordered
    head = F.conv(F.substring(_md5(key, seed), 1, 12), 16, 10).cast("long")
    rows = df.withColumns({"_h": head, "_md5": _md5(key, seed)})
    cells = before_counts(rows.groupBy(F.col(stratum).alias("_st"), F.col("_h").alias("_ch")).agg(F.count("*").alias("_c")), ["_st"], "_ch", "_c")
    cells = cells.join(quota, F.col("_st").eqNullSafe(F.col("_s"))).where("before < _q").select("_st", "_ch", "_c", (F.col("_q") - F.col("before")).alias("_need"))
    taken = rows.join(cells, F.col(stratum).eqNullSafe(F.col("_st")) & (F.col("_h") == F.col("_ch")))
    place = F.row_number().over(Window.partitionBy("_st", "_ch").orderBy("_md5", key))
    return taken.withColumn("_r", place).where("_r <= _need").select(df.columns)


def _md5(key: str, seed: int) -> Column:
    """A hash that orders alike in any engine; a null key is hashed as empty."""
    return F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(f"-{seed}")).cast("binary"))


def _by_hash(df: DataFrame, by: str, key: str, seed: int) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(_md5(key, seed), F.col(key))))


def capped_sample(df: DataFrame, label: str, cap: int, key: str, seed: int = 7) -> DataFrame:
    """At most ``cap`` rows of each class, chosen by hash."""
    return _by_hash(df, label, key, seed).where(F.col("_r") <= cap).drop("_r")


def half_even(c: Column) -> Column:
    return F.bround(c).cast("long")
