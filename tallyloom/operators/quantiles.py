"""Exact quantiles of groups of any size, with bounded memory in every task.

The keys and values are written once, narrow and without a shuffle.  Groups of up to ``WHOLE`` rows are
ordered whole, by their distinct values.  For a larger group a sketch brackets each wanted place; then one
pass counts the rows below the bracket and the distinct values inside it, and only those are ordered.  A
bracket that turns out not to hold its place is widened, so the result is exact whatever the sketch says.
Sketches are written before they are used: they depend on the order in which parts arrive, and two
evaluations may differ.  Values between two rows are interpolated.  Other aggregates join the result at
the end, a row a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.landing import settled

#: Rows up to which a group is ordered whole; the sketch's accuracy, and the half width of a bracket in its errors.
WHOLE, ACCURACY, MARGIN = 1_000_000, 10_000, 2

Quantiles = dict[str, tuple[Column | str, float]]


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _group(by: dict[str, Column | str]) -> Column:
    """The keys as one value that is never null itself."""
    return F.struct(F.lit(0).alias("_"), *[_column(c).alias(f"k{i}") for i, c in enumerate(by.values())])


def exact_quantiles(df: DataFrame, by: dict[str, Column | str], wanted: Quantiles) -> DataFrame:
    """One row per group that has a value: the keys, and a column per wanted (value, fraction).

    Null keys are groups; null values don't count.  Without keys it is one row, of nulls if there is no value.
    """
    columns = list({str(_column(v)): _column(v) for v, _ in wanted.values()}.items())
    place = {text: i for i, (text, _) in enumerate(columns)}
    narrow = settled(df.select(_group(by).alias("_g"), *[c.cast("double").alias(f"_v{i}") for i, (_, c) in enumerate(columns)]))  # read by several passes
    values = F.array(*[F.struct(F.lit(i).alias("_m"), F.col(f"_v{i}").alias("_v")) for i in range(len(columns))])
    rows = narrow.select("_g", F.explode(values).alias("_x")).select("_g", "_x.*").where("_v is not null")

    names = F.array(*[F.struct(F.lit(n).alias("_q"), F.lit(place[str(_column(v))]).alias("m"), F.lit(float(q)).alias("q")) for n, (v, q) in wanted.items()])
    large = settled(rows.groupBy("_g", "_m").agg(F.count("*").alias("_n")).where(F.col("_n") > WHOLE))  # few: at most one for ``WHOLE`` rows
    if large.take(1):
        small = rows.join(F.broadcast(large.drop("_n")), ["_g", "_m"], "left_anti")
        found = _in_order(_cells(small), names).unionByName(_in_brackets(rows, large, {n: (place[str(_column(v))], float(q)) for n, (v, q) in wanted.items()}))
    else:
        found = _in_order(_cells(rows), names)
    a, b = F.floor("_at"), F.ceil("_at")
    at = lambda n, p: F.max(F.when((F.col("_q") == n) & (F.col("_to") > p) & (F.col("_to") - F.col("_c") <= p), F.col("_v")))
    ends = [x for i, n in enumerate(wanted) for x in (at(n, a).alias(f"_a{i}"), at(n, b).alias(f"_b{i}"), F.max(F.when(F.col("_q") == n, F.col("_at"))).alias(f"_at{i}"))]
    out = found.groupBy(*(["_g"] if by else [])).agg(*ends)

    def value(i: int) -> Column:
        low, high, where = F.col(f"_a{i}"), F.col(f"_b{i}"), F.col(f"_at{i}")
        return F.when(low == high, low).otherwise(low * (F.ceil(where) - where) + high * (where - F.floor(where)))

    return out.select(*[F.col(f"_g.k{i}").alias(n) for i, n in enumerate(by)], *[value(i).alias(n) for i, n in enumerate(wanted)])


def _cells(rows: DataFrame) -> DataFrame:
    return rows.groupBy("_g", "_m", "_v").agg(F.count("*").alias("_c"))


def _in_order(cells: DataFrame, names: Column) -> DataFrame:
    """Cells of groups of up to ``WHOLE`` rows by wanted quantile (_q): rows up to the cell (_to) and the place (_at)."""
    whole = Window.partitionBy("_g", "_m")
    rows = cells.withColumns({"_to": F.sum("_c").over(whole.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)), "_n": F.sum("_c").over(whole)})
    rows = rows.select("_g", "_m", "_v", "_c", "_to", "_n", F.explode(names).alias("_w")).where("_w.m = _m")
    return rows.select("_g", "_v", "_c", "_to", F.col("_w._q").alias("_q"), (F.col("_w.q") * (F.col("_n") - 1)).alias("_at"))


def _in_brackets(rows: DataFrame, large: DataFrame, wanted: dict[str, tuple[int, float]]) -> DataFrame:
    """The same of large groups: the cells of a bracket around each wanted place, after one (null) of all rows below it."""
    mine = rows.join(F.broadcast(large), ["_g", "_m"])
    width = MARGIN / ACCURACY
    while True:
        ends = [x for _, q in wanted.values() for x in (max(0.0, q - width), min(1.0, q + width))]
        sketch = mine.groupBy("_g", "_m", "_n").agg(F.percentile_approx("_v", F.array(*map(F.lit, ends)), ACCURACY).alias("_e"))
        # where a bracket reaches an end of the order it is open: nothing is below -inf, and NaN is above all
        low = lambda i, q: F.lit(float("-inf")) if q - width <= 0 else F.get("_e", F.lit(2 * i))
        high = lambda i, q: F.lit(float("nan")) if q + width >= 1 else F.get("_e", F.lit(2 * i + 1))
        brackets = F.array(*[F.struct(F.lit(n).alias("_q"), F.lit(m).alias("m"), F.lit(q).alias("q"), low(i, q).alias("_low"), high(i, q).alias("_high")) for i, (n, (m, q)) in enumerate(wanted.items())])
        bracketed = sketch.select("_g", "_m", F.filter(brackets, lambda b: b["m"] == F.col("_m")).alias("_w"), "_n")
        bracketed = F.broadcast(settled(bracketed))  # a row a large group and column
        near = rows.join(bracketed, ["_g", "_m"]).select("_g", "_n", "_v", F.explode("_w").alias("_w")).where("_v <= _w._high")
        cell = F.when(F.col("_v") >= F.col("_w._low"), F.col("_v"))
        cells = near.groupBy("_g", F.col("_w._q").alias("_q"), cell.alias("_v")).agg(F.count("*").alias("_c"), F.first(F.col("_w.q") * (F.col("_n") - 1)).alias("_at"))
        running = F.sum("_c").over(Window.partitionBy("_g", "_q").orderBy(F.asc_nulls_first("_v")).rowsBetween(Window.unboundedPreceding, 0))
        found = settled(cells.withColumn("_to", running))
        reached = found.groupBy("_g", "_q").agg(F.max("_to").alias("to"), F.coalesce(F.max(F.when(F.col("_v").isNull(), F.col("_to"))), F.lit(0)).alias("below"), F.first("_at").alias("at"))
        if width >= 1 or not reached.where((F.floor("at") < F.col("below")) | (F.ceil("at") >= F.col("to"))).take(1):
            return found.select("_g", "_v", "_c", "_to", "_q", "_at")
        width *= 8


def group_stats(df: DataFrame, by: dict[str, Column | str] | list[str], aggregates: list[Column], wanted: Quantiles) -> DataFrame:
    """groupBy(by).agg(aggregates) with exact quantiles beside them (null for a group without a value)."""
    by = by if isinstance(by, dict) else {c: c for c in by}
    found = exact_quantiles(df, by, wanted)
    if not by:
        return df.agg(*aggregates).crossJoin(F.broadcast(found))  # one row
    stats = df.groupBy(*[_column(c).alias(n) for n, c in by.items()]).agg(*aggregates)
    key = lambda: F.struct(F.lit(0).alias("_"), *[F.col(n).alias(f"k{i}") for i, n in enumerate(by)])
    right = found.select(key().alias("_g"), *wanted)
    extra = [F.col(f"`{c}`") for c in stats.columns if c not in by]
    return stats.withColumn("_g", key()).join(right, "_g", "left").select(*by, *extra, *wanted)


def table_quantiles(df: DataFrame, value: str, fractions: list[float]) -> list[float]:
    """Any number of exact quantiles of a whole column on the driver: at most two rows a fraction are fetched."""
    from .stats import before_counts

    cells = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    n = df.agg(F.count(value)).first()[0]
    if not n:
        raise ValueError(f"no value in {value}")
    places = sorted({p for q in fractions for p in (int(q * (n - 1)), min(n - 1, int(q * (n - 1)) + 1))})
    wanted = F.filter(F.array(*[F.lit(p).cast("long") for p in places]), lambda p: (p >= F.col("before")) & (p < F.col("before") + F.col("_c")))
    rows = before_counts(cells, [], "_v", "_c").select("_v", F.explode(wanted).alias("p")).collect()
    at = {r.p: r._v for r in rows}
    out = []
    for q in fractions:
        k = int(q * (n - 1))
        rest = q * (n - 1) - k
        out.append(at[k] if rest == 0 else at[k] * (1 - rest) + at[k + 1] * rest)
    return out
