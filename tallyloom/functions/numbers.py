"""Numeric and array expressions with the null rules of the tables: a bad or missing value is null, never NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(c: Column) -> Column:
    """Double, or null where the text is no finite number."""
    d = c.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is null or 0."""
    return F.try_divide(a.cast("double"), F.nullif(b.cast("double"), F.lit(0.0)))


def share(condition: Column) -> Column:
    """Share of rows where the condition holds; null counts as not."""
    return F.avg(F.coalesce(condition.cast("int"), F.lit(0)))


def bins(value: Column, edges: list[float], names: list[str], right_closed: bool = False) -> Column:
    """Name of the bin; len(names) == len(edges) + 1; null stays null."""
    out = F.when(value.isNull(), F.lit(None))
    for edge, name in zip(edges, names, strict=False):
        out = out.when(value <= edge if right_closed else value < edge, name)
    return out.otherwise(names[-1])


def position(value: Column, order: list[str]) -> Column:
    """Place of a category in its order, from 0; null for others."""
    out = F.lit(None).cast("int")
    for i, name in reversed(list(enumerate(order))):
        out = F.when(value == name, F.lit(i)).otherwise(out)
    return out


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector at length 1; null for an empty, zero or non-finite one."""
    # as a lambda's variable the norm is computed once, not once per element
    scaled = F.transform(F.array(norm(a)), lambda n: F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)))
    return F.when(valid_vector(a), scaled[0])


def valid_vector(a: Column) -> Column:
    return F.coalesce((F.size(a) > 0) & F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def normal_tail(z: Column) -> Column:
    """Two-sided tail 2(1 - Phi(|z|)) by a rational approximation, absolute error below 1.5e-7."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)
