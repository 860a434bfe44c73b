"""Table validation and filled rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import _filled


def validate(df: DataFrame, required: list[str] = (), allowed: dict[str, list[str]] | None = None, ranges: dict[str, tuple] | None = None, floors: dict[str, float] | None = None, strict: bool = False) -> DataFrame:
    """(rule, violations): missing columns, values not allowed, out of range, and with ``strict`` rates below a floor.

    Everything about rows is one aggregation; nulls violate nothing but floors.
    """
    checks: dict[str, Column] = {f"required_{c}": F.lit(1) for c in required if c not in df.columns}
    for c, values in (allowed or {}).items():
        checks[f"allowed_{c}"] = F.count_if(~F.col(c).isin(values))
    for c, (low, high) in (ranges or {}).items():
        bad = F.lit(False)
        bad = bad | (F.col(c) < low) if low is not None else bad
        bad = bad | (F.col(c) > high) if high is not None else bad
        checks[f"range_{c}"] = F.count_if(bad)
    for c, least in (floors or {}).items() if strict else ():
        checks[f"floor_{c}"] = (F.avg(_filled(df, c).cast("int")) < least).cast("int")
    row = df.agg(F.count("*").alias("_n"), *[c.cast("long").alias(n) for n, c in checks.items()])
    return row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.coalesce(F.col(n), F.lit(0)).alias("violations")) for n in checks])).alias("r")).select("r.*")


def filled_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*[F.avg(_filled(df, c).cast("int")).alias(c) for c in columns])


def coverage_note(covered: Column, total: Column) -> Column:
    return F.format_string("coverage: %d of %d (%.1f%%)", covered, total, covered * 100.0 / total)
