"""What the query modules share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features as fe
from ..sources.landing import settled  # noqa: F401  (the query modules take it from here)
from . import bindings

Query = Callable[[SparkSession, str], DataFrame]
BRANDS = ["north", "south"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tidy(df: DataFrame) -> DataFrame:
    """Doubles to six digits, integers to bigint: what both engines agree on."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        c = F.col(f"`{f.name}`")
        if kind in ("double", "float", "decimal"):
            # scaled, rounded, scaled back: F.round(x, 6) goes by the shortest decimal and takes other sides at .5
            c = F.round(c.cast("double") * 1e6) / 1e6 + F.lit(0.0)
        elif kind in ("integer", "short", "byte"):
            c = c.cast("bigint")
        out.append(c.alias(f.name))
    return df.select(*out)


def floats(query: str, *columns: str) -> str:
    """The DuckDB query with these columns rounded like ``tidy`` does."""
    if not columns:
        return query
    fixed = ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in columns)
    return f"SELECT * REPLACE ({fixed}) FROM (\n{query}\n) AS q"


def duck(query: str, *columns: str) -> str:
    return floats(bindings.duck(query), *columns)


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bindings.posts(spark, sf_dir)


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts with engagement, wer and bri.  The medians of bri read the posts too, so their sums are written once."""
    return fe.with_bri(fe.with_engagement(bindings.posts(spark, sf_dir, once=True)))


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bindings.comments(spark, sf_dir)
