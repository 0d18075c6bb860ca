"""Query registry shared by ``__spark_entry__`` and ``bench.py``.

Each registered query is ``fn(spark, sf_dir) -> DataFrame`` plus, when the
operator is SQL-expressible, an independent DuckDB query written from the
operator's definition (not from our plan).  Fixture views are referenced by
name in the SQL and expanded by ``fixtures.with_views``.

Doubles are rounded to ``DIGITS`` decimals on *both* sides, because sums of
doubles depend on the summation order.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import fixtures

DIGITS = 9


@dataclass
class Query:
    name: str
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    ops: str


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None, ops: str = ""):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, fixtures.with_views(sql) if sql else None, ops)
        return fn
    return deco


def R(c: Column | str, digits: int = DIGITS) -> Column:
    """Round a double for the oracle comparison."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), digits)


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every double column of ``df``."""
    return df.select(*[R(f.name, digits).alias(f.name) if f.dataType.typeName() in ("double", "float")
                       else F.col(f.name) for f in df.schema.fields])
