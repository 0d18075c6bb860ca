"""Shared helpers for combining bounded aggregates without joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scalar_of(agg: DataFrame) -> Column:
    """A one-row aggregate as a scalar-subquery Column (a struct of its
    columns).  Spark runs the subquery once and inlines the value: no join."""
    return agg.select(F.struct(*agg.columns).alias("_s")).scalar()


def one_row(*parts: DataFrame) -> DataFrame:
    """Side-by-side concatenation of global (one-row) aggregates."""
    spark = parts[0].sparkSession
    cols = []
    for p in parts:
        s = scalar_of(p)
        cols += [s.getField(c).alias(c) for c in p.columns]
    return spark.range(1).select(*cols)
