"""First-wins deduplication (D1, D2, J6, W1) and the page report that crosses it with counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_by(df: DataFrame, key: Column, order: Column) -> DataFrame:
    """One row of each key, the first by `order`; map-side aggregation keeps hot keys out of single tasks."""
    row = F.struct(*df.columns)
    return df.groupBy(key.alias("__key")).agg(F.min_by(row, order).alias("__row")).select("__row.*")


def with_first(df: DataFrame, key: Column, order: Column) -> DataFrame:
    """df and `first`, the order value of its key's first row: a row wins if they are equal."""
    keyed = df.withColumn("__key", key)
    firsts = keyed.groupBy("__key").agg(F.min(order).alias("first"))
    return keyed.join(firsts, "__key").drop("__key")
