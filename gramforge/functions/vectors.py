"""Vector algebra as column and table functions: what an aligned numeric vector can do, a column can.

Comparison, arithmetic, element-wise functions and casts are Column operators already and need no wrapper; here are the
ones with a meaning of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def any_true(c: Column) -> Column:
    return F.coalesce(F.bool_or(c), F.lit(False))


def all_true(c: Column) -> Column:
    return F.coalesce(F.bool_and(c), F.lit(True))


def dot(a: Column, b: Column) -> Column:
    return F.coalesce(F.sum(a * b), F.lit(0.0))


def is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def is_infinite(c: Column) -> Column:
    return F.abs(c) == F.lit(float("inf"))


def condition(test: Column, yes: Column, no: Column) -> Column:
    """yes where test holds, no where it doesn't or is null."""
    return F.when(test, yes).otherwise(no)


def mask_assign(mask: Column, new: Column, old: Column) -> Column:
    return condition(mask, new, old)


def index_assign(rows: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """rows with the value that `new` (one row per key) has for their key; others, and those with a null there, stay."""
    own = new.select(key, F.col(value).alias("__new"))
    return rows.join(own, key, "left").withColumn(value, F.coalesce("__new", F.col(value))).drop("__new")


def bin_count(rows: DataFrame, key: str) -> DataFrame:
    """(key, n): rows of each key."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def bin_clipped_count(rows: DataFrame, value: str, size: int) -> DataFrame:
    """(value, n) for values from 0 to size - 1; others are ignored."""
    return rows.where((F.col(value) >= 0) & (F.col(value) < size)).groupBy(value).agg(F.count(F.lit(1)).alias("n"))


def bin_weight(rows: DataFrame, key: str, weight: str, mask: Column | None = None) -> DataFrame:
    """(key, total): sum of the weights of each key, of the rows in the mask."""
    w = F.col(weight) if mask is None else F.when(mask, F.col(weight)).otherwise(F.lit(0))
    return rows.groupBy(key).agg(F.sum(w).alias("total"))


def lookup(rows: DataFrame, table: DataFrame, key: str, value: str, default: object) -> DataFrame:
    """rows with the table's value of their key, or the default: a gather over a foreign key."""
    return rows.join(table.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))
