"""Latest-wins views over append-only tables: the store's upserts, lookups and orphan checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key by `order`, which should end in a tie-breaker. Keys with null are keys like others."""
    last = Window.partitionBy(*keys).orderBy(*[c.desc_nulls_last() for c in order])
    return df.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], order: list[Column], keep: tuple[str, ...] = ()) -> DataFrame:
    """`base` with the last change of each key; columns in `keep` stay as they were in rows that exist."""
    last = latest(changes, keys, order)
    if keep:
        old = base.select(*keys, *[F.col(c).alias(f"_old_{c}") for c in keep])
        last = last.join(old, keys, "left").select(*[F.coalesce(f"_old_{c}", c).alias(c) if c in keep else F.col(c) for c in base.columns])
    return base.join(last, keys, "left_anti").unionByName(last.select(*base.columns))


def missing_parents(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows of `child` whose key no parent has."""
    return child.join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")


def existing_first(df: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """`df` with `reviewed`: whether `others` has its key. Sorting by it puts the open rows first."""
    marks = others.select(key).distinct().withColumn("_there", F.lit(True))
    return df.join(marks, key, "left").withColumn("reviewed", F.col("_there").isNotNull()).drop("_there")


def search(df: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Rows whose columns, joined and in lower case, contain the text."""
    return df.filter(F.lower(F.concat_ws(" ", *columns)).contains(text.lower()))


def matching(df: DataFrame, **equal) -> DataFrame:
    """Rows where each given column equals its value, or is in it if that is a list, in which None stands for null; None alone leaves a column open."""
    for column, value in equal.items():
        if isinstance(value, (list, tuple, set)):
            known = F.col(column).isin(*[v for v in value if v is not None])
            df = df.filter(known | F.col(column).isNull() if None in value else known)
        elif value is not None:
            df = df.filter(F.col(column) == value)
    return df
