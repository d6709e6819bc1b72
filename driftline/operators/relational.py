"""Small relational operators that several steps share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first in an order that should be total."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__k", rank).where("__k = 1").drop("__k")


def group_number(df: DataFrame, keys: list[str], name: str, offset: int = 0) -> DataFrame:
    """df with a number for each distinct key, in key order from offset. Keys are numbered apart from the rows and by ranges, so no task sorts all of either."""
    numbered = row_ids(df.select(*keys).distinct(), [F.col(k) for k in keys], name).withColumn(name, F.col(name) + offset)
    numbered = numbered.withColumnsRenamed({k: f"__{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return df.join(numbered, same).select(*df.columns, name)


def row_ids(df: DataFrame, order: list[Column], name: str = "id") -> DataFrame:
    """df with row numbers from 0 in a total order: counts by range partition first, then places within each."""
    from ..session import written

    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = written(df.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()), "ranged")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy("__part").count().withColumn("__start", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return parts.withColumn("__k", place).join(F.broadcast(starts), "__part").withColumn(name, (F.col("__start") + F.col("__k") - 1).cast("long")).drop("__part", "__k", "__start")


def suffixed(df: DataFrame, suffix: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return df.withColumnsRenamed({c: c + suffix for c in df.columns if c not in keep})


def flagged(df: DataFrame, keys: DataFrame, on: str, name: str) -> DataFrame:
    """df with a flag: whether its value of `on` is in keys' only column. Null isn't."""
    known = keys.toDF("__key").where("__key is not null").distinct().withColumn(name, F.lit(True))
    return df.join(known, df[on] == known["__key"], "left").drop("__key").withColumn(name, F.coalesce(name, F.lit(False)))


def difference(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """a's value less b's for every key of either, a missing value counting as 0. Null keys are left out."""
    a = a.select(*keys, F.col(value).alias("__a")).dropna(subset=keys)
    b = b.select(*keys, F.col(value).alias("__b")).dropna(subset=keys)
    zero = F.lit(0)
    return a.join(b, keys, "full_outer").withColumn(value, F.coalesce("__a", zero) - F.coalesce("__b", zero)).select(*keys, value)


def dense_grid(df: DataFrame, left: str, right: str, value: str) -> DataFrame:
    """Every pair of the distinct values of two columns with its value, 0 where df has none. Both should have few values."""
    grid = df.select(left).distinct().crossJoin(F.broadcast(df.select(right).distinct()))
    return grid.join(df.select(left, right, value), [left, right], "left").withColumn(value, F.coalesce(value, F.lit(0)))


def expect_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """df, if no two rows have the same key; else a ValueError."""
    if not df.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError(f"{keys} are not unique")
    return df


def expect_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    return df


def expect_no_nulls(df: DataFrame, columns: list[str]) -> DataFrame:
    if not df.where(" or ".join(f"`{c}` is null" for c in columns)).isEmpty():
        raise ValueError(f"nulls in {columns}")
    return df
