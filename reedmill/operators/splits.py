"""Reducers of splits: the first rows in a given order, or those and a set of ids."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_rows(df: DataFrame, n: int, order: str) -> DataFrame:
    return df.orderBy(order).limit(n)


def first_or_listed(df: DataFrame, n: int, ids: Iterable[str], order: str, key: str = "article_id") -> DataFrame:
    """The first n rows in the order of a unique column, and all rows with a listed id; by_position tells the first."""
    ids = sorted(set(ids))
    last = df.orderBy(order).limit(n).agg(F.max(order).alias("last"))
    by_position = F.coalesce(F.col(order) <= F.col("last"), F.lit(False))
    rows = df.crossJoin(F.broadcast(last)).withColumn("by_position", by_position).drop("last")  # last is one row
    return rows.where(F.col("by_position") | F.col(key).cast("string").isin(ids))


def reducer_stats(df: DataFrame, kept: DataFrame, ids: Iterable[str], key: str = "article_id") -> DataFrame:
    """Rows read and kept by position and by id, and how many of the listed ids were found or not."""
    ids = sorted(set(ids))
    total = df.agg(F.count("*").alias("total"))
    listed = F.col(key).cast("string").isin(ids)
    counts = kept.agg(F.count_if("by_position").alias("kept_by_position"), F.count_if(~F.col("by_position")).alias("kept_by_id"), F.countDistinct(F.when(listed, F.col(key))).alias("found"))
    return total.crossJoin(counts).withColumn("not_found", F.lit(len(ids)) - F.col("found"))  # one row each


def cap_stats(df: DataFrame, n: int, order: str, key: str = "article_id") -> DataFrame:
    """Of a reducer to the first n rows: rows read, wanted and kept, and how many different ids the kept ones have."""
    total = df.agg(F.count("*").alias("total"))
    kept = first_rows(df, n, order).agg(F.count("*").alias("kept"), F.countDistinct(key).alias("distinct_kept_ids"))
    return total.crossJoin(kept).withColumn("target", F.lit(n))  # one row each


def missing_ids(df: DataFrame, wanted: DataFrame, key: str = "article_id") -> DataFrame:
    """Wanted ids that no row has."""
    return wanted.select(key).distinct().join(df.select(key), key, "left_anti")


def sample_per_group(df: DataFrame, group: str, key: str, size: int, seed: int = 0, salts: int = 16) -> DataFrame:
    """Up to ``size`` rows of each group by the smallest seeded hashes; ranked within salts first, then over their winners."""
    from pyspark.sql import Window

    rows = df.where(F.col(group).isNotNull()).withColumn("_h", F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))))
    rows = rows.withColumn("_s", F.pmod(F.hash(key), F.lit(salts)))
    order = ("_h", key)
    near = rows.withColumn("_r", F.row_number().over(Window.partitionBy(group, "_s").orderBy(*order))).where(F.col("_r") <= size)
    return near.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_r") <= size).drop("_h", "_s", "_r")
