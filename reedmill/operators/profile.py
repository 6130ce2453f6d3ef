"""Corpus profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nulls(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """One row (column, nulls) per column."""
    one = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    return one.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in columns))))


def profile(df: DataFrame, key: str = "article_id", content: str = "content") -> DataFrame:
    """Rows, distinct and repeated ids, and lengths of the content; a null content has length 0."""
    n = F.length(F.coalesce(F.col(content), F.lit("")))
    return df.agg(
        F.count("*").alias("rows"), F.countDistinct(key).alias("distinct_ids"), (F.count(key) - F.countDistinct(key)).alias("duplicate_ids"),
        F.min(n).alias("min_chars"), F.max(n).alias("max_chars"), F.sum(n).alias("total_chars"), F.avg(n).alias("avg_chars"), F.count_if(n == 0).alias("empty_contents"),
    )


def histogram(df: DataFrame, column: str = "category", most: int | None = None) -> DataFrame:
    """Rows per value, null as (null); the most frequent ones if a number is given."""
    counts = df.groupBy(F.coalesce(F.col(column), F.lit("(null)")).alias(column)).agg(F.count("*").alias("n"))
    return counts if most is None else counts.orderBy(F.desc("n"), column).limit(most)


def duplicates_across(df: DataFrame, key: str = "article_id", split: str = "split") -> DataFrame:
    """Ids that stand more than once: in how many rows and splits."""
    # a row per id and split first, so that no id of any size gathers in one task
    per = df.where(F.col(key).isNotNull()).groupBy(key, split).agg(F.count("*").alias("n"))
    return per.groupBy(key).agg(F.sum("n").alias("rows"), F.count(split).alias("splits")).where("rows > 1")


def typed_corpus(raw: DataFrame) -> DataFrame:
    """The typed corpus: a number as id, null where it is none, and absent columns as null."""
    out = raw
    for c in ("id", "title", "description", "content", "category"):
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("string"))
    return out.select(F.trim("id").try_cast("bigint").alias("id"), "title", "description", "content", "category")
