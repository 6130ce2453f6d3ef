"""Raw rows to cleaned article records, with quality flags, review rows and counters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from reedmill.functions import text as T

REQUIRED = ("id", "title", "description", "content", "category")
FLAGS = ("short_content", "long_content", "html_like", "url_like")


@dataclass(frozen=True)
class PreprocessConfig:
    min_content_chars: int = 300
    max_content_chars: int = 20_000
    strip_urls: bool = False
    include_embedding_text: bool = True


def require(df: DataFrame, columns: tuple[str, ...] = REQUIRED) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def present(columns: tuple[str, ...] = REQUIRED) -> Column:
    """Whether no required field is null or empty; blanks count as present."""
    out = F.lit(True)
    for c in columns:
        out &= F.coalesce(F.col(c) != "", F.lit(False))
    return out


def articles(raw: DataFrame, config: PreprocessConfig = PreprocessConfig(), extra: tuple[str, ...] = ()) -> DataFrame:
    """Cleaned article records of the rows in which nothing required is missing; extra columns are kept."""
    rows = require(raw).where(present())
    c = {x: T.clean(F.col(x), config.strip_urls) for x in REQUIRED[1:]}
    rows = rows.select(*extra, T.clean(F.col("id"), True).alias("article_id"), *(e.alias(x) for x, e in c.items()), F.col("content").alias("raw_content"))
    flags = T.quality_flags(F.col("raw_content"), F.col("content"), config.min_content_chars, config.max_content_chars)
    chars = lambda x: F.length(x).alias(f"{x}_chars")
    metadata = F.struct("article_id", "title", "description", "category", chars("content"), chars("title"), chars("description"), (F.length("content") < config.min_content_chars).alias("is_short"), (F.length("content") > config.max_content_chars).alias("is_long"))
    text = T.document_text(F.col("title"), F.col("description"), F.col("category"), F.col("content")) if config.include_embedding_text else F.col("content")
    return rows.select(*extra, "article_id", "title", "description", "content", "category", text.alias("text"), metadata.alias("metadata"), flags.alias("quality_flags"), "raw_content")


def review_rows(records: DataFrame, order: str, most: int | None = 100) -> DataFrame:
    """Records with a flag or a changed content, the first ones in the given order, with previews."""
    picked = records.where((F.size("quality_flags") > 0) | ~F.col("raw_content").eqNullSafe(F.col("content")))
    picked = picked.select(*dict.fromkeys((order, "article_id")), "title", "category", "quality_flags", T.preview(F.col("raw_content")).alias("raw_content_preview"), T.preview(F.col("content")).alias("clean_content_preview"))
    return picked if most is None else picked.orderBy(order).limit(most)


def counters(raw: DataFrame, config: PreprocessConfig = PreprocessConfig()) -> DataFrame:
    """Rows read, written and missing something, and the count of each flag, in one scan; only what the flags need is cleaned."""
    content = T.clean(F.when(present(), F.col("content")), config.strip_urls)
    rows = require(raw).select(present().alias("fine"), F.col("content").alias("raw_content"), content.alias("content"))
    flags = T.quality_flags(F.col("raw_content"), F.col("content"), config.min_content_chars, config.max_content_chars)
    rows = rows.select("fine", F.when(F.col("fine"), flags).alias("flags"))
    return rows.agg(F.count("*").alias("rows_read"), F.count_if(~F.col("fine")).alias("missing_required"), F.count_if("fine").alias("rows_written"), *(F.count_if(F.array_contains("flags", f)).alias(f) for f in FLAGS))


def observed(records: DataFrame, observation: Observation) -> DataFrame:
    """The records; the counters are filled in by the job that writes them."""
    return records.observe(observation, F.count(F.lit(1)).alias("rows_written"), *(F.count_if(F.array_contains("quality_flags", f)).alias(f) for f in FLAGS))
