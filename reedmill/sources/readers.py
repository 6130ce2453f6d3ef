"""Sources: article tables from CSV, JSON lines and Parquet, question-answer records, and splits of a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAW = "id string, title string, description string, content string, category string"
ARTICLE = (
    "article_id string, title string, description string, content string, category string, text string, "
    "metadata struct<article_id: string, title: string, description: string, category: string, content_chars: int, title_chars: int, description_chars: int, is_short: boolean, is_long: boolean>, quality_flags array<string>"
)
QA = "id string, article_id string, question string, qa_type string, answers array<string>, is_possible boolean, plausible_answers array<string>, source_article_ids array<bigint>"
#: Texts that count as missing in tables read for profiling.
MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
SPLITS = ("train", "validation", "test")


def header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV file."""
    return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"').columns


def csv_rows(spark: SparkSession, path: str, need: tuple[str, ...] = ("id", "title", "description", "content", "category")) -> DataFrame:
    """CSV by its header: doubled quotes, line breaks inside quotes, a byte order mark; all columns as text.

    A quoted file cannot be split, so its rows are spread over the cluster after reading.  Empty fields are null.
    """
    names = header(spark, path)
    absent = [c for c in need if c not in names]
    if absent:
        raise ValueError(f"missing columns: {', '.join(absent)}")
    schema = ", ".join(f"`{c}` string" for c in names)
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, quote='"', escape='"').repartition(spark.sparkContext.defaultParallelism)


def profiled_rows(spark: SparkSession, path: str) -> DataFrame:
    """CSV for profiling: texts like NA are null, and absent columns are added as null."""
    rows = csv_rows(spark, path, ())
    rows = rows.select(*(F.when(~F.col(c).isin(MISSING), F.col(c)).alias(c) for c in rows.columns))
    for c in ("id", "title", "description", "content", "category"):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("string"))
    return rows


def json_lines(spark: SparkSession, path: str, schema: str = ARTICLE, limit: int | None = None) -> DataFrame:
    """JSON lines, blank ones skipped; a broken line raises."""
    df = spark.read.schema(schema).json(path, mode="FAILFAST")
    return df if limit is None else df.limit(limit)


def qa_records(spark: SparkSession, path: str, tolerant: bool = False) -> DataFrame:
    """Question-answer records; a tolerant reader (for resuming) leaves broken lines out.  article_id stays JSON text."""
    return spark.read.schema(QA).json(path, mode="DROPMALFORMED" if tolerant else "FAILFAST")


def parquet_ids(spark: SparkSession, path: str, key: str = "id") -> DataFrame:
    """Only the ids are read."""
    return spark.read.parquet(path).select(key)


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def splits(spark: SparkSession, folder: str, read, suffix: str, names: tuple[str, ...] = SPLITS) -> DataFrame:
    """The present splits of a corpus with their name; absent files are skipped."""
    out = None
    for name in names:
        path = f"{folder}/{name}{suffix}"
        if exists(spark, path):
            part = read(spark, path).withColumn("split", F.lit(name))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError(f"no split in {folder}")
    return out


def load_split(spark: SparkSession, path: str) -> DataFrame:
    """One split from a file or folder, by the ending of its name: CSV, JSON lines or Parquet."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    return csv_rows(spark, path, ()) if path.endswith(".csv") else json_lines(spark, path)


def count_lines(spark: SparkSession, path: str) -> int:
    """Lines that are not blank."""
    return spark.read.text(path).where(F.trim("value") != "").count()
