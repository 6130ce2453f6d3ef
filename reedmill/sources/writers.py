"""Sinks: JSON lines, CSV, Parquet, appends, a summary and a report."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F


def json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Compact JSON lines; letters stay as they are and null fields are written."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def csv(df: DataFrame, path: str, mode: str = "errorifexists", order: str | None = None) -> None:
    """CSV with a header and doubled quotes; sorted by a column within files if one is given."""
    rows = df if order is None else df.sortWithinPartitions(order)
    rows.write.mode(mode).csv(path, header=True, quote='"', escape='"', emptyValue="")


def csv_text(df: DataFrame) -> DataFrame:
    """CSV records as one text column, for files with a byte order mark or of a single part."""
    quoted = [F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in df.columns]
    return df.select(F.concat_ws(",", *quoted).alias("value"))


def text(spark: SparkSession, content: str, path: str, byte_order_mark: bool = False) -> None:
    """One file with a text, written by the driver through the cluster's file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(("\ufeff" if byte_order_mark else "").encode() + content.encode()))
    finally:
        out.close()


def csv_with_mark(df: DataFrame, path: str, order: str) -> None:
    """CSV for spreadsheets: every part begins with a byte order mark and the header, so that each opens on its own."""
    head = "\ufeff" + ",".join(f'"{c}"' for c in df.columns)
    rows = csv_text(df.sortWithinPartitions(order))
    rows.mapInArrow(lambda batches: _headed(batches, head), "value string").write.text(path)


def _headed(batches: Iterator[pa.RecordBatch], head: str) -> Iterator[pa.RecordBatch]:
    above = [head]
    for batch in batches:
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays([pa.array(above + batch.column(0).to_pylist(), pa.string())], names=["value"])
            above = []


def parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path, compression="snappy")


def append(df: DataFrame, path: str) -> None:
    """One more batch of JSON lines behind those of earlier runs."""
    json_lines(df, path, "append")


def summary(stats: list[Row], configs: dict[str, dict], outputs: dict[str, str]) -> str:
    """JSON of strategy, its output, configuration and statistics."""
    by = {r["strategy"]: {k: v for k, v in r.asDict().items() if k != "strategy"} for r in stats}
    return json.dumps({s: {"output_path": outputs.get(s), "config": configs.get(s, {}), "stats": v} for s, v in by.items()}, ensure_ascii=False, indent=2)


def report(stats: list[Row] | list[dict], title: str = "Chunking report") -> str:
    """Markdown table of the statistics of each strategy, averages rounded to four digits."""
    head = ["strategy", "chunks", "chunks/article", "tokens/chunk", "min tokens", "max tokens", "chars/chunk"]
    fields = ["strategy", "chunks_written", "avg_chunks_per_article", "avg_chunk_tokens", "min_chunk_tokens", "max_chunk_tokens", "avg_chunk_chars"]
    cell = lambda v: f"{round(v, 4)}" if isinstance(v, float) else str(v)
    rows = [" | ".join(cell(r[f]) for f in fields) for r in sorted(stats, key=lambda r: r["strategy"])]
    return "\n".join([f"# {title}", "", f"| {' | '.join(head)} |", f"|{'---|' * len(head)}", *(f"| {r} |" for r in rows), ""])
