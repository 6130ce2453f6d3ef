"""Whole runs from files to files: cleaning a CSV, chunking article records, a chunking experiment with its summary and report."""

from __future__ import annotations

import json
import time
from collections.abc import Iterable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from reedmill.functions import text as T
from reedmill.operators import chunking, ingest
from reedmill.operators.chunking import ChunkingConfig
from reedmill.operators.ingest import PreprocessConfig
from reedmill.sources import readers, writers


def process_csv(spark: SparkSession, source: str, output: str, review_output: str | None = None, review_limit: int = 200, config: PreprocessConfig = PreprocessConfig(), mode: str = "errorifexists") -> dict[str, int]:
    """Cleans a CSV of articles into JSON lines; the counters come with the same pass.  Rows under review are a second, short one."""
    read, written = Observation("read"), Observation("written")
    rows = readers.csv_rows(spark, source).observe(read, F.count(F.lit(1)).alias("rows_read"), F.count_if(~ingest.present()).alias("missing_required"))
    records = ingest.articles(rows, config)
    writers.json_lines(ingest.observed(records, written).drop("raw_content"), output, mode)
    counters = {**read.get, **written.get, "review_rows": 0}
    if review_output:
        picked = ingest.review_rows(records, "article_id", review_limit)
        writers.json_lines(picked, review_output, mode)
        counters["review_rows"] = spark.read.text(review_output).count()
    return counters


def chunk_records(articles: DataFrame, output: str, config: ChunkingConfig = ChunkingConfig(), mode: str = "errorifexists") -> dict[str, int | float | None]:
    """Writes the chunks of article records as JSON lines; the statistics come with the same pass, with the time it took."""
    read, written = Observation("articles"), Observation("chunks")
    short = F.coalesce(F.col("metadata.is_short"), F.lit(False)) if "metadata" in articles.columns else F.length(F.coalesce("content", F.lit(""))) < PreprocessConfig().min_content_chars
    seen = articles.observe(read, F.count(F.lit(1)).alias("articles_read"), F.count_if(short).alias("short_articles"), F.count_if(T.strip(F.coalesce("content", F.lit(""))) == "").alias("empty_articles"))
    m = lambda f: F.col(f"metadata.{f}")
    bounds = [a(m(f)).alias(f"{name}_chunk_{part}") for f, part in (("token_count", "tokens"), ("chunk_chars", "chars")) for name, a in (("total", F.sum), ("min", F.min), ("max", F.max))]
    chunked = chunking.chunks(seen, config).observe(written, F.count(F.lit(1)).alias("chunks_written"), F.count_if(m("truncated_article") & (m("chunk_index") == 0)).alias("truncated_articles"), *bounds)
    started = time.perf_counter()
    writers.json_lines(chunked, output, mode)
    stats = {**read.get, **written.get, "elapsed_seconds": round(time.perf_counter() - started, 6)}
    n = stats["chunks_written"]
    share = lambda a, b: round((a or 0) / b, 4) if b else 0
    return stats | {
        "total_chunk_tokens": stats["total_chunk_tokens"] or 0, "total_chunk_chars": stats["total_chunk_chars"] or 0, "max_chunk_tokens": stats["max_chunk_tokens"] or 0, "max_chunk_chars": stats["max_chunk_chars"] or 0,
        "avg_chunks_per_article": share(n, stats["articles_read"]), "avg_chunk_tokens": share(stats["total_chunk_tokens"], n), "avg_chunk_chars": share(stats["total_chunk_chars"], n), "chunks_per_second": round(n / stats["elapsed_seconds"], 4),
    }


def chunking_experiment(spark: SparkSession, source: str, folder: str, configs: Iterable[ChunkingConfig], limit: int | None = None, mode: str = "errorifexists") -> dict[str, dict]:
    """Chunks one file under several configurations, and writes a summary and a report beside the chunks."""
    runs: dict[str, dict] = {}
    for config in configs:
        output = f"{folder}/chunks_{config.strategy}.jsonl"
        stats = chunk_records(readers.json_lines(spark, source, limit=limit), output, config, mode)
        runs[config.strategy] = {"output_path": output, "config": dict(vars(config)), "stats": stats}
        print(f"{config.strategy}: {stats['articles_read']} articles, {stats['chunks_written']} chunks, {stats['elapsed_seconds']} s -> {output}")
    texts = {"chunking_summary.json": json.dumps(runs, ensure_ascii=False, indent=2), "chunking_report.md": writers.report([{"strategy": s, **r["stats"]} for s, r in runs.items()])}
    for name, text in texts.items():
        writers.text(spark, text, f"{folder}/{name}")
    print(f"{sum(r['stats']['chunks_written'] for r in runs.values())} chunks under {len(runs)} strategies, summary and report in {folder}")
    return runs
