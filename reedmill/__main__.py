"""Commands: ``python -m reedmill ingest`` cleans a CSV, ``python -m reedmill chunk`` chunks article records."""

from __future__ import annotations

import argparse
import json

from reedmill.operators.chunking import STRATEGIES, ChunkingConfig
from reedmill.operators.ingest import PreprocessConfig


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="reedmill", description="Prepare a corpus of articles.")
    commands = out.add_subparsers(dest="command", required=True)
    a = commands.add_parser("ingest", help="clean a CSV of articles into JSON lines")
    a.add_argument("--input", required=True)
    a.add_argument("--output", required=True)
    a.add_argument("--review-output", default="", help="rows to look at, with previews; none if empty")
    a.add_argument("--review-limit", type=int, default=200)
    a.add_argument("--min-content-chars", type=int, default=300)
    a.add_argument("--long-content-chars", type=int, default=20_000)
    a.add_argument("--strip-urls", action="store_true", help="take addresses out instead of flagging them")
    a.add_argument("--content-only", action="store_true", help="the content alone as text")
    b = commands.add_parser("chunk", help="chunk article records under one or more strategies")
    b.add_argument("--input", required=True)
    b.add_argument("--output-dir", required=True)
    b.add_argument("--strategies", nargs="+", default=list(STRATEGIES), choices=list(STRATEGIES))
    b.add_argument("--chunk-size", type=int, default=450)
    b.add_argument("--overlap", type=int, default=80)
    b.add_argument("--min-chunk-tokens", type=int, default=80)
    b.add_argument("--small-article-chars", type=int, default=1000)
    b.add_argument("--max-chunks-per-article", type=int, default=None)
    b.add_argument("--no-title-injection", action="store_true", help="chunks without title, description and category")
    b.add_argument("--limit", type=int, default=None, help="number of articles that are read")
    for x in (a, b):
        x.add_argument("--mode", default="errorifexists", choices=("errorifexists", "overwrite"))
    return out


def main(arguments: list[str] | None = None) -> None:
    from pyspark.sql import SparkSession

    from reedmill.plans import runs

    o = parser().parse_args(arguments)
    spark = SparkSession.builder.appName(f"reedmill {o.command}").getOrCreate()
    if o.command == "ingest":
        config = PreprocessConfig(o.min_content_chars, o.long_content_chars, o.strip_urls, not o.content_only)
        print(json.dumps(runs.process_csv(spark, o.input, o.output, o.review_output or None, o.review_limit, config, o.mode), ensure_ascii=False, indent=2))
        return
    configs = [ChunkingConfig(s, o.chunk_size, o.overlap, o.min_chunk_tokens, o.small_article_chars, o.max_chunks_per_article, not o.no_title_injection) for s in o.strategies]
    runs.chunking_experiment(spark, o.input, o.output_dir, configs, o.limit, o.mode)


if __name__ == "__main__":
    main()
