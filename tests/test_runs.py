import csv
import json

from pyspark.sql import functions as F

from reedmill.__main__ import parser
from reedmill.operators.chunking import ChunkingConfig
from reedmill.plans import runs
from reedmill.sources import writers


def test_ingest_then_chunk(spark, tmp_path):
    source = tmp_path / "a.csv"
    with open(source, "w", encoding="utf-8-sig", newline="") as f:
        w = csv.writer(f)
        w.writerow(["id", "title", "description", "content", "category"])
        for i in range(20):
            w.writerow([i, f"Tin {i}", "Mô tả", ("Một hai ba bốn năm. " * (10 * i)).strip() if i else "", "Mục"])
    counters = runs.process_csv(spark, str(source), str(tmp_path / "out"), str(tmp_path / "review"), 5)
    assert (counters["rows_read"], counters["missing_required"], counters["rows_written"], counters["review_rows"]) == (20, 1, 19, 1)
    stats = runs.chunking_experiment(spark, str(tmp_path / "out"), str(tmp_path / "chunks"), [ChunkingConfig(s, 100, 20, 10) for s in ("token", "structured")])
    for s, r in stats.items():
        rows = [json.loads(x.value) for x in spark.read.text(r["output_path"]).collect()]
        assert len(rows) == r["stats"]["chunks_written"] and sum(x["metadata"]["token_count"] for x in rows) == r["stats"]["total_chunk_tokens"] and r["stats"]["articles_read"] == 19
        assert {x["metadata"]["content_chars"] for x in rows} and r["stats"]["chunks_per_second"] > 0 and r["stats"]["short_articles"] == 1
    assert json.loads((tmp_path / "chunks/chunking_summary.json").read_text())["token"]["config"]["chunk_size"] == 100
    assert "| structured |" in (tmp_path / "chunks/chunking_report.md").read_text()


def test_options():
    o = parser().parse_args(["chunk", "--input", "a", "--output-dir", "b", "--strategies", "token"])
    assert (o.chunk_size, o.overlap, o.strategies, o.limit) == (450, 80, ["token"], None)


def test_csv_with_a_byte_order_mark(spark, tmp_path):
    df = spark.range(3).select("id", F.lit('a "b", c').alias("text"))
    writers.csv_with_mark(df.coalesce(1), str(tmp_path / "x"), "id")
    part = next((tmp_path / "x").glob("part-*"))
    assert part.read_bytes().startswith(b"\xef\xbb\xbf")
    assert list(csv.reader(part.read_text("utf-8-sig").splitlines())) == [["id", "text"], ["0", 'a "b", c'], ["1", 'a "b", c'], ["2", 'a "b", c']]
