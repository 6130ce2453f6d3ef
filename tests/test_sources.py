import json

import pytest

from reedmill.operators import chunking
from reedmill.sources import readers as S
from reedmill.sources import writers as K
from reedmill.streaming import articles as stream

CSV = '﻿id,title,description,content,category\n1,"Tin ""mới""",d,"dòng\nhai",k\n2,,NA,x\n\n3,t,d, ,k\n'


def test_csv(spark, tmp_path):
    p = tmp_path / "train.csv"
    p.write_text(CSV, encoding="utf-8")
    rows = {r.id: r for r in S.csv_rows(spark, str(p)).collect()}
    assert rows["1"].title == 'Tin "mới"' and rows["1"].content == "dòng\nhai" and rows["2"].title is None and rows["2"].description == "NA" and rows["2"].category is None and rows["3"].content == " "
    assert {r.id: r.description for r in S.profiled_rows(spark, str(p)).collect()}["2"] is None
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="missing columns"):
        S.csv_rows(spark, str(tmp_path / "bad.csv"))
    both = S.splits(spark, str(tmp_path), S.csv_rows, ".csv")
    assert {r.split for r in both.collect()} == {"train"}


def test_json_round_trip(spark, tmp_path):
    qa = spark.createDataFrame([("a", "[1, 2]", "Đ/?", None, ["x"], None, [], [1, 2])], S.QA)
    K.json_lines(qa, str(tmp_path / "qa"))
    text = "".join(f.read_text() for f in (tmp_path / "qa").glob("*.json"))
    assert '"qa_type":null' in text and "Đ/?" in text
    K.append(qa, str(tmp_path / "qa"))
    assert S.qa_records(spark, str(tmp_path / "qa")).count() == 2
    (tmp_path / "mixed.jsonl").write_text('{"id": "1", "article_id": 5}\n\n{"id": "2", "article_id": [5, 6]}\n{broken\n')
    assert sorted((r.id, r.article_id) for r in S.qa_records(spark, str(tmp_path / "mixed.jsonl"), tolerant=True).collect()) == [("1", "5"), ("2", "[5, 6]")]
    with pytest.raises(Exception):  # noqa: B017
        S.qa_records(spark, str(tmp_path / "mixed.jsonl")).collect()
    assert S.count_lines(spark, str(tmp_path / "mixed.jsonl")) == 3


def test_csv_and_parquet_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b"\nc', None)], "id long, title string, description string")
    K.csv(df, str(tmp_path / "csv"))
    back = S.csv_rows(spark, str(tmp_path / "csv"), ("id",)).first()
    assert back.title == 'a "b"\nc'
    assert K.csv_text(df).first()[0] == '"1","a ""b""\nc",""'
    K.parquet(df, str(tmp_path / "p"))
    assert S.parquet_ids(spark, str(tmp_path / "p")).columns == ["id"]


def test_summary_and_report(spark):
    df = spark.createDataFrame([("1", "t", "d", "c", "một hai")], "article_id string, title string, description string, category string, content string")
    stats = chunking.chunk_stats(df, chunking.chunks(df)).collect()
    assert json.loads(K.summary(stats, {"token": {"chunk_size": 450}}, {"token": "x"}))["token"]["stats"]["chunks_written"] == 1
    assert "| token | 1 | 1.0 | 2.0 | 2 | 2 | 7.0 |" in K.report(stats)


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    row = {"id": "1", "title": "t", "description": "d", "content": "x" * 400, "category": "k"}
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps(r) for r in (row, row, row | {"id": "2"}, row | {"id": None})))
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    stream.start(stream.records(stream.raw_stream(spark, str(tmp_path / "in"))), out, check).awaitTermination()
    assert sorted(r.article_id for r in spark.read.parquet(out).collect()) == ["1", "2"]
    (tmp_path / "in" / "b.json").write_text("\n".join(json.dumps(r) for r in (row, row | {"id": "3"})))
    stream.start(stream.records(stream.raw_stream(spark, str(tmp_path / "in"))), out, check).awaitTermination()
    assert sorted(r.article_id for r in spark.read.parquet(out).collect()) == ["1", "2", "3"]
