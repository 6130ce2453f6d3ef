from pyspark.sql import Observation

from reedmill.operators import ingest, profile, splits


def raw(spark):
    rows = [
        (1, "5", "T", "D", "<b>Nội dung</b> " * 40, "k"), (2, "5", "T", "D", " ", "k"), (3, None, "T", "D", "x", "k"), (4, "x7", "T", "", "x", "k"), (5, "8", "T", "D", "Một hai " * 60, None), (6, "9", "T", "D", "Một hai " * 60, "k"),
    ]
    return spark.createDataFrame(rows, "row_id long, id string, title string, description string, content string, category string")


def test_ingest(spark):
    df = raw(spark).selectExpr("*", "1 as text", "2 as metadata")
    records = ingest.articles(df, extra=("row_id",))
    got = {r.row_id: r for r in records.collect()}
    assert set(got) == {1, 2, 6} and got[2].content == "" and got[2].quality_flags == ["short_content"] and got[1].quality_flags == ["html_like"] and got[6].quality_flags == []
    assert got[1].metadata.content_chars == len(got[1].content) and got[2].metadata.is_short and got[1].text.startswith("Tiêu đề: T\n")
    c = ingest.counters(df).first()
    assert (c.rows_read, c.rows_written, c.missing_required, c.short_content, c.html_like) == (6, 3, 3, 1, 1)
    assert [r.row_id for r in ingest.review_rows(records, "row_id", 2).collect()] == [1, 2]
    seen = Observation("ingest")
    ingest.observed(records, seen).count()
    assert seen.get["rows_written"] == 3
    assert ingest.articles(df.limit(0)).count() == 0
    try:
        ingest.require(df.drop("title"))
        raise AssertionError
    except ValueError as e:
        assert "title" in str(e)


def test_profiles(spark):
    df = raw(spark).withColumnRenamed("id", "article_id").selectExpr("*", "if(row_id < 3, 'a', 'b') as split")
    p = profile.profile(df).first()
    assert (p.rows, p.distinct_ids, p.duplicate_ids) == (6, 4, 1)
    assert {r.column: r.nulls for r in profile.nulls(df, ("title", "category")).collect()} == {"title": 0, "category": 1}
    assert {r.category: r.n for r in profile.histogram(df).collect()} == {"k": 5, "(null)": 1}
    assert [tuple(r) for r in profile.duplicates_across(df).collect()] == [("5", 2, 1)]
    assert [r.id for r in profile.typed_corpus(raw(spark).drop("title")).orderBy("content").collect() if r.id is None] == [None, None]
    assert profile.profile(df.limit(0)).first().rows == 0


def test_splits(spark):
    df = raw(spark).withColumnRenamed("id", "article_id").selectExpr("*", "1 as last")
    df = df.drop("last")
    kept = splits.first_or_listed(df, 2, ["9", "77"], "row_id")
    assert sorted((r.row_id, r.by_position) for r in kept.collect()) == [(1, True), (2, True), (6, False)]
    s = splits.reducer_stats(df, kept, ["9", "77"]).first()
    assert (s.total, s.kept_by_position, s.kept_by_id, s.found, s.not_found) == (6, 2, 1, 1, 1)
    assert splits.first_or_listed(df.limit(0), 2, ["9"], "row_id").count() == 0
    assert [r.row_id for r in splits.first_rows(df, 2, "row_id").collect()] == [1, 2]
    assert splits.missing_ids(df, spark.createDataFrame([("9",), ("77",)], "article_id string")).first()[0] == "77"
    many = spark.range(1000).selectExpr("id as row_id", "if(id % 3 = 0, 'a', 'b') as g")
    a, b = (splits.sample_per_group(many, "g", "row_id", 20).collect() for _ in range(2))
    assert sorted(a) == sorted(b) and len(a) == 40
