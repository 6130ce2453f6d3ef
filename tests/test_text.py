import random
import re

import pytest
from pyspark.sql import functions as F

from reedmill.functions import patterns as P
from reedmill.functions import text as T

CLEAN = {
    None: "", "NaN": "", "nan ": "nan", "é": "é", "a &lt;b&gt;x&lt;/b&gt; c": "a x c", "&amp;lt;": "&lt;", "&copy 2": "© 2", "a<b\nc>d": "a d", "TheoẢnh A": "Theo Ảnh A", "Video2": "Video2", "Tin sao Việt2": "Tin sao Việt 2",
    "anhlàđược": "anh là được", "AnhLÀ xong": "Anh LÀ xong", "hoalàm": "hoa làm", "voilà": "voi là", "a\r\n\r\n  b\tc \n\n d": "a\nb c\nd", "a\x0bb": "a b", "a\x85b": "a\nb", "a b": "a\nb",
    "a\xa0\xa0b\xa0\nc": "a\xa0\xa0b\nc", "": "", " \n ": "", "xem http://a.b/c nhé": "xem http://a.b/c nhé", "x" * 400_000: "x" * 400_000,
}


def column(spark, values, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string").repartition(2)
    return [r.y for r in df.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


def test_clean(spark):
    assert column(spark, CLEAN, T.clean) == list(CLEAN.values())
    assert column(spark, ["xem http://a.b/c nhé", "WWW.x.vn a"], lambda x: T.clean(x, True)) == ["xem nhé", "a"]


def test_glued_words_reach_a_fixpoint(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice([*P.GLUED_WORDS, "hoa", "A", " ", "9", "ơ", "."]) for _ in range(rng.randint(1, 7))) for _ in range(3000)]
    once = re.compile(rf"(?i)(?<=[{P.GLUED_AFTER}])(?=(?:{'|'.join(P.GLUED_WORDS)})\b)")

    def fixpoint(s):
        while (t := once.sub(" ", s)) != s:
            s = t
        return s

    assert column(spark, texts, T.part_words) == [fixpoint(t) for t in texts]


def test_flags(spark):
    raw = ["a&#39;b", "a&Eacute;b", "a&frac12;b", "a&nbsp;b", "1 < 2 > 0", "1 <2", "www.", "WWW.x.vn", None]
    got = column(spark, raw, lambda x: T.quality_flags(x, F.lit("y" * 300)))
    assert got == [[], [], [], ["html_like"], ["html_like"], [], [], ["url_like"], []]
    sizes = [299, 300, 20_000, 20_001]
    assert column(spark, ["z" * n for n in sizes], lambda x: T.quality_flags(x, x)) == [["short_content"], [], [], ["long_content"]]


def test_sentences_and_sections(spark):
    assert column(spark, ["...a. b", "1.5 kg. Hết", "a…b?!c", "...", "", None], T.sentences) == [["a.", "b"], ["1.", "5 kg.", "Hết"], ["a…", "b?!", "c"], [], [], None]
    assert column(spark, ["A b. c? d", "a.b"], T.flat_sentences) == [["A b.", "c?", "d"], ["a.b"]]
    got = column(spark, ["a", " a \n\n\n b ", "\n"], T.sections)
    assert [[tuple(s) for s in x] for x in got] == [[("content", "a")], [("paragraph_000", "a"), ("paragraph_001", "b")], []]
    assert column(spark, ["a\x1cb\xa0c　d", "", None], T.token_count) == [4, 0, None]


def test_templates(spark):
    row = spark.createDataFrame([("t", "", None, "c")], "t string, d string, k string, c string")
    t, d, k, c = (F.col(x) for x in "tdkc")
    assert row.select(T.document_text(t, d, k, c)).first()[0] == "Tiêu đề: t\nMô tả: \nChuyên mục: \nNội dung:\nc"
    assert row.select(T.document_text(t, d, k, F.lit(""))).first()[0].endswith("\nNội dung:")
    assert row.select(T.embedding_text(t, d, k, c)).first()[0] == "Tiêu đề: t\nĐoạn nội dung:\nc"
    assert row.select(T.passage_text(t, d, c)).first()[0] == "Title: t\nContent: c"
    assert row.select(T.fallback(d, k, c), T.fallback(d, k)).first()[:] == ("c", "")


@pytest.mark.parametrize("text, ids", [("1", [1]), ("[1, 2]", [1, 2]), (None, []), ("x", [None])])
def test_id_list(spark, text, ids):
    assert column(spark, [text], T.id_list) == [ids]


def test_ids_and_replies(spark):
    row = spark.createDataFrame([("7", 0)], "a string, i int")
    assert row.select(T.chunk_id(F.col("a"), F.lit("token"), F.col("i")), T.flat_chunk_id(F.col("a"), F.col("i")), T.qa_id(F.col("a"), F.col("i")), T.cross_qa_id(F.col("a"), F.col("i"))).first()[:] == ("7_token_0000", "article_7_chunk_0", "7_1", "cross_7_1")
    replies = ['```json\n[{"a": 1}]\n```', '[{"a": 2}]', '```\n[{"a": 3}]```', "none"]
    got = column(spark, replies, lambda x: T.fenced_json(x, "array<struct<a: int>>"))
    assert [None if x is None else x[0].a for x in got][:3] == [1, 2, 3]
