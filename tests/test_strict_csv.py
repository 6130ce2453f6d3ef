import csv
import io
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from reedmill.operators import strict_csv
from reedmill.operators.strict_csv import articles, assemble, parse, rejects

GRAMMAR = re.compile(r'(?:"(?:[^"]|"")*"|[^",\r\n]*)(?:,(?:"(?:[^"]|"")*"|[^",\r\n]*))*\Z')


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet='",a\n\r 1', min_size=1, max_size=14))
def test_quoting_is_rfc_4180(raw):
    reason, _ = parse(raw)
    if GRAMMAR.match(raw):
        assert reason != "quoting"
    elif not re.search(r"[\r\n]", raw):
        assert reason == "quoting"


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 9223372036854775807), st.lists(st.text(alphabet='ab",\n é', max_size=8), min_size=2, max_size=2), st.text(alphabet="xyz\n\"", min_size=1).filter(lambda s: s.strip()), st.booleans())
def test_written_records_come_back(number, texts, content, all_quoted):
    out = io.StringIO()
    csv.writer(out, quoting=csv.QUOTE_ALL if all_quoted else csv.QUOTE_MINIMAL, lineterminator="\n").writerow([number, *texts, content, "c"])
    assert parse(out.getvalue()[:-1]) == (None, [str(number), *texts, content, "c"])


def test_reasons():
    assert parse(None)[0] == parse("")[0] == parse("1;a;b")[0] == parse("1,a,b,c,d,")[0] == "column_count"
    assert parse('1,a,b,"x \\"y\\" z",c')[0] == parse('1,a "b" c,d,e,f')[0] == parse('1,"a,b,c,d')[0] == parse('1, "a",b,c,d')[0] == "quoting"
    for bad in ("", "0", "-1", "1.5", "1e3", "٣", "x1", "9223372036854775808", "nan", "9" * 5000):
        assert parse(f"{bad},a,b,c,d")[0] == "invalid_value"
    for bad in ("", " ", " ", '"\n"', "nan", " NaN "):
        assert parse(f"1,a,b,{bad},d")[0] == "invalid_value"
    assert parse('" 007 ",,,x,') == (None, [" 007 ", "", "", "x", ""])
    assert list(assemble(['1,"a\n', 'b",c\n', "2,x\n"])) == ['1,"a\nb",c', "2,x"]


def test_frames(spark):
    rows = [(1, "train", "f", 1, "5,t,d,c,k"), (2, None, None, None, None), (3, "t", "f", 2, '6,"a'), (4, "t", "f", 3, "7,t,d," + "x" * 300_000 + ",k")]
    df = spark.createDataFrame(rows, "row_id long, split string, file_name string, line_no long, raw_line string").withColumnRenamed("none", "title")
    df = df.selectExpr("*", "1 as reason", "2 as content")
    assert sorted(map(tuple, rejects(df).collect())) == [(2, "column_count"), (3, "quoting")]
    assert sorted((r.row_id, r.article_id, len(r.content)) for r in articles(df).collect()) == [(1, 5, 1), (4, 7, 300_000)]
    assert rejects(df.limit(0)).count() == 0


def test_records_of_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('\ufeffid,title,description,content,category\n1,a,b,"c\nd ""e""",f\n2,x\n3,"a"b,c,d,e\r\n4,a,b,nan,e\n5,a,b,c,e', encoding="utf-8")
    (tmp_path / "b.csv").write_text("id,title,description,content,category\n", encoding="utf-8")
    rows = strict_csv.file_records(spark, str(tmp_path))
    got = {(r.file_name, r.line_no): (r.reason, r.content) for r in strict_csv.read_strict(rows, keep=("file_name", "line_no")).collect()}
    assert got == {("a.csv", 2): (None, 'c\nd "e"'), ("a.csv", 4): ("column_count", None), ("a.csv", 5): ("quoting", None), ("a.csv", 6): ("invalid_value", None), ("a.csv", 7): (None, "c")}
