import pytest

from reedmill.llm.markup import WEIGHTS, cleaned, found, has_markup, judged, learn, plain, region, strip_markup

ORDINARY = [
    "- một\n- hai\n1. ba", "#hashtag và #tin", "Giá $86 mỗi kiện*, $72 mỗi hộp*, chưa phí.", "7 * 3 = 21", "Tỷ lệ < 9% và > 1,5%", "R&D; A & B", "Tệp bang_ke_34_v2.xls và _x", "“tôi [tạm] đồng ý” [1] (2)",
    "https://a.vn/b_c_d?x=1&lang=vi", "a < b và c > d", "* Tên đã đổi", "", "C:\\Users\\new", "5*3*2", "1 <2 >0",
]
MARKED = {
    "<p>Xin <b>chào</b></p>": "Xin chào",
    "a&nbsp;b": "a\u00a0b",
    "&amp;lt;em&amp;gt;x&amp;lt;/em&amp;gt;": "x",
    "x <!-- quảng cáo --> y": "x  y",
    "Một <h2>Đầu đề</h2> hai": "Một\n§ Đầu đề\nhai",
    "<ul>\n<li>Một</li>\n<li>Hai</li></ul>": "- Một\n\n- Hai",
    "đẩy lùi **lịch học** và *nếp cũ*": "đẩy lùi lịch học và nếp cũ",
    "## Rà lại": "§ Rà lại",
    "xem [hệ thống](/b-1.htm) loa": "xem hệ thống loa",
    "```python\ntong = sum([8, 3])\n```": "    tong = sum([8, 3])",
    "[[Tập tin:H.png|nhỏ|Chú thích]] và [[a|b]]": "Chú thích và b",
    "a\n== Công bố ==\nb": "a\n\n§ Công bố\n\nb",
    "Tính $S = \\frac{3a}{b^2}$ ra": "Tính ⟨S = (3a)/(b^2)⟩ ra",
    "\\section{Rà lại}\nCao \\textbf{thường giữa}~\\cite{n1}, tăng 27\\%": "§ Rà lại\n\nCao thường giữa, tăng 27%",
    "| A | B |\n|---|---:|\n| x | 9 |": "A\tB\nx\t9",
}


@pytest.mark.parametrize("text", ORDINARY)
def test_ordinary_text_stays(text):
    assert not has_markup(text) and cleaned(text) == text and judged(text) == (text, False)


@pytest.mark.parametrize("text", MARKED)
def test_markup_is_written_plainly(text):
    assert has_markup(text)
    got = cleaned(text).strip("\n")
    assert [x.strip() for x in got.split("\n") if x.strip()] == [x.strip() for x in MARKED[text].split("\n") if x.strip()]
    assert not has_markup(got)


def test_region_is_the_largest_sum():
    body = "Một hai ba <b>bốn</b> năm. " * 10 + "Hết."
    text = "<div><ul><li>Trang chủ</li></ul><script>var z=1;</script> " + body + " <ul><li>Xem</li></ul><br/><br/>"
    a, b = region(text, WEIGHTS)
    assert text[a:b].strip() == body


def test_words_outside_the_region_stay():
    body = "<p>" + "Một hai ba bốn năm. " * 20 + "</p>"
    table = "<table><tr><th>Mục</th><th>Số</th></tr><tr><td>Giá</td><td>12</td></tr></table>"
    for heavy in (WEIGHTS, WEIGHTS | {"tag": -8.0, "sign": 0.0}):
        for part, want in ((table, ["Mục\tSố", "Giá\t12"]), ("<h2>Hai chữ</h2>", ["§ Hai chữ"]), ("<ul><li>Một</li><li>Hai</li></ul>", ["- Một", "- Hai"]), ("<div><pre>x = 1</pre></div>", ["    x = 1"]), ("<p><i>An</i></p>", ["An"])):
            got = [x for x in cleaned(part + body + part, heavy).split("\n") if x.strip()]
            assert got == [*want, "Một hai ba bốn năm. " * 19 + "Một hai ba bốn năm.", *want]
    menu = '<ul><li><a href="/">Trang chủ</a></li><li><a href="/t">Thời sự</a></li></ul>'
    for part in (menu, "<nav><a href='/t'>Thời sự</a></nav>", "<script>var z=1;</script>", "<!-- ẩn -->"):
        assert cleaned(part + body + part).strip() == ("Một hai ba bốn năm. " * 20).strip()


def test_frames(spark):
    rows = [(1, "<p>Một hai</p>\n<ul></ul>\nba bốn", None), (2, "một", "**hai** ba"), (3, None, ""), (4, "R&D", "x" * 500_000), (4, "R&D", "x")]
    df = spark.createDataFrame(rows, "row_id long, content string, description string").selectExpr("*", "1 as field", "2 as clean")
    assert sorted(map(tuple, found(df).collect())) == [(1, "content"), (2, "description")]
    out = {(r.row_id, r.field): r.clean for r in strip_markup(df).collect()}
    assert len(strip_markup(df).collect()) == 8 and out[2, "description"] == "hai ba" and out[2, "content"] == "một"
    assert learn(df, ("content",))["word"] > 0 and found(df.limit(0)).count() == 0


def test_code_and_formulas_survive():
    text = "Đoạn văn đầu tiên của bài có **chữ đậm** ở đây.\n```python\nif a < b and c > d:\n    x_1 = y[0] * **z** # <b>không</b>\n```\nCông thức $a_{ij} + x_1^2$ đứng ở cuối câu này."
    got = plain(text)
    assert "    if a < b and c > d:\n        x_1 = y[0] * **z** # <b>không</b>" in got
    assert "⟨a_(ij) + x_1^2⟩" in got and "chữ đậm" in got and "**chữ" not in got
    assert "    if a < b:" in plain("Xin xem <pre><code>if a &lt; b:</code></pre> nhé")
