import pytest
from pyspark.sql import functions as F

from reedmill.llm import truncated
from reedmill.llm.truncated import cut_off, rates

BODY = [f"Ngày {i} nhóm {chr(97 + i % 26)} họp về bản vẽ mới. Theo biên bản của tổ {chr(97 + i % 23)} và đội {chr(97 + i % 17)}, kết quả lấy ý kiến cho thấy bữa cơm chung rất vui vẻ" for i in range(300)]
CUT = {
    100: BODY[0][:-6], 101: BODY[1] + ". Kết quả lấy ý ki… Xem tiếp", 102: BODY[2] + ".\nTheo biên", 103: BODY[3][:-6] + "...", 104: BODY[0][:-6], 105: BODY[4] + ". Kết quả lấy ý k�", 106: BODY[5] + ".\n“Nhóm họp về bản",
    107: BODY[6] + ". Theo biên bản, kết quả lấy ý ki", 108: BODY[7] + ". Kết quả lấy ý kiến cho th&#7", 109: BODY[8] + ". Theo biên bản, kết quả lấy ý kiến cho th" + "a" * 2000,
}
SIGNED = {400 + i: BODY[i] + f" lần {i}.\nTheo Bản tin" for i in range(10)}
LISTED = {420 + i: BODY[i] + f" lần {i}.\n- Nhóm họp về bản vẽ mới\n- Bữa cơm chung" for i in range(10)}
WHOLE = {200: BODY[6] + ".", 207: None, 208: "", 209: "  \n", 210: "xyz", 211: BODY[12] + ". Hết”."} | SIGNED | LISTED


@pytest.fixture
def documents(spark):
    rows = [*CUT.items(), *WHOLE.items(), *((1000 + i, b + ".") for i, b in enumerate(BODY)), (999, (BODY[0] + ". ") * 3000)]
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "if(doc_id < 200, 's', null) as source", "1 as gram", "2 as words", "3 as line", "4 as inside")


def test_cases(documents):
    assert {r.doc_id for r in cut_off(documents).collect()} == set(CUT)
    got = {r.source: (r.documents, r.cut) for r in rates(documents).collect()}
    assert got == {"s": (len(CUT), len(CUT)), None: (documents.count() - len(CUT), 0)}
    assert cut_off(documents.limit(0)).count() == 0


def test_the_counts_decide(documents, monkeypatch):
    counts = truncated.trigram_counts
    monkeypatch.setattr(truncated, "trigram_counts", lambda *a: counts(*a).where("false"))
    assert {r.doc_id for r in cut_off(documents).where("not marked").collect()} != {r.doc_id for r in cut_off(documents).where("not marked").collect()} | {100, 102, 103, 104, 106}
    # the same final words are an end where lines often end with them
    monkeypatch.setattr(truncated, "trigram_counts", lambda *a: counts(*a).withColumns({"lines": F.col("inside"), "prose": F.col("inside")}))
    assert not {100, 103, 104} & {r.doc_id for r in cut_off(documents).collect()}
