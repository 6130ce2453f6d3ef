import re
import unicodedata

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from reedmill.llm.pieces import WHITE, cuts, found, pieces, split

WS = "".join(map(chr, WHITE))


def spans(text, unit):
    if unit == "chars":
        return list(range(len(text) + 1))
    at = [m.start() for m in re.finditer(f"[^{re.escape(WS)}]+", text)]
    return [0, *at[1:], len(text)] if at else [0]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet="ab. \n é́", max_size=90), min_size=1, max_size=5), st.integers(2, 30), st.integers(0, 12), st.sampled_from(["chars", "tokens"]))
def test_pieces_are_legal_and_lossless(texts, limit, overlap, unit):
    overlap = min(overlap, limit - 1)
    item, number, start, stop, size = cuts(pa.array(texts), unit, limit, overlap)
    for i, text in enumerate(texts):
        at = spans(text, unit)
        mine = np.flatnonzero(item == i)
        if len(at) < 2:
            assert not len(mine)
            continue
        assert list(number[mine]) == list(range(len(mine)))
        pos = {p: k for k, p in enumerate(at)}
        a, b = [pos[x] for x in start[mine]], [pos[x] for x in stop[mine]]
        assert a[0] == 0 and b[-1] == len(at) - 1 and max(size[mine]) <= limit
        assert [y - x for x, y in zip(a, b)] == list(size[mine])
        for k in range(1, len(mine)):
            assert a[k] == max(b[k - 1] - overlap, 0) and b[k] > b[k - 1]
        rebuilt = "".join(text[max(start[k], stop[k - 1] if j else 0) : stop[k]] for j, k in enumerate(mine))
        assert rebuilt == text


def test_natural_boundaries():
    text = "Một hai ba. Bốn năm sáu. Bảy tám chín mười."
    item, _, start, stop, _ = cuts(pa.array([text]), "chars", 26, 3)
    assert [text[a:b] for a, b in zip(start, stop)] == ["Một hai ba. Bốn năm sáu. ", "u. Bảy tám chín mười."]


def test_frames(spark):
    art = spark.createDataFrame([(1, "x" * 1801), (2, "x" * 1800), (3, None), (4, ""), (5, "a b. " * 9000)], "row_id long, content string").selectExpr("*", "0 as piece", "1 as item_key")
    long = " ".join("t" for _ in range(151))
    chunks = spark.createDataFrame([("c1", long), ("c1", long), ("c2", long.replace(" ", " ")), ("c3", long.replace(" ", "​")), ("c4", long[2:]), ("c5", None)], "chunk_id string, chunk_text string")
    limits = spark.createDataFrame([("article", "chars", 1800, 150), ("chunk", "tokens", 150, 20)], "item_kind string, unit string, max_size int, overlap int")
    assert sorted(map(tuple, found(art, chunks, limits).collect())) == [("article", "1"), ("article", "5"), ("chunk", "c1"), ("chunk", "c2")]
    rows = pieces(art, chunks, limits).where("item_key = '5'").orderBy("piece").collect()
    assert rows[0].n_pieces == len(rows) and all(len(r.piece_text) <= 1800 and r.piece_text.endswith(". ") for r in rows)
    assert found(art.limit(0), chunks.limit(0), limits).count() == 0


def test_no_piece_begins_with_a_mark(spark):
    long = "một hai " + "e\u0302\u0301" * 900 + " ba. " + "a\u0301" * 500
    got = split(spark.createDataFrame([(1, long)], "id long, text string"), "text", 200, 24, "chars", ("id",)).orderBy("piece").collect()
    assert all(not unicodedata.combining(r.piece_text[0]) for r in got) and max(r.size for r in got) <= 200
    assert got[0].piece_text + "".join(r.piece_text[24:] for r in got[1:]) == long


def test_line_ends_come_first(spark):
    text = "Một hai ba. " * 10 + "Bốn\nnăm sáu. " + "Bảy tám. " * 20
    got = split(spark.createDataFrame([(1, text)], "id long, text string"), "text", 150, 0, "chars", ("id",)).orderBy("piece").collect()
    assert got[0].piece_text.endswith("Bốn\n")
