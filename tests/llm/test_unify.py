import itertools
import unicodedata

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from reedmill.llm import codepoints as C
from reedmill.llm.unify import look_alikes, unify

LIKE = dict(zip(C.LOOK_ALIKES[::2], C.LOOK_ALIKES[1::2], strict=True))
ORDINARY = [chr(c) for c in [*range(0x20, 0x7F), *range(0xC0, 0x250), *range(0x300, 0x345), *range(0x1E00, 0x1F00), 0xAC00, 0x1100, 0x1161, 0x11A8, 0x1F469] if chr(c) not in LIKE and c not in C.INVISIBLE and not unicodedata.decomposition(chr(c)).startswith("<")]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=ORDINARY, max_size=12)), max_size=8))
def test_composition_is_nfc(rows):
    expected = [None if r is None else unicodedata.normalize("NFC", r) for r in rows]
    assert C.canonical(pa.array(rows, pa.string())).to_pylist() == expected


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=15), max_size=5))
def test_decode_round_trip_and_idempotence(rows):
    a = pa.array(rows, pa.string())
    assert C.encode(*C.decode(a)).to_pylist() == rows
    once = C.canonical(a)
    assert C.canonical(once).to_pylist() == once.to_pylist()


def test_forms():
    same = ["Hòa  Bình", "Hòa  Bình", "Hòa 　Bình", "Hòa​  B­ình", "Ηòa  Вình", "Ｈòa  Bình"]
    assert set(C.canonical(pa.array(same)).to_pylist()) == {"Hòa  Bình"}
    visible = ["Hòa", "Hoà", "HÒA", "Hòa ", "Hòa\n", "Hòa."]
    assert C.canonical(pa.array(visible)).to_pylist() == visible
    assert C.canonical(pa.array(["\U0001f469‍\U0001f467", "a‍b"])).to_pylist() == ["\U0001f469‍\U0001f467", "ab"]
    assert C.canonical(pa.array([], pa.string())).to_pylist() == []
    long = "é" * 3_000_000
    assert C.canonical(pa.array([long, None, "x"])).to_pylist() == ["é" * 3_000_000, None, "x"]


def test_look_alikes_of_other_scripts_and_fonts():
    same = {"𝐀𝐛𝟏": "Ab1", "ﬁn": "fin", "ᎪᏟ": "AC", "ⅣⅡ": "IVII", "ꓐꓡ": "BL", "ＡＢ": "AB"}
    assert dict(zip(same, C.canonical(pa.array(list(same))).to_pylist())) == same
    other = ["①", "²", "½", "ſ", "…", "㎏", "ª"]
    assert C.canonical(pa.array(other)).to_pylist() == other


def test_one_hot_text_with_one_odd_spelling(spark):
    n = 30_000
    df = spark.range(n).selectExpr("id as row_id", "if(id % 3 = 0, if(id = 300, 'Tin  sáng', 'Tin\u00a0 sáng'), concat('x', id)) as title", "cast(null as string) as description", "'' as content")
    got = look_alikes(df)
    assert got.count() == n // 3 - 1 and got.where("field <> 'title' or row_id_a >= row_id_b or 300 not in (row_id_a, row_id_b)").isEmpty()


def test_pairs_match_brute_force(spark):
    texts = ["Tin sáng", "Tin sáng", "Tin sáng", "tin sáng", None, "", " ", " ", "Tin sáng", "​"]
    rows = [(i, t, texts[-i], None, f"x{i}") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "row_id long, title string, description string, content string, field string")
    got = {tuple(r) for r in look_alikes(df).collect()}
    form = lambda s: C.canonical(pa.array([s])).to_pylist()[0]
    want = {(f, a[0], b[0]) for k, f in ((1, "title"), (2, "description")) for a, b in itertools.combinations(rows, 2) if a[k] and b[k] and form(a[k]).strip() and a[k] != b[k] and form(a[k]) == form(b[k])}
    assert got == want and want
    assert unify(df).columns == df.columns
    assert look_alikes(df.limit(0)).count() == 0
