import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from reedmill.llm.codepoints import words
from reedmill.llm import overlap
from reedmill.llm.overlap import Bits, Index, covered, match, maximal, meeting, overlaps, report


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="abc ", max_size=60), min_size=1, max_size=5), st.text(alphabet="abcd ", max_size=40), st.integers(1, 4))
def test_backward_search_is_brute_force(docs, pattern, length):
    h, o = words(pa.array(docs))
    p, _ = words(pa.array([pattern]))
    if not len(h):
        return
    index = Index(h, o)
    ends = np.arange(length - 1, len(p))
    got = {}
    for end, lo, hi in zip(*index.search(index.symbols(p), ends, length)):
        got[int(end)] = sorted(index.locate(np.arange(lo, hi)).tolist())
    want = {}
    for end in ends:
        at = [int(o[d]) + d + i for d in range(len(docs)) for i in range(o[d + 1] - o[d] - length + 1) if list(h[o[d] + i : o[d] + i + length]) == list(p[end - length + 1 : end + 1])]
        if at:
            want[int(end)] = sorted(at)
    assert got == want


@given(st.lists(st.booleans(), max_size=300))
def test_packed_bits(flags):
    b = Bits(np.array(flags, bool))
    assert b.rank(np.arange(len(flags) + 1)).tolist() == [sum(flags[:i]) for i in range(len(flags) + 1)]
    assert b.at(np.arange(len(flags))).tolist() == flags


def test_maximal_matches_and_covered():
    # words 0-6 of one text stand at 10-16 of the other: three hits on one diagonal; another hit on another diagonal
    pair, start, place, length = maximal(np.array([3, 3, 3, 3, 4]), np.array([6, 4, 5, 30, 8]), np.array([12, 10, 11, 2, 0]))
    assert sorted(zip(pair, start, place, length)) == [(3, 0, 10, 7), (3, 26, 2, 5), (4, 4, 0, 5)]
    p, n = covered(np.array([1, 1, 1, 2]), np.array([0, 3, 30, 9]), np.array([5, 6, 5, 7]))
    assert list(p) == [1, 2] and list(n) == [14, 7]


def variants(rng, base):
    w = base.split()
    yield base
    yield base.upper().replace(" ", " ", 3)
    yield " ".join("x" if i % 30 == 5 else x for i, x in enumerate(w))
    yield " ".join(w[len(w) // 2 :] + w[: len(w) // 2])
    yield base + " Ghi chú ngắn của tòa soạn."


def test_match_and_frames(spark):
    rng = random.Random(1)
    vocabulary = [f"từ{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    base = [" ".join(rng.choice(vocabulary) for _ in range(120)) for _ in range(6)]
    half = [" ".join(b.split()[:60]) + " " + " ".join(rng.choice(vocabulary) for _ in range(60)) for b in base]
    assert {x for x, y in match(pa.array([base[0]]), pa.array([*variants(rng, base[0]), half[0]]))} == {0, 1, 2, 3, 4}
    rows = [(i, "train", "s", b) for i, b in enumerate(base)] + [(10 + i, "train", "s", half[i]) for i in range(6)] + [(50 + i, "train", None, base[0]) for i in range(30)]
    rows += [(100 + i, "test" if i % 2 else "validation", None, v) for i, v in enumerate(variants(rng, base[0]))] + [(200, "test", "s", "ngắn"), (201, "test", "s", None), (202, None, "s", base[1]), (203, "test", "s", ""), (204, "test", "s", "từ" * 3000), (205, "train", "s", "từ" * 3000)]
    df = spark.createDataFrame(rows, "row_id long, split string, source string, content string").selectExpr("*", "1 as id", "2 as text", "3 as t", "4 as e")
    got = {(r.row_id_a, r.row_id_b) for r in overlaps(df).collect()}
    assert got == {(a, b) for a in [0, *range(50, 80)] for b in range(100, 105)} | {(204, 205)}
    by = {(r.split, r.source): (r.records, r.overlapping, r.exact_copies) for r in report(df).collect()}
    assert by["test", "s"] == (4, 1, 1) and by["test", None] == (2, 2, 1) and by["validation", None] == (3, 3, 1)
    assert overlaps(df.limit(0)).count() == 0


def texts(rng, n, vocabulary):
    notice = " ".join(rng.choice(vocabulary) for _ in range(12))
    return [" ".join(rng.choice(vocabulary) for _ in range(rng.choice((30, 120, 250, 500)))) + " " + notice for _ in range(n)]


def pairs(spark, base, other):
    rows = [(i, "train", "s", b) for i, b in enumerate(base)] + [(1000 + i, "test", "s", b) for i, b in enumerate(other)]
    df = spark.createDataFrame(rows, "row_id long, split string, source string, content string")
    return {(r.row_id_a, r.row_id_b) for r in overlaps(df).collect()}


def test_every_tenth_word_replaced(spark):
    rng = random.Random(2)
    vocabulary = [f"từ{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(600)]
    base = texts(rng, 150, vocabulary)
    even = [" ".join(rng.choice(vocabulary) if i % 10 == k % 10 else x for i, x in enumerate(b.split())) for k, b in enumerate(base)]
    got = pairs(spark, base, even)
    assert len(got & {(i, 1000 + i) for i in range(len(base))}) >= 0.97 * len(base) and all(b - a == 1000 for a, b in got)


def test_a_random_tenth_replaced_or_new_words(spark):
    rng = random.Random(3)
    vocabulary = [f"từ{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(600)]
    base = texts(rng, 150, vocabulary)
    odd = [" ".join((rng.choice(vocabulary) if k % 2 else f"sai{k}x{i}") if rng.random() < 0.1 else x for i, x in enumerate(b.split())) for k, b in enumerate(base)]
    got = pairs(spark, base, odd)
    assert len(got & {(i, 1000 + i) for i in range(len(base))}) >= 0.95 * len(base) and all(b - a == 1000 for a, b in got)
    assert meeting(0.75) > 0.95


def test_shuffled_words_are_no_case_whatever_else_is_there(spark, monkeypatch):
    rng = random.Random(4)
    vocabulary = [f"từ{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(600)]
    base = texts(rng, 40, vocabulary)
    mixed = [" ".join(rng.sample(b.split(), len(b.split()))) for b in base]
    short = ["một" * 60, "hai " + "ba" * 80]
    rows = [*base, *short]
    got = pairs(spark, rows, [*mixed, *short, *base[:5]])
    want = {(40, 1040), (41, 1041), *((i, 1042 + i) for i in range(5))}
    assert got == want
    monkeypatch.setattr(overlap, "SHARD", 300)
    monkeypatch.setattr(overlap, "STREAM", 500)
    assert pairs(spark, rows, [*mixed, *short, *base[:5]]) == want


def test_markup_hides_no_content(spark):
    rng = random.Random(6)
    vocabulary = "thời sự hôm nay Hà Nội người dân đường phố học sinh trường kinh tế xã hội giá vàng tăng giảm mưa lớn miền Trung chính quyền địa phương cho biết đã được của và".split()
    base = [" ".join(rng.choice(vocabulary) for _ in range(120)) for _ in range(8)]
    coded = lambda x: "".join(f"&#{ord(c)};" if ord(c) > 127 else c for c in x)
    w = base[2].split()
    other = [f"<N {base[0]}>", coded(base[1]), " ".join([*w[:10], "x <y", *w[10:110], "y> z", *w[110:]]), coded(base[3]).replace("&", "&amp;")]
    other += [" ".join(x[:1] + "&shy;" + x[1:] for x in base[4].split()), " ".join(f"&lt;b class=&quot;x y&quot;&gt;{x}&lt;/b&gt;" for x in base[5].split()), " ".join(f"{x[:1]}<b>{x[1:]}</b>" for x in base[6].split()), f"<!-- {base[7]} -->"]
    rules = ["-" * 150, "🎉 " * 80, " " * 200]
    got = pairs(spark, [*base, *rules, "=" * 150], [*other, "-" * 150, "🎉" * 160, " " * 200, "~" * 150])
    assert got == {(i, 1000 + i) for i in range(9)}  # 80 emoji are not 160, blanks are no text


def test_tags_are_told_from_prose():
    for x in ('<p class="a">', "<br/>", "<img src=x alt='a > b' disabled/>", "</div >", "<ref name=a/>", "<!-- x -->", "<!DOCTYPE html>", "<em>", '<o:p x="1">'):
        assert overlap.displayed(f"một {x} hai").split() == ["một", "hai"], x
    for x in ("<b và c>", "<em đi học>", "<Nguyễn Văn A>", "<!Nóng>", "x <y z", "<a b c>"):
        assert overlap.displayed(x) == x


def test_rare_words_put_in_and_a_sentence_added(spark):
    rng = random.Random(8)
    vocabulary = [f"từ{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(3000)]
    often = [1 / (i + 1) for i in range(len(vocabulary))]
    base = [" ".join(rng.choices(vocabulary, often, k=rng.choice((80, 150, 300)))) for _ in range(300)]
    other = [" ".join([*(rng.choice(vocabulary) if rng.random() < 0.1 else x for x in b.split()), *rng.choices(vocabulary, k=12)]) for b in base]
    want = {(i, 1000 + i) for i in range(len(base)) if match(pa.array([other[i]]), pa.array([base[i]]))}
    got = pairs(spark, base, other)
    assert len(want) > 250 and len(got & want) >= 0.98 * len(want) and got <= want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["", "ab cd a b ", "c a ba " * 40]), st.text(alphabet="abcd ", max_size=200)).map("".join), min_size=2, max_size=5))
def test_bags_never_tell_fewer_shared_words_than_there_are(texts):
    h, o, r, w, times = overlap.once_per_row(pa.array(texts))
    bag = overlap.bags(r, w, times, np.diff(o))
    a, b = (x.ravel() for x in np.indices((len(texts), len(texts))))
    most = overlap.most_shared(bag.values.to_numpy().view(np.uint64), bag.offsets.to_numpy().astype(np.int64), np.diff(o), a, b)
    for i, j, k in zip(a, b, most, strict=True):
        assert overlap.shared_words(h[o[i] : o[i + 1]], h[o[j] : o[j + 1]]) <= k
        assert texts[i] != texts[j] or k == o[i + 1] - o[i]


def half_alike(rng, n):
    """Texts of 120 words, somewhat more than half of which are one of twelve stocks, and the same of other texts, the last ten of which are altered copies."""
    stocks = [[f"kho{chr(97 + k)}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(66)] for k in range(12)]
    vocabulary = [f"từ{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    base, other = ([" ".join([*stocks[i % 12], *(rng.choice(vocabulary) for _ in range(54))]) for i in range(n)] for _ in range(2))
    return base, [*other, *(" ".join(x if i % 15 else "khác" for i, x in enumerate(b.split())) for b in base[:10])]


def test_pairs_that_share_half_their_words_do_not_reach_the_index(monkeypatch):
    base, other = half_alike(random.Random(9), 20)
    table = pa.table({"id": [*range(20), *range(1000, 1020)], "evaluation": [False] * 20 + [True] * 20, "text": [*base, *other[:20]], "met": [list(range(1000, 1020))] * 20 + [None] * 20})
    built = []
    monkeypatch.setattr(overlap, "Index", lambda h, o: built.append(len(h)) or Index(h, o))
    assert overlap.search_group(table).num_rows == 0 and not built
    assert overlap.search_group(table.set_column(2, "text", [[*base, *other[:19], base[3].upper()]])).to_pylist() == [{"t": 3, "e": 1019}]
    assert built == [120]


def test_pairs_that_share_half_their_words_move_no_text(spark, monkeypatch):
    base, other = half_alike(random.Random(10), 120)
    rows = [(i, "train", "s", b) for i, b in enumerate(base)] + [(1000 + i, "test", "s", b) for i, b in enumerate(other)]
    df = spark.createDataFrame(rows, "row_id long, split string, source string, content string")
    text = overlap.eligible(df, "row_id", df["content"])
    classes = overlap.fingerprints(text, overlap.word_weights(text))
    near = overlap.meetings(classes)
    left = {(r.t, r.e) for r in overlap.possible(near, classes).collect()}
    assert near.count() > 200 and len(left) < 30 and left >= {(i, 1120 + i) for i in range(10)}
    monkeypatch.setattr(overlap, "BAG_SHARD", 1000)
    monkeypatch.setattr(overlap, "BAG_STREAM", 700)
    assert left == {(r.t, r.e) for r in overlap.possible(near, classes).collect()}
    assert pairs(spark, base, other) == {(i, 1120 + i) for i in range(10)}
