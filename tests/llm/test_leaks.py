import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from reedmill.llm import leaks
from reedmill.llm.leaks import Blocks, Items, found, lcs, window_sums


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=25), st.lists(st.integers(0, 6), max_size=40))
def test_lcs(a, b):
    bits = {}
    for i, x in enumerate(a):
        bits[x] = bits.get(x, 0) | 1 << i
    t = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
    assert lcs(bits, len(a), b) == t[-1, -1]


def test_windows():
    first, sums = window_sums(np.arange(8, dtype=np.float32).reshape(8, 1), np.array([0, 5, 6, 8]), 3)
    assert list(first) == [0, 1, 2, 5, 6] and list(sums[:, 0]) == [3, 6, 9, 5, 13]
    assert Items([1, 2, 3], ["a b", " . ", ""]).ids == [1]


def test_blocks_are_counts():
    rng = np.random.default_rng(1)
    offsets, size = np.array([0, 40, 40, 47, 90]), 6
    index = rng.integers(0, size + 1, 90)
    blocks = Blocks(index, offsets, size)
    assert list(blocks.starts) == [0, 16, 32, 40, 47, 63, 79] and list(blocks.ends) == [0, 3, 3, 4, 7]
    counts = np.zeros((7, size))
    for i, (a, b) in enumerate(zip(blocks.starts, [16, 32, 40, 47, 63, 79, 90])):
        for w in index[a:b]:
            if w < size:
                counts[i, w] += 1
    basis, back = rng.standard_normal((size, 3)).astype(np.float32), rng.standard_normal((7, 3)).astype(np.float32)
    assert np.allclose(blocks.times(basis), counts @ basis, atol=1e-5) and np.allclose(blocks.transposed(back, size), counts.T @ back, atol=1e-5)


def test_short_and_very_long_items(spark):
    rng = random.Random(5)
    text = lambda n: [f"tu{rng.randrange(3000)}" for _ in range(n)]
    long = text(1500)
    docs = [(i, " ".join(text(300))) for i in range(60)] + [(100, " ".join(text(50) + ["Khóa", "số", "bảy", "mở"] + text(50))), (101, " ".join(text(100) + long[:1200] + text(100))), (102, "số mở " + " ".join(text(80)) + " bảy khóa")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    ev = spark.createDataFrame([(1, "khóa số bảy mở"), (2, " ".join(long))], "item_id long, text string")
    assert {tuple(r)[:2] for r in found(df, ev).collect()} == {(100, 1), (101, 2)}


def test_recall_against_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [f"tu{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(500)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [text(rng.randint(60, 140)) for _ in range(30)]
    docs, truth = [], set()
    for i in range(300):
        w = text(rng.randint(40, 400))
        if i % 3 == 0:
            k = rng.randrange(30)
            share = rng.choice([0.3, 0.7, 0.85, 1.0])
            piece = items[k][: int(share * len(items[k]))]
            piece = [x if rng.random() > 0.05 or share < 0.6 else "khac" for x in piece]
            at = rng.randrange(len(w))
            w = w[:at] + ["<b>" + piece[0] + "</b>", *piece[1:]] + w[at:]
            if share > 0.6:
                truth.add((i, k))
        docs.append((i, " ".join(w).upper() if i % 2 else ", ".join(w)))
    docs += [(900, None), (901, ""), (902, " ".join(text(60_000)) + " " + " ".join(items[0]))]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id", "2 as held")
    ev = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)] + [(98, None), (99, "ngắn")], "item_id long, text string")
    assert {tuple(r)[:2] for r in found(df, ev).collect()} == truth | {(902, 0)}
    assert found(df, ev.limit(0)).count() == 0 and found(df.limit(0), ev).count() == 0


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(leaks, "ITEMS", 2)
    ev = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(20))) for i in range(7)], "item_id long, text string")
    df = ev.selectExpr("item_id + 100 as doc_id", "concat('một hai ', text) as text")
    assert {(r.doc_id, r.item_id) for r in found(df, ev).collect()} == {(i + 100, i) for i in range(7)}
