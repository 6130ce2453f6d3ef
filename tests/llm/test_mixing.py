import base64

import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from reedmill.llm.mixing import counter, default_vocabulary, mix, rates, shares

PATH = default_vocabulary()


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_counts_are_the_tokenizer_s(text):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    e = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert counter(PATH)(text) == len(e.encode_ordinary(text))


def test_mixture(spark):
    docs = [(i, "a b c d", "big" if i % 10 else "small") for i in range(2000)] + [(5000, "x", None), (5001, None, "big"), (5002, "", "big"), (5003, "z", "odd")]
    documents = spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("*", "1 as rate", "2 as tokens")
    weights = spark.createDataFrame([("big", 70, 4), ("small", 29, 2), ("none", 1, 3)], "source string, target_pct int, max_repeats int")
    got = {r.source: r for r in rates(documents, weights).collect()}
    assert {s for s, r in got.items() if r.short} == {"small", "none"} and got["small"].rate == 2.0
    rows = mix(documents, rates(documents, weights)).collect()
    assert len(set(map(tuple, rows))) == len(rows) and max(r["copy"] for r in rows if r.source == "small") == 2
    big = sum(r.source == "big" for r in rows)
    assert abs(big / 1802 - got["big"].rate) < 0.05
    actual = {r.source: r.actual_pct for r in shares(documents, weights).collect()}
    assert abs(sum(actual.values()) - 100) < 1e-6 and actual["none"] == 0
    assert mix(documents.limit(0), rates(documents.limit(0), weights)).count() == 0
