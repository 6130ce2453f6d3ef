import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from reedmill.operators import retrieval as R
from reedmill.operators import similarity as S


def test_tfidf_groups(spark):
    rows = [(i, f"a{i:02d}", f"tin {i % 4}", None, f"nhóm {'mưa bão lũ' if i % 4 == 0 else 'bóng đá cúp' if i % 4 == 1 else 'chữ%d khác%d' % (i, i)}", "k" if i < 40 else None if i == 40 else "l") for i in range(42)]
    df = spark.createDataFrame(rows + rows[:3], "row_id long, article_id string, title string, description string, content string, category string").selectExpr("*", "1 as w", "2 as term")
    w = S.weights(S.sampled(df))
    norms = [r.s for r in w.groupBy("category", "article_id").agg(F.sum(F.col("w") * F.col("w")).alias("s")).collect()]
    assert len(norms) == 41 and all(abs(x - 1) < 1e-9 for x in norms)
    groups = S.cross_groups(df).collect()
    assert [g.category for g in groups] == ["k", "k"] and all(len(g.article_ids) == 3 and g.similarity > 0.9 for g in groups)
    assert {tuple(r.article_ids) for r in S.triples(df).collect()} == {tuple(f"a{i:02d}" for i in x) for x in ((0, 1, 2), (3, 4, 5))} or S.triples(df).count() == 2
    assert S.cross_groups(df.limit(0)).count() == 0


def greedy_by_hand(m, size, least):
    left, out = list(range(len(m))), []
    while len(left) >= size:
        seed = max(left, key=lambda a: (np.mean([m[a, b] for b in left if b != a]), -a))
        near = sorted((b for b in left if b != seed), key=lambda b: -m[seed, b])[: size - 1]
        chosen = [seed, *near]
        mean = np.mean([m[a, b] for i, a in enumerate(chosen) for b in chosen[i + 1 :]])
        if mean >= least:
            out.append((mean, chosen))
        left = [x for x in left if x not in chosen]
    return out


def test_greedy():
    rng = np.random.default_rng(1)
    for _ in range(50):
        v = rng.random((rng.integers(0, 14), 5))
        m = v @ v.T
        got, want = S.greedy(m, 3, 1.0), greedy_by_hand(m, 3, 1.0)
        assert [g for _, g in got] == [g for _, g in want] and np.allclose([s for s, _ in got], [s for s, _ in want])


def test_bm25_and_fusion(spark):
    docs = spark.createDataFrame([(1, "mưa lớn ở phố"), (2, "phố phố"), (3, None), (4, ""), (5, "xa lạ")], "doc_id long, text string").selectExpr("*", "1 as tf", "2 as term", "3 as n")
    queries = spark.createDataFrame([(10, "phố MƯA phố"), (11, "không"), (12, None)], "query_id long, text string")
    rows = R.bm25(docs, queries).orderBy("rank").collect()
    assert [(r.query_id, r.doc_id, r.rank) for r in rows] == [(10, 1, 1), (10, 2, 2)]
    mean = (4 + 2 + 2) / 5
    idf = lambda df: math.log(1 + (5 - df + 0.5) / (df + 0.5))
    score = lambda tf, dl, df: idf(df) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))
    assert abs(rows[0].score - score(1, 4, 1) - score(1, 4, 2)) < 1e-9 and abs(rows[1].score - score(2, 2, 2)) < 1e-9
    a = spark.createDataFrame([(1, 5, 3.0, 1), (1, 6, 2.0, 2)], "query_id long, doc_id long, score double, rank int")
    b = spark.createDataFrame([(1, 6, 9.0, 1)], "query_id long, doc_id long, score double, rank int")
    assert [(r.doc_id, round(r.score, 9)) for r in R.reciprocal_ranks(a, b).orderBy("rank").collect()] == [(6, round(1 / 62 + 1 / 61, 9)), (5, round(1 / 61, 9))]
    assert [(r.doc_id, r.score) for r in R.weighted(a, b, 0.8).orderBy("rank").collect()] == [(5, 0.8), (6, pytest.approx(0.2))]
    assert [r.score for r in R.z_scores(a).orderBy("doc_id").collect()] == [1.0, -1.0]
    texts = spark.createDataFrame([(1, 5, "a", "b"), (1, 6, "a", "bbb")], "query_id long, doc_id long, query string, text string")
    assert [r.doc_id for r in R.rerank(a, texts, lambda q, t: len(t)).orderBy("rank").collect()] == [6, 5]
    assert R.context(R.bm25(docs, queries), docs).first().context == "[Nguồn 1]\nmưa lớn ở phố\n\n[Nguồn 2]\nphố phố"
    assert R.bm25(docs.limit(0), queries).count() == 0


def test_dense_and_metrics(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(300, 8))
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, [0.0] * 8)], "doc_id long, vector array<double>").repartition(5)
    queries = vectors.where("doc_id % 100 = 0 and vector is not null").selectExpr("doc_id as query_id", "vector")
    got = {(r.query_id, r.rank): r.doc_id for r in R.dense(vectors, queries, 5).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q in (0, 100, 200):
        assert [got[q, k] for k in range(1, 6)] == np.argsort(-(u[q] @ u.T))[:5].tolist()
    assert R.dense(vectors, queries.limit(0)).count() == 0
    ranking = spark.createDataFrame([(1, 5, 1), (1, 6, 2), (1, 7, 3), (2, 5, 1)], "query_id long, doc_id long, rank int")
    gold = spark.createDataFrame([(1, 6), (1, 99), (2, 8)], "query_id long, doc_id long")
    m = {r.query_id: r for r in R.metrics(ranking, gold).collect()}
    assert (m[1].recall_1, m[1].recall_3, m[1].hit_3, m[1].mrr_10) == (0, 0.5, 1, 0.5) and abs(m[1].ndcg_10 - (1 / math.log2(3)) / (1 + 1 / math.log2(3))) < 1e-9 and m[2].mrr_10 == 0
    assert R.mean_metrics(R.metrics(ranking, gold)).first().mrr_10 == 0.25


def test_answer_scores(spark):
    rows = [("Hà Nội, là.", "là hà nội"), ("a b c", "a c"), ("", "."), ("x", ""), (None, "x")]
    df = spark.createDataFrame(rows, "a string, g string")
    got = df.select(R.exact_match(F.col("a"), F.col("g")), R.token_f1(F.col("a"), F.col("g")), R.rouge_l(F.col("a"), F.col("g"))).collect()
    assert [tuple(r) for r in got] == [(0, 1.0, pytest.approx(2 / 3)), (0, 0.8, 0.8), (1, 1.0, 1.0), (0, 0.0, 0.0), (None, None, None)]
    flags = spark.createDataFrame([(True, False, True), (True, True, False), (False, True, False), (None, False, False)], "is_possible boolean, refused boolean, cited boolean")
    assert tuple(R.refusal_metrics(flags).first()) == (1.0, 0.5, 0.5)
