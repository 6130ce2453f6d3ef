"""Lexical and vector retrieval, fusion, and metrics of retrieval and answers."""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from reedmill.functions import patterns as P
from reedmill.functions import text as T

K1, B = 1.5, 0.75
RRF = 60
SALTS = 32
#: Query vectors that are held at once.
QUERIES = 2000
#: Weights that are added at once.
CELLS = 1 << 22
#: Digits to which scores are compared, as sums differ in their last ones with the order.
DIGITS = 9


def normal_text(text: Column, lower: bool = True) -> Column:
    """Composed and in lower case; a null is empty."""
    text = T.composed(F.coalesce(text, F.lit("")))
    return F.lower(text) if lower else text


def query_terms(text: Column, lower: bool = True) -> Column:
    """Words parted at blanks."""
    return F.filter(F.split(normal_text(text, lower), P.BLANKS), lambda w: w != "")


def top(scored: DataFrame, k: int, query: str = "query_id", item: str = "doc_id") -> DataFrame:
    """The k best items per query with their rank, scores equal to ``DIGITS`` digits by item; ranked within salts first, so that no query gathers in one task."""
    order = (F.desc(F.round("score", DIGITS)), F.col(item))
    near = scored.withColumn("_s", F.pmod(F.hash(item), F.lit(SALTS)))
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy(query, "_s").orderBy(*order))).where(F.col("rank") <= k).drop("_s")
    return near.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(*order))).where(F.col("rank") <= k)


class Terms:
    """The words of a block of queries."""

    def __init__(self, queries: list[tuple[int, list[str]]]) -> None:
        self.ids = np.array([q for q, _ in queries], np.int64)
        self.place = {w: i for i, w in enumerate(sorted({w for _, words in queries for w in words}))}
        self.asked = np.zeros((len(self.place), len(queries)))
        for k, (_, words) in enumerate(queries):
            self.asked[[self.place[w] for w in set(words)], k] = 1

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Lengths of some documents, and where words of the queries stand: document, word and how often, by document."""
        place, size = self.place, len(self.place)
        parted = [t.split() for t in texts]
        known = [[place[w] for w in words if w in place] for words in parted]
        doc = np.repeat(np.arange(len(texts)), [len(x) for x in known])
        pair, tf = np.unique(doc * size + np.fromiter(itertools.chain.from_iterable(known), np.int64, len(doc)), return_counts=True)
        return np.array([len(x) for x in parted], np.int64), pair // max(size, 1), pair % max(size, 1), tf


def bm25_block(texts: DataFrame, terms: Terms, k: int, k1: float, b: float) -> DataFrame:
    """(query_id, doc_id, score) of the best documents per batch: one scan for the statistics, one for the scores."""
    size = len(terms.place)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 2, np.int64)
        for batch in batches:
            length, _, word, _ = terms.counts(batch.column(1).to_pylist())
            total[:size] += np.bincount(word, minlength=size)
            total[size:] += (len(length), length.sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 2)), pa.array(total)], names=["i", "n"])

    stats = np.zeros(size + 2, np.int64)
    for i, n in texts.mapInArrow(count, "i long, n long").groupBy("i").agg(F.sum("n")).collect():  # one row per word of the queries
        stats[i] = n
    df, n, mean = stats[:size], stats[size], stats[size + 1] / max(stats[size], 1)
    weight = terms.asked * np.log(1 + (n - df + 0.5) / (df + 0.5))[:, None]
    held = max(1, CELLS // max(len(terms.ids), 1))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            order = np.argsort(ids, kind="stable")
            length, doc, word, tf = terms.counts(batch.column(1).take(pa.array(order)).to_pylist())
            part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[doc] / max(mean, 1e-300)))
            scores = np.zeros((len(ids), len(terms.ids)))
            for a in range(0, len(doc), held):
                d = doc[a : a + held]
                heads = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
                scores[d[heads]] += np.add.reduceat(weight[word[a : a + held]] * part[a : a + held, None], heads, axis=0)
            scores = scores.T
            best = np.argsort(-np.round(scores, DIGITS), axis=1, kind="stable")[:, :k]
            query = np.repeat(terms.ids, best.shape[1])
            found = np.take_along_axis(scores, best, 1).ravel()
            some = found > 0
            yield pa.RecordBatch.from_arrays([pa.array(query[some]), pa.array(ids[order][best.ravel()][some]), pa.array(found[some])], names=["query_id", "doc_id", "score"])

    return texts.mapInArrow(score, "query_id long, doc_id long, score double")


def bm25(documents: DataFrame, queries: DataFrame, k: int = 10, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, doc_id, score, rank) for documents (doc_id, text) and queries (query_id, text).

    Queries are held in blocks, as word weights; each batch of documents is scored against a block as a sparse product
    and keeps its best k, so that no posting is shuffled and a word that stands everywhere is no hot key.  Null and
    empty texts count as documents without words; documents without a word of the query are not ranked; equal scores
    rank by doc_id.
    """
    count = queries.count()
    blocks = max(1, -(-count // QUERIES))
    texts = documents.select("doc_id", normal_text(F.col("text")).alias("text"))
    out = None
    for block in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        rows = part.select("query_id", normal_text(F.col("text")).alias("text")).orderBy("query_id").collect()  # about QUERIES rows
        terms = Terms([(r.query_id, r.text.split()) for r in rows])
        if terms.place:
            found = bm25_block(texts, terms, k, k1, b)
            out = found if out is None else out.unionByName(found)
    if out is None:
        out = documents.sparkSession.createDataFrame([], "query_id long, doc_id long, score double")
    return top(out, k)


def with_texts(ranking: DataFrame, documents: DataFrame) -> DataFrame:
    """A ranking with the title (first line) and the text of each document."""
    return ranking.join(documents.select("doc_id", F.substring_index("text", "\n", 1).alias("title"), "text"), "doc_id")


def dense(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, doc_id, score, rank) by cosine, for vectors (doc_id, vector) and queries (query_id, vector).

    Queries are held in blocks; a batch of vectors meets a block as one matrix product and keeps its best k.  Null
    vectors have no neighbours, a zero vector has cosine 0.
    """
    count = queries.count()
    out = None
    for block in range(max(1, -(-count // QUERIES))):
        part = queries.where("vector is not null")
        if count > QUERIES:
            part = part.where(F.pmod(F.xxhash64("query_id"), F.lit(-(-count // QUERIES))) == block)
        rows = part.orderBy("query_id").collect()  # about QUERIES rows
        if not rows:
            continue
        q = np.array([r.vector for r in rows], np.float64)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        ids = np.array([r.query_id for r in rows])

        def work(batches: Iterator[pa.RecordBatch], q: np.ndarray = q, ids: np.ndarray = ids) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                v = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
                v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
                doc = batch.column(0).to_numpy()
                order = np.argsort(doc, kind="stable")
                s = q @ v[order].T
                best = np.argsort(-s, axis=1, kind="stable")[:, :k]
                n = best.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), pa.array(doc[order][best].ravel()), pa.array(np.take_along_axis(s, best, 1).ravel())], names=["query_id", "doc_id", "score"])

        found = vectors.where("vector is not null").select("doc_id", "vector").mapInArrow(work, "query_id long, doc_id long, score double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = vectors.sparkSession.createDataFrame([], "query_id long, doc_id long, score double")
    return top(out, k)


def reciprocal_ranks(a: DataFrame, b: DataFrame, k: int = 10, constant: int = RRF) -> DataFrame:
    """Two rankings fused by reciprocal ranks."""
    both = a.select("query_id", "doc_id", F.col("rank").alias("ra")).join(b.select("query_id", "doc_id", F.col("rank").alias("rb")), ["query_id", "doc_id"], "full_outer")
    part = lambda c: F.coalesce(1 / (constant + F.col(c)), F.lit(0.0))
    return top(both.select("query_id", "doc_id", (part("ra") + part("rb")).alias("score")), k)


def min_max(ranking: DataFrame) -> DataFrame:
    """Scores of each query scaled to 0..1; equal scores become 1."""
    bounds = ranking.groupBy("query_id").agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    return ranking.join(bounds, "query_id").withColumn("score", F.when(F.col("hi") > F.col("lo"), (F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(1.0)).drop("lo", "hi")


def z_scores(ranking: DataFrame) -> DataFrame:
    """Scores of each query less their mean, by their deviation; equal scores become 0."""
    m = ranking.groupBy("query_id").agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("d"))
    return ranking.join(m, "query_id").withColumn("score", F.when(F.col("d") > 0, (F.col("score") - F.col("m")) / F.col("d")).otherwise(0.0)).drop("m", "d")


def weighted(dense_ranking: DataFrame, lexical_ranking: DataFrame, alpha: float = 0.5, k: int = 10) -> DataFrame:
    """alpha * dense + (1 - alpha) * lexical over min-max scaled scores; an absent score counts 0."""
    a, b = min_max(dense_ranking), min_max(lexical_ranking)
    both = a.select("query_id", "doc_id", F.col("score").alias("x")).join(b.select("query_id", "doc_id", F.col("score").alias("y")), ["query_id", "doc_id"], "full_outer")
    return top(both.select("query_id", "doc_id", (alpha * F.coalesce("x", F.lit(0.0)) + (1 - alpha) * F.coalesce("y", F.lit(0.0))).alias("score")), k)


def rerank(ranking: DataFrame, texts: DataFrame, scorer, k: int = 10) -> DataFrame:
    """A ranking rescored by a pluggable function of (query text, document text); texts: query_id, doc_id, query, text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, t = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([float(scorer(a, b)) for a, b in zip(q, t, strict=True)])], names=["query_id", "doc_id", "score"])

    rows = ranking.select("query_id", "doc_id").join(texts, ["query_id", "doc_id"]).select("query_id", "doc_id", "query", "text")
    return top(rows.mapInArrow(work, "query_id long, doc_id long, score double"), k)


def metrics(ranking: DataFrame, gold: DataFrame, cuts: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """Per query of gold (query_id, doc_id): hits and recall at the cuts, MRR and nDCG at the last; queries without a hit count 0."""
    last = max(cuts)
    relevant = gold.distinct().groupBy("query_id").agg(F.count("*").alias("relevant"))
    hits = ranking.where(F.col("rank") <= last).join(gold.distinct(), ["query_id", "doc_id"], "left_semi")
    per = hits.groupBy("query_id").agg(*(F.count_if(F.col("rank") <= c).alias(f"hits_{c}") for c in cuts), (1 / F.min("rank")).alias("mrr"), F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    rows = relevant.join(per, "query_id", "left").fillna(0)
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("relevant"), F.lit(last)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    return rows.select("query_id", "relevant", *((F.col(f"hits_{c}") / F.col("relevant")).alias(f"recall_{c}") for c in cuts), *((F.col(f"hits_{c}") > 0).cast("int").alias(f"hit_{c}") for c in cuts), F.col("mrr").alias("mrr_10"), (F.col("dcg") / ideal).alias("ndcg_10"))


def mean_metrics(per_query: DataFrame, groups: DataFrame | None = None, by: str = "qa_type") -> DataFrame:
    """Means over all queries, or per group of (query_id, group)."""
    names = [c for c in per_query.columns if c not in ("query_id", "relevant")]
    rows = per_query if groups is None else per_query.join(groups, "query_id")
    aggregates = [F.count("*").alias("queries"), *(F.avg(c).alias(c) for c in names)]
    return rows.agg(*aggregates) if groups is None else rows.groupBy(by).agg(*aggregates)


def context(ranking: DataFrame, documents: DataFrame, k: int = 5) -> DataFrame:
    """The texts of the best k documents of each query, each under a source line, as one context."""
    rows = ranking.where(F.col("rank") <= k).join(documents.select("doc_id", "text"), "doc_id")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "text"))), lambda x: F.concat(F.lit("[Nguồn "), x["doc_id"].cast("string"), F.lit("]\n"), x["text"]))
    return rows.groupBy("query_id").agg(F.array_join(parts, "\n\n").alias("context"))


def normal_answer(text: Column) -> Column:
    """Lower case, without punctuation, words one blank apart."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\p{N}]+", " "), " +", " "))


def answer_words(text: Column) -> Column:
    return F.filter(F.split(normal_answer(text), " "), lambda w: w != "")


def exact_match(answer: Column, gold: Column) -> Column:
    return (normal_answer(answer) == normal_answer(gold)).cast("int")


@F.arrow_udf(DoubleType())
def _bag_f1(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([None if x is None or y is None else _f(sum((Counter(x) & Counter(y)).values()), len(x), len(y)) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())


def _f(common: int, n: int, m: int) -> float:
    if not n or not m:
        return float(n == m)
    return 2 * common / (n + m)


def _lcs(a: list[str], b: list[str]) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@F.arrow_udf(DoubleType())
def _rouge_l(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([None if x is None or y is None else _f(_lcs(x, y), len(x), len(y)) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())


def token_f1(answer: Column, gold: Column) -> Column:
    """Overlap of the words as bags; two empty answers agree."""
    return _bag_f1(answer_words(answer), answer_words(gold))


def rouge_l(answer: Column, gold: Column) -> Column:
    """F-measure of the longest common subsequence of words."""
    return _rouge_l(answer_words(answer), answer_words(gold))


def refusal_metrics(rows: DataFrame) -> DataFrame:
    """For (is_possible, refused, cited): how often impossible questions are refused, possible ones wrongly, and answers cite a source."""
    yes, no = F.coalesce("is_possible", F.lit(False)), F.coalesce(~F.col("is_possible"), F.lit(False))
    share = lambda a, b: F.count_if(a & b) / F.nullif(F.count_if(b), F.lit(0))
    return rows.agg(share(F.col("refused"), no).alias("refusal_accuracy"), share(F.col("refused"), yes).alias("false_refusal_rate"), share(F.col("cited"), ~F.col("refused")).alias("citation_rate"))
