"""Grouping of related articles within a category by TF-IDF similarity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reedmill.operators.splits import sample_per_group

SAMPLE = 50
FEATURES = 5000
GROUP = 3
LEAST_SIMILARITY = 0.15
GROUPS_PER_CATEGORY = 2
WORD = r"(?U)\b\w\w+\b"


def weights(articles: DataFrame, features: int = FEATURES) -> DataFrame:
    """L2-normalised TF-IDF weights (category, article_id, term, w), each category on its own; null fields are the word nan."""
    text = F.concat_ws(" ", *(F.coalesce(c, F.lit("nan")) for c in ("title", "description")), F.substring(F.coalesce("content", F.lit("nan")), 1, 500))
    tf = articles.select("category", "article_id", F.explode(F.regexp_extract_all(F.lower(text), F.lit(WORD), 0)).alias("term")).groupBy("category", "article_id", "term").agg(F.count("*").alias("tf"))
    terms = tf.groupBy("category", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))
    rank = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("total"), "term"))
    terms = terms.withColumn("r", rank).where(F.col("r") <= features)  # a category is a sample of at most SAMPLE articles
    n = articles.groupBy("category").agg(F.count("*").alias("n"))
    raw = tf.join(terms, ["category", "term"]).join(n, "category").withColumn("x", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    norm = raw.groupBy("category", "article_id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return raw.join(norm, ["category", "article_id"]).select("category", "article_id", "term", (F.col("x") / F.col("norm")).alias("w"))


def sampled(articles: DataFrame, size: int = SAMPLE, seed: int = 0) -> DataFrame:
    """At most ``size`` articles per category (the sampling is the operator's), one row per article."""
    once = articles.where("category is not null and article_id is not null").groupBy("category", "article_id").agg(F.min_by(F.struct("title", "description", "content"), "row_id").alias("x")).select("category", "article_id", "x.*")
    return sample_per_group(once, "category", "article_id", size, seed)


def pairs(w: DataFrame) -> DataFrame:
    """Cosine of every pair of sampled articles of a category that share a term."""
    a, b = w.select("category", "term", F.col("article_id").alias("a"), F.col("w").alias("wa")), w.select("category", "term", F.col("article_id").alias("b"), F.col("w").alias("wb"))
    return a.join(b, ["category", "term"]).where("a < b").groupBy("category", "a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("similarity"))


def greedy(similarity: np.ndarray, size: int = GROUP, least: float = LEAST_SIMILARITY) -> list[tuple[float, list[int]]]:
    """Groups (mean similarity, members): the most central remaining article and its nearest ones, which are used up in any case."""
    left = np.arange(len(similarity))
    out = []
    while len(left) >= max(size, 2):
        block = similarity[np.ix_(left, left)]
        mean = (block.sum(axis=1) - np.diag(block)) / (len(left) - 1)
        seed = int(np.argmax(mean))
        others = np.delete(np.arange(len(left)), seed)
        near = others[np.argsort(-block[seed, others], kind="stable")][: size - 1]
        chosen = [seed, *near.tolist()]
        inner = block[np.ix_(chosen, chosen)][np.triu_indices(size, 1)]
        if inner.mean() >= least:
            out.append((float(inner.mean()), left[chosen].tolist()))
        left = np.delete(left, chosen)
    return out


def cross_groups(articles: DataFrame, sample: int = SAMPLE, size: int = GROUP, most: int = GROUPS_PER_CATEGORY, least: float = LEAST_SIMILARITY, seed: int = 0) -> DataFrame:
    """Per category the best groups (category, group_no, similarity, article_ids); categories with fewer articles than a group are skipped."""
    rows = sampled(articles, sample, seed)

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=["article_id"])
        ids = sorted(pdf["article_id"].unique())
        found: list[tuple[float, list[int]]] = []
        if len(ids) >= size:
            pdf = pdf.assign(i=np.searchsorted(ids, pdf["article_id"]))
            terms, t = np.unique(pdf["term"].to_numpy(), return_inverse=True)
            m = np.zeros((len(ids), len(terms)))
            m[pdf["i"].to_numpy(), t] = pdf["w"].to_numpy()
            found = sorted(greedy(m @ m.T, size, least), key=lambda g: -g[0])[:most]
        text = lambda x: pd.Series(x, dtype=object)  # noqa: E731  also where there is no group
        return pd.DataFrame({"category": text([pdf["category"].iloc[0]] * len(found) if found else []), "group_no": pd.Series(range(len(found)), dtype="int32"), "similarity": pd.Series([s for s, _ in found], dtype="float64"), "article_ids": text([[ids[i] for i in g] for _, g in found])})

    return weights(rows).groupBy("category").applyInPandas(work, "category string, group_no int, similarity double, article_ids array<string>")


def triples(articles: DataFrame, size: int = GROUP, most: int = GROUPS_PER_CATEGORY) -> DataFrame:
    """The fallback without similarity: sampled articles in the order of their ids, in groups of the same size."""
    number = F.row_number().over(Window.partitionBy("category").orderBy("article_id")) - 1
    rows = sampled(articles).withColumn("group_no", F.floor(number / size).cast("int")).where(F.col("group_no") < most)
    return rows.groupBy("category", "group_no").agg(F.sort_array(F.collect_list("article_id")).alias("article_ids")).where(F.size("article_ids") == size)
