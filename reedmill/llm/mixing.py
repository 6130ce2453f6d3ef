"""Problem 9: sources combined to target shares of the total size in tokens.

Method: tokens are summed per source, a repetition rate follows for each source, and every document is emitted
``floor(rate)`` times plus one more copy drawn by a seeded hash with the fraction as its probability.

The rates are those at which each source has its part of the total size of all documents with a source.  A source that
falls short (its documents are too few even at ``max_repeats``) gives all it has; the mixture is smaller by what it
lacks, and the actual shares of the others are larger in proportion, which ``shares`` reports beside the targets.

Documents without a source take no part; a null or empty text has no tokens; a source without a weight is not used.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from reedmill.functions.session import cut_lineage

MEMO = 1 << 20
#: Size up to which the weights are broadcast.
MAX_SOURCES = 100_000


@functools.cache
def counter(path: str) -> Callable[[str], int]:
    """Number of byte-pair tokens of a text.  Pieces between which no merge happens are counted once each and kept."""
    import regex
    import tiktoken

    import public_tokenizers

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}  # noqa: SIM115
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    pieces = regex.compile(public_tokenizers.PATTERN).findall
    memo: dict[str, int] = {}

    def count(text: str) -> int:
        found = pieces(text)
        try:
            return sum(map(memo.__getitem__, found))
        except KeyError:
            if len(memo) > MEMO:
                memo.clear()
            for p in found:
                if p not in memo:
                    memo[p] = len(encoding._encode_single_piece(p.encode()))
            return sum(memo[p] for p in found)

    return count


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def token_count(text: Column, vocabulary: str | None = None) -> Column:
    """Tokens of a public tokenizer; the path of its vocabulary is a parameter."""

    @F.arrow_udf(LongType())
    def tokens(texts: pa.Array) -> pa.Array:
        count = counter(vocabulary or default_vocabulary())
        return pa.array([count(x) if x else 0 for x in texts.to_pylist()], pa.int64())

    return tokens(text)


def small(sources: DataFrame) -> DataFrame:
    """A table of one row per source, to be broadcast if its size allows it."""
    return F.broadcast(sources) if sources.limit(MAX_SOURCES + 1).count() <= MAX_SOURCES else sources


def rates(documents: DataFrame, weights: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """One row per weighted source: its size, target, repetition rate, and whether it falls short of the target."""
    sizes = documents.where("source is not null").select("source", token_count(F.col("text"), vocabulary).alias("tokens")).groupBy("source").agg(F.sum("tokens").alias("size"), F.count("*").alias("documents"))
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total"))
    rows = small(weights).join(sizes, "source", "left")
    rows = rows.crossJoin(F.broadcast(total)).withColumn("size", F.coalesce("size", F.lit(0)))  # total is one row
    target = F.col("target_pct") * F.col("total") / 100
    rate = F.when(F.col("size") > 0, F.least(F.col("max_repeats").cast("double"), target / F.col("size"))).otherwise(0.0)
    return rows.select("source", "target_pct", "max_repeats", "size", "total", F.coalesce("documents", F.lit(0)).alias("documents"), rate.alias("rate"), (F.col("size") * F.col("max_repeats") * 100 < F.col("target_pct") * F.col("total")).alias("short"))


def mix(documents: DataFrame, rate: DataFrame, key: str = "doc_id", seed: int = 11) -> DataFrame:
    """The mixture: one row (key, source, copy) per emitted copy."""
    chance = F.shiftrightunsigned(F.xxhash64(F.col(key), F.lit(seed)), 11) / float(1 << 53)
    whole = F.floor("rate")
    copies = (whole + (chance < F.col("rate") - whole).cast("long")).cast("int")
    used = documents.select(key, "source").join(small(cut_lineage(rate.select("source", "rate"))), "source").withColumn("copies", copies).where("copies > 0")
    return used.select(key, "source", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))


def shares(documents: DataFrame, weights: DataFrame, vocabulary: str | None = None, key: str = "doc_id", seed: int = 11) -> DataFrame:
    """The report: target and actual share of each source in the mixture, and its copies."""
    rate = rates(documents, weights, vocabulary)
    copies = mix(documents, rate, key, seed).groupBy(key, "source").agg(F.count("*").alias("copies"))
    tokens = documents.where("source is not null").select(key, token_count(F.col("text"), vocabulary).alias("tokens"))
    used = copies.join(tokens, key).groupBy("source").agg(F.sum("copies").alias("copies"), F.sum(F.col("copies") * F.col("tokens")).alias("used"))
    whole = used.agg(F.sum("used").alias("all_used"))
    return rate.join(used, "source", "left").crossJoin(F.broadcast(whole)).select("source", "target_pct", "max_repeats", "size", "rate", "short", F.coalesce("copies", F.lit(0)).alias("copies"), (F.coalesce("used", F.lit(0)) * 100 / F.col("all_used")).alias("actual_pct"))
