"""The second chunker: sentences of flat cleaned text packed by tokens of a pluggable tokenizer.

It shares no rule with the strategies of ``chunking``: another sentence split, another overlap (whole sentences that
fit into it, possibly none), and every passage below the least size is dropped unless all are.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reedmill.functions import text as T


@dataclass(frozen=True)
class Tokenizer:
    """Encodes a text to a list of tokens and back."""

    encode: Callable[[str], list]
    decode: Callable[[list], str]


def blank_tokens() -> Tokenizer:
    """Tokens parted at blanks.  Not a subword tokenizer: counts differ from one."""
    return Tokenizer(lambda s: s.split(), " ".join)


def byte_pairs(vocabulary: str, pattern: str) -> Callable[[], Tokenizer]:
    """A maker of a byte-pair tokenizer from a rank file; made once per worker."""

    def make() -> Tokenizer:
        import base64

        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        e = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return Tokenizer(e.encode_ordinary, lambda t: e.decode(t, errors="replace"))

    return make


def windows(text: str, tokenizer: Tokenizer, size: int, overlap: int) -> list[str]:
    """Token windows of a long sentence, decoded; a character cut apart becomes a replacement character."""
    tokens = tokenizer.encode(text)
    if len(tokens) <= size:
        return [text]
    if overlap >= size:
        raise ValueError("the overlap must be smaller than the size")
    starts = range(0, max(1, len(tokens) - overlap), size - overlap)
    parts = (tokenizer.decode(tokens[a : a + size]).strip() for a in starts)
    return [p for p in parts if p]


def passages(sentences: list[str], tokenizer: Tokenizer, size: int = 512, overlap: int = 96, least: int = 50) -> list[str]:
    n = lambda s: len(tokenizer.encode(s))
    out: list[str] = []
    held: list[tuple[str, int]] = []

    def flush() -> None:
        if held:
            out.append(" ".join(s for s, _ in held).strip())

    for sentence in sentences:
        k = n(sentence)
        if k > size:
            flush()
            held = []
            out += windows(sentence, tokenizer, size, overlap)
            continue
        if held and sum(c for _, c in held) + k > size:
            flush()
            room, keep = overlap, len(held)
            while keep and held[keep - 1][1] <= room:
                keep -= 1
                room -= held[keep][1]
            held = held[keep:]
        held = [*held, (sentence, k)]
    flush()
    sized = [(p, n(p)) for p in out]
    large = [p for p, c in sized if c >= least]
    if large or not sized:
        return large
    return [max(sized, key=lambda x: x[1])[0]]


OUT = "array<struct<text: string, n_tokens: int>>"


def flat_chunks(articles: DataFrame, size: int = 512, overlap: int = 96, least: int = 50, source: str = "", make: Callable[[], Tokenizer] = blank_tokens) -> DataFrame:
    """One row per passage.  Articles with a null id are skipped; an empty content has no passage."""
    if overlap >= size:
        raise ValueError("the overlap must be smaller than the size")
    kept: list[Tokenizer] = []

    @F.arrow_udf(OUT)
    def pack(sentences: pa.Array) -> pa.Array:
        if not kept:
            kept.append(make())
        t = kept[0]
        return pa.array([[{"text": p, "n_tokens": len(t.encode(p))} for p in passages(x, t, size, overlap, least)] if x else [] for x in sentences.to_pylist()], pa.list_(pa.struct([("text", pa.string()), ("n_tokens", pa.int32())])))

    fields = {c: T.clean_flat(F.col(c)) for c in ("title", "description", "category")}
    rows = articles.where("article_id is not null").select(F.col("article_id").try_cast("bigint").alias("article_id"), *(e.alias(c) for c, e in fields.items()), pack(T.flat_sentences(F.col("content"))).alias("p"))
    # outer, as an inner explode makes the optimiser filter by the packed list below, where it would be packed once more
    rows = rows.where("article_id is not null").select("article_id", *fields, F.posexplode_outer("p").alias("chunk_index", "p")).where("p is not null")
    return rows.select(
        T.flat_chunk_id(F.col("article_id"), F.col("chunk_index")).alias("chunk_id"), "article_id", *fields, F.lit(source).alias("source"), F.lit("").alias("url"), "chunk_index", F.col("p.n_tokens").alias("n_tokens"), F.col("p.text").alias("text"),
        T.passage_text(F.col("title"), F.col("description"), F.col("p.text")).alias("embedding_text"),
    )


def flat_stats(articles: DataFrame, chunked: DataFrame) -> DataFrame:
    """Articles with passages, passages, their average size, and articles with an id but no passage."""
    per = chunked.agg(F.countDistinct("article_id").alias("articles"), F.count("*").alias("chunks"), F.avg("n_tokens").alias("avg_tokens"))
    empty = articles.where("article_id is not null").agg(F.count_if(F.size(T.flat_sentences(F.col("content"))) == 0).alias("skipped_empty"))
    return per.crossJoin(empty)  # two rows of one
