"""Chunking of articles under four comparable strategies.

The sequential strategies run per Arrow batch in Python; assembly into chunks, the merge of small tails, the cap and
the statistics are native.  The token strategy exists in both forms, which the tests hold against each other.

A null or blank content has no chunk.  A content of at most ``small_article_chars`` characters is one chunk.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reedmill.functions import patterns as P
from reedmill.functions import text as T

TOKEN = re.compile(r"\S+")
SENTENCE = re.compile(P.SENTENCE)
#: Separators of the recursive strategy, coarse to fine.
SEPARATORS = ("\n\n", "\n", ". ", "? ", "! ", " ")

Unit = tuple[str, int, int, int, str]  # text, start, end, tokens, structure


@dataclass(frozen=True)
class ChunkingConfig:
    strategy: str = "token"
    chunk_size: int = 450
    overlap: int = 80
    min_chunk_tokens: int = 80
    small_article_chars: int = 1000
    max_chunks_per_article: int | None = None
    inject_title_description: bool = True


def size_of(text: str) -> int:
    return sum(1 for _ in TOKEN.finditer(text))


def token_windows(text: str, size: int, overlap: int) -> Iterator[tuple[str, int, int, int]]:
    """Windows of tokens, cut out of the text with its inner blanks."""
    spans = [m.span() for m in TOKEN.finditer(text)]
    first = 0
    while first < len(spans):
        window = spans[first : first + size]
        a, b = window[0][0], window[-1][1]
        yield text[a:b], a, b, len(window)
        if first + size >= len(spans):
            return
        first += max(1, size - overlap)


def recursive_parts(text: str, size: int, overlap: int) -> Iterator[str]:
    """Parts no longer than the size where separators allow it, packed greedily; each takes the end of the one before along."""
    parts = [text]
    for separator in SEPARATORS:
        finer: list[str] = []
        for part in parts:
            if len(part) <= size or separator not in part:
                finer.append(part)
                continue
            *heads, tail = part.split(separator)
            finer += [h + separator for h in heads]
            finer += [tail] * bool(tail)
        parts = finer
    held = ""
    for part in parts:
        if held and len(held) + len(part) > size:
            yield held
            held = (held[-overlap:] if overlap > 0 else "") + part
        else:
            held += part
    yield held


def sentence_windows(text: str, size: int, overlap: int) -> Iterator[str]:
    """Sentences packed up to the size; a new window begins with the last sentences of the one before, at least one."""
    found = [s for s in (m.group().strip() for m in SENTENCE.finditer(text)) if s]
    if not found:
        if text.strip():
            yield text
        return
    window: list[tuple[str, int]] = []
    for sentence in found:
        n = size_of(sentence)
        if window and sum(k for _, k in window) + n > size:
            yield " ".join(s for s, _ in window)
            kept, total = len(window), 0
            while kept and (total < overlap or kept == len(window)):
                kept -= 1
                total += window[kept][1]
            window = window[kept:]
        if n > size:
            for piece, *_ in token_windows(sentence, size, overlap):
                yield piece
            window = []
        else:
            window.append((sentence, n))
    if window:
        yield " ".join(s for s, _ in window)


def located(text: str, parts: Iterator[str]) -> Iterator[tuple[str, int, int, int]]:
    """Spans of parts: looked for from where the last one ended, else from the start, else taken to begin there."""
    seen = 0
    for part in parts:
        part = part.strip()
        if not part:
            continue
        at = text.find(part, seen)
        at = at if at >= 0 else text.find(part)
        at = at if at >= 0 else seen
        seen = max(seen, at + len(part))
        yield part, at, at + len(part), size_of(part)


def paragraphs(text: str) -> list[tuple[str, str, int]]:
    """Name, stripped text and offset (of the unstripped text) of the non-empty paragraphs."""
    spans, begin = [], 0
    for gap in re.finditer(r"\n+|\Z", text):
        raw = text[begin : gap.start()]
        if raw.strip():
            spans.append((raw.strip(), begin))
        begin = gap.end()
    if len(spans) == 1:
        return [("content", *spans[0])]
    return [(f"paragraph_{i:03d}", t, at) for i, (t, at) in enumerate(spans)]


def _token(text: str, c: ChunkingConfig) -> Iterator[Unit]:
    return ((*u, "content") for u in token_windows(text, c.chunk_size, c.overlap))


def _recursive(text: str, c: ChunkingConfig) -> Iterator[Unit]:
    return ((*u, "content") for u in located(text, recursive_parts(text, c.chunk_size, c.overlap)))


def _sentence(text: str, c: ChunkingConfig) -> Iterator[Unit]:
    return ((*u, "content") for u in located(text, sentence_windows(text, c.chunk_size, c.overlap)))


def _structured(text: str, c: ChunkingConfig) -> Iterator[Unit]:
    for name, body, offset in paragraphs(text):
        for part, a, b, n in located(body, sentence_windows(body, c.chunk_size, c.overlap)):
            yield part, offset + a, offset + b, n, name


#: Strategy: the function that cuts a content, and the name of the implementation in the metadata.
STRATEGIES: dict[str, tuple[Callable[[str, ChunkingConfig], Iterator[Unit]], str]] = {
    "token": (_token, "internal_token_window"),
    "langchain_recursive": (_recursive, "internal_recursive_character_fallback"),
    "llamaindex": (_sentence, "internal_sentence_splitter_fallback"),
    "structured": (_structured, "internal_structured_sentence_window"),
}
UNITS = "array<struct<text: string, start: int, stop: int, tokens: int, structure: string>>"
META = "title description category".split()
#: What the metadata of an article hold beside its texts; chunks carry them on.
SIZES = "content_chars title_chars description_chars is_short is_long".split()


def cut_units(config: ChunkingConfig) -> Callable[[Column], Column]:
    """An Arrow function that cuts contents into units; its result is built column by column."""
    if config.strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy: {config.strategy}")
    cut = STRATEGIES[config.strategy][0]
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string())

    @F.arrow_udf(UNITS)
    def units(text: pa.Array) -> pa.Array:
        ends, found = [0], []
        for x in text.to_pylist():
            if x:
                found += cut(x, config)
            ends.append(len(found))
        columns = zip(*found, strict=True) if found else ((),) * len(kinds)
        fields = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, ["text", "start", "stop", "tokens", "structure"]))

    return units


def blank(column: str) -> Column:
    return T.strip(F.coalesce(F.col(column), F.lit(""))) == ""


def large(column: str, config: ChunkingConfig) -> Column:
    return ~blank(column) & (F.length(column) > config.small_article_chars)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """An expression over a value that is computed once, also where functions over array elements use it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def token_units(text: Column, size: int, overlap: int) -> Column:
    """The units of the token strategy as a native expression."""
    step = max(1, size - overlap)
    lead = F.length(F.regexp_extract(text, f"^[{P.WS}]*", 0))
    found = F.struct(lead.alias("lead"), F.regexp_extract_all(text, F.lit(f"{P.TOKEN}[{P.WS}]*"), 0).alias("words"))

    def windows(x: Column) -> Column:
        words, n = x["words"], F.size(x["words"])
        count = F.when(n <= size, F.least(n, F.lit(1))).otherwise(1 + F.ceil((n - size) / step)).cast("int")

        def unit(k: Column) -> Column:
            first = (k - 1) * step
            body = T.strip(F.array_join(F.slice(words, first + 1, size), ""))
            start = x["lead"] + F.length(F.array_join(F.slice(words, 1, first), ""))
            return F.struct(body.alias("text"), start.cast("int").alias("start"), (start + F.length(body)).cast("int").alias("stop"), F.least(F.lit(size), n - first).cast("int").alias("tokens"), F.lit("content").alias("structure"))

        return F.when(count > 0, F.transform(F.sequence(F.lit(1), count), unit)).otherwise(F.array().cast(UNITS))

    return let(found, windows)


def merged_words(left: Column, right: Column) -> Column:
    """Two texts as words, with the largest overlap of the left's end and the right's beginning only once."""
    parted = F.struct(*(F.filter(F.split(T.strip(x), P.BLANKS), lambda w: w != "").alias(n) for n, x in (("a", left), ("b", right))))

    def join(x: Column) -> Column:
        a, b = x["a"], x["b"]
        most = F.least(F.size(a), F.size(b))
        same = lambda k: F.slice(a, F.size(a) - k + 1, k) == F.slice(b, 1, k)
        shared = F.when(most > 0, F.try_element_at(F.filter(F.sequence(most, F.lit(1), F.lit(-1)), same), F.lit(1)))
        return F.array_join(F.concat(a, F.slice(b, 1 + F.coalesce(shared, F.lit(0)), F.greatest(F.size(b), F.lit(1)))), " ")

    return let(parted, join)


def merge_small_tail(units: Column, least: int) -> Column:
    """A last unit below the least number of tokens goes into the one before it, once."""
    n = F.size(units)
    tail, before = F.try_element_at(units, F.lit(-1)), F.try_element_at(units, F.lit(-2))
    text = merged_words(before["text"], tail["text"])
    structure = F.when(before["structure"] == tail["structure"], tail["structure"]).otherwise(F.concat_ws("+", before["structure"], tail["structure"]))
    joined = F.struct(text.alias("text"), before["start"].alias("start"), tail["stop"].alias("stop"), T.token_count(text).cast("int").alias("tokens"), structure.alias("structure"))
    if least <= 0:
        return units
    return F.when((n >= 2) & (tail["tokens"] < least), F.concat(F.slice(units, 1, F.greatest(n - 2, F.lit(0))), F.array(joined))).otherwise(units)


def chunks(articles: DataFrame, config: ChunkingConfig = ChunkingConfig(), native: bool = False) -> DataFrame:
    """One row per chunk: chunk_id, article_id, strategy, text, chunk_text and the metadata."""
    return experiment(articles, [config], native)


def experiment(articles: DataFrame, configs: list[ChunkingConfig], native: bool = False) -> DataFrame:
    """The chunks of the same articles under several configurations: one scan, and one pass through Python for all.

    Titles and the like that are null or empty are taken from the metadata of the article, if it has such; all other
    metadata are carried on.  Articles without an id have chunks without one.
    """
    if not configs:
        raise ValueError("no configuration")
    if native and any(c.strategy != "token" for c in configs):
        raise ValueError("only the token strategy is native")
    given = [f.name for f in articles.schema["metadata"].dataType.fields] if "metadata" in articles.columns else []
    fields = [T.fallback(F.col(c), *([F.col("metadata")[c]] if c in given else [])).alias(c) for c in META]
    carried = [F.col("metadata")[c].alias(c) for c in SIZES if c in given]
    rows = articles.select(F.col("article_id").cast("string").alias("article_id"), *fields, "content", F.struct(*carried).alias("carried") if carried else F.lit(None).alias("carried"))
    none = F.array().cast(UNITS)
    least = min(configs, key=lambda c: c.small_article_chars)
    cut = lambda c: token_units(F.col("content"), c.chunk_size, c.overlap) if native else cut_units(c)(F.col("large"))
    # short contents don't travel to Python: a function there gets every row, so that it gets nulls for them
    rows = rows.withColumn("large", F.when(large("content", least), F.col("content"))).withColumns({f"u{i}": F.when(large("content", c), cut(c)).otherwise(none) for i, c in enumerate(configs)})
    whole = F.array(F.struct(F.col("content").alias("text"), F.lit(0).alias("start"), F.length("content").alias("stop"), T.token_count(F.col("content")).cast("int").alias("tokens"), F.lit("content").alias("structure")))
    small = lambda c: ~blank("content") & (F.length("content") <= c.small_article_chars)
    runs = [
        F.struct(
            F.lit(c.strategy).alias("strategy"), F.when(small(c), "single_small_article").otherwise(STRATEGIES[c.strategy][1]).alias("implementation"), F.lit(c.inject_title_description).alias("inject"),
            F.lit(c.max_chunks_per_article).cast("int").alias("most"), F.when(small(c), whole).otherwise(merge_small_tail(F.col(f"u{i}"), c.min_chunk_tokens)).alias("units"),
        )
        for i, c in enumerate(configs)
    ]
    rows = rows.select("article_id", *META, "carried", F.explode(F.array(*runs)).alias("run")).select("article_id", *META, "carried", "run.*")
    over = F.coalesce(F.size("units") > F.col("most"), F.lit(False))
    rows = rows.select("*", over.alias("truncated"), F.least(F.size("units"), F.col("most")).alias("num_chunks"), F.posexplode_outer("units").alias("chunk_index", "unit")).where("unit is not null and (most is null or chunk_index < most)")
    chunk = T.strip(F.col("unit.text"))
    text = F.when(F.col("inject"), T.embedding_text(*map(F.col, META), chunk)).otherwise(chunk)
    metadata = F.struct(
        "article_id", *META, *(F.col("carried")[c].alias(c) for c in SIZES if c in given), "strategy", "implementation", F.col("unit.structure").alias("structure"), "chunk_index", "num_chunks", F.col("unit.start").alias("char_start"), F.col("unit.stop").alias("char_end"),
        F.col("unit.tokens").alias("token_count"), F.length(chunk).alias("chunk_chars"), F.col("truncated").alias("truncated_article"),
    )
    return rows.select(T.chunk_id(F.col("article_id"), F.col("strategy"), F.col("chunk_index")).alias("chunk_id"), "article_id", "strategy", text.alias("text"), chunk.alias("chunk_text"), metadata.alias("metadata"))


def chunk_stats(articles: DataFrame, chunked: DataFrame, shortest: int = 300) -> DataFrame:
    """One row per strategy: counts of articles and chunks, sums and bounds.  Averages are not rounded."""
    m = lambda f: F.col(f"metadata.{f}")
    per = chunked.groupBy("strategy").agg(
        F.count("*").alias("chunks_written"),
        F.count_if(m("truncated_article") & (m("chunk_index") == 0)).alias("truncated_articles"),
        F.sum(m("token_count")).alias("total_chunk_tokens"), F.min(m("token_count")).alias("min_chunk_tokens"), F.max(m("token_count")).alias("max_chunk_tokens"),
        F.sum(m("chunk_chars")).alias("total_chunk_chars"), F.min(m("chunk_chars")).alias("min_chunk_chars"), F.max(m("chunk_chars")).alias("max_chunk_chars"),
    )
    given = [f.name for f in articles.schema["metadata"].dataType.fields] if "metadata" in articles.columns else []
    length = F.length(F.coalesce("content", F.lit(""))) < shortest
    is_short = F.coalesce(F.col("metadata.is_short"), F.lit(False)) if "is_short" in given else length
    of_all = articles.agg(F.count("*").alias("articles_read"), F.count_if(is_short).alias("short_articles"), F.count_if(blank("content")).alias("empty_articles"))
    both = per.crossJoin(F.broadcast(of_all))  # one row
    ratio = lambda a, b: F.col(a) / F.nullif(F.col(b), F.lit(0))
    return both.withColumns({"avg_chunks_per_article": ratio("chunks_written", "articles_read"), "avg_chunk_tokens": ratio("total_chunk_tokens", "chunks_written"), "avg_chunk_chars": ratio("total_chunk_chars", "chunks_written")})
