"""Column functions on article text.  All but ``composed`` and ``decoded`` are native expressions."""

from __future__ import annotations

import html
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from reedmill.functions import patterns as P


@F.arrow_udf(StringType())
def composed(text: pa.Array) -> pa.Array:
    """NFC form.

    Every row goes through: Python's own quick check is several times faster than a pattern in the JVM that would pick
    out the rows that may change, and a function in Python gets every row anyway, whatever condition stands around it.
    """
    return pa.array([None if x is None else unicodedata.normalize("NFC", x) for x in text.to_pylist()], pa.string())


@F.arrow_udf(StringType())
def decoded(text: pa.Array) -> pa.Array:
    """NFC form with HTML entities decoded once."""
    nfc = (x and unicodedata.normalize("NFC", x) for x in text.to_pylist())
    return pa.array([html.unescape(x) if x and "&" in x else x for x in nfc], pa.string())


def strip(text: Column) -> Column:
    return F.regexp_replace(text, P.ENDS, "")


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, P.TAG, " ")


def strip_urls(text: Column) -> Column:
    return F.regexp_replace(text, P.URL, " ")


def part_prefixes(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, P.PREFIX, "$1 "), P.NUMBER_PREFIX, P.GLUED_NUMBER_PREFIX + " ")


def part_words(text: Column) -> Column:
    return F.regexp_replace(text, P.GLUED, " ")


def tidy_blanks(text: Column) -> Column:
    """One blank between words, one line end between non-empty lines, none at the ends."""
    return strip(F.regexp_replace(F.regexp_replace(text, P.LINE_BREAK, "\n"), P.INNER_BLANKS, " "))


def clean(text: Column, urls: bool = False) -> Column:
    """The cleaning pipeline; null and the word nan (any case) become an empty text.  ``urls`` takes addresses out."""
    filled = F.coalesce(text, F.lit(""))
    out = strip_tags(decoded(F.when(F.lower(filled) == "nan", "").otherwise(filled)))
    return tidy_blanks(part_words(part_prefixes(strip_urls(out) if urls else out)))


def clean_flat(text: Column) -> Column:
    """The second chunker's cleaning: every run of blanks, also across lines, becomes one."""
    return strip(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), "\ufeff\u00a0", "  "), P.BLANKS, " "))


def token_count(text: Column) -> Column:
    """Words parted at blanks; blanks of all kinds become one first, as a class of many ranges makes a pattern slow."""
    return F.regexp_count(F.translate(text, P.WS_CHARACTERS, " " * len(P.WS_CHARACTERS)), F.lit("[^ ]+"))


def sentences(text: Column) -> Column:
    """Stretches up to closing marks, stripped; marks at the start are lost."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(P.SENTENCE), 0), strip), lambda s: s != "")


def flat_sentences(text: Column) -> Column:
    """Sentences of cleaned flat text: parted at blanks behind a closing mark."""
    return F.filter(F.transform(F.split(clean_flat(text), P.SENTENCE_GAP), strip), lambda s: s != "")


def sections(text: Column) -> Column:
    """Non-empty paragraphs as (name, text); a single one is named content."""
    parts = F.filter(F.transform(F.split(text, r"\n+"), strip), lambda s: s != "")
    name = lambda i: F.when(F.size(parts) == 1, F.lit("content")).otherwise(F.format_string("paragraph_%03d", i))
    return F.transform(parts, lambda s, i: F.struct(name(i).alias("name"), s.alias("text")))


def document_text(title: Column, description: Column, category: Column, content: Column) -> Column:
    """The project's document template; labels stay when a field is empty, an empty content is left out."""
    lines = [F.concat(F.lit(label), F.coalesce(x, F.lit(""))) for label, x in (("Tiêu đề: ", title), ("Mô tả: ", description), ("Chuyên mục: ", category))]
    return F.concat_ws("\n", *lines, F.lit("Nội dung:"), F.when(content != "", content))


def embedding_text(title: Column, description: Column, category: Column, chunk: Column) -> Column:
    """The chunk template; empty fields are left out with their labels."""
    lines = [F.when(x != "", F.concat(F.lit(label), x)) for label, x in (("Tiêu đề: ", title), ("Mô tả: ", description), ("Chuyên mục: ", category))]
    return F.concat_ws("\n", *lines, F.lit("Đoạn nội dung:"), F.when(chunk != "", chunk))


def passage_text(title: Column, description: Column, passage: Column) -> Column:
    """The second chunker's template."""
    lines = [F.when(x != "", F.concat(F.lit(label), x)) for label, x in (("Title: ", title), ("Description: ", description))]
    return F.concat_ws("\n", *lines, F.concat(F.lit("Content: "), passage))


def quality_flags(raw: Column, cleaned: Column, shortest: int = 300, longest: int = 20_000) -> Column:
    """Flags in fixed order; length is of the cleaned text, likeness to HTML and URLs of the raw one."""
    raw = F.coalesce(raw, F.lit(""))
    tests = {"short_content": F.length(cleaned) < shortest, "long_content": F.length(cleaned) > longest, "html_like": raw.rlike(P.TAG) | raw.rlike(P.ENTITY), "url_like": raw.rlike(P.URL)}
    return F.array_compact(F.array(*(F.when(t, F.lit(n)) for n, t in tests.items())))


def preview(text: Column, size: int = 800) -> Column:
    return F.substring(text, 1, size)


def chunk_id(article: Column, strategy: Column, index: Column) -> Column:
    return F.format_string("%s_%s_%04d", article, strategy, index)


def flat_chunk_id(article: Column, index: Column) -> Column:
    return F.format_string("article_%s_chunk_%s", article.cast("string"), index.cast("string"))


def qa_id(article: Column, index: Column) -> Column:
    return F.concat_ws("_", article.cast("string"), (index + 1).cast("string"))


def cross_qa_id(group: Column, index: Column) -> Column:
    return F.concat_ws("_", F.lit("cross"), group.cast("string"), (index + 1).cast("string"))


def id_list(article_id: Column) -> Column:
    """JSON text of one number or a list as an array of numbers; null gives an empty array."""
    return F.when(article_id.isNull(), F.array().cast("array<bigint>")).otherwise(F.coalesce(F.from_json(article_id, "array<bigint>"), F.array(article_id.try_cast("bigint"))))


def fallback(*columns: Column) -> Column:
    """The first value that is neither null nor empty, else an empty text."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns), F.lit(""))


def fenced_json(reply: Column, schema: str) -> Column:
    """A model's reply, with or without a code fence and its language tag, as typed JSON; null where it is none."""
    body = F.regexp_extract(reply, r"(?s)^\s*```(?:json)?\s*(.*?)\s*(?:```.*)?$", 1)
    return F.from_json(F.when(strip(reply).startswith("```"), body).otherwise(reply), schema)


def prompt(title: Column, content: Column, size: int = 3000) -> Column:
    """The article part of a prompt, its content cut to the size that prompts allow (a feature of the generator)."""
    return F.concat_ws("\n", F.concat(F.lit("Tiêu đề: "), F.coalesce(title, F.lit(""))), F.concat(F.lit("Nội dung: "), F.substring(F.coalesce(content, F.lit("")), 1, size)))
