"""All queries of the core by name, and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reedmill.functions import patterns as P
from reedmill.functions import text as T
from reedmill.functions.session import spread, table
from reedmill.operators import chunking, flat_chunks, ingest, profile, qa, retrieval, similarity, splits, strict_csv
from reedmill.operators.chunking import ChunkingConfig
from reedmill.plans import chunk_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Size of the corpus reducer and the ids it also keeps (of these tables).
FIRST_ROWS = 500
KEEP_IDS = ("2000000001", "2000000042", "2000000111", "2000000739", "2000001001")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def records(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "article_records")


def raw(spark: SparkSession, folder: str) -> DataFrame:
    """The records as raw rows: id and the four text columns."""
    return spread(records(spark, folder).select("row_id", F.col("article_id").alias("id"), "title", "description", "content", "category"))


def articles(spark: SparkSession, folder: str) -> DataFrame:
    """All records as articles with their metadata."""
    return spread(records(spark, folder).select("row_id", "article_id", "title", "description", "content", "category", "metadata"))


_B = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_strip = lambda x: f"regexp_replace({x}, '^[{_B}]+|[{_B}]+$', '', 'g')"
_tokens = lambda x: f"len(regexp_extract_all({x}, '[^{_B}]+'))"


# strict CSV (problem 5)
_FIELD = '(?:"(?:[^"]|"")*"|[^",]*)'
_RECORDS = rf"""
WITH r AS (
  SELECT *, NOT regexp_full_match(raw_line, '{_FIELD}(?:,{_FIELD})*') AS bad_quotes,
    length(regexp_replace(raw_line, '"(?:[^"]|"")*"', '', 'g')) - length(replace(regexp_replace(raw_line, '"(?:[^"]|"")*"', '', 'g'), ',', '')) + 1 AS n
  FROM raw_rows
), f AS (
  SELECT *, CASE WHEN NOT bad_quotes AND n = 5 THEN regexp_extract(raw_line, '^({_FIELD}),({_FIELD}),({_FIELD}),({_FIELD}),({_FIELD})$', ['a', 'b', 'c', 'd', 'e']) END AS x FROM r
), v AS (
  SELECT *, CASE WHEN x IS NOT NULL THEN list_transform([x.a, x.b, x.c, x.d, x.e], lambda s: CASE WHEN s[1] = '"' THEN replace(s[2:-2], '""', '"') ELSE s END) END AS y FROM f
), w AS (
  SELECT *, {_strip("y[1]")} AS id, {_strip("y[4]")} AS body FROM v
), k AS (
  SELECT *, CASE WHEN raw_line IS NULL THEN 'column_count' WHEN bad_quotes THEN 'quoting' WHEN n <> 5 THEN 'column_count'
    WHEN NOT regexp_full_match(id, '[0-9]+') OR coalesce(TRY_CAST(id AS BIGINT), 0) < 1 OR body = '' OR lower(body) = 'nan' THEN 'invalid_value' END AS reason FROM w
)
"""


@query(_RECORDS + "SELECT row_id, reason FROM k WHERE reason IS NOT NULL")
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return strict_csv.rejects(table(spark, folder, "raw_rows"))


@query(_RECORDS + "SELECT row_id, split, file_name, line_no, CAST(id AS BIGINT) AS article_id, y[2] AS title, y[3] AS description, y[4] AS content, y[5] AS category FROM k WHERE reason IS NULL")
def p5_articles(spark: SparkSession, folder: str) -> DataFrame:
    return strict_csv.articles(table(spark, folder, "raw_rows"))


# profiles
@query("SELECT count(*) AS rows, count(DISTINCT article_id) AS distinct_ids, count(article_id) - count(DISTINCT article_id) AS duplicate_ids, min(n) AS min_chars, max(n) AS max_chars, CAST(sum(n) AS BIGINT) AS total_chars, avg(n) AS avg_chars, count_if(n = 0) AS empty_contents FROM (SELECT article_id, length(coalesce(content, '')) AS n FROM article_records)")
def eda_profile(spark: SparkSession, folder: str) -> DataFrame:
    return profile.profile(records(spark, folder))


@query("SELECT \"column\", nulls FROM (SELECT count_if(title IS NULL) AS title, count_if(description IS NULL) AS description, count_if(content IS NULL) AS content, count_if(category IS NULL) AS category FROM article_records) UNPIVOT (nulls FOR \"column\" IN (title, description, content, category))")
def eda_nulls(spark: SparkSession, folder: str) -> DataFrame:
    return profile.nulls(records(spark, folder), ("title", "description", "content", "category"))


@query("SELECT coalesce(category, '(null)') AS category, count(*) AS n FROM article_records GROUP BY 1")
def eda_categories(spark: SparkSession, folder: str) -> DataFrame:
    return profile.histogram(records(spark, folder))


@query("SELECT coalesce(category, '(null)') AS category, count(*) AS n FROM article_records GROUP BY 1 ORDER BY n DESC, category LIMIT 15")
def eda_top_categories(spark: SparkSession, folder: str) -> DataFrame:
    return profile.histogram(records(spark, folder), most=15)


@query("SELECT article_id, CAST(count(*) AS BIGINT) AS rows, count(DISTINCT split) AS splits FROM article_records WHERE article_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def eda_duplicates_across_splits(spark: SparkSession, folder: str) -> DataFrame:
    return profile.duplicates_across(records(spark, folder))


@query("SELECT TRY_CAST(trim(article_id) AS BIGINT) AS id, title, description, content, category FROM article_records")
def typed_corpus(spark: SparkSession, folder: str) -> DataFrame:
    return profile.typed_corpus(raw(spark, folder))


# ingest
_PRESENT = " AND ".join(f"coalesce({c}, '') <> ''" for c in ("article_id", "title", "description", "content", "category"))


@query(f"SELECT row_id FROM article_records WHERE {_PRESENT}")
def ingest_present_rows(spark: SparkSession, folder: str) -> DataFrame:
    return raw(spark, folder).where(ingest.present()).select("row_id")


#: The entities that stand in these tables, and what they stand for; the one for the ampersand comes last.
_ENTITIES = {"&nbsp;": 160, "&#160;": 160, "&lt;": 60, "&gt;": 62, "&#8211;": 8211, "&#8230;": 8230, "&#x27;": 39, "&ldquo;": 8220, "&rdquo;": 8221, "&quot;": 34, "&amp;": 38}
_END = r"([^\p{L}\p{M}\p{N}_]|$)"


def _clean(x: str, urls: bool = False) -> str:
    """The cleaning pipeline as an expression."""
    out = f"nfc_normalize(CASE WHEN lower({x}) = 'nan' THEN '' ELSE coalesce({x}, '') END)"
    for entity, code in _ENTITIES.items():
        out = f"replace({out}, '{entity}', chr({code}))"
    out = f"regexp_replace({out}, '<[^>]+>', ' ', 'g')"
    if urls:
        out = f"regexp_replace({out}, '(?i)https?://[^{_B}]+|www\\.[^{_B}]+', ' ', 'g')"
    out = f"regexp_replace({out}, '(^|[^\\p{{L}}\\p{{M}}\\p{{N}}_])({'|'.join(P.GLUED_PREFIXES)})([A-ZÀ-ỸĐ])', '\\1\\2 \\3', 'g')"
    out = f"regexp_replace({out}, '(^|[^\\p{{L}}\\p{{M}}\\p{{N}}_])({P.GLUED_NUMBER_PREFIX})([0-9])', '\\1\\2 \\3', 'g')"
    for _ in range(4):  # words in a row are parted from left to right
        out = f"regexp_replace({out}, '(?i)([{P.GLUED_AFTER}])((?:{'|'.join(P.GLUED_WORDS)})+){_END}', '\\1 \\2\\3', 'g')"
    return _strip(f"regexp_replace(regexp_replace({out}, '[{_B}]*[\\n\\r\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}][{_B}]*', E'\\n', 'g'), '[ \\t\\f\\v]+', ' ', 'g')")


_FLAGS = f"list_filter([CASE WHEN length(content) < 300 THEN 'short_content' END, CASE WHEN length(content) > 20000 THEN 'long_content' END, CASE WHEN regexp_matches(raw_content, '<[^>]+>') OR regexp_matches(raw_content, '&[a-z]+;') THEN 'html_like' END, CASE WHEN regexp_matches(raw_content, '(?i)https?://[^{_B}]+|www\\.[^{_B}]+') THEN 'url_like' END], lambda x: x IS NOT NULL)"
_FLAG_COUNTS = ", ".join(f"count_if(list_contains(quality_flags, '{f}')) AS {f}" for f in ingest.FLAGS)
_INGESTED = f"""
WITH c AS (SELECT row_id, {_clean('article_id', True)} AS article_id, {', '.join(f'{_clean(c)} AS {c}' for c in ('title', 'description', 'content', 'category'))}, content AS raw_content FROM article_records WHERE {_PRESENT}),
i AS (
  SELECT row_id, article_id, title, description, content, category, 'Tiêu đề: ' || title || chr(10) || 'Mô tả: ' || description || chr(10) || 'Chuyên mục: ' || category || chr(10) || 'Nội dung:' || CASE WHEN content <> '' THEN chr(10) || content ELSE '' END AS text,
    length(content) AS content_chars, length(title) AS title_chars, length(description) AS description_chars, length(content) < 300 AS is_short, length(content) > 20000 AS is_long,
    {_FLAGS} AS quality_flags, raw_content FROM c
)
"""


@query(_INGESTED + "SELECT * EXCLUDE (raw_content) FROM i")
def ingest_articles(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.articles(raw(spark, folder), extra=("row_id",)).select("row_id", "article_id", "title", "description", "content", "category", "text", *(f"metadata.{c}" for c in chunking.SIZES), "quality_flags")


@query(_INGESTED + f"SELECT (SELECT count(*) FROM article_records) AS rows_read, (SELECT count_if(NOT ({_PRESENT})) FROM article_records) AS missing_required, count(*) AS rows_written, {_FLAG_COUNTS} FROM i")
def ingest_counters(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.counters(raw(spark, folder))


@query(_INGESTED + "SELECT row_id, article_id, title, category, quality_flags, substring(raw_content, 1, 800) AS raw_content_preview, substring(content, 1, 800) AS clean_content_preview FROM i WHERE len(quality_flags) > 0 OR raw_content <> content ORDER BY row_id LIMIT 200")
def ingest_review(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.review_rows(ingest.articles(raw(spark, folder), extra=("row_id",)), "row_id", 200)


@query(f"SELECT row_id, {_clean('content')} AS content FROM article_records")
def clean_text(spark: SparkSession, folder: str) -> DataFrame:
    return records(spark, folder).select("row_id", T.clean(F.col("content")).alias("content"))


@query(
    f"SELECT row_id, list_filter([CASE WHEN length(coalesce(content, '')) < 300 THEN 'short_content' END, CASE WHEN length(coalesce(content, '')) > 20000 THEN 'long_content' END, "
    f"CASE WHEN regexp_matches(content, '<[^>]+>') OR regexp_matches(content, '&[a-z]+;') THEN 'html_like' END, CASE WHEN regexp_matches(content, '(?i)https?://[^{_B}]+|www\\.[^{_B}]+') THEN 'url_like' END], lambda x: x IS NOT NULL) AS flags FROM article_records"
)
def quality_flags(spark: SparkSession, folder: str) -> DataFrame:
    return records(spark, folder).select("row_id", T.quality_flags(F.col("content"), F.coalesce("content", F.lit(""))).alias("flags"))


@query(f"SELECT row_id, regexp_replace(regexp_replace(content, '<[^>]+>', ' ', 'g'), '(?i)https?://[^{_B}]+|www\\.[^{_B}]+', ' ', 'g') AS content FROM article_records")
def strip_tags_and_urls(spark: SparkSession, folder: str) -> DataFrame:
    return records(spark, folder).select("row_id", T.strip_urls(T.strip_tags(F.col("content"))).alias("content"))


@query(f"SELECT row_id, {_strip(f'''regexp_replace(regexp_replace(content, '[{_B}]*[\\n\\r\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}][{_B}]*', E'\\n', 'g'), '[ \\t\\f\\v]+', ' ', 'g')''')} AS content FROM article_records")
def tidy_blanks(spark: SparkSession, folder: str) -> DataFrame:
    return records(spark, folder).select("row_id", T.tidy_blanks(F.col("content")).alias("content"))


@query(f"SELECT row_id, {_strip(f'''regexp_replace(replace(coalesce(content, ''), chr(65279), ' '), '[{_B}]+', ' ', 'g')''')} AS content FROM article_records")
def clean_flat(spark: SparkSession, folder: str) -> DataFrame:
    return records(spark, folder).select("row_id", T.clean_flat(F.col("content")).alias("content"))


@query("SELECT row_id, 'Tiêu đề: ' || coalesce(title, '') || chr(10) || 'Mô tả: ' || coalesce(description, '') || chr(10) || 'Chuyên mục: ' || coalesce(category, '') || chr(10) || 'Nội dung:' || CASE WHEN coalesce(content, '') <> '' THEN chr(10) || content ELSE '' END AS text FROM article_records")
def document_text(spark: SparkSession, folder: str) -> DataFrame:
    return records(spark, folder).select("row_id", T.document_text(*(F.col(c) for c in ("title", "description", "category", "content"))).alias("text"))


@query("SELECT row_id, concat_ws(chr(10), CASE WHEN title <> '' THEN 'Title: ' || title END, CASE WHEN description <> '' THEN 'Description: ' || description END, 'Content: ' || content) AS text FROM article_records WHERE content IS NOT NULL")
def passage_text(spark: SparkSession, folder: str) -> DataFrame:
    return records(spark, folder).where("content is not null").select("row_id", T.passage_text(F.col("title"), F.col("description"), F.col("content")).alias("text"))


@query(f"SELECT row_id, {_tokens('content')} AS tokens FROM article_records")
def token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return records(spark, folder).select("row_id", T.token_count(F.col("content")).alias("tokens"))


@query(f"SELECT row_id, list_filter(list_transform(regexp_extract_all(content, '[^.!?…]+(?:[.!?…]+|$)'), lambda s: {_strip('s')}), lambda s: s <> '') AS sentences FROM article_records")
def sentences(spark: SparkSession, folder: str) -> DataFrame:
    return records(spark, folder).select("row_id", T.sentences(F.col("content")).alias("sentences"))


@query(f"SELECT row_id, i - 1 AS i, s AS text FROM (SELECT row_id, unnest(p) AS s, generate_subscripts(p, 1) AS i FROM (SELECT row_id, list_filter(list_transform(regexp_split_to_array(content, '\\n+'), lambda s: {_strip('s')}), lambda s: s <> '') AS p FROM article_records))")
def sections(spark: SparkSession, folder: str) -> DataFrame:
    return records(spark, folder).select("row_id", F.posexplode(T.sections(F.col("content"))).alias("i", "s")).select("row_id", "i", "s.text")


# chunking
def flat_metadata(df: DataFrame, *more: str) -> DataFrame:
    names = "chunk_index num_chunks char_start char_end token_count chunk_chars implementation structure content_chars truncated_article".split()
    return df.select("chunk_id", "article_id", "strategy", "chunk_text", "text", *(f"metadata.{c}" for c in names))


@query(chunk_sql.chunks())
def chunk_token(spark: SparkSession, folder: str) -> DataFrame:
    return flat_metadata(chunking.chunks(articles(spark, folder)))


@query(chunk_sql.chunks(size=45, overlap=8, least=0))
def chunk_token_small_windows(spark: SparkSession, folder: str) -> DataFrame:
    return flat_metadata(chunking.chunks(articles(spark, folder), ChunkingConfig(chunk_size=45, overlap=8, min_chunk_tokens=0), native=True))


@query(chunk_sql.chunks(size=45, overlap=8, least=0, most=3))
def chunk_cap(spark: SparkSession, folder: str) -> DataFrame:
    return flat_metadata(chunking.chunks(articles(spark, folder), ChunkingConfig(chunk_size=45, overlap=8, min_chunk_tokens=0, max_chunks_per_article=3)))


@query(chunk_sql.chunks(size=45, overlap=8, least=30))
def chunk_tail_merge(spark: SparkSession, folder: str) -> DataFrame:
    return flat_metadata(chunking.chunks(articles(spark, folder), ChunkingConfig(chunk_size=45, overlap=8, min_chunk_tokens=30)))


@query(chunk_sql.chunks("langchain_recursive"))
def chunk_recursive(spark: SparkSession, folder: str) -> DataFrame:
    return flat_metadata(chunking.chunks(articles(spark, folder), ChunkingConfig("langchain_recursive")))


@query(chunk_sql.chunks("llamaindex"))
def chunk_sentence(spark: SparkSession, folder: str) -> DataFrame:
    return flat_metadata(chunking.chunks(articles(spark, folder), ChunkingConfig("llamaindex")))


@query(chunk_sql.chunks("structured"))
def chunk_structured(spark: SparkSession, folder: str) -> DataFrame:
    return flat_metadata(chunking.chunks(articles(spark, folder), ChunkingConfig("structured")))


@query(chunk_sql.chunks("structured", 60, 12, 30))
def chunk_structured_small(spark: SparkSession, folder: str) -> DataFrame:
    return flat_metadata(chunking.chunks(articles(spark, folder), ChunkingConfig("structured", 60, 12, 30)))


@query(chunk_sql.stats(chunk_sql.chunks()))
def chunk_token_stats(spark: SparkSession, folder: str) -> DataFrame:
    rows = articles(spark, folder)
    return chunking.chunk_stats(rows, chunking.chunks(rows))


@query(chunk_sql.stats(*map(chunk_sql.chunks, chunking.STRATEGIES)))
def chunk_experiment_stats(spark: SparkSession, folder: str) -> DataFrame:
    rows = articles(spark, folder)
    return chunking.chunk_stats(rows, chunking.experiment(rows, [ChunkingConfig(s) for s in chunking.STRATEGIES]))


@query(f"SELECT CAST(sum(chunks_written) AS BIGINT) AS chunks, count(*) AS strategies FROM ({chunk_sql.stats(*map(chunk_sql.chunks, chunking.STRATEGIES))})")
def chunk_experiment_total(spark: SparkSession, folder: str) -> DataFrame:
    chunked = chunking.experiment(articles(spark, folder), [ChunkingConfig(s) for s in chunking.STRATEGIES])
    return chunked.groupBy("strategy").count().agg(F.sum("count").alias("chunks"), F.count("*").alias("strategies"))


@query(" UNION ALL ".join(f"SELECT *, {size} AS chunk_size, {overlap} AS overlap FROM ({chunk_sql.stats(chunk_sql.chunks(size=size, overlap=overlap))})" for size, overlap in ((256, 50), (384, 64), (512, 100))))
def chunk_sizes_stats(spark: SparkSession, folder: str) -> DataFrame:
    rows = articles(spark, folder)
    out = None
    for size, overlap in ((256, 50), (384, 64), (512, 100)):
        part = chunking.chunk_stats(rows, chunking.chunks(rows, ChunkingConfig(chunk_size=size, overlap=overlap))).withColumns({"chunk_size": F.lit(size), "overlap": F.lit(overlap)})
        out = part if out is None else out.unionByName(part)
    return out


@query(chunk_sql.flat())
def chunk_flat(spark: SparkSession, folder: str) -> DataFrame:
    return flat_chunks.flat_chunks(articles(spark, folder))


@query()
def chunk_flat_byte_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """The same on byte pairs of a public tokenizer."""
    import public_tokenizers

    return flat_chunks.flat_chunks(articles(spark, folder), make=flat_chunks.byte_pairs(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN))


@query(f"SELECT count(DISTINCT article_id) AS articles, count(*) AS chunks, avg(n_tokens) AS avg_tokens, (SELECT count(*) FROM article_records WHERE article_id IS NOT NULL AND NOT regexp_matches(coalesce(replace(content, chr(65279), ' '), ''), '[^{_B}]')) AS skipped_empty FROM ({chunk_sql.flat()})")
def chunk_flat_stats(spark: SparkSession, folder: str) -> DataFrame:
    rows = articles(spark, folder)
    return flat_chunks.flat_stats(rows, flat_chunks.flat_chunks(rows))


# splits
_IDS = ", ".join(f"'{i}'" for i in KEEP_IDS)
_KEPT = f"(SELECT *, row_number() OVER (ORDER BY row_id) <= {FIRST_ROWS} AS by_position FROM article_records) WHERE by_position OR article_id IN ({_IDS})"


@query(f"SELECT row_id, article_id, by_position FROM {_KEPT}")
def split_first_or_listed(spark: SparkSession, folder: str) -> DataFrame:
    return splits.first_or_listed(records(spark, folder), FIRST_ROWS, KEEP_IDS, "row_id").select("row_id", "article_id", "by_position")


@query(f"SELECT row_id, article_id FROM article_records ORDER BY row_id LIMIT {FIRST_ROWS}")
def split_first(spark: SparkSession, folder: str) -> DataFrame:
    return splits.first_rows(records(spark, folder), FIRST_ROWS, "row_id").select("row_id", "article_id")


@query(f"SELECT (SELECT count(*) FROM article_records) AS total, count_if(by_position) AS kept_by_position, count_if(NOT by_position) AS kept_by_id, count(DISTINCT CASE WHEN article_id IN ({_IDS}) THEN article_id END) AS found, {len(KEEP_IDS)} - count(DISTINCT CASE WHEN article_id IN ({_IDS}) THEN article_id END) AS not_found FROM {_KEPT}")
def split_stats(spark: SparkSession, folder: str) -> DataFrame:
    rows = records(spark, folder)
    return splits.reducer_stats(rows, splits.first_or_listed(rows, FIRST_ROWS, KEEP_IDS, "row_id"), KEEP_IDS)


@query(f"SELECT (SELECT count(*) FROM article_records) AS total, count(*) AS kept, count(DISTINCT article_id) AS distinct_kept_ids, {FIRST_ROWS} AS target FROM (SELECT article_id FROM article_records ORDER BY row_id LIMIT {FIRST_ROWS})")
def split_cap_stats(spark: SparkSession, folder: str) -> DataFrame:
    return splits.cap_stats(records(spark, folder), FIRST_ROWS, "row_id")


@query("SELECT count(DISTINCT category) AS categories FROM article_records")
def category_count(spark: SparkSession, folder: str) -> DataFrame:
    return records(spark, folder).agg(F.countDistinct("category").alias("categories"))


@query("SELECT category, row_id FROM (SELECT category, row_id, row_number() OVER (PARTITION BY category ORDER BY md5(concat_ws('|', CAST(row_id AS VARCHAR), '0')), row_id) AS r FROM article_records WHERE category IS NOT NULL) WHERE r <= 50")
def sample_per_category(spark: SparkSession, folder: str) -> DataFrame:
    return splits.sample_per_group(records(spark, folder), "category", "row_id", 50).select("category", "row_id")


# questions and answers
_REFS = "(SELECT id, unnest(CASE WHEN article_id IS NULL THEN [] WHEN article_id LIKE '[%' THEN CAST(CAST(article_id AS JSON) AS BIGINT[]) ELSE [TRY_CAST(article_id AS BIGINT)] END) AS article_id FROM qa_output)"


@query(f"SELECT id, article_id FROM {_REFS}")
def qa_references(spark: SparkSession, folder: str) -> DataFrame:
    return qa.references(table(spark, folder, "qa_output"))


@query(f"SELECT id, article_id FROM {_REFS} r WHERE NOT EXISTS (SELECT 1 FROM article_records a WHERE TRY_CAST(a.article_id AS BIGINT) = r.article_id)")
def qa_missing_references(spark: SparkSession, folder: str) -> DataFrame:
    return qa.missing_references(table(spark, folder, "qa_output"), records(spark, folder))


@query(f"SELECT DISTINCT article_id FROM {_REFS} r WHERE article_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM article_records a WHERE TRY_CAST(a.article_id AS BIGINT) = r.article_id) ORDER BY 1 LIMIT 20")
def qa_first_missing(spark: SparkSession, folder: str) -> DataFrame:
    return qa.missing_references(table(spark, folder, "qa_output"), records(spark, folder)).where("article_id is not null").select("article_id").distinct().orderBy("article_id").limit(20)


@query(f"SELECT split, count(DISTINCT TRY_CAST(article_id AS BIGINT)) AS articles FROM article_records WHERE TRY_CAST(article_id AS BIGINT) IN (SELECT article_id FROM {_REFS}) GROUP BY 1")
def qa_references_by_split(spark: SparkSession, folder: str) -> DataFrame:
    return qa.references_by_split(table(spark, folder, "qa_output"), records(spark, folder))


@query("SELECT coalesce(nullif(qa_type, ''), 'single-article') AS qa_type, count(*) AS n FROM qa_output GROUP BY 1")
def qa_type_counts(spark: SparkSession, folder: str) -> DataFrame:
    return qa.type_counts(table(spark, folder, "qa_output"))


@query("SELECT count(*) AS total, count_if(is_possible) AS possible, count_if(NOT is_possible) AS impossible, count_if(is_possible) * 100.0 / count(*) AS possible_pct, count_if(NOT is_possible) * 100.0 / count(*) AS impossible_pct, count_if(is_possible AND coalesce(len(answers), 0) = 0) AS possible_without_answer, count_if(NOT is_possible AND coalesce(len(answers), 0) > 0) AS impossible_with_answer FROM qa_output")
def qa_validation(spark: SparkSession, folder: str) -> DataFrame:
    return qa.validation(table(spark, folder, "qa_output"))


@query("SELECT coalesce(question, '') AS question, count(*) AS n FROM qa_output GROUP BY 1 HAVING count(*) > 1")
def qa_duplicate_questions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "qa_output").groupBy(F.coalesce("question", F.lit("")).alias("question")).agg(F.count("*").alias("n")).where("n > 1")


def qa_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Items of each single article in the order of their ids."""
    rows = table(spark, folder, "qa_output").where("article_id is not null and article_id not like '[%'")
    item = F.struct("id", "question", "qa_type", "answers", "is_possible", "plausible_answers")
    # items of one article: a handful, as generated per prompt; rewritten records stay in
    grouped = rows.groupBy("article_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    return grouped.withColumn("items", F.transform("items", lambda x: F.struct(*(x[c].alias(c) for c in ("question", "qa_type", "answers", "is_possible", "plausible_answers")))))


_TEXTS = "CAST([] AS VARCHAR[])"
_MOVED = f"CASE WHEN len(coalesce(x.plausible_answers, {_TEXTS})) > 0 THEN x.plausible_answers ELSE coalesce(x.answers, {_TEXTS}) END[1:2]"
_KIND = _strip("coalesce(x.qa_type, '')")


@query(f"""
WITH g AS (SELECT article_id, list({{question: question, qa_type: qa_type, answers: answers, is_possible: is_possible, plausible_answers: plausible_answers}} ORDER BY id, question NULLS FIRST, qa_type NULLS FIRST, answers NULLS FIRST, is_possible NULLS FIRST, plausible_answers NULLS FIRST) AS items FROM qa_output WHERE article_id IS NOT NULL AND article_id NOT LIKE '[%' GROUP BY 1),
e AS (SELECT article_id, i, len(items) AS n, items[i] AS x FROM (SELECT *, unnest(range(1, len(items) + 1)) AS i FROM g)),
k AS (SELECT *, CASE WHEN lower({_KIND}) IN ({", ".join(f"'{t}'" for t in qa.SINGLE_TYPES)}) THEN lower({_KIND}) WHEN x.is_possible IS NOT DISTINCT FROM false THEN 'unanswerable' ELSE 'factoid' END AS kind FROM e),
h AS (SELECT *, n >= 5 AND i = n AND NOT bool_or(kind IN ('unanswerable', 'claim_verification')) OVER (PARTITION BY article_id) AS forced FROM k)
SELECT article_id || '_' || i AS id, article_id, x.question AS question, CASE WHEN forced THEN 'unanswerable' ELSE kind END AS qa_type, CASE WHEN forced OR kind = 'unanswerable' THEN {_TEXTS} ELSE x.answers END AS answers, NOT (forced OR kind = 'unanswerable') AS is_possible,
  CASE WHEN forced OR (kind = 'unanswerable' AND len(coalesce(x.answers, {_TEXTS})) > 0) THEN {_MOVED} ELSE x.plausible_answers END AS plausible_answers FROM h
""")
def qa_repair(spark: SparkSession, folder: str) -> DataFrame:
    return qa.repair(qa_groups(spark, folder))


@query(f"""
SELECT concat_ws('_', 'cross', regexp_extract(id, '^cross_(\\d+)_', 1), '1') AS id, CAST(CAST(article_id AS JSON) AS BIGINT[]) AS article_id, coalesce(question, '') AS question, CASE WHEN qa_type IN ({", ".join(f"'{t}'" for t in qa.CROSS_TYPES)}) THEN qa_type ELSE '{qa.CROSS_TYPES[0]}' END AS qa_type, coalesce(answers, {_TEXTS}) AS answers,
  coalesce(is_possible, true) AS is_possible, coalesce(plausible_answers, {_TEXTS}) AS plausible_answers, CAST(CAST(article_id AS JSON) AS BIGINT[]) AS source_article_ids FROM qa_output WHERE article_id LIKE '[%'
""")
def qa_repair_cross(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "qa_output").where("article_id like '[%'")
    item = F.struct("question", "qa_type", "answers", "is_possible", "plausible_answers")
    return qa.repair_cross(rows.select(F.regexp_extract("id", r"^cross_(\d+)_", 1).alias("group_id"), T.id_list(F.col("article_id")).alias("article_ids"), F.array(item).alias("items")))


@query(
    "SELECT id, CASE WHEN article_id IS NULL THEN '' WHEN article_id LIKE '[%' THEN array_to_string(CAST(CAST(article_id AS JSON) AS BIGINT[]), '; ') ELSE CAST(TRY_CAST(article_id AS BIGINT) AS VARCHAR) END AS article_id, coalesce(question, '') AS question, coalesce(qa_type, '') AS qa_type, coalesce(array_to_string(answers, '; '), '') AS answers, "
    "CASE WHEN is_possible THEN 'True' WHEN NOT is_possible THEN 'False' ELSE '' END AS is_possible, coalesce(array_to_string(plausible_answers, '; '), '') AS plausible_answers, coalesce(array_to_string(source_article_ids, '; '), '') AS source_article_ids FROM qa_output"
)
def qa_export(spark: SparkSession, folder: str) -> DataFrame:
    return qa.flat(table(spark, folder, "qa_output"))


@query(f"SELECT a.article_id FROM (SELECT DISTINCT article_id FROM article_records WHERE article_id IS NOT NULL) a WHERE article_id NOT IN (SELECT CAST(article_id AS VARCHAR) FROM {_REFS} WHERE article_id IS NOT NULL)")
def qa_unprocessed(spark: SparkSession, folder: str) -> DataFrame:
    return qa.unprocessed(records(spark, folder).where("article_id is not null").select("article_id").distinct(), table(spark, folder, "qa_output"))


@query("SELECT concat_ws('_', article_id, '1') AS id, article_id, split_part(coalesce(title, ''), chr(10), 1) || '?' AS question, 'factoid' AS qa_type, [split_part(coalesce(title, ''), chr(10), 1)] AS answers, true AS is_possible, CAST([] AS VARCHAR[]) AS plausible_answers FROM article_records")
def qa_generation(spark: SparkSession, folder: str) -> DataFrame:
    return qa.repair(qa.generate(qa.prompts(articles(spark, folder)), qa.echo_provider))


# similarity
_SAMPLED = f"""
WITH o AS (SELECT category, article_id, arg_min({{t: title, d: description, c: content}}, row_id) AS x FROM article_records WHERE category IS NOT NULL AND article_id IS NOT NULL GROUP BY 1, 2),
s AS (SELECT category, article_id, x.t AS title, x.d AS description, x.c AS content FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY md5(concat_ws('|', CAST(article_id AS VARCHAR), '0')), article_id) AS r FROM o) WHERE r <= {similarity.SAMPLE})
"""


@query(f"""{_SAMPLED},
w AS (SELECT category, article_id, unnest(regexp_extract_all(lower(concat_ws(' ', coalesce(title, 'nan'), coalesce(description, 'nan'), substring(coalesce(content, 'nan'), 1, 500))), '[\\p{{L}}\\p{{M}}\\p{{N}}\\p{{Pc}}\\x{{200c}}\\x{{200d}}]+')) AS term FROM s),
tf AS (SELECT category, article_id, term, count(*) AS tf FROM w WHERE length(term) >= 2 GROUP BY ALL),
df AS (SELECT * FROM (SELECT category, term, count(*) AS df, row_number() OVER (PARTITION BY category ORDER BY sum(tf) DESC, term) AS r FROM tf GROUP BY 1, 2) WHERE r <= {similarity.FEATURES}),
n AS (SELECT category, count(*) AS n FROM s GROUP BY 1),
x AS (SELECT category, article_id, term, tf * (ln((1 + n) / (1 + df)) + 1) AS x FROM tf JOIN df USING (category, term) JOIN n USING (category)),
v AS (SELECT category, article_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY category, article_id)) AS w FROM x)
SELECT a.category, a.article_id AS a, b.article_id AS b, round(sum(a.w * b.w), 6) AS similarity FROM v a JOIN v b ON a.category = b.category AND a.term = b.term AND a.article_id < b.article_id GROUP BY ALL
""")
def tfidf_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return similarity.pairs(similarity.weights(similarity.sampled(records(spark, folder)))).withColumn("similarity", F.round("similarity", 6))


@query()
def cross_groups(spark: SparkSession, folder: str) -> DataFrame:
    return similarity.cross_groups(records(spark, folder)).withColumn("similarity", F.round("similarity", 9))


@query(f"{_SAMPLED} SELECT category, CAST(g AS INT) AS group_no, list(article_id ORDER BY article_id) AS article_ids FROM (SELECT *, (row_number() OVER (PARTITION BY category ORDER BY article_id) - 1) // {similarity.GROUP} AS g FROM s) WHERE g < {similarity.GROUPS_PER_CATEGORY} GROUP BY 1, 2 HAVING count(*) = {similarity.GROUP}")
def cross_triples(spark: SparkSession, folder: str) -> DataFrame:
    return similarity.triples(records(spark, folder))


# retrieval
def questions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "eval_items").select(F.col("item_id").alias("query_id"), F.col("question").alias("text"))


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents").select("doc_id", "text"))


_BM25 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(nfc_normalize(coalesce(text, ''))), '[^{_B}]+') AS w FROM documents),
s AS (SELECT avg(len(w)) AS mean, count(*) AS n FROM d),
q AS (SELECT item_id AS query_id, unnest(list_distinct(regexp_extract_all(lower(nfc_normalize(question)), '[^{_B}]+'))) AS term FROM eval_items),
p AS (SELECT doc_id, any_value(len(w)) AS dl, term, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term),
f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
r AS (SELECT query_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))) AS score FROM q JOIN f USING (term) JOIN p USING (term), s GROUP BY 1, 2),
bm25 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM r)
"""


@query(_BM25 + "SELECT query_id, doc_id, round(score, 6) AS score FROM bm25 WHERE rank <= 10")
def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.bm25(corpus(spark, folder), questions(spark, folder)).select("query_id", "doc_id", F.round("score", 6).alias("score"))


@query(_BM25 + "SELECT query_id, doc_id, CAST(rank AS INT) AS rank, split_part(text, chr(10), 1) AS title, text FROM bm25 JOIN documents USING (doc_id) WHERE rank <= 3")
def bm25_results(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.with_texts(retrieval.bm25(corpus(spark, folder), questions(spark, folder), 3).select("query_id", "doc_id", "rank"), corpus(spark, folder))


def vectors(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """All vectors, and as queries those whose id is divisible by 100."""
    rows = table(spark, folder, "embeddings")
    return rows.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")), rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


_DENSE = """
SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
  SELECT q.vec_id AS query_id, e.vec_id AS doc_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS score FROM (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q, embeddings e)) WHERE rank <= 10
"""


@query(f"SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM ({_DENSE})")
def dense_topk(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.dense(*vectors(spark, folder)).withColumn("score", F.round("score", 6)).select("query_id", "doc_id", "score", "rank")


_GOLD = "(SELECT q.vec_id AS query_id, e.vec_id AS doc_id FROM (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q JOIN embeddings e USING (label) WHERE q.label IS NOT NULL)"


@query(f"""
WITH r AS ({_DENSE}), g AS {_GOLD}, n AS (SELECT query_id, count(*) AS relevant FROM g GROUP BY 1),
h AS (SELECT r.query_id, r.rank FROM r JOIN g USING (query_id, doc_id)),
p AS (SELECT query_id, count_if(rank <= 1) AS h1, count_if(rank <= 3) AS h3, count_if(rank <= 5) AS h5, count_if(rank <= 10) AS h10, 1 / min(rank) AS mrr, sum(1 / log2(rank + 1.0)) AS dcg FROM h GROUP BY 1)
SELECT n.query_id, relevant, coalesce(h1, 0) / relevant AS recall_1, coalesce(h3, 0) / relevant AS recall_3, coalesce(h5, 0) / relevant AS recall_5, coalesce(h10, 0) / relevant AS recall_10,
  CAST(coalesce(h1, 0) > 0 AS INT) AS hit_1, CAST(coalesce(h3, 0) > 0 AS INT) AS hit_3, CAST(coalesce(h5, 0) > 0 AS INT) AS hit_5, CAST(coalesce(h10, 0) > 0 AS INT) AS hit_10, round(coalesce(mrr, 0), 6) AS mrr_10,
  round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(relevant, 10) + 1), lambda i: 1 / log2(i + 1.0))), 6) AS ndcg_10 FROM n LEFT JOIN p USING (query_id)
""")
def retrieval_metrics(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    gold = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label").join(rows.select(F.col("vec_id").alias("doc_id"), "label"), "label").select("query_id", "doc_id")
    return retrieval.metrics(retrieval.dense(*vectors(spark, folder)), gold).withColumns({c: F.round(c, 6) for c in ("mrr_10", "ndcg_10")})


@query("SELECT count(*) AS queries, avg(recall_1) AS recall_1, avg(recall_3) AS recall_3, avg(recall_5) AS recall_5, avg(recall_10) AS recall_10, avg(hit_1) AS hit_1, avg(hit_3) AS hit_3, avg(hit_5) AS hit_5, avg(hit_10) AS hit_10, avg(mrr_10) AS mrr_10, avg(ndcg_10) AS ndcg_10 FROM (" + SQL["retrieval_metrics"] + ")")
def retrieval_mean_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.mean_metrics(retrieval_metrics(spark, folder))


# Hybrid: each question is asked by its words and by a vector.  The tables hold no vectors of texts, so that the vector
# with the number of the item or document stands for it; documents without a vector are found by their words alone.
def hybrid(spark: SparkSession, folder: str, k: int = 50) -> tuple[DataFrame, DataFrame]:
    """The rankings by vectors and by words."""
    rows = table(spark, folder, "embeddings")
    items = table(spark, folder, "eval_items").select("item_id")
    asked = rows.join(items, rows.vec_id == items.item_id % F.lit(97), "right").select(F.col("item_id").alias("query_id"), F.col("embedding").alias("vector"))
    return retrieval.dense(rows.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")), asked, k), retrieval.bm25(corpus(spark, folder), questions(spark, folder), k)


_HYBRID = _BM25 + """
, v AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
  SELECT item_id AS query_id, e.vec_id AS doc_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS score FROM eval_items JOIN embeddings q ON q.vec_id = item_id % 97, embeddings e)),
a AS (SELECT * FROM v WHERE rank <= 50), b AS (SELECT query_id, doc_id, score, rank FROM bm25 WHERE rank <= 50)
"""
_FUSED = "SELECT query_id, doc_id, round(score, 6) AS score, CAST(place AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS place FROM fu) WHERE place <= 10"


def fused(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


@query(_HYBRID + ", fu AS (SELECT query_id, doc_id, coalesce(1 / (60 + a.rank), 0) + coalesce(1 / (60 + b.rank), 0) AS score FROM a FULL JOIN b USING (query_id, doc_id)) " + _FUSED)
def hybrid_reciprocal_ranks(spark: SparkSession, folder: str) -> DataFrame:
    return fused(retrieval.reciprocal_ranks(*hybrid(spark, folder)))


_SCALED = "SELECT query_id, doc_id, CASE WHEN max(score) OVER q > min(score) OVER q THEN (score - min(score) OVER q) / (max(score) OVER q - min(score) OVER q) ELSE 1 END AS s FROM {} WINDOW q AS (PARTITION BY query_id)"


@query(_HYBRID + f", x AS ({_SCALED.format('a')}), y AS ({_SCALED.format('b')}), fu AS (SELECT query_id, doc_id, 0.4 * coalesce(x.s, 0) + 0.6 * coalesce(y.s, 0) AS score FROM x FULL JOIN y USING (query_id, doc_id)) " + _FUSED)
def hybrid_weighted(spark: SparkSession, folder: str) -> DataFrame:
    return fused(retrieval.weighted(*hybrid(spark, folder), 0.4))


@query(_BM25 + "SELECT query_id, string_agg('[Nguồn ' || doc_id || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS context FROM bm25 JOIN documents USING (doc_id) WHERE rank <= 5 GROUP BY query_id")
def context_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.context(retrieval.bm25(corpus(spark, folder), questions(spark, folder), 5), corpus(spark, folder))


_NORMAL = r"trim(regexp_replace(lower({}), '[^\p{{L}}\p{{M}}\p{{N}}]+', ' ', 'g'))"
_A, _G = _NORMAL.format("answers[1]"), _NORMAL.format("answers[2]")


@query(f"""
WITH x AS (SELECT id, question, {_A} AS a, {_G} AS g FROM qa_output WHERE len(answers) >= 2)
SELECT id, question, CAST(a = g AS INT) AS em,
  round(CASE WHEN a = '' OR g = '' THEN CAST(a = g AS INT) ELSE 2.0 * (SELECT coalesce(sum(least(m, n)), 0) FROM (SELECT w, count(*) AS m FROM (SELECT unnest(string_split(a, ' ')) AS w) GROUP BY 1) JOIN (SELECT w, count(*) AS n FROM (SELECT unnest(string_split(g, ' ')) AS w) GROUP BY 1) USING (w)) / (len(string_split(a, ' ')) + len(string_split(g, ' '))) END, 6) AS f1 FROM x
""")
def answer_scores(spark: SparkSession, folder: str) -> DataFrame:
    a, g = F.get("answers", F.lit(0)), F.get("answers", F.lit(1))
    return table(spark, folder, "qa_output").where("size(answers) >= 2").select("id", "question", retrieval.exact_match(a, g).alias("em"), F.round(retrieval.token_f1(a, g), 6).alias("f1"))


@query(f"""
WITH RECURSIVE x AS (SELECT id, question, list_filter(string_split({_A}, ' '), lambda w: w <> '') AS a, list_filter(string_split({_G}, ' '), lambda w: w <> '') AS g, row_number() OVER () AS k FROM qa_output WHERE len(answers) >= 2),
l AS (  -- one row of the table of common subsequences per word of the answer
  SELECT k, 0 AS i, list_transform(range(len(g) + 1), lambda j: 0) AS row FROM x
  UNION ALL
  SELECT l.k, i + 1, list_prepend(0, list_transform(range(1, len(g) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda m: CASE WHEN a[i + 1] = g[m] THEN greatest(l.row[m] + 1, l.row[j + 1]) ELSE l.row[j + 1] END)))) FROM l JOIN x USING (k) WHERE i < len(a)
)
SELECT id, question, round(CASE WHEN len(a) = 0 OR len(g) = 0 THEN CAST(len(a) = len(g) AS INT) ELSE 2.0 * row[len(g) + 1] / (len(a) + len(g)) END, 6) AS rouge_l FROM x JOIN l USING (k) WHERE i = len(a)
""")
def answer_rouge_l(spark: SparkSession, folder: str) -> DataFrame:
    a, g = F.get("answers", F.lit(0)), F.get("answers", F.lit(1))
    return table(spark, folder, "qa_output").where("size(answers) >= 2").select("id", "question", F.round(retrieval.rouge_l(a, g), 6).alias("rouge_l"))
