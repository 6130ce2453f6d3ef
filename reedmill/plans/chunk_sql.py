"""SQL that says what the chunkers do: sentence and part packing as recursive queries, spans, tails and assembly."""

from __future__ import annotations

B = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SEPARATORS = (r"E'\n\n'", r"E'\n'", "'. '", "'? '", "'! '", "' '")


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{B}]+|[{B}]+$', '', 'g')"


def words(x: str) -> str:
    return f"regexp_extract_all({x}, '[^{B}]+')"


def field(c: str) -> str:
    return f"coalesce(nullif({c}, ''), nullif(metadata.{c}, ''), '')"


#: All articles, and those that are cut (more than 1,000 characters).
ARTICLES = f"""
a AS (SELECT row_id, article_id, {', '.join(f'{field(c)} AS {c}' for c in ('title', 'description', 'category'))}, content, metadata.content_chars AS content_chars, metadata.is_short AS is_short FROM article_records),
l AS (SELECT row_id, content FROM a WHERE {strip("coalesce(content, '')")} <> '' AND length(content) > 1000)
"""


def windows(text: str, size: int, overlap: int) -> str:
    """List of the windows of words of a text, with the blanks between them."""
    w = f"regexp_extract_all({text}, '[^{B}]+[{B}]*')"
    return f"list_transform(range(CASE WHEN len({w}) <= {size} THEN least(len({w}), 1) ELSE 1 + CAST(ceil((len({w}) - {size}) / {max(1, size - overlap)}.0) AS BIGINT) END), lambda v: {strip(f'''array_to_string({w}[v * {max(1, size - overlap)} + 1 : v * {max(1, size - overlap)} + {size}], '')''')})"


def token_units(size: int, overlap: int) -> str:
    step = max(1, size - overlap)
    return f"""
t AS (SELECT row_id, length(regexp_extract(content, '^[{B}]*')) AS lead, regexp_extract_all(content, '[^{B}]+[{B}]*') AS w FROM l),
k AS (SELECT *, unnest(range(CASE WHEN len(w) <= {size} THEN 1 ELSE 1 + CAST(ceil((len(w) - {size}) / {step}.0) AS INT) END)) AS i FROM t),
v AS (SELECT row_id, i + 1 AS idx, {strip(f"array_to_string(w[i * {step} + 1 : i * {step} + {size}], '')")} AS text, lead + length(array_to_string(w[1 : i * {step}], '')) AS start FROM k),
u AS (SELECT row_id, idx, text, start, start + length(text) AS stop, len({words('text')}) AS tokens, 'content' AS structure FROM v)"""


#: Where parts stand in their bodies: from where the last one ended, else from the start, else there.
LOCATED = f"""
f AS (SELECT row_id, sec, off, body, structure, list_filter(list_transform(parts, lambda p: {strip('p')}), lambda p: p <> '') AS parts FROM p),
g AS (
  SELECT row_id, sec, off, body, structure, parts, 0 AS k, 0 AS seen, 0 AS place FROM f
  UNION ALL
  SELECT row_id, sec, off, body, structure, parts, k + 1, greatest(seen, place2 + length(part)), place2 FROM (
    SELECT *, CASE WHEN instr(substring(body, seen + 1), part) > 0 THEN seen + instr(substring(body, seen + 1), part) - 1 WHEN instr(body, part) > 0 THEN instr(body, part) - 1 ELSE seen END AS place2
    FROM (SELECT *, parts[k + 1] AS part FROM g WHERE k < len(parts)))
),
u AS (SELECT row_id, row_number() OVER (PARTITION BY row_id ORDER BY sec, k) AS idx, parts[k] AS text, off + place AS start, off + place + length(parts[k]) AS stop, len({words('parts[k]')}) AS tokens, structure FROM g WHERE k > 0)"""

#: Paragraphs of a text: stripped bodies with the places where they began.
PARAGRAPHS = f"""
x AS (SELECT row_id, content, regexp_extract_all(content, '[^\\n]*\\n*') AS raw FROM l),
y AS (SELECT row_id, unnest(range(1, len(raw) + 1)) AS i, raw FROM x),
z AS (SELECT row_id, i, {strip("regexp_replace(raw[i], '\\n+$', '')")} AS body, length(array_to_string(raw[1 : i - 1], '')) AS off FROM y),
b AS (SELECT row_id, row_number() OVER (PARTITION BY row_id ORDER BY i) - 1 AS sec, count(*) OVER (PARTITION BY row_id) AS n, off, body FROM z WHERE body <> '')"""


def sentence_parts(size: int, overlap: int) -> str:
    """Bodies b (row_id, sec, off, body, structure) as parts: sentences packed up to the size."""
    return f"""
s AS (SELECT *, list_filter(list_transform(regexp_extract_all(body, '[^.!?…]+(?:[.!?…]+|$)'), lambda s: {strip('s')}), lambda s: s <> '') AS s FROM b0),
n AS (SELECT *, list_transform(s, lambda x: len({words('x')})) AS n FROM s),
r AS (
  SELECT row_id, sec, off, body, structure, s, n, 1 AS i, 1 AS a, CAST([] AS VARCHAR[]) AS done FROM n
  UNION ALL
  SELECT row_id, sec, off, body, structure, s, n, i + 1, CASE WHEN n[i] > {size} THEN i + 1 WHEN full_up THEN coalesce(list_max(list_filter(range(a, i), lambda j: list_sum(n[j : i - 1]) >= {overlap})), a) ELSE a END,
    list_concat(done, CASE WHEN full_up THEN [array_to_string(s[a : i - 1], ' ')] ELSE [] END, CASE WHEN n[i] > {size} THEN {windows('s[i]', size, overlap)} ELSE [] END)
  FROM (SELECT *, a < i AND list_sum(n[a : i - 1]) + n[i] > {size} AS full_up FROM r WHERE i <= len(s))
),
p AS (SELECT row_id, sec, off, body, structure, CASE WHEN len(s) = 0 THEN [body] WHEN a < i THEN list_append(done, array_to_string(s[a : i - 1], ' ')) ELSE done END AS parts FROM r WHERE i > len(s)),"""


def recursive_parts(size: int, overlap: int) -> str:
    steps = []
    for k, separator in enumerate(SEPARATORS):
        split = f"string_split(x, {separator})"
        steps.append(f"q{k + 1} AS (SELECT row_id, content, flatten(list_transform(s, lambda x: CASE WHEN length(x) <= {size} OR NOT contains(x, {separator}) THEN [x] ELSE list_concat(list_transform({split}[:-2], lambda h: h || {separator}), CASE WHEN {split}[-1] <> '' THEN [{split}[-1]] ELSE [] END) END)) AS s FROM q{k})")
    tail = f"held[-{overlap}:]" if overlap > 0 else "''"
    return f"""
q0 AS (SELECT row_id, content, [content] AS s FROM l),
{', '.join(steps)},
r AS (
  SELECT row_id, content, s, 1 AS i, '' AS held, CAST([] AS VARCHAR[]) AS done FROM q{len(SEPARATORS)}
  UNION ALL
  SELECT row_id, content, s, i + 1, CASE WHEN full_up THEN {tail} || s[i] ELSE held || s[i] END, CASE WHEN full_up THEN list_append(done, held) ELSE done END
  FROM (SELECT *, held <> '' AND length(held) + length(s[i]) > {size} AS full_up FROM r WHERE i <= len(s))
),
p AS (SELECT row_id, 0 AS sec, 0 AS off, content AS body, 'content' AS structure, list_append(done, held) AS parts FROM r WHERE i > len(s)),"""


def units(strategy: str, size: int, overlap: int) -> str:
    if strategy == "token":
        return token_units(size, overlap)
    if strategy == "langchain_recursive":
        return recursive_parts(size, overlap) + LOCATED
    if strategy == "llamaindex":
        return "b0 AS (SELECT row_id, 0 AS sec, 0 AS off, content AS body, 'content' AS structure FROM l)," + sentence_parts(size, overlap) + LOCATED
    named = "b0 AS (SELECT row_id, sec, off, body, CASE WHEN n = 1 THEN 'content' ELSE 'paragraph_' || CASE WHEN sec < 1000 THEN lpad(CAST(sec AS VARCHAR), 3, '0') ELSE CAST(sec AS VARCHAR) END END AS structure FROM b),"
    return PARAGRAPHS + "," + named + sentence_parts(size, overlap) + LOCATED


IMPLEMENTATIONS = {"token": "internal_token_window", "langchain_recursive": "internal_recursive_character_fallback", "llamaindex": "internal_sentence_splitter_fallback", "structured": "internal_structured_sentence_window"}


def chunks(strategy: str = "token", size: int = 450, overlap: int = 80, least: int = 80, most: int | None = None) -> str:
    """A query whose rows are the chunks, without WITH in front of the last SELECT's source."""
    shared = "coalesce(list_max(list_filter(range(1, least(len(x), len(y)) + 1), lambda k: x[len(x) - k + 1 :] = y[1 : k])), 0)"
    cap = "num_chunks" if most is None else f"least(num_chunks, {most})"
    return f"""
WITH RECURSIVE {ARTICLES}, {units(strategy, size, overlap)},
c AS (SELECT *, count(*) OVER (PARTITION BY row_id) AS n FROM u),
j AS (
  SELECT c.row_id, c.idx, b.text AS bt, c.text AS tt, b.start, c.stop, b.structure AS bs, c.structure AS ts, {words('b.text')} AS x, {words('c.text')} AS y FROM c JOIN c b ON b.row_id = c.row_id AND b.idx = c.idx - 1 WHERE c.idx = c.n AND c.n >= 2 AND c.tokens < {least}
),
m AS (SELECT row_id, idx - 1 AS idx, array_to_string(list_concat(x, y[{shared} + 1 :]), ' ') AS text, start, stop, CASE WHEN bs = ts THEN ts ELSE bs || '+' || ts END AS structure FROM j),
e AS (
  SELECT row_id, idx, text, start, stop, tokens, structure, false AS small FROM c WHERE NOT (n >= 2 AND idx >= n - 1 AND row_id IN (SELECT row_id FROM m))
  UNION ALL SELECT row_id, idx, text, start, stop, len({words('text')}), structure, false FROM m
  UNION ALL SELECT row_id, 1, content, 0, length(content), len({words('content')}), 'content', true FROM a WHERE {strip("coalesce(content, '')")} <> '' AND length(content) <= 1000
),
h AS (SELECT *, count(*) OVER (PARTITION BY row_id) AS num_chunks, {strip('text')} AS chunk_text FROM e)
SELECT article_id || '_{strategy}_' || CASE WHEN idx <= 10000 THEN lpad(CAST(idx - 1 AS VARCHAR), 4, '0') ELSE CAST(idx - 1 AS VARCHAR) END AS chunk_id, article_id, '{strategy}' AS strategy, chunk_text,
  concat_ws(chr(10), CASE WHEN title <> '' THEN 'Tiêu đề: ' || title END, CASE WHEN description <> '' THEN 'Mô tả: ' || description END, CASE WHEN category <> '' THEN 'Chuyên mục: ' || category END, 'Đoạn nội dung:', nullif(chunk_text, '')) AS text,
  CAST(idx - 1 AS INT) AS chunk_index, CAST({cap} AS INT) AS num_chunks, CAST(start AS INT) AS char_start, CAST(stop AS INT) AS char_end, tokens AS token_count, length(chunk_text) AS chunk_chars,
  CASE WHEN small THEN 'single_small_article' ELSE '{IMPLEMENTATIONS[strategy]}' END AS implementation, structure, content_chars, num_chunks > {cap} AS truncated_article
FROM h JOIN a USING (row_id){'' if most is None else f' WHERE idx <= {most}'}
"""


def stats(*runs: str) -> str:
    """Statistics over the chunks of some runs, one row per run."""
    return " UNION ALL ".join(
        f"SELECT strategy, count(*) AS chunks_written, count_if(truncated_article AND chunk_index = 0) AS truncated_articles, CAST(sum(token_count) AS BIGINT) AS total_chunk_tokens, min(token_count) AS min_chunk_tokens, max(token_count) AS max_chunk_tokens, CAST(sum(chunk_chars) AS BIGINT) AS total_chunk_chars, "
        f"min(chunk_chars) AS min_chunk_chars, max(chunk_chars) AS max_chunk_chars, any_value(articles_read) AS articles_read, any_value(short_articles) AS short_articles, any_value(empty_articles) AS empty_articles, count(*) / any_value(articles_read) AS avg_chunks_per_article, "
        f"sum(token_count) / count(*) AS avg_chunk_tokens, sum(chunk_chars) / count(*) AS avg_chunk_chars FROM ({run}) c, (SELECT count(*) AS articles_read, count_if(coalesce(metadata.is_short, false)) AS short_articles, count_if({strip(chr(99) + 'oalesce(content, ' + repr('') + ')')} = '') AS empty_articles FROM article_records) s GROUP BY strategy"
        for run in runs
    )


def flat(size: int = 512, overlap: int = 96, least: int = 50) -> str:
    """The passages of the second chunker, on words."""
    clean = lambda x: strip(f"regexp_replace(translate(coalesce({x}, ''), chr(65279) || chr(160), '  '), '[{B}]+', ' ', 'g')")
    gaps = f"regexp_replace({clean('content')}, '([.!?。！？])[{B}]+', '\\1' || chr(1), 'g')"
    w = words("s[i]")
    pieces = f"list_filter(list_transform(range(0, greatest(1, len({w}) - {overlap}), {size - overlap}), lambda k: array_to_string({w}[k + 1 : k + {size}], ' ')), lambda x: x <> '')"
    return f"""
WITH RECURSIVE b AS (SELECT row_id, TRY_CAST(article_id AS BIGINT) AS article_id, {', '.join(f'{clean(c)} AS {c}' for c in ('title', 'description', 'category'))}, list_filter(list_transform(string_split({gaps}, chr(1)), lambda s: {strip('s')}), lambda s: s <> '') AS s FROM article_records WHERE article_id IS NOT NULL),
n AS (SELECT *, list_transform(s, lambda x: len({words('x')})) AS n FROM b WHERE article_id IS NOT NULL),
r AS (
  SELECT row_id, s, n, 1 AS i, 1 AS a, CAST([] AS VARCHAR[]) AS done FROM n
  UNION ALL
  SELECT row_id, s, n, i + 1, CASE WHEN n[i] > {size} THEN i + 1 WHEN full_up THEN coalesce(list_min(list_filter(range(a, i), lambda j: list_sum(n[j : i - 1]) <= {overlap})), i) ELSE a END,
    list_concat(done, CASE WHEN a < i AND (full_up OR n[i] > {size}) THEN [array_to_string(s[a : i - 1], ' ')] ELSE [] END, CASE WHEN n[i] > {size} THEN {pieces} ELSE [] END)
  FROM (SELECT *, a < i AND list_sum(n[a : i - 1]) + n[i] > {size} AS full_up FROM r WHERE i <= len(s))
),
p AS (SELECT row_id, list_transform(CASE WHEN a < i THEN list_append(done, array_to_string(s[a : i - 1], ' ')) ELSE done END, lambda x: {{t: x, n: len({words('x')})}}) AS p FROM r WHERE i > len(s)),
f AS (SELECT row_id, CASE WHEN len(list_filter(p, lambda x: x.n >= {least})) > 0 OR len(p) = 0 THEN list_filter(p, lambda x: x.n >= {least}) ELSE [list_filter(p, lambda x: x.n = list_max(list_transform(p, lambda y: y.n)))[1]] END AS p FROM p),
o AS (SELECT row_id, unnest(range(len(p))) AS k, p FROM f)
SELECT 'article_' || article_id || '_chunk_' || k AS chunk_id, article_id, title, description, category, '' AS source, '' AS url, CAST(k AS INT) AS chunk_index, CAST(p[k + 1].n AS INT) AS n_tokens, p[k + 1].t AS text,
  concat_ws(chr(10), CASE WHEN title <> '' THEN 'Title: ' || title END, CASE WHEN description <> '' THEN 'Description: ' || description END, 'Content: ' || p[k + 1].t) AS embedding_text
FROM o JOIN n USING (row_id)
"""
