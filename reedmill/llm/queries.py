"""The pN_ queries and their SQL."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import numpy as np

from pyspark.sql import DataFrame, SparkSession

from reedmill.functions.session import table
from reedmill.llm import answers, leaks, markup, mixing, overlap, pieces, quota, truncated, unify
from reedmill.llm.codepoints import DELETE, PLAIN, tables


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return unify.look_alikes(table(spark, folder, "article_records"))


def p1_unified(spark: SparkSession, folder: str) -> DataFrame:
    return unify.unify(table(spark, folder, "article_records").select("row_id", *unify.FIELDS))


def p2_report(spark: SparkSession, folder: str) -> DataFrame:
    return quota.report(table(spark, folder, "article_records"), table(spark, folder, "category_targets"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return p2_report(spark, folder).where("short").select("category")


def p2_sample(spark: SparkSession, folder: str) -> DataFrame:
    return quota.sample(table(spark, folder, "article_records"), table(spark, folder, "category_targets"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return overlap.overlaps(table(spark, folder, "article_records")).select("row_id_a", "row_id_b")


def p3_report(spark: SparkSession, folder: str) -> DataFrame:
    return overlap.report(table(spark, folder, "article_records"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return answers.defects(table(spark, folder, "qa_output"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return markup.found(table(spark, folder, "article_records"))


def p6_clean(spark: SparkSession, folder: str) -> DataFrame:
    return markup.strip_markup(table(spark, folder, "article_records"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.found(table(spark, folder, "article_records"), table(spark, folder, "chunks"), table(spark, folder, "size_limits"))


def p7_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.pieces(table(spark, folder, "article_records"), table(spark, folder, "chunks"), table(spark, folder, "size_limits"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.found(table(spark, folder, "documents"), table(spark, folder, "eval_items")).select("doc_id", "item_id")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.rates(table(spark, folder, "documents"), table(spark, folder, "source_weights")).where("short").select("source")


def p9_mixture(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return mixing.mix(documents, mixing.rates(documents, table(spark, folder, "source_weights")))


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.shares(table(spark, folder, "documents"), table(spark, folder, "source_weights"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return truncated.cut_off(table(spark, folder, "documents")).select("doc_id")


def p10_rates(spark: SparkSession, folder: str) -> DataFrame:
    return truncated.rates(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_unified, p2_found, p2_report, p2_sample, p3_found, p3_report, p4_found, p6_found, p6_clean, p7_found, p7_pieces, p8_found, p9_found, p9_mixture, p9_shares, p10_found, p10_rates)
}

#: Labels of article_records and of the targets in one form, pools and the sample size.
_POOLS = r"""
WITH keyed AS (
  SELECT article_id, trim(regexp_replace(regexp_replace(lower(nfc_normalize(category)), '[\x{A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]', ' ', 'g'), '\s+', ' ', 'g')) AS k FROM article_records
), goal AS (
  SELECT category, target_pct, min_rows, trim(regexp_replace(lower(nfc_normalize(category)), '\s+', ' ', 'g')) AS k FROM category_targets
), pools AS (
  SELECT g.category, g.target_pct, g.min_rows, count(DISTINCT a.article_id) AS pool FROM goal g LEFT JOIN keyed a ON a.k = g.k GROUP BY 1, 2, 3
), n AS (SELECT sum(pool) // 4 AS n FROM pools)
"""


def _form(text: str) -> str:
    """The one form of a text in SQL: every special character replaced by what the table holds for it, then composed."""
    t = tables()
    one: dict[str, str] = {}
    gone: list[str] = []
    several: dict[str, str] = {}
    for cp in map(int, np.flatnonzero((t.kind != PLAIN) | t.has)):
        if 0xD800 <= cp < 0xE000:
            continue
        to = "" if t.kind[cp] == DELETE else unicodedata.normalize("NFC", "".join(map(chr, t.flat[t.where[cp] : t.where[cp] + t.length[cp]]))) if t.has[cp] else chr(cp)
        if to == chr(cp):
            continue
        if not to:
            gone.append(chr(cp))
        elif len(to) == 1:
            one[chr(cp)] = to
        else:
            several[chr(cp)] = to
    quoted = lambda x: x.replace("'", "''").replace("\0", "")
    out = f"translate({text}, '{quoted(''.join(one))}' || '{quoted(''.join(gone))}', '{quoted(''.join(one.values()))}')"
    cases = f"MAP {{{', '.join(f"'{quoted(a)}': '{quoted(b)}'" for a, b in several.items())}}}"
    expanded = f"array_to_string(list_transform(string_split({out}, ''), lambda c: coalesce({cases}[c], c)), '')"
    return f"nfc_normalize(CASE WHEN regexp_matches({out}, '[{''.join(several)}]') THEN {expanded} ELSE {out} END)"


def _joined(text: str) -> str:
    """The one form with the joiners inside emoji kept."""
    joiner = r"'([\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE0F}])\x{200D}([\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE0F}])', '\1' || chr(57344) || '\2', 'g'"
    return f"replace({_form(f'regexp_replace(regexp_replace({text}, {joiner}), {joiner})')}, chr(57344), chr(8205))"


_BLANK = r"regexp_full_match({}, '[\s\p{{Z}}\p{{Cf}}]*')"
_FORMS = " UNION ALL ".join(f"SELECT '{f}' AS field, row_id, {f} AS raw, {_form(f)} AS form FROM article_records WHERE {f} IS NOT NULL AND NOT {_BLANK.format(f)}" for f in unify.FIELDS)

#: Final words of open ends against the counts of trigrams, as strings; CUTS has the documents that were cut off.
_W = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_CUTS = r"""
WITH t AS (
  SELECT doc_id, text, regexp_matches(substring(text, -3, 3), '[^.!?\d][.!?]\n?$') AND NOT starts_with(substring(text, -3, 3), '..') AS done FROM documents WHERE text IS NOT NULL
), b AS (
  SELECT doc_id, done, CASE WHEN done THEN text ELSE regexp_replace(text, '[{_W}\p{Cf}]+$', '') END AS whole FROM t
), e AS (
  SELECT *, CASE WHEN done THEN whole WHEN regexp_matches(whole, '(^|[^….])(…|\.\.\.)[{_W}]*([\[(«]?[{_W}]*\p{L}[\p{L} ]{1,24}[\])»]?)?[{_W}]*$') THEN regexp_replace(whole, '(^|[^….])(…|\.\.\.)[{_W}]*([\[(«]?[{_W}]*\p{L}[\p{L} ]{1,24}[\])»]?)?[{_W}]*$', '\1')
    ELSE regexp_replace(whole, '(�+|</?[a-z]{0,12}|&#?[a-z0-9]{0,7}|[{_W}]*[\[(][{_W}]*(…|\.\.\.)[{_W}]*[\])])[{_W}]*$', '') END AS shorter FROM b WHERE whole <> ''
), d AS (SELECT doc_id, done, whole, CASE WHEN done THEN shorter ELSE regexp_replace(shorter, '[{_W}\p{Cf}]+$', '') END AS body FROM e
), s AS (
  SELECT *, regexp_split_to_array(chr(4) || ' ' || chr(4) || ' ' || chr(4) || ' ' || replace(regexp_replace(regexp_replace(translate(body, '123456789', '000000000'), '([.!?…]+["”’»)\]]*)([\t-\r ]|$)', ' ' || chr(3) || ' \2', 'g'),
    '\x03([^\x03\n]*[^\x03\n \t\x{A0}][^\x03\n]*)\n', chr(3) || '\1 ' || chr(5) || ' ', 'g'), chr(10), ' ' || chr(4) || ' ') || ' ' || chr(6), '[^\p{L}\p{M}\p{N}\x03-\x06]+') AS w FROM d
), g AS (
  SELECT w[i] AS a, w[i + 1] AS b, w[i + 2] AS c, w[i + 3] AS n FROM (SELECT w, unnest(range(1, len(w) - 3)) AS i FROM s WHERE len(w) >= 5)
), counts AS (
  SELECT a, b, c, count(*) AS inside, count_if(n = chr(3)) AS stops, count_if(n = chr(4)) AS lines, count_if(n = chr(5)) AS prose FROM g GROUP BY ALL
), o AS (
  SELECT doc_id, body <> whole AND NOT (regexp_matches(whole, '(…|\.\.\.)$') AND regexp_matches(body, '[\p{L}\p{N}]$')) AS marked, regexp_matches(body, '\d[.]$') AS number, CASE WHEN w[-2] = chr(3) THEN w[:-3] ELSE w[:-2] END AS w
  FROM s WHERE NOT done AND body <> '' AND (regexp_matches(body, '\d[.]$') OR NOT regexp_matches(body, '[.!?。！？]+["''”’»)\]]*$') OR (body <> whole AND NOT (regexp_matches(whole, '(…|\.\.\.)$') AND regexp_matches(body, '[\p{L}\p{N}]$'))))
), ends AS (
  SELECT doc_id, marked, number, w[-4] AS w1, w[-3] AS w2, w[-2] AS w3, w[-1] AS w4, contains(regexp_split_to_array(array_to_string(w, ' '), '[\x04\x05]')[-1], chr(3)) AS in_prose, array_to_string(w[greatest(len(w) - 30, 1) : len(w) - 13], ' ') AS before FROM o
), tails AS (SELECT w2, w3, w4, in_prose, count(DISTINCT before) AS texts FROM ends WHERE NOT marked AND NOT number GROUP BY ALL
), pairs AS (SELECT b, c, sum(inside) AS inside, sum(lines) AS lines, sum(prose) AS prose FROM counts GROUP BY ALL
), singles AS (SELECT c, sum(inside) AS inside, sum(lines) AS lines, sum(prose) AS prose FROM pairs GROUP BY ALL
), j AS (
  SELECT ends.*, coalesce(k.inside, 0) AS inside, coalesce(k.stops, 0) AS stops, coalesce(f.inside, 0) AS around, coalesce(texts, 0) - CASE WHEN marked OR number THEN 0 ELSE 1 END AS tails,
    CASE WHEN in_prose THEN coalesce(k.prose, 0) ELSE coalesce(k.lines, 0) END + coalesce(texts, 0) - CASE WHEN marked OR number THEN 0 ELSE 1 END AS n_ends,
    coalesce(p.inside, 0) AS inside2, CASE WHEN in_prose THEN coalesce(p.prose, 0) ELSE coalesce(p.lines, 0) END AS ends2, coalesce(q.inside, 0) AS inside1, CASE WHEN in_prose THEN coalesce(q.prose, 0) ELSE coalesce(q.lines, 0) END AS ends1
  FROM ends LEFT JOIN tails USING (w2, w3, w4, in_prose) LEFT JOIN counts k ON k.a = w2 AND k.b = w3 AND k.c = w4 LEFT JOIN counts f ON f.a = w1 AND f.b = w2 AND f.c = w3 LEFT JOIN pairs p ON p.b = w3 AND p.c = w4 LEFT JOIN singles q ON q.c = w4
), cuts AS (
  SELECT doc_id FROM j WHERE CASE WHEN marked THEN true WHEN number THEN inside >= 5 AND stops < 0.04 * inside WHEN inside >= 5 THEN n_ends < 0.005 * (inside + tails)
    WHEN around >= 5 AND w3 NOT IN (chr(4), chr(5)) THEN n_ends < 0.2 * around WHEN inside + tails >= 5 THEN n_ends < 0.005 * (inside + tails)
    WHEN inside2 >= 200 THEN ends2 < 0.005 * inside2 WHEN inside1 >= 200 THEN ends1 < 0.005 * inside1 ELSE inside1 < 5 AND NOT list_has_any([w1, w2, w3], [chr(4), chr(5)]) END
)
""".replace("{_W}", _W)

SQL: dict[str, str] = {
    "p1_found": f"WITH f AS ({_FORMS}) SELECT a.field, least(a.row_id, b.row_id) AS row_id_a, greatest(a.row_id, b.row_id) AS row_id_b FROM f a JOIN f b ON a.field = b.field AND a.form = b.form AND a.raw <> b.raw AND a.row_id < b.row_id",
    "p1_unified": f"SELECT row_id, {', '.join(f'{_joined(f)} AS {f}' for f in unify.FIELDS)} FROM article_records",
    # any usual tokenizer tells the same sources: the SQL counts words
    "p9_found": r"""
WITH d AS (SELECT source, len(regexp_extract_all(coalesce(text, ''), '[^\s]+')) AS n FROM documents WHERE source IS NOT NULL), t AS (SELECT sum(n) AS total FROM d), s AS (SELECT source, sum(n) AS size FROM d GROUP BY 1)
SELECT w.source FROM source_weights w LEFT JOIN s USING (source), t WHERE coalesce(size, 0) * max_repeats * 100 < target_pct * total
""",
    "p10_found": _CUTS + "SELECT doc_id FROM cuts",
    "p10_rates": _CUTS + "SELECT source, count(*) AS documents, count(c.doc_id) AS cut, count(c.doc_id) / count(*) AS rate FROM documents d LEFT JOIN cuts c USING (doc_id) GROUP BY source",
    "p2_found": _POOLS + "SELECT category FROM pools, n WHERE pool * 100 < target_pct * n.n OR pool < min_rows",
    "p7_found": r"""
SELECT 'article' AS item_kind, CAST(row_id AS VARCHAR) AS item_key FROM article_records WHERE length(content) > (SELECT max_size FROM size_limits WHERE item_kind = 'article')
UNION SELECT 'chunk', chunk_id FROM chunks
WHERE length(regexp_replace(regexp_replace(chunk_text, '[^\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', 'x', 'g'), '[^x]', '', 'g')) > (SELECT max_size FROM size_limits WHERE item_kind = 'chunk')
""",
}
