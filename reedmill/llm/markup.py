"""Problem 6: HTML, Markdown, wiki and LaTeX markup becomes clean text that keeps its structure.

Method: a text is a sequence of tokens; words score positive and markup negative, with weights learnt as log-odds
from lines labelled as content or as markup, and a linear scan finds the contiguous region with the largest sum.
A text in which the scan scores any token as markup holds markup (``p6_found``).  The text of the region is then
written in plain form:

* headings are lines of their own that begin with ``§``, list entries begin with ``- ``,
* cells of a table row are separated by tabs, code is indented by four blanks,
* formulas stand between ``⟨`` and ``⟩`` in linear notation.

Text without markup is passed on as it is, a null stays null.  Plain dash lists, numbering, hashtags, prices,
footnote stars, comparison and multiplication signs, ampersands in names, file names, bracketed words and web
addresses are not markup.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from html.entities import html5

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Element names.
ELEMENTS = (
    "a abbr article aside audio b big blockquote body br button caption center cite code col colgroup dd del details div dl dt em embed figcaption figure font footer form gallery h1 h2 h3 h4 h5 h6 head header hr html "
    "i iframe img input ins kbd label li link main mark math meta nav noscript nowiki ol option p path picture pre q ref references s samp script section select small source span strike strong style sub summary sup svg "
    "table tbody td textarea tfoot th thead time title tr tt u ul var video"
).split()
#: LaTeX commands that may stand without braces.
COMMANDS = "alpha approx beta cdot delta div epsilon equiv gamma geq ge hline infty in item label lambda leq le ldots mu neq newline noindent omega par partial pi pm prod quad rho rightarrow sigma sum theta tau times to".split()
#: Elements inside a line of text.
INLINE = re.compile(r"</?(?:b|i|u|s|em|strong|span|small|big|sub|sup|code|cite|q|mark|font|del|ins|kbd|tt|var)\b")
NAMED = "|".join(sorted({e.rstrip(";") for e in html5 if e.endswith(";")}, key=len, reverse=True))

_TAG = rf"</?(?:{'|'.join(sorted(ELEMENTS, key=len, reverse=True))})(?:\s+[A-Za-z_:][\w:.-]*(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'<>]+))?)*\s*/?>"
_ATTRIBUTES = rf"</?(?:{'|'.join(ELEMENTS)})(?:\s[^<>]*)>"
KINDS = {
    "dropped": r"<!--.*?-->|<(?P<gone>script|style)\b[^>]*>.*?</(?P=gone)\s*>|<!DOCTYPE[^>]*>",
    "tag": rf"{_TAG}|{_ATTRIBUTES}",
    "entity": rf"&(?:#\d{{1,7}}|#[xX][0-9a-fA-F]{{1,6}}|{NAMED});",
    "fence": r"```.*?```|```",
    "math": r"\\\(.+?\\\)|\\\[.+?\\\]|\$\$.+?\$\$|\$(?=[^$\n]*[\\^_])[^$\n]+\$",
    "latex": rf"\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{{|\\(?:{'|'.join(COMMANDS)})(?![A-Za-z])|\\[%&#_]",
    "template": r"\{\{[^{}]*\}\}|\{\{|\}\}",
    "wiki": r"\[\[[^\[\]]*\]\]|^\{\|[^\n]*$|^\|\}|^\|-+[ \t]*$|^={2,6}[^=\n][^\n]*?={2,6}[ \t]*$|'''|''(?=\S)(?=[^\n]*\S'')|(?<=\S)''|\[https?://\S+ [^\]\n]+\]|__[A-Z]+__",
    "link": r"!?\[[^\[\]\n]*\]\([^()\s]+(?:\s+\"[^\"\n]*\")?\)",
    "heading": r"^[ \t]{0,3}#{1,6}[ \t]+(?=\S)",
    "quote": r"^[ \t]{0,3}>[ \t]+(?=[^\s\d])",
    "rule": r"^[ \t]*\|?(?:[ \t]*:?-{3,}:?[ \t]*\|)+[ \t]*:?-*:?[ \t]*\|?[ \t]*$",
    "strong": r"(?<![\w*])\*\*(?=\S)(?:[^*\n]|\*(?!\*))+?(?<=\S)\*\*(?!\*)|(?<!\w)__(?=\S)[^_\n]+(?<=\S)__(?!\w)|~~(?=\S)[^~\n]+(?<=\S)~~|(?<=\w)\*\*(?=\S)[^*\n]+(?<=\S)\*\*",
    "soft": r"(?<![\w*])\*(?=[^\s*])[^*\n]*(?<=[^\s*])\*(?![\w*])|(?<![\w/_.])_(?=[^\s_])[^_\n]+(?<=[^\s_])_(?![\w/_.])",
    "code": r"`[^`\n]+`",
}
MARKUP = re.compile("|".join(f"(?P<{k}>{v})" for k, v in KINDS.items()), re.M | re.S)
TOKEN = re.compile(r"\w+|[^\w\s]+")
#: Characters without which a text cannot hold markup.
SUSPECT = r"(?m)[<&*_`~\\$|\[{]|''|==|^\s*#{1,6}\s|^\s*>"
#: Kinds of markup that bear text.
BEARING = ("inline", "wiki", "latex", "fence", "math", "link", "heading", "quote", "strong", "soft", "code")
#: Weights of the token kinds, unless learnt ones are given.
WEIGHTS = {"word": 1.0, "sign": 0.1, "dropped": -4.0, "tag": -2.0, "entity": -0.5, "template": -2.0, "rule": -1.0} | dict.fromkeys(BEARING, 0.2)
#: Kinds of markup that bear no text.
BARE = ("dropped", "tag", "inline", "template", "rule")
#: Words of a text from which menus can be told from its lists.
JUDGED = 30
#: Navigation: elements for it, and lists without lists inside.
NAVIGATION = re.compile(r"<nav\b[^>]*>.*?</nav\s*>|<(?P<list>ul|ol)\b[^>]*>(?P<items>(?:(?!<(?:ul|ol)\b).)*?)</(?P=list)\s*>", re.S | re.I)
#: What entries of menus say.
MENU = frozenset(("trang chủ", "trang nhất", "home", "menu", "xem", "xem thêm", "xem tiếp", "đọc thêm", "đọc tiếp", "chia sẻ", "liên hệ", "đăng nhập", "đăng ký", "tìm kiếm", "bình luận", "về đầu trang", "quay lại", "trang trước", "trang sau", "sơ đồ trang"))
#: Largest number of texts from which weights are learnt.
SAMPLE = 4000


def tokens(text: str) -> Iterator[tuple[str, int, int]]:
    """Kind, start and end of each token: markup by its kind, else words and signs."""
    at = 0
    for m in MARKUP.finditer(text):
        for t in TOKEN.finditer(text, at, m.start()):
            yield ("word" if t.group()[0].isalnum() else "sign"), t.start(), t.end()
        if m.end() > m.start():
            kind = m.lastgroup if m.lastgroup != "gone" else "dropped"
            yield "inline" if kind == "tag" and INLINE.match(m.group()) else kind, m.start(), m.end()
        at = m.end()
    for t in TOKEN.finditer(text, at):
        yield ("word" if t.group()[0].isalnum() else "sign"), t.start(), t.end()


def has_markup(text: str) -> bool:
    return MARKUP.search(text) is not None


def labelled(text: str) -> Counter:
    """Counts of (label, token kind) over the lines of a text; a line is markup if that takes more than half of it."""
    out: Counter = Counter()
    at = 0
    found = list(tokens(text))
    for line in text.splitlines(keepends=True):
        mine = [t for t in found if at <= t[1] < at + len(line)]
        taken = sum(e - s for k, s, e in mine if k not in ("word", "sign"))
        label = "markup" if 2 * taken > len(line.strip()) else "content"
        out.update((label, k) for k, _, _ in mine)
        at += len(line)
    return out


def log_odds(counts: Counter) -> dict[str, float]:
    """Weights by kind; words and what bears text are never negative, what is dropped never positive."""
    whole = {label: sum(n for (x, _), n in counts.items() if x == label) + len(KINDS) + 3 for label in ("content", "markup")}
    out = {k: math.log((counts["content", k] + 1) / whole["content"]) - math.log((counts["markup", k] + 1) / whole["markup"]) for k in ("word", "sign", "inline", *KINDS)}
    return out | {"word": max(out["word"], 0.1), "sign": max(out["sign"], 0.0), "dropped": min(out["dropped"], -0.1)} | {k: max(out[k], 0.1) for k in BEARING}


def menus(text: str) -> list[tuple[int, int]]:
    """Start and end of each navigation element, and of each list of menu entries, or of links with a menu entry among them."""
    out = []
    for m in NAVIGATION.finditer(text):
        items = [x for x in re.split(r"</?li\b[^>]*>", m.group("items") or "", flags=re.I) if x.strip()]
        known = [re.sub(r"<[^>]*>", "", x).strip().casefold() in MENU for x in items]
        if m.group("items") is None or any(known) and all(k or re.fullmatch(r"\s*<a\b[^>]*>[^<]*</a\s*>\s*", x, re.I) for k, x in zip(known, items, strict=True)):
            out.append(m.span())
    return out


def scan(text: str, weights: dict[str, float]) -> tuple[int, int, bool]:
    """Start and end of the contiguous region with the largest sum of weights, widened to all other text, and whether
    any token was scored as markup.

    What lies before the first or behind the last text that is no navigation goes.  In texts that are too short to
    judge nothing counts as navigation.
    """
    best, span, total, start = 0.0, (0, 0), 0.0, None
    found = list(tokens(text))
    met = any(kind not in ("word", "sign") for kind, _, _ in found)
    if not met:
        return 0, len(text), False
    for kind, a, b in found:
        if total <= 0:
            total, start = 0.0, a
        total += weights.get(kind, 0.0)
        if total > best:
            best, span = total, (start, b)
    outside = [t for t in found if (t[2] <= span[0] or t[1] >= span[1]) and t[0] not in BARE]
    gone = menus(text) if sum(k == "word" for k, _, _ in found) >= JUDGED else []
    stays = [t for t in outside if not any(x <= t[1] < y for x, y in gone)]
    a, b = min([span[0] if best else len(text), *(t[1] for t in stays)]), max([span[1], *(t[2] for t in stays)])
    for kind, start, stop in reversed([t for t in found if t[2] <= a]):  # markup directly around the region shapes it
        if text[stop:a].strip() or kind not in BARE[1:] or any(x <= start < y for x, y in gone):
            break
        a = start
    for kind, start, stop in [t for t in found if t[1] >= b]:
        if text[b:start].strip() or kind not in BARE[1:] or any(x <= start < y for x, y in gone):
            break
        b = stop
    return a, b, True


def region(text: str, weights: dict[str, float]) -> tuple[int, int]:
    """Start and end of the best region."""
    return scan(text, weights)[:2]


def _formula(x: str) -> str:
    x = re.sub(r"^(?:\\\(|\\\[|\$\$?)\s*|\s*(?:\\\)|\\\]|\$\$?)$", "", x)
    for _ in range(4):
        x = re.sub(r"\\d?frac\{([^{}]*)\}\{([^{}]*)\}", r"(\1)/(\2)", x)
        x = re.sub(r"\\sqrt\{([^{}]*)\}", r"√(\1)", x)
        x = re.sub(r"\\[A-Za-z]+\{([^{}]*)\}", r"\1", x)
        x = re.sub(r"([_^])\{([^{}]*)\}", lambda m: m.group(1) + (m.group(2) if len(m.group(2)) < 2 else f"({m.group(2)})"), x)
    signs = {"leq": "≤", "le": "≤", "geq": "≥", "ge": "≥", "approx": "≈", "times": "×", "cdot": "·", "neq": "≠", "pm": "±", "infty": "∞", "sum": "∑", "pi": "π", "alpha": "α", "beta": "β", "sigma": "σ", "mu": "μ", "lambda": "λ"}
    x = re.sub(r"\\([A-Za-z]+)", lambda m: signs.get(m.group(1), m.group(1)), x)
    return "⟨" + re.sub(r"\s+", " ", x.replace("{,}", ",").replace("{", "(").replace("}", ")").replace("\\", "")).strip() + "⟩"


def _indent(code: str) -> str:
    code = code.strip("\n")
    return "\n" + "\n".join("    " + x for x in code.split("\n")) + "\n"


def _row(cells: Iterable[str]) -> str:
    return "\n" + "\t".join(c.strip() for c in cells) + "\n"


def _wiki_link(m: re.Match) -> str:
    target, _, shown = m.group(1).partition("|")
    space = target.partition(":")[0].strip().lower()
    if ":" in target and space in ("thể loại", "category"):
        return ""
    if ":" in target and space in ("tập tin", "hình", "file", "image"):
        return shown.rpartition("|")[2]
    return shown.rpartition("|")[2] or target.lstrip(":")


def unescaped(text: str) -> str:
    """A text without entities, also where they were escaped again."""
    for _ in range(8):
        if not re.search(KINDS["entity"], text):
            break
        text = html.unescape(text)
    return text


def plain(text: str, rounds: int = 4) -> str:
    """The text without markup, with its structure in plain form; code and formulas are not touched again.

    Markup that comes out of markup is taken off in further rounds.
    """
    text = text.replace("\x00", "")
    kept: list[str] = []
    for _ in range(rounds):
        text = _without_markup(text, kept)
        if not has_markup(text):
            break
    for _ in range(2):
        text = re.sub(r"\x00(\d+)\x00", lambda m: kept[int(m.group(1))], text)
    text = re.sub(r"[ \t]+$", "", text, flags=re.M)
    return re.sub(r"\n{3,}", "\n\n", text).strip("\n")


def _without_markup(text: str, kept: list[str]) -> str:
    """One round; code and formulas go to kept, and marks with their numbers stand for them."""
    text = unescaped(text)

    def keep(x: str) -> str:
        kept.append(x)
        return f"\x00{len(kept) - 1}\x00"

    sub = lambda p, r, x, f=re.S | re.M: re.sub(p, r, x, flags=f)
    text = sub(r"```[^\n`]*\n(.*?)\n?```", lambda m: keep(_indent(m.group(1))), text)
    text = sub(r"<pre\b[^>]*>(.*?)</pre\s*>", lambda m: keep(_indent(re.sub(_TAG, "", m.group(1)))), text)
    text = sub(r"<code\b[^>]*>([^\n]*?)</code\s*>|`([^`\n]+)`", lambda m: keep(m.group(1) or m.group(2) or ""), text)
    text = sub(KINDS["math"], lambda m: keep(_formula(m.group())), text)
    text = sub(KINDS["dropped"], "", text)
    # wiki
    for _ in range(3):
        text = sub(r"\{\{[^{}]*\}\}", "", text)
    text = sub(r"^\{\|.*$|^\|\}[ \t]*\n?|^\|-+[ \t]*\n", "", text, re.M)
    text = sub(r"^!(.*!!.*)$", lambda m: _row(m.group(1).split("!!")), text, re.M)
    text = sub(r"^\|(.*\|\|.*)$", lambda m: _row(m.group(1).split("||")), text, re.M)
    for _ in range(3):
        text = sub(r"\[\[([^\[\]]*)\]\]", _wiki_link, text)
    text = sub(r"\[https?://\S+ ([^\]\n]+)\]", r"\1", text)
    text = sub(r"^={2,6}[ \t]*([^=\n].*?)[ \t]*={2,6}[ \t]*$", r"\n§ \1\n", text, re.M)
    text = sub(r"'{2,5}(?=\S)(.+?)(?<=\S)'{2,5}", r"\1", text, 0)
    text = sub(r"__[A-Z]+__", "", text)
    # HTML
    text = sub(r"<ref\b[^>]*/>|<ref\b[^>]*>.*?</ref\s*>", "", text)
    text = sub(r"<h[1-6]\b[^>]*>\s*(.*?)\s*</h[1-6]\s*>", lambda m: "\n§ " + re.sub(r"\s*\n\s*", " ", m.group(1)) + "\n", text)
    text = sub(r"<li\b[^>]*>\s*", "\n- ", text)
    text = sub(r"</t[dh]\s*>\s*(?=<t[dh]\b)", "\t", text)
    text = sub(r"<(?:br|hr)\b[^>]*>|</?(?:p|div|tr|table|ul|ol|li|dl|dd|dt|blockquote|section|article|thead|tbody|figure|figcaption|caption|h[1-6])(?:\s[^<>]*)?/?>", "\n", text)
    text = sub(rf"{_TAG}|{_ATTRIBUTES}|<!--|-->", "", text)
    # Markdown
    text = sub(r"!?\[([^\[\]\n]*)\]\([^()\s]+(?:\s+\"[^\"\n]*\")?\)", r"\1", text)
    text = sub(KINDS["heading"] + r"(.*?)[ \t]*#*$", r"\n§ \1\n", text, re.M)
    text = sub(KINDS["quote"], "", text, re.M)
    text = sub(KINDS["rule"] + r"\n?", "", text, re.M)
    text = sub(r"^[ \t]*\|(.*)\|[ \t]*$", lambda m: "\t".join(c.strip() for c in m.group(1).split("|")), text, re.M)
    text = sub(r"^[ \t]*[*+][ \t]+(?=\S)(?=.*\*)", "- ", text, re.M)
    for _ in range(2):
        text = sub(r"\*\*(?=\S)(.+?)(?<=\S)\*\*", r"\1", text, 0)
        text = sub(r"(?<!\w)__(?=\S)([^_\n]+)(?<=\S)__(?!\w)|~~(?=\S)([^~\n]+)(?<=\S)~~", lambda m: m.group(1) or m.group(2), text)
        text = sub(r"(?<![\w*])\*(?=[^\s*])([^*\n]*)(?<=[^\s*])\*(?![\w*])|(?<![\w/_.])_(?=[^\s_])([^_\n]+)(?<=[^\s_])_(?![\w/_.])", lambda m: m.group(1) or m.group(2), text)
    # LaTeX
    text = sub(r"\\(?:sub)*(?:section|chapter|paragraph)\*?\{([^{}]*)\}", r"\n§ \1\n", text)
    text = sub(r"~?\\(?:cite[a-z]*|label|footnotemark)(?:\[[^\]\n]*\])?\{[^{}]*\}|\\(?:begin|end)\{[^{}]*\}(?:\[[^\]\n]*\])?", "", text)
    text = sub(r"\\ref\{([^{}]*)\}", r"\1", text)
    text = sub(r"[ \t]*\\item(?![A-Za-z])[ \t]*", "\n- ", text)
    for _ in range(4):
        text = sub(r"\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{([^{}]*)\}", r"\1", text)
    text = sub(rf"\\(?:{'|'.join(COMMANDS)})(?![A-Za-z])|\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?(?=\{{)", "", text)
    text = sub(r"\\([%&#_])", r"\1", text)
    return text


def judged(text: str, weights: dict[str, float] = WEIGHTS) -> tuple[str, bool]:
    """The best region of a text in plain form, and whether the scan met markup; a text in which it met none stays as it is."""
    *_, met = scan(text, weights)
    if not met:
        return text, False
    text = unescaped(text)
    a, b = region(text, weights)
    return plain(text[a:b] if b > a else text), True


def cleaned(text: str, weights: dict[str, float] = WEIGHTS) -> str:
    return judged(text, weights)[0]


def learn(df: DataFrame, fields: tuple[str, ...], sample: int = SAMPLE) -> dict[str, float]:
    """Weights from at most ``sample`` texts that may hold markup."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for x in batch.column(0).to_pylist():
                total.update(labelled(x))
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.string()), pa.array([k[1] for k in total], pa.string()), pa.array(list(total.values()), pa.int64())], names=["label", "kind", "n"])

    texts = df.select(F.explode(F.array(*fields)).alias("text")).where(F.col("text").rlike(SUSPECT))
    # those with the smallest hashes, whatever the order of the files; only hashes meet in one task
    h = F.xxhash64("text")
    most = texts.select(h.alias("h")).distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    rows = texts.where(h <= F.lit(most)).mapInArrow(count, "label string, kind string, n long").groupBy("label", "kind").sum("n").collect()
    counts: Counter = Counter({(r[0], r[1]): r[2] for r in rows})
    return log_odds(counts) if any(k[0] == "markup" for k in counts) else WEIGHTS


def suspect(text: Column) -> Column:
    return F.coalesce(text.rlike(SUSPECT), F.lit(False))


def strip_markup(df: DataFrame, fields: tuple[str, ...] = ("content", "description"), key: str = "row_id", weights: dict[str, float] | None = None) -> DataFrame:
    """One row per non-null field (key, field, had_markup, clean); only texts with suspicious characters leave the JVM."""
    weights = weights or learn(df, fields)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            done = [judged(x, weights) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([d[1] for d in done], pa.bool_()), pa.array([d[0] for d in done], pa.string())], names=[key, "field", "had_markup", "clean"])

    long = df.select(key, F.inline(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("clean")) for f in fields)))).where("clean is not null")
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, field string, had_markup boolean, clean string"
    dirty = long.where(suspect(F.col("clean"))).mapInArrow(work, schema)
    return dirty.unionByName(long.where(~suspect(F.col("clean"))).withColumn("had_markup", F.lit(False)))


def found(df: DataFrame, fields: tuple[str, ...] = ("content", "description"), key: str = "row_id") -> DataFrame:
    return strip_markup(df, fields, key).where("had_markup").select(key, "field").distinct()
