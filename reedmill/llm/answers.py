"""Problem 4: question-answer pairs whose answers do not properly answer, with the type of the defect.

Method: the openings of all responses are clustered by the similarity of their sets of hashed shingles of five words,
0.8 and more, without MinHash bands: openings are so short that all such pairs are found exactly; a cluster that recurs behind unrelated prompts and speaks in the voice of an answerer that declines is a
refusal template; its shingles reveal the refusals among all answers that decline, and all answers that begin like it
are refusals if most of them decline.  What declines is told by lists of wordings (``DECLINES``).  Checks of copying, language and
termination label the rest; the language is told by how usual the three-letter runs of an answer are in the questions; what a complete ending is follows from counts of word pairs in all answers.

Defined results: a null or empty list of answers, and null answers in it, count as no answer; a null is_possible
counts as possible; a null question is not copied.  Records written again give one row.
"""

from __future__ import annotations

import functools
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reedmill.functions.session import cut_lineage
from reedmill.llm.codepoints import canonical

SHINGLE = 5
SIMILARITY = 0.8
#: Words of a response that count as its opening.
OPENING = 12
#: Different openings of prompts from which prompts count as unrelated.
UNRELATED = 2
#: Most shingles of an opening.  Up to these two sets are similar only if they are equal or one has one shingle more.
MOST = OPENING - SHINGLE + 1
assert (MOST - 1) / (MOST + 1) < SIMILARITY and (MOST - 2) / MOST < SIMILARITY

#: Who speaks (without accents).
SPEAKERS = "toi minh em chung toi tro ly mo hinh ngon ngu i we je ich yo eu ako saya aku ik ja".split()
#: What an answerer says that declines (without accents).
DECLINES = [
    "khong the tra loi", "khong the ho tro", "khong the giup", "khong the cung cap", "chua the ho tro", "chua the tra loi", "khong giup duoc", "khong co quyen", "khong co du du lieu", "khong du du lieu", "khong tim thay ngu canh",
    "khong nen dua ra", "khong duoc phep", "chua duoc cung cap", "khong duoc cung cap", "danh bo qua", "xin phep tu choi", "tu choi tra loi", "tu choi noi dung", "tu choi yeu cau", "ngoai pham vi", "khong co thong tin", "khong biet", "khong the dap ung",
    "cannot", "can t", "can not", "unable to", "not able to", "do not have", "don t have", "won t", "will not", "sorry", "decline", "ne peux pas", "ne suis pas", "ne sais pas", "desole", "kann nicht", "kann ich nicht", "leider", "no puedo", "lo siento", "nao posso", "maaf", "tidak bisa", "tidak dapat",
]
#: The same where words are not parted or the verb tells the speaker.
DECLINES_WITHIN = [
    *("답변할 수 없", "답변드릴 수 없", "답변해 드릴 수 없", "대답할 수 없", "도와드릴 수 없", "도와 드릴 수 없", "제공할 수 없습니다", "죄송하지만", "죄송합니다"),
    *("无法回答", "不能回答", "无法提供", "无法协助", "无法帮助", "不能帮助", "很抱歉", "對不起", "对不起", "無法回答", "無法提供", "無法協助", "お答えできません", "お答えすることはできません", "回答できません", "お手伝いできません", "提供できません", "申し訳ありません", "申し訳ございません"),
    *("не могу ответить", "не могу помочь", "не могу предоставить", "не могу обсуждать", "я не имею доступа", "у меня нет доступа", "у меня нет информации", "вынужден отказаться", "не можу відповісти", "не можу допомогти"),
    *("non posso rispondere", "non posso aiutar", "non posso fornire", "non sono in grado di", "mi dispiace, ma", "kan ik niet beantwoorden", "kan ik niet helpen", "nie mogę odpowiedzieć", "nie mogę pomóc", "bu soruyu yanıtlayamam", "yardımcı olamıyorum", "yardımcı olamam", "nemohu odpovědět"),
    *("ไม่สามารถตอบ", "ไม่สามารถช่วย", "ไม่สามารถให้ข้อมูล", "ขออภัย", "لا أستطيع الإجابة", "لا يمكنني الإجابة", "لا أستطيع مساعدتك", "لا يمكنني مساعدتك", "मैं इस प्रश्न का उत्तर नहीं दे सक", "मैं मदद नहीं कर सक"),
]
#: Refusals without a speaker, whole.
CURT = re.compile(r"(?:xin loi |rat tiec |da )?(?:khong the|chua the|tu choi|khong|khong duoc)(?: tra loi| ho tro| giup| phan hoi| cung cap| dap ung| binh luan)(?: duoc| cau hoi nay| yeu cau nay| noi dung nay| cau nay)?(?: a| nhe)?|(?:noi dung|yeu cau|cau hoi)(?: nay)?(?: da)? bi tu choi")
#: Words that may introduce a repeated question.
EXTRA = 3

#: Part of the answers of a class that must decline for all of them to count.
MOSTLY = 0.5
#: Parts over which the rows of a frequent word are spread.
SALTS = 8

#: First and last parts of Vietnamese syllables, without accents.
ONSETS = "ngh ng nh gh gi kh ph qu th tr ch b c d g h k l m n p r s t v x".split() + [""]
RIMES = [v + c for v in "oa oe uy ie ye uo ua ue uye oo a e i o u y".split() for c in ("", "ch", "nh", "ng", "c", "m", "n", "p", "t")] + "ai ao au ay eo eu ia ieu yeu iu oai oay oao oeo oi uai uay ui uoi uou uu uya uyu ya".split()
#: Buckets in which three-letter runs are counted, and the part of the way from the usual run of a question to one never
#: seen beyond which a text is in another language.
BUCKETS, ALIEN = 1 << 16, 0.45
#: Runs from which the language can be told.
LEAST_RUNS = 4
WORD = re.compile(r"\w+")
#: What stands behind the last word of a sentence or line.
STOPS = re.compile(r"[\"'”’»)\]]*[.!?。！？;](?!\.\.)[\"'”’»)\]]*(?:\s|$)|[\"'”’»)\]]*\s*\n")
LETTERS = re.compile(r"[^\W\d_]+")
STOP = ".!?。！？"
CLOSERS = "\"'”’»)]"
SIGN = {"“": "”", "(": ")", "[": "]", "«": "»"}


def fold(text: str) -> str:
    """A text without accents and case, with d for đ."""
    text = unicodedata.normalize("NFKD", text.casefold().replace("đ", "d"))
    return "".join(c for c in text if not unicodedata.combining(c))


@functools.lru_cache(1 << 16)
def plain_word(word: str) -> str:
    """A word without accents and case, its numbers as 0."""
    return re.sub(r"\d+", "0", fold(word))


@functools.lru_cache(1 << 16)
def cased_word(word: str) -> str:
    """A word without case, its numbers as 0."""
    return re.sub(r"\d+", "0", word.casefold())


WITHIN = re.compile("|".join(re.escape(fold(x)) for x in canonical(pa.array(DECLINES_WITHIN)).to_pylist()))


def copies(question: list[str], answer: list[str]) -> bool:
    """Whether an answer repeats the question, once or more, and adds at most a few words that introduce it."""
    if len(question) < 3 or len(answer) < len(question) - 2:
        return False
    q, a = " ".join(question), f" {' '.join(answer)} "
    if f" {q} " in a:
        return len(WORD.findall(a.replace(f" {q} ", "  ").replace(f" {q} ", " "))) <= EXTRA
    return len(answer) <= len(question) and len(answer) >= 0.85 * len(question) and a.strip() in q and len(question) >= 6


def runs(word: str) -> list[int]:
    """The buckets of a folded word's three-letter runs, its edges included."""
    word = f"^{word}$"
    return [zlib.crc32(word[i : i + 3].encode()) % BUCKETS for i in range(len(word) - 2)]


class Language:
    """How usual the three-letter runs of a text are in the questions, above a prior of all syllables that can be written."""

    def __init__(self, counts: np.ndarray) -> None:
        n = counts + np.bincount([x for a in ONSETS for b in RIMES for x in runs(a + b)], minlength=BUCKETS)
        whole = n.sum() + 0.5 * np.count_nonzero(n)
        self.log = np.log((n + 0.5) / whole)
        usual, unseen = (n * self.log).sum() / n.sum(), np.log(0.5 / whole)
        self.bound = usual + ALIEN * (unseen - usual)
        self.known: dict[str, tuple[float, int]] = {}

    def word(self, word: str) -> tuple[float, int]:
        got = self.known.get(word)
        if got is None:
            if len(self.known) > BUCKETS:
                self.known.clear()
            at = runs(word)
            got = self.known[word] = (float(self.log[at].sum()), len(at))
        return got

    def foreign(self, text: str) -> bool:
        """Whether a text is in another language, by its different words that are neither names nor numbers nor single letters."""
        words = {w for w in LETTERS.findall(text) if not w[0].isupper() and len(w) > 1}
        scores = [self.word(fold(w)) for w in words]
        n = sum(k for _, k in scores)
        return n >= LEAST_RUNS and sum(x for x, _ in scores) < self.bound * n


def language(pairs: DataFrame) -> Language:
    """Learnt from all questions: a table of fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        total = np.zeros(BUCKETS, np.int64)

        def add() -> None:
            for w, n in seen.items():
                np.add.at(total, runs(w), n)
            seen.clear()

        for batch in batches:
            for q in canonical(batch.column(0)).to_pylist():
                seen.update(fold(w) for w in LETTERS.findall(q))
            if len(seen) > BUCKETS:
                add()
        add()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["b", "n"])

    total = np.zeros(BUCKETS, np.int64)
    for b, n in pairs.where("question is not null").select("question").mapInArrow(count, "b long, n long").groupBy("b").agg(F.sum("n")).collect():  # at most BUCKETS rows
        total[b] = n
    return Language(total)


def ending(text: str) -> str:
    """``stop`` after a full stop, ``open`` after a word, ``cut`` where a text visibly breaks off."""
    text = text.strip().strip("​﻿⁠")
    if text[:1] in SIGN and text.endswith(SIGN[text[0]]) and text.count(text[0]) == 1:
        text = text[1:-1].rstrip()
    bare = text.rstrip(CLOSERS)
    if re.search(r"(?:…|\.\.\.)$", bare):
        return "dots"
    if bare.endswith(tuple(STOP)):
        return "stop"
    if not text[-1:].isalnum() and not text.endswith(("%", "+", ")", "]", "”", "»", '"', "°", "'", "’")):
        return "cut"
    if any(text.count(a) > text.count(b) for a, b in SIGN.items()):
        return "cut"
    return "open"


def proper(words: list[str]) -> bool:
    """Names, dates and numbers alone."""
    return 0 < len(words) <= 6 and all(w[0].isupper() or w[0].isdigit() for w in words) and (len(words) > 1 or words[0].isdigit())


ANSWERS = "id string, n int, prompt string, words array<string>, copy boolean, foreign boolean, ending string, proper boolean, curt boolean, voice boolean, stops array<boolean>, exact array<string>"


def features(pairs: DataFrame, spoken_in: Language) -> DataFrame:
    """One row per answer with a letter or digit, of pairs that are not marked as impossible."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ns = batch.column(0), batch.column(1)
            questions, answers = (canonical(batch.column(i)).to_pylist() for i in (2, 3))
            cols: list[list] = [[] for _ in range(10)]
            for q, a in zip(questions, answers, strict=True):
                matches = list(WORD.finditer(a))
                raw, folded = [m.group() for m in matches], fold(a)
                qw, aw = WORD.findall(fold(q or "")), [plain_word(w) for w in raw]
                aw_full = WORD.findall(folded)
                joined = f" {' '.join(aw)} "
                spoken = any(f" {s} " in joined for s in SPEAKERS) and any(f" {d} " in joined for d in DECLINES) or WITHIN.search(folded) is not None
                stops = [STOPS.match(a, m.end()) is not None for m in matches]
                row = (" ".join(qw[:2]), aw, copies(qw, aw_full), spoken_in.foreign(a), ending(a), proper(raw), CURT.fullmatch(joined.strip()) is not None, spoken, stops, [cased_word(w) for w in raw])
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            kinds = (pa.string(), pa.list_(pa.string()), pa.bool_(), pa.bool_(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_(), pa.list_(pa.bool_()), pa.list_(pa.string()))
            arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
            names = ["id", "n", "prompt", "words", "copy", "foreign", "ending", "proper", "curt", "voice", "stops", "exact"]
            yield pa.RecordBatch.from_arrays([ids, ns, *arrays], names=names)

    exploded = pairs.where("is_possible is null or is_possible").select("id", F.posexplode("answers").alias("n", "answer"), "question")
    exploded = exploded.where(F.col("answer").rlike(r"[\p{L}\p{N}]")).select("id", "n", "question", "answer").distinct()
    return exploded.mapInArrow(work, ANSWERS)


def shingles(column: str = "words") -> F.Column:
    """Hashes of all windows of five words; a shorter text is one window."""
    n = F.size(column)
    return F.array_distinct(F.when(n <= SHINGLE, F.array(F.xxhash64(F.array_join(column, " ")))).otherwise(F.transform(F.sequence(F.lit(1), n - SHINGLE + 1), lambda i: F.xxhash64(F.array_join(F.slice(column, i, SHINGLE), " ")))))


def connected(edges: DataFrame) -> DataFrame:
    """(s, root): of each node of some edges (a, b) the smallest node it is connected with."""
    both = cut_lineage(edges.union(edges.select("b", "a")))
    label = both.groupBy(F.col("a").alias("s")).agg(F.min("b").alias("root")).select("s", F.least("s", "root").alias("root"))
    while True:
        near = both.join(label.select(F.col("s").alias("b"), "root"), "b").groupBy(F.col("a").alias("s")).agg(F.min("root").alias("near"))
        step = label.join(near, "s").select("s", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = step.select(F.col("s").alias("root"), F.col("root").alias("next"))
        label = cut_lineage(step.join(jump, "root").select("s", "old", F.least("root", "next").alias("root")))
        if label.where("root <> old").isEmpty():
            return label.select("s", "root")
        label = label.select("s", "root")


def opening_clusters(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per distinct opening: its shingles and the class it belongs to (every opening has one); and the openings with the prompts behind them."""
    opening = F.slice("words", 1, OPENING)
    named = answers.where("not copy").select(opening.alias("words"), "prompt", "voice", "curt")
    # counted per prompt first: what an opening is said to is never gathered, its prompts stay rows
    by_prompt = cut_lineage(named.groupBy("words", "prompt").agg(F.max("voice").alias("voice"), F.max("curt").alias("curt"), F.count("*").alias("said"), F.count_if(F.col("voice") | F.col("curt")).alias("declined")))
    distinct = by_prompt.groupBy("words").agg(F.max("voice").alias("voice"), F.max("curt").alias("curt"), F.sum("said").alias("said"), F.sum("declined").alias("declined"))
    # of the openings only fingerprints move on
    distinct = cut_lineage(distinct.select(F.xxhash64("words").alias("o"), "voice", "curt", "said", "declined", F.array_sort(shingles()).alias("sh")).withColumn("s", F.xxhash64("sh")))
    sets = distinct.select("s", "sh").dropDuplicates(["s"])
    n = F.size("sh")
    # each set meets those that it has when one shingle is left out: as many rows as shingles, however often a set recurs
    less = sets.where(n - 1 >= SIMILARITY * n).select(F.explode(F.transform("sh", lambda x: F.xxhash64(F.filter("sh", lambda y: y != x)))).alias("a"), F.col("s").alias("b"))
    roots = connected(less.join(sets.select(F.col("s").alias("a")), "a"))
    return distinct.join(roots, "s", "left").withColumn("root", F.coalesce("root", "s")), by_prompt.select(F.xxhash64("words").alias("o"), "prompt")


def revealed(clusters: DataFrame, prompts: DataFrame) -> DataFrame:
    """Of the classes that recur behind unrelated prompts and in which an answerer declines: the openings, and whether most answers of the class decline."""
    voices = clusters.groupBy("root").agg(F.sum("said").alias("all_said"), F.sum("declined").alias("all_declined")).where("all_declined > 0")
    spread = prompts.join(clusters.join(voices, "root", "left_semi").select("o", "root"), "o").groupBy("root").agg(F.countDistinct("prompt").alias("spread"))
    reveal = spread.where(F.col("spread") >= UNRELATED).join(voices, "root")
    return clusters.join(reveal.select("root", (F.col("all_declined") >= MOSTLY * F.col("all_said")).alias("mostly")), "root")


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """A left join with a table of one row per key, which is repeated ``SALTS`` times: frequent words are hot keys of the rows."""
    salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("id", "n"), F.lit(SALTS)).cast("int")).join(salted, [*keys, "salt"], "left").drop("salt")


def final_counts(answers: DataFrame) -> DataFrame:
    """Of each pair of adjacent words in all answers: how often it ends a sentence, an answer without full stop, or neither."""
    n = F.size("exact")
    pair = lambda i: F.struct(F.get("exact", i).alias("w1"), F.get("exact", i + 1).alias("w2"), F.get("stops", i + 1).alias("t"), (i + 2 == n).alias("f"))
    pairs = answers.where((n >= 2) & ~F.col("copy")).select(F.inline_outer(F.transform(F.sequence(F.lit(0), n - 2), pair))).where("w1 is not null")
    return pairs.groupBy("w1", "w2").agg(F.sum(F.col("t").cast("long")).alias("stopped"), F.sum((F.col("f") & ~F.col("t")).cast("long")).alias("final"), F.sum((~F.col("f") & ~F.col("t")).cast("long")).alias("inside"))


def defects(pairs: DataFrame) -> DataFrame:
    """(id, defect), one row per defective id and defect."""
    pairs = pairs.select("id", "question", F.coalesce("answers", F.array().cast("array<string>")).alias("answers"), "is_possible")
    said = F.exists("answers", lambda x: F.coalesce(x.rlike(r"[\p{L}\p{N}]"), F.lit(False)))
    plain = pairs.select("id", F.when(~F.coalesce("is_possible", F.lit(True)) & said, "flag_mismatch").when(F.coalesce("is_possible", F.lit(True)) & ~said, "empty_answer").alias("defect")).where("defect is not null")

    answers = cut_lineage(features(pairs, language(pairs)))
    clusters, prompts = opening_clusters(answers)
    stock = cut_lineage(revealed(cut_lineage(clusters), prompts))
    lexicon = stock.where("voice or curt").select(F.explode("sh").alias("sh")).distinct()
    own = answers.where("not copy").select("id", "n", F.explode_outer(shingles()).alias("sh"), "voice", "curt").where("sh is not null")  # outer: an inner one makes the shingles twice
    spoken = own.where("voice or curt").join(lexicon, "sh", "left_semi").select("id", "n")
    begun = answers.where("not copy").select("id", "n", F.xxhash64(F.slice("words", 1, OPENING)).alias("o")).join(stock.where("mostly").select("o"), "o", "left_semi").select("id", "n")
    refused = spoken.union(begun).distinct().withColumn("refusal", F.lit(True))
    at = lambda i: F.try_element_at("exact", F.lit(i))
    counts = final_counts(answers)
    first = counts.groupBy("w1").agg(F.sum(F.col("stopped") + F.col("final") + F.col("inside")).alias("first"))
    second = counts.groupBy("w2").agg(F.sum("inside").alias("w2_inside"), F.sum("stopped").alias("w2_stopped"), F.sum("final").alias("w2_final"))
    again = answers.where("ending = 'open'").groupBy(F.xxhash64("exact").alias("whole")).agg(F.count("*").alias("again"))
    # no list of words goes through the joins
    short = answers.select("id", "n", "copy", "foreign", "ending", "proper", F.size("words").alias("size"), at(-2).alias("w1"), at(-1).alias("w2"), F.xxhash64("exact").alias("whole"))
    judged = short.join(refused, ["id", "n"], "left")
    for table, keys in ((counts, ["w1", "w2"]), (first, ["w1"]), (second, ["w2"]), (again, ["whole"])):
        judged = spread_join(judged, table, keys)
    judged = judged.fillna(0, ["stopped", "final", "inside", "first", "w2_inside", "w2_stopped", "w2_final", "again"])
    every = F.col("stopped") + F.col("final") + F.col("inside")
    ends_sentences = (F.col("stopped") >= 1) & (F.col("stopped") >= 0.01 * every)
    ends_answers = (F.col("inside") >= 1) & (F.col("final") >= 2) & ((F.col("final") >= 0.05 * every) | (F.col("again") >= 3))
    only_final = (F.col("inside") == 0) & (F.col("final") >= 3) & (F.col("final") >= 0.01 * F.col("first")) & (F.col("w2_inside") <= F.col("w2_final") + F.col("w2_stopped"))
    usual = ends_sentences | ends_answers | only_final
    broken = (F.col("ending") == "cut") | F.col("ending").isin("open", "dots") & ~F.col("proper") & ~(F.col("size") < 2) & ~usual
    defect = F.when(F.coalesce("refusal", F.lit(False)), "refusal").when(F.col("copy"), "copies_question").when(F.col("foreign"), "other_language").when(broken, "truncated_answer")
    return plain.union(judged.select("id", defect.alias("defect")).where("defect is not null")).distinct()
