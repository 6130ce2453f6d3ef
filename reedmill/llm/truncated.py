"""Problem 10: documents whose text was cut off before its end, and the rate of cut texts per source.

Method, in SQL only: word trigrams are counted inside all texts, with how often a line or text ends openly behind them
(without a full stop), and joined with the final trigrams of the texts that do not end with a full stop.  The counts
decide:

* a final trigram that is frequent inside and (almost) never terminal tells of a cut, one that is sometimes terminal
  (by-lines, credits, sign-offs, headings, list entries) of an end,
* a final trigram that is not frequent inside, behind a trigram (one word earlier) that is, has an unusual last word: a
  word cut off, unless a good part of what follows the earlier trigram are such ends,
* where both are rare, the final two words or at last the final word are asked in the same way as the trigram, and a
  final word that hardly stands inside any text tells of a word cut off.

Ends are counted apart for lines that hold a full stop before and for lines that hold none (headings, credits, list
entries), and a final trigram is held against the ends of lines like its own.  Ends of other texts count as terminal
once per different text before them, as a text delivered twice and cut at one place is no evidence of an end.  A final point behind a number may be the point of a cut date or amount: it is an end
unless its trigram is frequent inside and almost never ends a sentence.  Marks put behind a cut (an ellipsis with
"read more" and the like, a broken tag or entity, replacement characters) are taken off before counting and tell of a
cut by themselves.  An end of which no count tells anything is no case.  A null or blank text is not cut.  Texts
delivered twice count each time.

Words are hashed to 21 bits, a trigram is one number from which those of its last two and last words follow; only these
numbers are shuffled, after partial aggregation.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reedmill.functions.session import cut_lineage

#: What may stand behind a cut: replacement characters, a broken tag or entity, or an ellipsis with a few words in brackets or not.
TAIL = r"(?U)(?:(?<!�)�++|</?[a-z]{0,12}|&#?[a-z0-9]{0,7}|(?<!\s)\s*+[\[(]\s*+(?:…|\.\.\.)\s*+[\])]|(?<![….])(?:…|\.\.\.)\s*+(?:[\[(«]?\s*+\p{L}[\p{L} ]{1,24}[\])»]?)?)\s*+$"
#: Blanks and invisible characters, which go from the end.
BLANKS = "".join(c for c in map(chr, range(0x20000)) if c.isspace() and not "\x1c" <= c <= "\x1f" or unicodedata.category(c) == "Cf")
#: Without a run of LONG blanks or replacement characters in the last SUFFIX characters, all that may stand behind a cut is among them.
SUFFIX, LONG = 160, 35
COMPLETE = r"[.!?。！？]+[\"'”’»)\]]*$"
#: A final number with a point may be a cut date or amount.
NUMBER = r"\d[.]$"
SENTENCE_END = r"[.!?…]+[\"”’»)\]]*(?=\s|$)"
#: Words that stand for the end of a sentence, of a line, of a line that ends openly behind a full stop within it, and of the text.
STOP, LINE, PROSE, TEXT = "\u0003", "\u0004", "\u0005", "\u0006"
SEPARATOR = f"[^\\p{{L}}\\p{{M}}\\p{{N}}{STOP}{LINE}{PROSE}{TEXT}]+"
OPEN_PROSE = f"{STOP}(\\h*+[^{STOP}\n]++)\n"
#: Bits of a word's hash.
BITS = 21
#: Occurrences from which words count as frequent.
FREQUENT = 5
#: Part of the occurrences of frequent words that end openly, from which they count as terminal; one or two words count
#: as frequent from as many occurrences as that part can be told of.
TERMINAL = 0.005
OFTEN = 200
#: The same for sentences that end behind a number.
NUMBERED = 0.04
#: Part of what follows the earlier trigram, from which a rare end counts as terminal.
SHARED = 0.2
#: The words before the final ones by which two ends count as different.
BEFORE = (30, 12)


def words(text: Column) -> Column:
    """The words of a text, digits as 0; ends of sentences, lines and the text are words of their own."""
    digits = F.translate(text, "123456789", "000000000")
    stops = F.regexp_replace(F.regexp_replace(digits, SENTENCE_END, f" {STOP} "), OPEN_PROSE, f"{STOP}$1 {PROSE} ")
    return F.split(F.concat(F.lit(f"{LINE} {LINE} {LINE} "), F.replace(stops, F.lit("\n"), F.lit(f" {LINE} ")), F.lit(f" {TEXT}")), SEPARATOR)


def hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w).bitwiseAND((1 << BITS) - 1))


def held(value: Column) -> Column:
    """A value that is computed once, however often it is used (the optimiser copies plain expressions)."""
    return F.explode(F.array(value))


def plainly_complete(text: Column) -> Column:
    """Whether a text ends with a single full stop that is not behind a digit: told from three characters."""
    last = F.substring(text, -3, 3)
    return last.rlike(r"[^.!?\d][.!?]$") & ~last.startswith("..")


def bodies(documents: DataFrame, key: str) -> DataFrame:
    """Per document with a text: the text without blanks at its end, and without what stands behind a cut."""
    trimmed = lambda c: F.rtrim(c, F.lit(BLANKS))
    d = documents.select(F.col(key).alias("doc"), trimmed(F.col("text")).alias("whole")).where("whole <> ''")
    last = F.substring("whole", -SUFFIX, SUFFIX)
    size = F.when(last.rlike(rf"(?U)[\s�]{{{LONG}}}"), 0).otherwise(F.greatest(F.length("whole") - SUFFIX, F.lit(0)))
    d = d.withColumn("n", size)
    shorter = F.concat(F.substring("whole", F.lit(1), F.col("n")), F.regexp_replace(F.substring("whole", F.col("n") + 1, F.length("whole")), TAIL, ""))
    return d.select("doc", held(F.struct("whole", trimmed(shorter).alias("body"))).alias("x")).select("doc", "x.*")


def code(word: str) -> Column:
    return F.xxhash64(F.lit(word)).bitwiseAND((1 << BITS) - 1)


def trigram_counts(documents: DataFrame, key: str) -> DataFrame:
    """Of each trigram that stands inside texts (as a number): how often, and how often a sentence or an open line of either kind ends behind it."""
    done = plainly_complete(F.col("text"))
    texts = documents.where(done).select("text").unionByName(bodies(documents.where(~done), key).select(F.col("body").alias("text")))
    w = texts.select(held(hashes(words(F.col("text")))).alias("h"))  # at least four, with those that stand for ends
    cut = lambda i: F.slice("h", i, F.size("h") - 4)
    # outer, as an inner one makes the optimiser filter by the zipped list, which would be made once more
    rows = w.select(F.inline_outer(F.arrays_zip(cut(1).alias("a"), cut(2).alias("b"), cut(3).alias("c"), cut(4).alias("d")))).where("a is not null")
    gram = F.shiftleft(F.col("a"), 2 * BITS).bitwiseOR(F.shiftleft(F.col("b"), BITS)).bitwiseOR(F.col("c"))
    ends = lambda k: F.sum((F.col("d") == code(k)).cast("long"))
    return rows.groupBy(gram.alias("gram")).agg(F.count("*").alias("inside"), ends(STOP).alias("stops"), ends(LINE).alias("lines"), ends(PROSE).alias("prose"))


def open_ends(documents: DataFrame, key: str) -> DataFrame:
    """The documents that do not end with a full stop, or behind a number, with their last words as numbers."""
    d = bodies(documents.where(~plainly_complete(F.col("text"))), key).where("body <> ''")
    ellipsis = F.col("whole").rlike(r"(…|\.\.\.)$") & F.col("body").rlike(r"(?U)[\p{L}\p{N}]$")
    d = d.withColumns({"marked": (F.col("body") != F.col("whole")) & ~ellipsis, "number": F.col("body").rlike(NUMBER)})
    d = d.where(F.col("marked") | F.col("number") | ~F.col("body").rlike(COMPLETE)).select("doc", "marked", "number", held(words(F.col("body"))).alias("words"))
    ended = F.try_element_at("words", F.lit(-2)) == STOP  # a final stop is not among the last words
    d = d.withColumn("words", F.slice("words", 1, F.size("words") - F.when(ended, 2).otherwise(1)))
    n = F.size("words")
    start = F.greatest(n - BEFORE[0], F.lit(1))
    line = F.element_at(F.split(F.array_join("words", " "), f"[{LINE}{PROSE}]"), -1)
    d = d.withColumns({"last": hashes(F.slice("words", n - 3, 4)), "before": F.xxhash64(F.slice("words", start, F.greatest(n - BEFORE[1] - start, F.lit(0)))), "in_prose": line.contains(STOP)})
    at = lambda i: F.get("last", F.lit(i))
    gram = lambda i: F.shiftleft(at(i), 2 * BITS).bitwiseOR(F.shiftleft(at(i + 1), BITS)).bitwiseOR(at(i + 2))
    starts = F.greatest(*((at(i) == code(k)).cast("int") for i in range(3) for k in (LINE, PROSE))) == 1
    alone = at(2).isin(code(LINE), code(PROSE))
    return d.select("doc", "marked", "number", "in_prose", starts.alias("line_starts"), alone.alias("alone"), gram(1).alias("gram"), gram(0).alias("earlier"), "before")


def judged(documents: DataFrame, key: str) -> DataFrame:
    """The open ends with the counts of their words, and whether these tell of a cut."""
    last = cut_lineage(open_ends(documents, key))
    counts = cut_lineage(trigram_counts(documents, key))
    # how often other texts end with the words in a line of the kind, once per different text before them
    tails = last.where("not marked and not number").groupBy("gram", "in_prose").agg(F.countDistinct("before").alias("texts"))
    own = F.when(F.col("marked") | F.col("number"), 0).otherwise(1)
    rows = last.join(tails, ["gram", "in_prose"], "left").join(counts, "gram", "left").join(counts.select(F.col("gram").alias("earlier"), F.col("inside").alias("around")), "earlier", "left")
    rows = rows.fillna(0, ["texts", "inside", "stops", "lines", "prose", "around"]).withColumn("tails", F.col("texts") - own)
    rows = cut_lineage(rows.withColumn("ends", F.when(F.col("in_prose"), F.col("prose")).otherwise(F.col("lines")) + F.col("tails")))
    two, one = F.col("gram").bitwiseAND((1 << 2 * BITS) - 1), F.col("gram").bitwiseAND((1 << BITS) - 1)
    sums = [F.sum(c).alias(c) for c in ("inside", "lines", "prose")]
    pairs = counts.groupBy(two.alias("two")).agg(*sums)
    singles = pairs.groupBy(F.col("two").bitwiseAND((1 << BITS) - 1).alias("one")).agg(*sums)
    asked = rows.where(~F.col("marked") & ~F.col("number") & (F.col("inside") < FREQUENT) & ((F.col("around") < FREQUENT) | F.col("alone"))).select("doc", "in_prose", two.alias("two"), one.alias("one"))
    of = lambda t, k: t.select(k, F.col("inside").alias(f"inside_{k}"), F.col("lines").alias(f"lines_{k}"), F.col("prose").alias(f"prose_{k}"))
    backed = asked.join(of(pairs, "two"), "two", "left").join(of(singles, "one"), "one", "left")
    backed = backed.dropDuplicates(["doc"]).select("doc", *(x for k in ("two", "one") for x in (f"inside_{k}", F.when(F.col("in_prose"), F.col(f"prose_{k}")).otherwise(F.col(f"lines_{k}")).alias(f"ends_{k}"))))
    rows = rows.join(backed, "doc", "left").fillna(0, ["inside_two", "ends_two", "inside_one", "ends_one"])
    flag = (
        F.when(F.col("marked"), True)
        .when(F.col("number"), (F.col("inside") >= FREQUENT) & (F.col("stops") < NUMBERED * F.col("inside")))
        .when(F.col("inside") >= FREQUENT, F.col("ends") < TERMINAL * (F.col("inside") + F.col("tails")))
        .when((F.col("around") >= FREQUENT) & ~F.col("alone"), F.col("ends") < SHARED * F.col("around"))
        .when(F.col("inside") + F.col("tails") >= FREQUENT, F.col("ends") < TERMINAL * (F.col("inside") + F.col("tails")))
        .when(F.col("inside_two") >= OFTEN, F.col("ends_two") < TERMINAL * F.col("inside_two"))
        .when(F.col("inside_one") >= OFTEN, F.col("ends_one") < TERMINAL * F.col("inside_one"))
        .otherwise((F.col("inside_one") < FREQUENT) & ~F.col("line_starts"))
    )
    return rows.withColumn("cut", flag)


def cut_off(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """Keys of the documents that were cut off, with the counts that tell so."""
    return judged(documents, key).where("cut").select(F.col("doc").alias(key), "marked", "inside", "ends", "around")


def rates(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per source: documents, cut documents and the rate.  A null source is a source of its own."""
    cut = cut_off(documents, key).select(key).withColumn("cut", F.lit(1))
    return documents.select(key, "source").join(cut, key, "left").groupBy("source").agg(F.count("*").alias("documents"), F.count("cut").alias("cut"), (F.count("cut") / F.count("*")).alias("rate"))
