"""Generation, repair, validation and export of question-answer records."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reedmill.functions import text as T

#: Types of questions on one article and on several.
SINGLE_TYPES = ("factoid", "event_summary", "cause_effect", "entity_role", "comparison", "claim_verification", "unanswerable")
CROSS_TYPES = ("multi_doc_comparison", "timeline")
#: What a prompt says about each type.
ABOUT = {
    "factoid": "một dữ kiện: ai, việc gì, lúc nào, nơi nào, bao nhiêu", "event_summary": "tóm lại việc chính", "cause_effect": "vì sao, hoặc dẫn đến điều gì", "entity_role": "một người hay tổ chức giữ vai trò gì", "comparison": "hai đối tượng trong bài khác nhau ra sao",
    "claim_verification": "một nhận định đúng hay sai theo bài", "unanswerable": "điều mà bài không cho biết", "multi_doc_comparison": "các bài giống hay khác nhau ở đâu", "timeline": "thứ tự thời gian qua các bài",
}
HARD_TYPES = ("unanswerable", "claim_verification")
ITEM = "array<struct<question: string, qa_type: string, answers: array<string>, is_possible: boolean, plausible_answers: array<string>>>"
NO_TEXTS = "array<string>"


def repaired(items: Column) -> Column:
    """Items of one article with valid types and flags, the last one made unanswerable if five or more have no hard type."""
    none = F.array().cast(NO_TEXTS)

    def unanswerable(x: Column, force: Column) -> Column:
        answers, plausible = F.coalesce(x["answers"], none), F.coalesce(x["plausible_answers"], none)
        moved = F.slice(F.when(F.size(plausible) > 0, plausible).otherwise(answers), 1, 2)
        return F.struct(x["question"].alias("question"), F.lit("unanswerable").alias("qa_type"), none.alias("answers"), F.lit(False).alias("is_possible"), F.when(force | (F.size(answers) > 0), moved).otherwise(x["plausible_answers"]).alias("plausible_answers"))

    def one(x: Column) -> Column:
        kind = F.lower(T.strip(F.coalesce(x["qa_type"], F.lit(""))))
        kind = F.when(kind.isin(*SINGLE_TYPES), kind).when(x["is_possible"].eqNullSafe(F.lit(False)), "unanswerable").otherwise("factoid")
        fine = F.struct(x["question"].alias("question"), kind.alias("qa_type"), x["answers"].alias("answers"), F.lit(True).alias("is_possible"), x["plausible_answers"].alias("plausible_answers"))
        return F.when(kind == "unanswerable", unanswerable(x, F.lit(False))).otherwise(fine)

    fixed = F.transform(items, one)
    hard = F.exists(fixed, lambda x: x["qa_type"].isin(*HARD_TYPES))
    last = F.transform(F.slice(fixed, -1, 1), lambda x: unanswerable(x, F.lit(True)))
    return F.when((F.size(fixed) >= 5) & ~hard, F.concat(F.slice(fixed, 1, F.greatest(F.size(fixed) - 1, F.lit(0))), last)).otherwise(fixed)


def repair(groups: DataFrame, key: str = "article_id", items: str = "items") -> DataFrame:
    """One row per repaired item with its id."""
    rows = groups.select(F.col(key).alias("_k"), F.posexplode(repaired(F.col(items))).alias("_i", "q"))
    return rows.select(T.qa_id(F.col("_k"), F.col("_i")).alias("id"), F.col("_k").alias(key), "q.*")


def repair_cross(groups: DataFrame, group: str = "group_id", ids: str = "article_ids", items: str = "items") -> DataFrame:
    """Items on several articles: an unknown type is a comparison, missing source ids are those of the group."""
    rows = groups.select(F.col(group).alias("_g"), F.col(ids).alias("article_id"), F.posexplode(items).alias("_i", "q"))
    kind = F.when(F.col("q.qa_type").isin(*CROSS_TYPES), F.col("q.qa_type")).otherwise(CROSS_TYPES[0])
    return rows.select(
        T.cross_qa_id(F.col("_g"), F.col("_i")).alias("id"), "article_id", F.coalesce("q.question", F.lit("")).alias("question"), kind.alias("qa_type"), F.coalesce("q.answers", F.array().cast(NO_TEXTS)).alias("answers"),
        F.coalesce("q.is_possible", F.lit(True)).alias("is_possible"), F.coalesce("q.plausible_answers", F.array().cast(NO_TEXTS)).alias("plausible_answers"), F.col("article_id").alias("source_article_ids"),
    )


def references(qa: DataFrame) -> DataFrame:
    """One row (id, article_id) per referenced article."""
    return qa.select("id", F.explode(T.id_list(F.col("article_id"))).alias("article_id"))


def missing_references(qa: DataFrame, corpus: DataFrame) -> DataFrame:
    """References to articles that the corpus does not have, repeated ones kept."""
    known = corpus.select(F.col("article_id").try_cast("bigint").alias("article_id")).distinct()
    return references(qa).join(known, "article_id", "left_anti").select("id", "article_id")


def references_by_split(qa: DataFrame, corpus: DataFrame) -> DataFrame:
    """Distinct referenced articles in each split; an article in two splits counts in both."""
    asked = references(qa).select("article_id").distinct()
    held = corpus.select("split", F.col("article_id").try_cast("bigint").alias("article_id")).distinct()
    return held.join(asked, "article_id", "left_semi").groupBy("split").agg(F.count("*").alias("articles"))


def type_counts(qa: DataFrame) -> DataFrame:
    """Records per type; a null or empty one counts as single-article."""
    return qa.groupBy(F.coalesce(F.nullif("qa_type", F.lit("")), F.lit("single-article")).alias("qa_type")).agg(F.count("*").alias("n"))


def validation(qa: DataFrame) -> DataFrame:
    """Counts of records, of both flags (a null is neither), and of answers that contradict the flag."""
    n = F.coalesce(F.size("answers"), F.lit(0))
    share = lambda c: F.count_if(c) * 100.0 / F.nullif(F.count("*"), F.lit(0))
    yes, no = F.coalesce("is_possible", F.lit(False)), F.coalesce(~F.col("is_possible"), F.lit(False))
    return qa.agg(
        F.count("*").alias("total"), F.count_if(yes).alias("possible"), F.count_if(no).alias("impossible"), share(yes).alias("possible_pct"), share(no).alias("impossible_pct"),
        F.count_if(yes & (n <= 0)).alias("possible_without_answer"), F.count_if(no & (n > 0)).alias("impossible_with_answer"),
    )


def unprocessed(articles: DataFrame, done: DataFrame) -> DataFrame:
    """Articles to which no record of an earlier run refers, cross-article records included."""
    ids = references(done).select(F.col("article_id").cast("string").alias("article_id")).distinct()
    return articles.join(ids, "article_id", "left_anti")


def flat(qa: DataFrame) -> DataFrame:
    """Eight text columns for export, lists joined by semicolons."""
    ids = F.concat_ws("; ", F.transform(T.id_list(F.col("article_id")), lambda x: x.cast("string")))
    sources = F.concat_ws("; ", F.transform("source_article_ids", lambda x: x.cast("string")))
    flag = F.when(F.col("is_possible"), "True").when(~F.col("is_possible"), "False").otherwise("")
    return qa.select("id", ids.alias("article_id"), F.coalesce("question", F.lit("")).alias("question"), F.coalesce("qa_type", F.lit("")).alias("qa_type"), F.concat_ws("; ", "answers").alias("answers"), flag.alias("is_possible"), F.concat_ws("; ", "plausible_answers").alias("plausible_answers"), sources.alias("source_article_ids"))


def kinds(names: tuple[str, ...]) -> str:
    """The types of questions as the lines of a prompt that name them."""
    return "\n".join(f"- {n}: {ABOUT[n]}" for n in names)


def prompts(articles: DataFrame, size: int = 3000) -> DataFrame:
    """One prompt per article: its title and the beginning of its content."""
    return articles.select("article_id", T.prompt(F.col("title"), F.col("content"), size).alias("prompt"))


def cross_prompts(groups: DataFrame, articles: DataFrame, size: int = 2000) -> DataFrame:
    """One prompt per group (group_id, article_ids): its articles one after the other, each cut to the size."""
    rows = groups.select("group_id", F.posexplode("article_ids").alias("at", "article_id")).join(articles.dropDuplicates(["article_id"]), "article_id")
    one = F.concat(F.lit("--- "), F.col("article_id").cast("string"), F.lit(" ---\n"), T.prompt(F.col("title"), F.col("content"), size))
    # a group is a handful of articles
    return rows.groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("at", one.alias("text")))).alias("parts")).select(F.col("group_id").cast("string").alias("article_id"), F.concat_ws("\n", F.transform("parts", lambda x: x["text"])).alias("prompt"))


def generate_all(articles: DataFrame, done: DataFrame, groups: DataFrame, reply: Callable[[str], str | None], wait: float = 60.0) -> tuple[DataFrame, DataFrame]:
    """Both phases, independent of each other: repaired items of the articles without any yet, and of the groups of articles."""
    single = repair(generate(prompts(unprocessed(articles, done)), reply, wait=wait, about=kinds(SINGLE_TYPES)))
    items = generate(cross_prompts(groups, articles), reply, wait=wait, about=kinds(CROSS_TYPES)).withColumnRenamed("article_id", "group_id")
    return single, repair_cross(items.join(groups.select(F.col("group_id").cast("string").alias("group_id"), "article_ids"), "group_id"))


def generate(prompted: DataFrame, reply: Callable[[str], str | None], retries: int = 1, wait: float = 0.0, about: str = "") -> DataFrame:
    """Replies of a provider per article; after a failure it waits before it tries again.  A call that fails again is left out, as is a reply that is no JSON.

    about is said behind each prompt, such as the types of questions to ask.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for p in batch.column(1).to_pylist():
                answer = None
                for attempt in range(retries + 1):
                    try:
                        answer = reply(f"{p}\n{about}" if about else p)
                        break
                    except Exception:  # noqa: BLE001  a provider may fail in any way
                        if attempt < retries:
                            time.sleep(wait)
                out.append(answer)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["article_id", "reply"])

    replies = prompted.select("article_id", "prompt").mapInArrow(work, "article_id string, reply string")
    return replies.select("article_id", T.fenced_json(F.col("reply"), ITEM).alias("items")).where("items is not null")


def echo_provider(prompt: str) -> str:
    """A deterministic stand-in for a model: one question on the title line."""
    import json

    title = prompt.split("\n", 1)[0].removeprefix("Tiêu đề: ")
    return "```json\n" + json.dumps([{"question": f"{title}?", "qa_type": "factoid", "answers": [title], "is_possible": True, "plausible_answers": []}], ensure_ascii=False) + "\n```"
