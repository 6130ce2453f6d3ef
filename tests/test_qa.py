from reedmill.operators import qa

SCHEMA = f"article_id string, items {qa.ITEM}"


def run(spark, items):
    return [r.asDict() for r in qa.repair(spark.createDataFrame([("7", items)], SCHEMA)).orderBy("id").collect()]


def item(kind, answers, flag, plausible=None):
    return ("q", kind, answers, flag, plausible)


def test_repair(spark):
    five = run(spark, [item("factoid", ["a", "b", "c"], True)] * 5)
    assert [r["qa_type"] for r in five] == ["factoid"] * 4 + ["unanswerable"] and five[-1]["answers"] == [] and five[-1]["plausible_answers"] == ["a", "b"] and five[-1]["is_possible"] is False
    assert [r["qa_type"] for r in run(spark, [item("factoid", ["a"], True)] * 4)] == ["factoid"] * 4
    got = run(spark, [item(" Timeline ", ["a"], None), item("x", ["a"], False), item("UNANSWERABLE", ["a", "b", "c"], True, []), item("unanswerable", [], True, ["p", "q", "r"]), item("claim_verification", ["a"], False, ["p"]), item("unanswerable", ["a"], None, ["p", "q", "r"])])
    assert [r["qa_type"] for r in got] == ["factoid", "unanswerable", "unanswerable", "unanswerable", "claim_verification", "unanswerable"]
    assert [r["is_possible"] for r in got] == [True, False, False, False, True, False]
    assert [r["plausible_answers"] for r in got] == [None, ["a"], ["a", "b"], ["p", "q", "r"], ["p"], ["p", "q"]]
    assert run(spark, []) == []


def records(spark):
    rows = [
        ("7_1", "7", "q", "factoid", ["a"], True, None, None), ("7_2", "7", "q", None, [], True, [], None), ("8_1", "8", "q", "", ["a"], False, [], None), ("c", "[7, 9]", "q", "timeline", None, None, [], [7, 9]), ("n", None, None, "x", ["a"], None, [], None), ("7_3", "8", "q", "factoid", ["a"], True, [], None),
    ]
    return spark.createDataFrame(rows, "id string, article_id string, question string, qa_type string, answers array<string>, is_possible boolean, plausible_answers array<string>, source_article_ids array<bigint>")


def test_validation(spark):
    df = records(spark).selectExpr("*", "1 as split")
    corpus = spark.createDataFrame([("7", "train"), ("7", "test"), ("x", "test")], "article_id string, split string")
    assert sorted(map(tuple, qa.missing_references(df, corpus).collect())) == [("7_3", 8), ("8_1", 8), ("c", 9)]
    assert {r.split: r.articles for r in qa.references_by_split(df, corpus).collect()} == {"train": 1, "test": 1}
    v = qa.validation(df).first()
    assert (v.total, v.possible, v.impossible, v.possible_without_answer, v.impossible_with_answer) == (6, 3, 1, 1, 1)
    assert qa.validation(df.limit(0)).first().possible_pct is None
    assert {r.qa_type: r.n for r in qa.type_counts(df).collect()} == {"factoid": 2, "single-article": 2, "timeline": 1, "x": 1}
    assert sorted(r.article_id for r in qa.unprocessed(spark.createDataFrame([("7",), ("9",), ("11",)], "article_id string"), df).collect()) == ["11"]
    flat = {r.id: r for r in qa.flat(df).collect()}
    assert flat["c"].article_id == "7; 9" and flat["c"].source_article_ids == "7; 9" and flat["n"].is_possible == "" and flat["8_1"].is_possible == "False"


def test_generation_and_cross_repair(spark):
    articles = spark.createDataFrame([("1", "Tin", "x" * 9000), ("2", None, None)], "article_id string, title string, content string")
    prompts = qa.prompts(articles)
    assert max(len(r.prompt) for r in prompts.collect()) < 3100
    calls = []

    def flaky(p):
        calls.append(p)
        if "Tin" in p:
            return qa.echo_provider(p)
        raise RuntimeError

    got = qa.generate(prompts, flaky).collect()
    assert [r.article_id for r in got] == ["1"] or {r.article_id for r in got if r["items"]} == {"1"}
    cross = spark.createDataFrame([("3", [1, 2], [item("odd", None, None), item("timeline", ["a"], False)])], f"group_id string, article_ids array<bigint>, items {qa.ITEM}")
    rows = sorted(qa.repair_cross(cross).collect(), key=lambda r: r.id)
    assert [(r.id, r.qa_type, r.is_possible, r.source_article_ids) for r in rows] == [("cross_3_1", "multi_doc_comparison", True, [1, 2]), ("cross_3_2", "timeline", False, [1, 2])]


def test_both_phases_and_waiting(spark):
    articles = spark.createDataFrame([("1", "T1", "a" * 9000), ("2", "T2", None), ("3", None, "c")], "article_id string, title string, content string")
    done = spark.createDataFrame([("1_1", "1")], "id string, article_id string")
    groups = spark.createDataFrame([(7, [2, 1])], "group_id long, article_ids array<bigint>")
    single, cross = qa.generate_all(articles, done, groups, qa.echo_provider, wait=0.0)
    assert {r.article_id for r in single.collect()} == {"2", "3"}
    assert [(r.id, r.article_id, r.qa_type) for r in cross.collect()] == [("cross_7_1", [2, 1], "multi_doc_comparison")]
    prompt = qa.cross_prompts(groups, articles).first().prompt
    assert prompt.index("T2") < prompt.index("T1") and prompt.count("a" * 2000) == 1 and "a" * 2001 not in prompt
    heard = qa.generate(qa.prompts(articles), lambda p: qa.echo_provider(p) if "- timeline: " in p else None, about=qa.kinds(qa.CROSS_TYPES))
    assert heard.count() == 3
    failing = qa.generate(qa.prompts(articles), lambda p: 1 / 0, wait=0.01)
    assert failing.count() == 0
