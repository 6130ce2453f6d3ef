import random

import numpy as np
import pytest

from reedmill.llm.answers import BUCKETS, OPENING, Language, copies, defects, ending, fold, language, opening_clusters

GOOD = ["Đội duy tu đường bộ", "Đội duy tu đường bộ là bên nâng cấp cầu.", "Doi duy tu duong bo la ben nang cap cau.", "Bà Ngạc Lam Thượng", "27/3", "478 mét đường", "“318 học viên”", "Nhà máy R&D"]
OTHER = ["The main reason was the unusually heavy rain.", "Il s'agit de 921 cas près de Lập Thạnh, An Linh, selon la commission.", "Der Grund war das anhaltende Hochwasser.", "Proyek itu ditunda selama 3 hari.", "약 437명이 참여했다.", "共有0户居民参加了会议。", "Heavy rain", "It rained.", "Le maire", "La ciudad"]
#: What the rule of syllables tells alone, without any question.
RULE = Language(np.zeros(BUCKETS, np.int64))


@pytest.mark.parametrize("text", GOOD)
def test_vietnamese(text):
    assert not RULE.foreign(text)


@pytest.mark.parametrize("text", OTHER)
def test_foreign(text):
    assert RULE.foreign(text)


def test_the_language_is_that_of_the_questions(spark):
    told = "Wie lange dauerten die Arbeiten am Damm|Warum wurde das Projekt verschoben|Wer hat den Bericht geschrieben|Wann wurde die Schleuse geschlossen|Wo liegt das neue Lager der Gemeinde".split("|")
    df = spark.createDataFrame([(q + f" {i}?",) for q in told for i in range(400)] + [(None,), ("",)], "question string")
    assert not language(df).foreign("das Projekt wurde verschoben") and language(df).foreign("the committee said it was too late")
    assert not language(df.limit(0)).foreign("người dân") and not RULE.foreign("") and not RULE.foreign("12")


def test_copies_and_endings():
    q = fold("Vai trò của đội cờ trong câu chuyện ở Lệ Hùng là gì").split()
    for a in ("Vai trò của đội cờ trong câu chuyện ở Lệ Hùng là gì", "Câu hỏi là Vai trò của đội cờ trong câu chuyện ở Lệ Hùng là gì", "Vai trò của đội cờ trong câu chuyện ở Lệ Hùng là gì " * 2):
        assert copies(q, fold(a).split())
    assert not copies(q, fold("Vai trò của đội cờ trong câu chuyện ở Lệ Hùng là gì là do quỹ dự phòng thay đổi").split())
    assert not copies([], ["a"])
    assert [ending(x) for x in ("a.", "a”.", "“a.”", "“a”", "a (", "a, “b", "a -", "a…", "a")] == ["stop", "stop", "stop", "open", "cut", "cut", "cut", "dots", "open"]


def test_defects(spark):
    kinds = ["Có bao nhiêu", "Ai là", "Nguyên nhân nào", "Vai trò của"]
    rows = [(f"n{i}", f"{kinds[i % 4]} người thứ {i} trong câu chuyện ở Lệ Hùng?", [f"Nhóm {chr(97 + i % 20)} đã nâng cấp cây cầu treo qua suối cạn."], True) for i in range(80)]
    rows += [(f"r{i}", f"{kinds[i % 4]} điều {i}?", ["Rất tiếc, tôi không thể trả lời câu hỏi này."], True) for i in range(8)]
    rows += [(f"s{i}", f"{kinds[i % 4]} điều {i}?", ["Ban tổ chức xin lỗi khán giả và hoàn vé."], True) for i in range(8)]
    rows += [
        ("e1", "Ai?", [], True), ("e2", "Ai?", None, None), ("e3", "Ai?", ["-", None], True), ("ok", "Ai?", ["-", None], False), ("m", "Ai?", ["a", ""], False),
        ("t1", "Ai là người?", ["Nhóm a đã nâng cấp cây cầu tr"], True), ("t2", "Ai là người?", ["Nhóm b đã nâng cấp cây cầu treo qua suối cạn.", "Nhóm b đã (", "Nhóm b đã ("], True), ("p", "Ai là người?", ["Nhóm b đã nâng cấp cây cầu treo qua suối cạn"], True),
        ("c", "Ai là người nâng cấp cầu?", ["AI LÀ NGƯỜI NÂNG CẤP CẦU"], True), ("o", None, [OTHER[0]], True), ("l", "Ai?", ["Nhóm a. " * 4000], True),
    ]
    df = spark.createDataFrame(rows + rows[-11:], "id string, question string, answers array<string>, is_possible boolean").selectExpr("*", "1 as words", "2 as prompt", "3 as n")
    got = sorted(map(tuple, defects(df).collect()))
    want = [("c", "copies_question"), ("e1", "empty_answer"), ("e2", "empty_answer"), ("e3", "empty_answer"), ("m", "flag_mismatch"), ("o", "other_language"), ("t1", "truncated_answer"), ("t2", "truncated_answer")] + [(f"r{i}", "refusal") for i in range(8)]
    assert got == sorted(want)
    assert defects(df.limit(0)).count() == 0


def test_every_opening_has_the_class_of_brute_force(spark):
    rng = random.Random(3)
    core = [f"w{i}" for i in range(9)]
    texts = {tuple(core[: rng.randint(3, 9)]) for _ in range(20)} | {(rng.choice("abcdef"), *core[rng.randint(0, 2) :], *rng.choices("xyz", k=rng.randint(0, 3))) for _ in range(150)} | {(f"u{i}", *core) for i in range(30)} | {("x",)}
    texts = sorted({t[:OPENING] for t in texts})
    df = spark.createDataFrame([(list(t), "a b", False, False, False) for t in texts for _ in range(2)], "words array<string>, prompt string, copy boolean, voice boolean, curt boolean")
    rows = opening_clusters(df)[0].selectExpr("o", "root", "sh").collect()
    assert len(rows) == len(texts)
    root = {r.o: r.o for r in rows}

    def top(x):
        return x if root[x] == x else top(root[x])

    for i, a in enumerate(rows):
        for b in rows[:i]:
            both = len({*a.sh} & {*b.sh})
            if both >= 0.8 * len({*a.sh} | {*b.sh}):
                root[top(a.o)] = top(b.o)
    pairs = {(r.root, top(r.o)) for r in rows}
    assert len({x for x, _ in pairs}) == len({y for _, y in pairs}) == len(pairs) < len(texts)


def test_templates_in_other_scripts_and_all_members_of_a_class(spark):
    kinds = ["Có bao nhiêu", "Ai là", "Nguyên nhân nào", "Vai trò của"]
    said = {"ko": "죄송하지만 이 질문에는 답변할 수 없습니다.", "zh": "很抱歉，我无法回答这个问题。", "ru": "Извините, но я не могу ответить на этот вопрос.", "it": "Mi dispiace, ma non posso rispondere a questa domanda.", "vi": "Theo quy định chung ở đây thì tôi không thể trả lời câu hỏi này."}
    rows = [(f"{k}{i}", f"{kinds[i % 4]} điều {i}?", [a]) for k, a in said.items() for i in range(8)]
    rows += [("vi-again", "Ai là người?", ["Theo quy định chung ở đây thì tôi không thể trả lời câu này."])]
    rows += [(f"n{i}", f"{kinds[i % 4]} điều {i}?", ["이유는 비용 문제였습니다."]) for i in range(8)]
    df = spark.createDataFrame(rows, "id string, question string, answers array<string>").selectExpr("*", "true as is_possible")
    got = {r.id: r.defect for r in defects(df).collect()}
    assert got == {r[0]: "other_language" if r[0][0] == "n" else "refusal" for r in rows}
    # no wording of a list in the second half of the class, most of the class declines
    rows = [(f"a{i}", f"{kinds[i % 4]} điều {i}?", ["Chuyện này vốn dĩ rất dài nên xin cho tôi dừng ở đây, tôi không thể trả lời."]) for i in range(8)] + [("b", "Ai là người?", ["Chuyện này vốn dĩ rất dài nên xin cho tôi dừng ở đây, tôi thôi nói."])]
    df = spark.createDataFrame(rows, "id string, question string, answers array<string>").selectExpr("*", "true as is_possible")
    assert {r.id: r.defect for r in defects(df).collect()} == {r[0]: "refusal" for r in rows}
