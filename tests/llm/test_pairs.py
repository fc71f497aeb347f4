import pytest

from weftgraph.llm import pairs as P
from weftgraph.llm.text import language

Q = "Which gene causes Falimo syndrome type 2?"
FACT = "Falimo syndrome type 2 is caused by changes in the ABCD12 gene. [F3]"
CASES = [
    (Q, None, "empty"), (Q, " ​\n", "empty"), (Q, "N/A", "empty"), (Q, "[F1, F2].", "empty"), (Q, "**Answer:**", "empty"), (Q, "...", "empty"), (Q, "(no answer)", "empty"),
    (Q, Q, "copied_question"), (Q, "Q: " + Q.upper(), "copied_question"), (Q, Q + " " + Q, "copied_question"), (Q, "You asked: " + Q[:-1] + "...", "copied_question"), (Q, "Question: " + Q + "\nAnswer:", "copied_question"),
    (Q, Q + "\n" + FACT, None), (Q, "Falimo syndrome", None),
    (Q, "I'm sorry, but I can't help with that.", "refusal"), (Q, "Unfortunately I have to decline; please see a professional.", "refusal"), (Q, "No comment on Falimo syndrome type 2. Please ask something different. Take care!", "refusal"),
    (Q, "We can't give medical advice. " + FACT, None), (Q, 'Because the records say "we can\'t help with that", the registry closed for Falimo syndrome type 2. [F9]', None), (Q, "Sorry, there is no record of a trial that is open today. " + FACT, None),
    (Q, "Lo siento, no puedo responder a esta pregunta.", "refusal"), (Q, "抱歉，我无法回答这个问题。", "refusal"),
    (Q, "Die Gene sind verschieden, deshalb passt eine Behandlung nicht ohne Weiteres für eine andere Krankheit. [F10]", "other_language"), (Q, "О болезни: Многие семьи замечают первые признаки до 6 лет. [F1]", "other_language"), (Q, "关于 Falimo：该病由 ABCD12 基因的变化引起。[F22]", "other_language"),
    ("¿Qué gen causa Falimo?", "Muchas familias notan los primeros signos antes de los 3 años. [F1]", None), ("¿Qué gen causa Falimo?", "Many families first notice the signs before the age of 3. [F1]", "other_language"),
    (Q, FACT + ' In Spanish it is called "enfermedad de Falimo que causa los signos de la piel".', None), (Q, "Ｔｈｅ ｇｅｎｅ ｉｓ ｋｎｏｗｎ. [Ｆ１]", None),
    (Q, FACT + " The closest commu", "truncated"), (Q, FACT + " Many families first notice signs. [F", "truncated"), (Q, FACT + "\n- ", "truncated"), (Q, FACT + "\n- Ask", "truncated"), (Q, FACT + " The genes differ,", "truncated"), (Q, "```\ncode\n", "truncated"), (Q, 'They said "we will', "truncated"),
    (Q, FACT + " See https://records.example.org/d/11", None), (Q, FACT + " (disorder)", None), (Q, "Yes. [F1]", None), (Q, "ABCD12 [F2]", None), (Q, "```\ncode\n```", None), (Q, "| a | b |\n| --- | --- |\n| 1 | 2 |", None), (Q, "A slow change (see record 5). [F1]", None),
    (Q, Q + " Yes.", None), (Q, "I am not able to answer, but Open Cilia Network keeps a registry. [F3]", None), (Q, "I'm sorry, but I can't help with that; please see a doctor.", "refusal"), (Q, "Я не могу ответить на этот вопрос.", "refusal"), (Q, "<br>", "empty"), (Q, "n.a.", "empty"),
    (None, FACT, None), (None, None, "empty"), (None, "I cannot answer this question.", "refusal"),
]


def judged(spark, rows, schema="i bigint, q string, a string"):
    return {r.id: r.defect_type for r in P.defects(spark.createDataFrame(rows, schema), "i", "q", "a").collect()}


def test_cases(spark):
    got = judged(spark, [(i, q, a) for i, (q, a, _) in enumerate(CASES)])
    wrong = {CASES[i][1]: got.get(i) for i, (_, _, want) in enumerate(CASES) if got.get(i) != want}
    assert not wrong


def test_list_items_are_judged_by_the_corpus(spark):
    rows = [(i, Q, f"- They carry over.\n- The team meets before joining forces.\n- Such as startle response overlap. {i}.") for i in range(40)]
    items = ["- The team meets before joining forces", "- They carry over", "- Such as startle", "- The team meets before joi"]
    got = judged(spark, rows + [(100 + i, Q, x) for i, x in enumerate(items)])
    assert [got.get(100 + i) for i in range(4)] == [None, None, "truncated", "truncated"]


def test_tiles():
    assert P.tiles("a b c d".split(), "b c d e".split(), 3) == (["a"], 3)
    assert P.tiles("a b c a b c".split(), "a b c".split(), 3) == ([], 3)
    assert P.tiles([], ["a"], 1) == ([], 0)


def test_edges(spark):
    rows = [(None, Q, "N/A", 1), (1, Q, "N/A", 1), (1, Q, "N/A", 1), (2, "", FACT, 1), (3, Q, "x " * 200_000 + "end. [F1]", 1)]
    out = P.defects(spark.createDataFrame(rows, "i bigint, q string, a string, prev int"), "i", "q", "a").collect()
    assert sorted(((r.id or 0), r.defect_type) for r in out) == [(0, "empty"), (1, "empty")]
    assert judged(spark, []) == {}


@pytest.mark.parametrize("text,lang", [("The genes differ and this is not the same", "en"), ("Los genes son distintos y no se sabe por qué", "es"), ("Les gènes sont différents et on ne sait pas pourquoi", "fr"), ("Die Gene sind verschieden und man weiß nicht warum", "de"), ("Os genes são diferentes e não se sabe por quê", "pt"), ("这些基因不同", "zh"), ("Гены различаются", "ru"), ("", "und"), ("X12", "und")])
def test_language(text, lang):
    assert language(text) == lang


@pytest.mark.parametrize("times", [5, 6, 40, 20_000])
def test_question_told_many_times(times):
    q = "Which gene causes the type 2 disease?"
    assert P.is_copy(q, " ".join([q] * times)) and P.is_copy(q, "Answer: " + " ".join([q] * times) + " Which gene")
    assert not P.is_copy(q, " ".join([q] * times) + " It is FBN1.") and not P.is_copy(q, "gene which disease the " * 4 * times)


@pytest.mark.parametrize("text", ["I must abstain.", "I won't go there.", "申し訳ありませんが、お答えできません。", "죄송합니다. 답변해 드릴 수 없습니다.", "Mi dispiace, non posso rispondere a questa domanda.", "Helaas kan ik deze vraag niet beantwoorden.", "عذرا، لا يمكنني الإجابة على هذا السؤال."])
def test_refusals_of_more_languages(text):
    assert P.is_refusal(text)


@pytest.mark.parametrize("text", ["Das Gen ist GBA1.", "El gen es GBA1.", "Sjukdomen orsakas av en mutation i genen.", "Chorobę powoduje mutacja w genie."])
def test_short_answers_and_languages_without_word_lists(text):
    assert P.in_other_language("Which gene causes the disease?", text)
    assert not P.in_other_language("Which gene causes the disease?", "Autosomal recessive inheritance, GBA1 and Qorilo")


@pytest.mark.parametrize("text,rest", [
    ("<ul><li>one</li>", ["<ul>"]), ("<ul><li>one</li></ul>", []), ("a *very important", ["*"]), ("a *very* important", []), ("p.Asn370Ser* is rare", []), ("```\nx\n~~~", ["```"]), ("~~~\nx\n~~~", []), ("* one\n* two", []), ("p<0.05 and a<b", []), ("**bold* x", ["**", ]), ("(a [b)", []),
])
def test_open_parts(text, rest):
    assert P.open_parts(text)[: len(rest)] == rest and bool(P.open_parts(text)) == bool(rest)


def test_very_short_answers(spark):
    corpus = [(i, Q, f"Because the enzyme is low, yes, the cells store fat. {i}.") for i in range(150)]
    short = ["Because the enzy", "Because the", "Yes", "Low", "Gaucher disease", "I am trun"]
    got = judged(spark, corpus + [(500 + i, Q, x) for i, x in enumerate(short)])
    assert [got.get(500 + i) for i in range(6)] == ["truncated", "truncated", None, None, None, None]
    assert judged(spark, [(i, Q, "The text was truncated here.") for i in range(9)] + [(500, Q, "I am trun")]) == {500: "truncated"}
