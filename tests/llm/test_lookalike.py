import random
import unicodedata

import pytest

from weftgraph.llm import lookalike as lk


def one_form(text):
    """By the library's normal forms, for one text at a time."""
    parts = lk.parts_table()
    return unicodedata.normalize("NFC", "".join("".join(map(chr, parts.get(ord(c), [ord(c)]))) for c in text))


def forms(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i bigint, t string")
    return {r.i: r.canonical for r in lk.canonicalise(df, "t").collect()}


SAME = [
    ("ＡＢＣ　ｘ", "ABC x"), ("café", "café"), ("a​b﻿­c⁠", "abc"), ("a b c d", "a b c d"), ("non‑stop‐x", "non-stop-x"), ("ﬁnd ﬂow", "find flow"),
    ("аԁеһіјорсухѕ", "adehijopcyxs"), ("Βemabefο", "Bemabefo"), ("ΚK", "KK"), ("q̣̇", "q̣̇"), ("ɡene", "gene"), ("ё", "ë"),
]
OTHER = [("a", "A"), ("e", "é"), ("x²", "x2"), ("‘a’", "'a'"), ("a–b", "a-b"), ("a b", "ab"), ("α", "a")]


def test_same_and_other_looks(spark):
    got = forms(spark, [x for p in SAME + OTHER for x in p])
    for i, (a, b) in enumerate(SAME):
        assert got[2 * i] == got[2 * i + 1] == unicodedata.normalize("NFC", b), (a, b)
    for i in range(len(SAME), len(SAME) + len(OTHER)):
        assert got[2 * i] != got[2 * i + 1]


def test_random_texts_equal_the_library(spark):
    rng = random.Random(6)
    pool = "ab \n" + "éàçñöﬁｗ̧̛̣́̈​ аоΑκ漢가각가ǆΐάự" + "🎉"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(25))) for _ in range(300)]
    nfc = lambda t: unicodedata.normalize("NFC", unicodedata.normalize("NFD", one_form(t)))
    got = forms(spark, texts)
    assert {i: nfc(got[i]) for i in got} == {i: nfc(t) for i, t in enumerate(texts)}


def test_null_empty_long_and_only_invisible(spark):
    got = forms(spark, [None, "", "​", "é" * 20_000, "plain"])
    assert got == {0: None, 1: "", 2: "", 3: "é" * 20_000, 4: "plain"}
    assert forms(spark, []) == {}


@pytest.mark.parametrize("group_rows", [2, 1000])
def test_pairs_equal_brute_force(spark, group_rows):
    rng = random.Random(9)
    looks = ["gene x", "café", "--", "A1"]
    spell = lambda t: "".join(rng.choice([c, c + "​", {"e": "е", "x": "х", "é": "é", " ": " ", "A": "Α"}.get(c, c)]) for c in t)
    rows = [("f" if i % 2 else "g", i, spell(rng.choice(looks))) for i in range(60)] + [("f", 100, None), ("f", None, "gene x"), ("f", 1, None)]
    rows += rows[:3]
    kept = {(f, i, t) for f, i, t in rows if t is not None and i is not None}
    want = {(f, i, j) for f, i, t in kept for g, j, u in kept if f == g and i < j and t != u and one_form(t) == one_form(u) and any(c.isalpha() for c in one_form(t))}
    got = lk.same_look_pairs(spark.createDataFrame(rows, "field_name string, id bigint, text string"), group_rows).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
