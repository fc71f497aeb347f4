import random

import pytest
from pyspark.sql import functions as F

from weftgraph.llm import tokenizer as tk

PATH = f"{tk.TOKENIZERS}/{tk.RANK_FILE}"
TEXTS = ["", None, "a", " ", "Hello world", "  two  blanks\n\n\nlines\t\r\n", "naïve café Löloleba α-syndrome type 2", "关于这个病 的基因", "emoji 🎉🎉 👩‍👩‍👧", "<|endoftext|> it's they'LL we've", "ZTBN18 12345 3.14 1e-9", "\x00\x01​﻿­", "a" * 300, "ab" * 5000, "Ａｂｏｕｔ", "  x　", "don't 'S 's", "é" * 99]


@pytest.fixture(scope="module")
def reference():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{tk.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def encoded(spark, rows, schema="doc_id bigint, text string"):
    return tk.encode_corpus(spark.createDataFrame(rows, schema), "doc_id", "text")


def test_odd_texts(spark, reference):
    rows = encoded(spark, list(enumerate(TEXTS))).collect()
    assert {r.doc_id: r.ids for r in rows} == dict(enumerate(reference(TEXTS)))


def test_random_texts(spark, reference):
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcdefgh ABÉß12 \n'.,-é漢🎉​") for _ in range(rng.randrange(200))) for _ in range(150)]
    assert {r.doc_id: r.ids for r in encoded(spark, list(enumerate(texts))).collect()} == dict(enumerate(reference(texts)))


def test_fold_and_heap_agree(spark, monkeypatch):
    rows = list(enumerate(TEXTS))
    want = {r.doc_id: r.ids for r in encoded(spark, rows).collect()}
    monkeypatch.setattr(tk, "FOLD_BYTES", 0)
    assert {r.doc_id: r.ids for r in encoded(spark, rows).collect()} == want
    monkeypatch.setattr(tk, "FOLD_BYTES", 700)
    assert {r.doc_id: r.ids for r in encoded(spark, rows).collect()} == want


def test_words_beyond_the_dictionary_are_folded_where_they_stand(spark, monkeypatch):
    rows = [*enumerate(TEXTS), *((100 + i, "the cell and the gene") for i in range(30))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = {r.doc_id: r.ids for r in encoded(spark, rows).collect()}
    for most in (0, 3):
        monkeypatch.setattr(tk.dictionary, "__defaults__", (most,))
        head, longer = tk.dictionary(df, "text", PATH)
        assert len(head) <= most and longer
        assert {r.doc_id: r.ids for r in encoded(spark, rows).collect()} == want


def test_every_piece_is_one_id_as_a_word(reference):
    ranks = tk.ranks(PATH)
    import re

    words = {p.decode(): i for p, i in ranks.items() if re.fullmatch(rb" ?[A-Za-z]+|[0-9]+", p)}
    assert reference(list(words)) == [[i] for i in words.values()]


def test_repeats_nulls_and_clashing_names(spark, reference):
    rows = [(1, "a b", 5), (1, "a b", 5), (1, "c", 5), (None, "a b", 6)]
    got = encoded(spark, rows, "doc_id bigint, text string, word int").collect()
    assert sorted((r.doc_id or 0, r.ids) for r in got) == sorted([(1, reference(["a b"])[0]), (1, reference(["c"])[0]), (0, reference(["a b"])[0])])
    assert encoded(spark, []).count() == 0


def test_decode_is_the_inverse(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS) if t is not None]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    back = tk.encode_corpus(df, "doc_id", "text").select("doc_id", tk.decode(F.col("ids")).alias("t"))
    assert {r.doc_id: r.t for r in back.collect()} == dict(rows)


def test_counts(spark, reference):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    assert {r.doc_id: r.n_tokens for r in tk.count_tokens(df, "doc_id", "text").collect()} == {i: len(x) for i, x in enumerate(reference(TEXTS))}
