import numpy as np
import pytest

from weftgraph.llm import abuse as A
from weftgraph.session import table


def test_disguises():
    assert A.words("s u b h u m a n") == A.words("s.u.b.h.u.m.a.n") == A.words("s-u-b-h-u-m-a-n") == ["subhuman"]
    assert A.passages("s​t​upid іdіоt")[0] == ("stupid", "idiot")
    assert A.words("1d10t sh1t ABCD12 42 yeeees") == ["idiot", "shit", "g0", "0", "yes"]
    assert A.passages(None) == A.passages("") == A.passages(" .\n") == []


def test_disguises_in_passages():
    assert A.passages("Well. You are an i.d.i.o.t! Go.") == [("well",), ("you", "are", "an", "idiot"), ("go",)]
    assert A.passages("What sh!t.")[0] == ("what", "shit") and A.passages("SH!T")[0] == ("shit",)
    assert A.passages("You $tup1d @sshole, you a$$ and !diot")[0] == ("you", "stupid", "asshole", "you", "ass", "and", "idiot")
    assert A.passages("You are a m o r o n.")[0] == A.passages("you are a m.o.r.o.n")[0] == ("you", "are", "a", "moron")
    assert ("you", "asshole") in A.passages("You a s s h o l e") and A.passages("a.s.s.h.o.l.e") == [("asshole",)]


def test_sentences_without_blanks():
    assert ("you", "idiot") in A.passages("Go away!you idiot") and A.passages("Go away.You idiot") == [("go", "away"), ("you", "idiot")]
    assert A.passages("It costs $500, 1.5 mg. Done.") == [("it", "costs", "0", "0", "0", "mg"), ("done",)]
    assert A.passages("你好！你是") == [("你", "好"), ("你", "是")]


def test_passages_cover_every_word():
    text = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200))
    ps = A.passages(text)
    assert {w for p in ps for w in p} == set(text.split()) and max(map(len, ps)) <= A.PASSAGE


def test_gradient_step_lowers_the_loss():
    rng = np.random.default_rng(1)
    texts = [("you", "idiot"), ("kind", "words"), ("stupid", "liar", "you"), ("the", "gene")] * 8
    y = np.array([1, 0, 1, 0] * 8, dtype=np.float32)
    m = A.Model(3)
    A.fit(texts, y, np.ones(len(y), np.float32), 25, m, rng)
    p = 1 / (1 + np.exp(-m.logits(texts)))
    assert (p[y > 0] > 0.8).all() and (p[y == 0] < 0.2).all()


def test_training_sees_every_passage(monkeypatch):
    seen = []
    monkeypatch.setattr(A, "fit", lambda texts, labels, weights, epochs, model, rng: seen.append((set(texts), len(labels), len(weights), epochs)))
    clean = {("note", f"n{i}"): 1.0 for i in range(9_000)}
    for some in (clean, dict(list(clean.items())[:50])):
        A._fit_passages([("you", "idiot")], some, 1)
        texts, labels, weights, epochs = seen.pop()
        assert set(some) <= texts and labels == weights and epochs == A.EPOCHS


@pytest.fixture(scope="module")
def learned(spark):
    d = "/root/testdata/sf0.1"
    docs, reviews = table(spark, d, "documents"), table(spark, d, "content_reviews")
    half = reviews.where("review_id % 2 = 0")
    return A.learn(docs, half), docs, reviews.where("review_id % 2 = 1")


def test_held_out_accuracy(spark, learned):
    (model, limits, _), docs, held = learned
    rows = A.score_documents(docs.join(held, "doc_id"), model, limits, keep=("review_label",)).toPandas()
    flagged, bad = rows["flagged"], rows["review_label"] != "ok"
    precision, recall = (flagged & bad).sum() / flagged.sum(), (flagged & bad).sum() / bad.sum()
    # a part of the reviews is wrong, which bounds both from above
    assert precision > 0.8 and recall > 0.6


def test_edges(spark, learned):
    (model, limits, _), _, _ = learned
    long = "The registry is closed on Monday. " * 5000 + "You are a stupid idiot and nobody likes you. " + "Thanks for the link. " * 5000
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "You are a stupid idiot.", None), (3, long, "x"), (3, long, "x"), (4, "Thank you all for the support.", "x")], "doc_id bigint, text string, score string")
    got = [(r.doc_id, r.flagged) for r in A.score_documents(df, model, limits).collect()]
    assert sorted(got, key=str) == sorted([(1, False), (2, False), (None, True), (3, True), (3, True), (4, False)], key=str)
    assert A.score_documents(df.limit(0), model, limits).count() == 0
    scored = A.score_documents(df.withColumnRenamed("score", "source"), model, limits, keep=("source",))
    assert {r.source: (r.documents, r.flagged) for r in A.rates(scored).collect()} == {"x": (5, 2), None: (1, 1)}


def test_without_reviews(spark):
    empty = spark.createDataFrame([], "doc_id bigint, review_label string")
    model, limits, _ = A.learn(spark.createDataFrame([(1, "x")], "doc_id bigint, text string"), empty)
    assert limits == {"": 0.0} and model.logits([("you", "are", "an", "idiot")])[0] > 0


def test_no_seed_is_in_the_tables():
    import re

    import pyarrow.dataset as ds
    from weftgraph.llm.seeds import UNWANTED
    from weftgraph.llm.text import fold

    def runs(text):
        ws = re.findall(r"[㐀-鿿]|[^\W\d_]+(?:'[^\W\d_]+)*", fold(text).casefold())
        n = min(len(ws), 4 if re.search(r"[㐀-鿿]", text) else 3)
        return {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)}

    wanted = {r for s in UNWANTED for r in runs(s)}
    sizes = {len(r) for r in wanted}
    for scale in ("sf0.001", "sf0.01", "sf0.1"):
        texts = ds.dataset(f"/root/testdata/{scale}/documents.parquet").to_table(columns=["text"])["text"].to_pylist()
        for part in {p for t in texts if t for p in re.split(r"[.!?。！？\n]+", t)}:
            ws = re.findall(r"[㐀-鿿]|[^\W\d_]+(?:'[^\W\d_]+)*", fold(part).casefold())
            found = {tuple(ws[i : i + n]) for n in sizes for i in range(len(ws) - n + 1)} & wanted
            assert not found


def test_thresholds_cover_reviews_beyond_the_fit(spark, monkeypatch):
    monkeypatch.setattr(A, "MAX_REVIEWS", 40)
    good, bad = "Die Studie ist seit dem Jahr {} offen und wird von der Klinik geführt.", "Du bist ein dummer Idiot und nicht mehr wert als der Müll {}."
    rows = [(i, (bad if i % 4 == 0 else good).format(i), "abusive" if i % 4 == 0 else "ok") for i in range(160)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, review_label string")
    _, limits, f1 = A.learn(df.select("doc_id", "text"), df.select("doc_id", "review_label"))
    assert "de" in limits and 0 < f1 <= 1


def test_counts_stand_for_documents():
    rng = np.random.default_rng(5)
    scores, labels = np.round(rng.normal(0, 2, 400), 1), (rng.random(400) < 0.3).astype(np.float32)
    langs = np.array(["en", "de"] * 200, dtype=object)
    kinds, n = np.unique(np.array(list(zip(scores, labels, langs == "en"))), axis=0, return_counts=True)
    counted = A.calibrate(kinds[:, 0], kinds[:, 1], np.where(kinds[:, 2] > 0, "en", "de").astype(object), n)
    whole = A.calibrate(scores, labels, langs)
    assert counted[0].keys() == whole[0].keys() and abs(counted[1] - whole[1]) < 0.05
