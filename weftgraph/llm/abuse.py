"""Abusive, hateful or sexual content, by a convolutional text classifier.

A text is folded to one look, its disguises are undone (spaced, dotted, masked and digit-for-letter spellings), in both
readings where it is open what is a disguise, and it is cut at its sentences into passages of at most ``PASSAGE`` words, long sentences with overlap. Each word is the mean
of four hashed embeddings (itself, its first and last letter with its length, its beginning, its end). Filters of
several widths with max pooling give a passage's score, and the highest passage is the document's, so a document's
length does not matter and nothing is cut off.

The model is trained in numpy on reviewed documents. A review says only that something in a document is unwanted:
training starts from the passage of each flagged document whose words are the most telling, then lets the model itself
choose, and leaves out reviews that the model contradicts strongly, as a few are wrong. ``MAX_REVIEWS`` bounds the
reviewed documents that are fetched for training; thresholds cover every reviewed document and scoring every document.
"""

from __future__ import annotations

import math
import re
import sys
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.seeds import UNWANTED
from weftgraph.llm.text import CITATION, fold, language

MAX_REVIEWS = 20_000
PASSAGE, OVERLAP = 14, 7
EPOCHS = 8
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 15, 24, 24, (1, 2, 3, 5)
_LEET = str.maketrans("0134579@$!", "oieastgasi")
_SPACED = re.compile(r"(?<![^\W_])[^\W\d_](?:([ ._\-*·|/])[^\W\d_](?![^\W_])){2,}(?![^\W_])")
_TOKEN = re.compile(r"[@aA]\$\$(?![^\W_])|(?:[^\W_]|[@$](?=[^\W\d_])|(?<!\S)!(?=[^\W\d_]))(?:[^\W_]|[*@$!#](?=[*@$!#]*[^\W_]))*")
_CJK = re.compile(r"([぀-ヿ㐀-鿿가-힯])")
# an end is before white space, a capital after a small letter, or a script without blanks; other marks may be a mask
_SENTENCE = re.compile(r"(?<=[.!?])[\"'”’)\]]*(?:\s+|$)|(?<=[。！？])[\"'”’)\]]*\s*|(?<=[a-zß-ÿа-я][.!?])(?=[A-ZÀ-ÞА-Я])|(?<=[.!?])(?=[぀-ヿ㐀-鿿가-힯])|\n+")
_MASK = re.compile(r"!(?=[^\W\d_])")
_ONE = frozenset("aAiIoOyYeEuUàÀéÉ")  # words of one letter


def _open(run: str, other: bool) -> str:
    """A spaced word put together. A word of one letter before it stays out if the other letters have other separators;
    if not, it may be part of the word: only ``a`` stays out then, and in the other reading only the rest."""
    alone = len(run) >= 7 and run[1] == " " and run[0] in _ONE and (" " not in run[3:] or (run[0] in "aA") != other)
    return run[: 2 * alone] + re.sub(r"[ ._\-*·|/]", "", run[2 * alone :])


def _undone(text: str, other: bool = False) -> str:
    """Spaced words put together; in the other reading ``!`` before a letter ends a sentence and is no mask."""
    opened = _SPACED.sub(lambda m: _open(m.group(), other), text)
    return _MASK.sub("! ", opened) if other else opened


def words(text: str) -> list[str]:
    """The words of a passage with its disguises undone; numbers are ``0`` and codes ``g0``."""
    return _words(_undone(text))


@lru_cache(maxsize=1 << 18)
def _word(w: str) -> str:
    if w.isdigit():
        w = "0"
    elif re.fullmatch(r"[^\W\d_]{2,}\d+", w):
        w = "g0"
    elif re.search(r"[^\W\d_][\d@$!]+[^\W\d_]", w) or w[0] in "@$!" or w[-1] == "$":
        w = w.translate(_LEET)
    return sys.intern(re.sub(r"(.)\1{2,}", r"\1", w.casefold()))


def _words(text: str) -> list[str]:
    return [_word(w) for w in _TOKEN.findall(text if text.isascii() else _CJK.sub(r" \1 ", text))]


def readings(text: str | None) -> list[str]:
    """The sentences of a text with its disguises undone, then those that only the other reading has."""
    if not text:
        return []
    plain = CITATION.sub(" ", fold(text))
    if _SPACED.search(plain) is None and "!" not in plain:
        return _SENTENCE.split(plain)
    first, other = _undone(plain), _undone(plain, other=True)
    out = _SENTENCE.split(first)
    if other != first:
        known = set(out)
        out += [s for s in _SENTENCE.split(other) if s not in known]
    return out


@lru_cache(maxsize=1 << 17)
def _cut(sentence: str) -> tuple[tuple[str, ...], ...]:
    """The passages of a sentence; many sentences come again in other documents."""
    ws = _words(sentence)
    return tuple(tuple(ws[i : i + PASSAGE]) for i in range(0, max(1, len(ws) - OVERLAP), PASSAGE - OVERLAP)) if ws else ()


def passages(text: str | None) -> list[tuple[str, ...]]:
    """All passages of a text, also in the other reading where it has two; none for a null or empty one."""
    return list(dict.fromkeys(p for s in readings(text) for p in _cut(s)))


_IDS: dict[str, tuple[int, int, int, int]] = {}


def _ids(word: str) -> tuple[int, int, int, int]:
    got = _IDS.get(word)
    if got is None:
        h = lambda s: zlib.crc32(s.encode()) % (BUCKETS - 1) + 1
        got = h("w" + word), h(f"s{word[0]}{word[-1]}{min(len(word), 12)}{'*' if not word.isalnum() else ''}"), h("p" + word[:4]), h("e" + word[-3:])
        if len(_IDS) < 500_000:
            _IDS[word] = got
    return got


def encode(batch: list[tuple[str, ...]]) -> np.ndarray:
    """(passages, length, 4) ids; 0 is padding on both sides."""
    length = max(max(map(len, batch), default=0), max(WIDTHS))
    out = np.zeros((len(batch), length, 4), dtype=np.int32)
    for i, ws in enumerate(batch):
        if ws:
            out[i, : len(ws)] = [_ids(w) for w in ws]
    return out


class Model:
    """Embeddings, filters and the output layer."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.p = {"emb": rng.normal(0, 0.3, (BUCKETS, DIM)).astype(np.float32)}
        self.p["emb"][0] = 0
        for w in WIDTHS:
            self.p[f"f{w}"] = rng.normal(0, math.sqrt(2 / (w * DIM)), (w * DIM, FILTERS)).astype(np.float32)
            self.p[f"b{w}"] = np.zeros(FILTERS, dtype=np.float32)
        self.p["out"] = rng.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32)
        self.p["bias"] = np.full(1, -2.0, dtype=np.float32)

    def forward(self, ids: np.ndarray, keep: dict | None = None) -> np.ndarray:
        x = self.p["emb"][ids].mean(axis=2)
        b, n, _ = x.shape
        real = ids[:, :, 0] > 0
        pooled = []
        for w in WIDTHS:
            at = n - w + 1
            win = np.lib.stride_tricks.sliding_window_view(x, w, axis=1).transpose(0, 1, 3, 2).reshape(b * at, w * DIM)
            z = (win @ self.p[f"f{w}"]).reshape(b, at, FILTERS) + self.p[f"b{w}"]
            z = np.where(real[:, :at, None], z, -1e9)
            z[:, 0] = np.maximum(z[:, 0], -1e8)  # a passage always has a first place
            arg = z.argmax(axis=1)
            top = np.take_along_axis(z, arg[:, None], axis=1)[:, 0]
            act = np.maximum(top, 0)
            if keep is not None:
                keep[w] = (win, arg, top > 0, at)
            pooled.append(act)
        h = np.concatenate(pooled, axis=1)
        if keep is not None:
            keep["h"], keep["shape"] = h, x.shape
        return h @ self.p["out"] + self.p["bias"][0]

    def logits(self, texts: list[tuple[str, ...]], size: int = 1024) -> np.ndarray:
        order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
        out = np.empty(len(texts), dtype=np.float32)
        for i in range(0, len(order), size):
            part = order[i : i + size]
            out[part] = self.forward(encode([texts[k] for k in part]))
        return out


def fit(texts: list[tuple[str, ...]], labels: np.ndarray, weights: np.ndarray, epochs: int, model: Model, rng: np.random.Generator, rate: float = 0.004, batch: int = 128) -> None:
    """Adam on the weighted logistic loss; embeddings are updated where they are used."""
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    v = {k: np.zeros_like(v) for k, v in model.p.items()}
    every, lengths = encode(texts), np.array([max(len(x), max(WIDTHS)) for x in texts])
    t = 0
    for _ in range(epochs):
        # batches of similar length, in random order
        order = rng.permutation(len(texts))
        order = np.concatenate([x[np.argsort(lengths[x], kind="stable")] for x in np.array_split(order, max(1, len(order) // (batch * 16)))])
        for i in rng.permutation(np.arange(0, len(order), batch)):
            part = order[i : i + batch]
            t += 1
            ids = every[part, : lengths[part].max()]
            drop = rng.random(ids.shape) < 0.1  # no single spelling may carry a word alone
            drop[:, :, 1] &= False
            ids = np.where(drop & (ids[:, :, :1] > 0), ids[:, :, 1:2], ids)
            keep: dict = {}
            y = labels[part]
            p = 1 / (1 + np.exp(-np.clip(model.forward(ids, keep), -30, 30)))
            g = ((p - y) * weights[part] / len(part)).astype(np.float32)
            grads = {"out": keep["h"].T @ g, "bias": g.sum(keepdims=True)}
            gh = g[:, None] * model.p["out"][None]
            b, n, _ = keep["shape"]
            gx = np.zeros(keep["shape"], dtype=np.float32)
            for j, w in enumerate(WIDTHS):
                win, arg, on, at = keep[w]
                gz = np.zeros((b, at, FILTERS), dtype=np.float32)
                np.put_along_axis(gz, arg[:, None], (gh[:, j * FILTERS : (j + 1) * FILTERS] * on)[:, None], axis=1)
                flat = gz.reshape(b * at, FILTERS)
                grads[f"f{w}"], grads[f"b{w}"] = win.T @ flat, flat.sum(axis=0)
                gw = (flat @ model.p[f"f{w}"].T).reshape(b, at, w, DIM)
                for k in range(w):
                    gx[:, k : k + at] += gw[:, :, k]
            rows = ids.reshape(-1)
            each = np.repeat(gx.reshape(b * n, DIM) / 4, 4, axis=0)
            by = np.argsort(rows, kind="stable")
            firsts = np.flatnonzero(np.r_[True, np.diff(rows[by]) != 0])
            used, summed = rows[by][firsts], np.add.reduceat(each[by], firsts, axis=0)
            if used[0] == 0:
                used, summed = used[1:], summed[1:]
            lr = rate * math.sqrt(1 - 0.999**t) / (1 - 0.9**t)
            for k, grad in grads.items():
                grad = grad + 1e-4 * model.p[k] if k != "bias" else grad
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad * grad
                model.p[k] -= lr * m[k] / (np.sqrt(v[k]) + 1e-8)
            m["emb"][used] = 0.9 * m["emb"][used] + 0.1 * summed
            v["emb"][used] = 0.999 * v["emb"][used] + 0.001 * summed * summed
            model.p["emb"][used] -= lr * m["emb"][used] / (np.sqrt(v["emb"][used]) + 1e-8)


def _telling(docs: list[list[tuple[str, ...]]], labels: np.ndarray) -> dict[str, float]:
    """Log odds of each word's document frequency."""
    pos, neg = Counter(), Counter()
    for ps, y in zip(docs, labels):
        (pos if y else neg).update({w for p in ps for w in p} | {f"{a} {b}" for p in ps for a, b in zip(p, p[1:])})
    n1, n0 = max(1, int(labels.sum())), max(1, int((1 - labels).sum()))
    return {w: math.log((pos[w] + 0.1) / (n1 + 1)) - math.log((neg[w] + 0.1) / (n0 + 1)) for w in pos}


def _fit_passages(ones: list[tuple[str, ...]], clean: dict[tuple[str, ...], float], seed: int) -> Model:
    """``clean`` has a weight of each passage, such as the number of clean documents with it."""
    rng = np.random.default_rng(seed)
    model = Model(seed)
    ones = ones + [tuple(words(fold(s))) for s in UNWANTED]
    zeros = sorted(clean)
    weight = np.sqrt(np.minimum(np.array([clean[p] for p in zeros], dtype=float), 25))
    y = np.r_[np.ones(len(ones)), np.zeros(len(zeros))].astype(np.float32)
    w = np.r_[np.full(len(ones), np.clip(weight.sum() / len(ones) / 2, 0.5, 6)), weight].astype(np.float32)
    fit(ones + zeros, y, w, EPOCHS, model, rng)
    return model


def _most_telling(docs: list[list[tuple[str, ...]]], labels: np.ndarray) -> tuple[list[tuple[str, ...]], dict[tuple[str, ...], float]]:
    """The most telling passage of each flagged document, if no clean one has it, and the passages of clean ones."""
    odds = _telling(docs, labels)

    def weight(p: tuple[str, ...]) -> float:
        return sum(sorted((odds.get(x, 0.0) for x in {*p, *(f"{a} {b}" for a, b in zip(p, p[1:]))}), reverse=True)[:4])

    clean = Counter(p for ps, y in zip(docs, labels) if not y for p in set(ps))
    chosen = [max(ps, key=lambda p: (p not in clean, weight(p))) for ps, y in zip(docs, labels) if y and ps]
    return [p for p in chosen if p not in clean], clean


def train(docs: list[list[tuple[str, ...]]], labels: np.ndarray, seed: int = 7) -> tuple[Model, np.ndarray, list[Model]]:
    """A model of passages from labels of documents, the score of each document by a model that had not seen it, and
    the two models of halves that gave these scores.

    Two models, each of one half, score the other half. What they agree on trains the last one: of flagged documents
    the passage found by the model that had not seen it, unless none stands out (the review is then taken as wrong);
    of clean ones all passages that are not clearly unwanted.
    """
    half = np.random.default_rng(seed).integers(0, 2, len(docs))
    unseen, best = np.full(len(docs), -20.0), [None] * len(docs)
    in_flagged, in_clean = Counter(), Counter()
    for ps, y in zip(docs, labels):
        (in_flagged if y else in_clean).update(set(ps))
    doubtful: set[tuple[str, ...]] = set()
    hard: set[tuple[str, ...]] = set()
    halves: list[Model] = []
    for f in (0, 1):
        ones, zeros = _most_telling([d for d, h in zip(docs, half) if h != f], labels[half != f])
        model = _fit_passages(ones, zeros, seed + f)
        halves.append(model)
        rest = [i for i in range(len(docs)) if half[i] == f]
        flat = [p for i in rest for p in docs[i]]
        scores, at = model.logits(flat), 0
        for i in rest:
            own = dict(zip(docs[i], scores[at : at + len(docs[i])]))
            at += len(docs[i])
            unseen[i] = max(own.values(), default=-20.0)
            if labels[i]:
                # what clean documents say as often is not what the review means
                own = {p: s for p, s in own.items() if in_flagged[p] > in_clean[p]}
                best[i] = max(own, key=own.get, default=None)
                if best[i] is not None and own[best[i]] <= -2:
                    best[i] = None
            else:
                doubtful.update(p for p, s in own.items() if s > 2 and in_clean[p] <= in_flagged[p] + 1)
                hard.update(p for p, s in own.items() if s > -2)
    chosen = [p for p in best if p is not None]
    left_out = doubtful | set(chosen)
    return _fit_passages(chosen, {p: n + 20.0 * (p in hard) for p, n in in_clean.items() if p not in left_out}, seed + 2), unseen, halves


def document_logits(model: Model, docs: list[list[tuple[str, ...]]]) -> np.ndarray:
    """The highest passage of each document; -20 without a passage."""
    flat = [p for ps in docs for p in ps]
    scores = model.logits(flat) if flat else np.zeros(0, np.float32)
    out, at = np.full(len(docs), -20.0), 0
    for i, ps in enumerate(docs):
        if ps:
            out[i] = scores[at : at + len(ps)].max()
        at += len(ps)
    return out


def best_threshold(scores: np.ndarray, labels: np.ndarray, counts: np.ndarray, slack: float = 0.03) -> float:
    """The lowest logit whose F1 is within ``slack`` of the best, in the middle of its gap, kept between -1 and 1.

    The lowest, as the scores come from models of half the reviews, which are less sure than the one that is used.
    """
    order = np.argsort(-scores)
    hits = np.cumsum((labels * counts)[order])
    f1 = 2 * hits / (np.cumsum(counts[order]) + max(1, (labels * counts).sum()))
    k = int(np.flatnonzero(f1 >= f1.max() - slack)[-1])
    after = scores[order[k + 1]] if k + 1 < len(order) else scores[order[k]] - 2
    return float(np.clip((scores[order[k]] + after) / 2, -1.0, 1.0))


def calibrate(scores: np.ndarray, labels: np.ndarray, langs: np.ndarray, counts: np.ndarray | None = None, least: int = 20) -> tuple[dict[str, float], float]:
    """Thresholds by language from scores of unseen documents, ``""`` for languages with under ``least`` flagged ones,
    and the F1 reached on them. ``counts`` has the documents of each score, else one."""
    counts = np.ones(len(scores)) if counts is None else counts
    hits = labels * counts
    if hits.sum() < 5:
        return {"": 0.0}, 0.0
    found = {"": best_threshold(scores, labels, counts)}
    for lang in sorted({str(x) for x in langs}):
        at = langs == lang
        if hits[at].sum() >= least:
            found[lang] = best_threshold(scores[at], labels[at], counts[at])
    guess = scores >= np.array([found.get(x, found[""]) for x in langs])
    return found, float(2 * hits[guess].sum() / max(1, counts[guess].sum() + hits.sum()))


def learn(documents: DataFrame, reviews: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "review_label") -> tuple[Model, dict[str, float], float]:
    """Model, thresholds and F1 on unseen documents. The model is from at most ``MAX_REVIEWS`` reviewed documents, chosen
    by a hash; the thresholds are from all: those beyond are scored in Spark by the models of halves and counted.

    Reviews of a document that contradict each other equally are left out; without any review the seeds alone train.
    """
    rated = reviews.where(f"{id_col} is not null and {label} is not null").groupBy(id_col).agg(F.avg((F.lower(F.trim(label)) != "ok").cast("int")).alias("y")).where("y <> 0.5")
    picked = rated.orderBy(F.xxhash64(id_col), id_col).limit(MAX_REVIEWS)

    def read(some: DataFrame) -> DataFrame:
        return documents.select(id_col, F.col(text).alias("text")).join(some, id_col).where("text is not null").dropDuplicates([id_col]).select(id_col, "text", "y")

    rows = read(picked).toPandas().sort_values(id_col)
    docs = [passages(t) for t in rows["text"]]
    labels = (rows["y"].to_numpy(dtype=float) > 0.5).astype(np.float32)
    model, scores, halves = train(docs, labels)
    langs, counts = np.array([language(t) for t in rows["text"]], dtype=object), np.ones(len(rows))
    if rated.count() > MAX_REVIEWS:
        more = _counted(read(rated.join(picked.select(id_col), id_col, "left_anti")), halves, id_col).toPandas()
        scores, labels = np.r_[scores, more["logit"].to_numpy(dtype=float)], np.r_[labels, more["bad"].to_numpy(dtype=np.float32)]
        langs, counts = np.r_[langs, more["lang"].to_numpy(dtype=object)], np.r_[counts, more["n"].to_numpy(dtype=float)]
    thresholds, f1 = calibrate(scores, labels, langs, counts)
    return model, thresholds, f1


def _counted(rows: DataFrame, halves: list[Model], id_col: str) -> DataFrame:
    """``lang, logit, bad, n`` of ``id, text, y``: documents by language, logit to two places and label."""
    parts = [score_documents(rows.where(F.pmod(F.xxhash64(id_col), F.lit(2)) == f), half, {"": 0.0}, id_col, "text", ("y",)) for f, half in enumerate(halves)]
    odds = F.ln(F.col("score") / (1 - F.col("score")))
    logit = F.when(F.col("score") <= 2e-9, -20.0).when(F.col("score") >= 1 - 2e-9, 20.0).otherwise(F.round(odds, 2))
    return parts[0].unionAll(parts[1]).groupBy("lang", logit.alias("logit"), (F.col("y") > 0.5).cast("int").alias("bad")).agg(F.count("*").alias("n"))


def score_documents(documents: DataFrame, model: Model, thresholds: dict[str, float], id_col: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id, *keep, score, lang, flagged`` of every row; whole texts, one pass, no shuffle.

    A null, empty or wordless text has score 0 and is not flagged; repeated rows stay; a null id comes out as null;
    an empty table gives none. ``lang`` is detected, as the column of that name may be wrong.
    """
    shared = documents.sparkSession.sparkContext.broadcast((model.p, thresholds))
    fields = documents.select(id_col, *keep).schema
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "score double, lang string, flagged boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        params, limits = shared.value
        own = Model.__new__(Model)
        own.p = params
        known: dict[tuple[str, ...], float] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                texts = batch.column(batch.num_columns - 1).to_pylist()
                docs = [passages(t) for t in texts]
                new = sorted({p for ps in docs for p in ps} - known.keys())
                if len(known) > 200_000:
                    known.clear()
                    new = sorted({p for ps in docs for p in ps})
                known.update(zip(new, own.logits(new).tolist()) if new else ())
                top = np.array([max((known[p] for p in ps), default=-40.0) for ps in docs])
                langs = [language(t) if t else "und" for t in texts]
                limit = np.array([limits.get(x, limits[""]) for x in langs])
                extra = [pa.array(np.where(top <= -40, 0.0, 1 / (1 + np.exp(-np.clip(top, -40, 40))))), pa.array(langs), pa.array(top >= limit)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(batch.num_columns - 1)), *extra], names=[*(f.name for f in fields), "score", "lang", "flagged"])

    return documents.select(id_col, *keep, F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)


def rates(scored: DataFrame, source: str = "source") -> DataFrame:
    """Documents, flagged documents and their rate per source; a null source is a group of its own."""
    return scored.groupBy(source).agg(F.count("*").alias("documents"), F.count_if("flagged").alias("flagged")).withColumn("rate", F.col("flagged") / F.col("documents"))
