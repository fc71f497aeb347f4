"""Byte-level BPE of a whole corpus with a public rank file.

A word is encoded by a fold of ranked merges in Spark's higher-order functions over its bytes, with the ranks as one
literal. The most frequent distinct words of the corpus, at most ``DICTIONARY`` of them however large it is, are encoded
once and become a second literal in which documents look their words up; the others, the thin end of the distribution,
are folded where they stand. Only the counts of words are shuffled: no text, no occurrence of a word and no ids are.

Bytes travel as strings of the characters U+0000 to U+00FF, so that pieces can be keys of a map literal.
"""

from __future__ import annotations

import base64
import heapq
import json
import os
import zlib
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.session import cut

TOKENIZERS = os.environ.get("WEFTGRAPH_TOKENIZERS", "/opt/tokenizers")
RANK_FILE = "byte_bpe_50k.tiktoken"
# fixed values: how the public vocabulary splits text; (?U) gives \s the meaning it has there
PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words that are encoded once for all documents: at most so many, the most frequent.
DICTIONARY = 100_000
#: Words of more bytes are merged with a heap in Python, which gives the same pieces in n log n instead of n².
FOLD_BYTES = 96
_BUCKETS = 8192
_SLOTS = 1 << 16
_NONE = 2**31 - 1


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in lines if line.strip())}


@lru_cache(maxsize=4)
def _rank_table(application: str, path: str) -> Column:
    return _held(_rank_json(path), "array<map<string,int>>")


@lru_cache(maxsize=4)
def _rank_json(path: str) -> str:
    """The rank map as an array of small maps, by CRC-32 of the piece: a lookup reads six entries, not 50,000."""
    buckets: list[dict[str, int]] = [{} for _ in range(_BUCKETS)]
    for piece, rank in ranks(path).items():
        name = piece.decode("latin-1")
        buckets[zlib.crc32(name.encode()) % _BUCKETS][name] = rank
    return json.dumps(buckets)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _held(text: str, kind: str) -> Column:
    """A table given as JSON, as a literal in Spark's binary form: one block of bytes in the plan.

    As a plain literal its hundred thousand objects would be read again by every task, a second or more each.
    """
    spark = SparkSession.active()
    parsed = F.from_json(F.lit(text), kind)
    try:
        rows = spark.range(1).select(parsed)._jdf.queryExecution().executedPlan().executeCollect()
        expressions = spark._jvm.org.apache.spark.sql.catalyst.expressions
        value = expressions.Literal(rows[0].getArray(0), spark._jvm.org.apache.spark.sql.types.DataType.fromDDL(kind))
        return Column(spark._jvm.org.apache.spark.sql.classic.ExpressionUtils.column(value))
    except (AttributeError, TypeError):  # another kind of session
        return parsed


def _as_bytes(word: Column) -> Column:
    return F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")


def _fold(word: Column, path: str) -> Column:
    """The ids of a word: in each step the leftmost pair of lowest rank becomes one piece."""
    table = _rank_table(SparkSession.active().sparkContext.applicationId, path)
    none = F.lit(_NONE)

    def encode(rank_table: Column) -> Column:
        def rank(piece: Column) -> Column:
            return F.get(rank_table, (F.crc32(piece.cast("binary")) % _BUCKETS).cast("int"))[piece]

        def pair(a: Column, b: Column) -> Column:
            return F.coalesce(rank(F.concat(a, b)), none)

        def part(piece: Column, r: Column) -> Column:
            return F.struct(piece.alias("p"), r.alias("r"))

        def start(chars: Column) -> Column:
            return F.transform(chars, lambda c, i: part(c, pair(c, F.get(chars, i + 1))))

        def merge(acc: Column, i: Column) -> Column:
            both = F.concat(F.get(acc, i)["p"], F.get(acc, i + 1)["p"])
            before = F.get(acc, i - 1)["p"]
            left = F.when(i > 0, F.concat(F.slice(acc, 1, F.greatest(i - 1, F.lit(0))), F.array(part(before, pair(before, both))))).otherwise(F.slice(acc, 1, 0))
            return F.concat(left, F.array(part(both, pair(both, F.get(acc, i + 2)["p"]))), F.slice(acc, i + 3, F.size(acc)))

        def step(acc: Column, _: Column) -> Column:
            best = F.array_min(F.transform(acc, lambda x, i: F.struct(x["r"].alias("r"), i.alias("i"))))
            return _let(best, lambda b: F.when(b["r"] == none, acc).otherwise(merge(acc, b["i"])))

        def spell(chars: Column) -> Column:
            done = F.aggregate(F.slice(F.sequence(F.lit(1), F.size(chars)), 1, F.size(chars) - 1), start(chars), step)
            return F.transform(done, lambda x: rank(x["p"]))

        return _let(rank(_as_bytes(word)), lambda whole: F.when(whole.isNotNull(), F.array(whole)).otherwise(_let(F.split(_as_bytes(word), ""), spell)))

    return _let(table, encode)


def heap_bpe(piece: bytes, rank: dict[bytes, int]) -> list[int]:
    """The same merges with a heap of pairs; for words of any length."""
    if piece in rank:
        return [rank[piece]]
    parts: list[bytes | None] = [piece[i : i + 1] for i in range(len(piece))]
    after, before = [*range(1, len(parts)), -1], [*range(-1, len(parts) - 1)]
    heap = [(r, i, parts[i] + parts[i + 1]) for i in range(len(parts) - 1) if (r := rank.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, both = heapq.heappop(heap)
        j = after[i] if parts[i] is not None else -1
        if j < 0 or parts[i] + parts[j] != both:
            continue
        parts[i], parts[j], after[i] = both, None, after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b >= 0 and (r := rank.get(parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (r, a, parts[a] + parts[b]))
    return [rank[p] for p in parts if p is not None]


def _long_words(path: str):
    @F.pandas_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
    def encode(words: pd.Series) -> pd.Series:
        table = ranks(path)
        return words.map(lambda ws: [heap_bpe(w.encode(), table) for w in ws] if ws is not None else None)

    return encode


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def word_counts(texts: DataFrame, text: str) -> DataFrame:
    """``word, n`` of all texts; partial counts are made before the shuffle."""
    return texts.select(F.explode(words_of(F.col(text))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def dictionary(texts: DataFrame, text: str, path: str, most: int = DICTIONARY) -> tuple[list, bool]:
    """Rows ``b, word, ids`` of the most frequent words of at most ``FOLD_BYTES`` bytes, and whether any word is longer.

    A threshold on counts is taken from a histogram of eighths of a doubling, so that at most ``most`` words, however
    large the corpus, come to the driver; each is encoded once, by the fold.
    """
    counted = cut(word_counts(texts, text).withColumn("b8", F.floor(8 * F.log2("n")).cast("int")))
    short = counted.where(F.octet_length("word") <= FOLD_BYTES)
    least, room = None, most
    for r in sorted(short.groupBy("b8").agg(F.count("*").alias("k")).collect(), key=lambda r: -r.b8):  # at most 512 rows
        room -= r.k
        if room < 0:
            break
        least = r.b8
    longer = not counted.where(F.octet_length("word") > FOLD_BYTES).isEmpty()
    if least is None:
        return [], longer
    head = short.where(F.col("b8") >= least).repartition(max(8, texts.sparkSession.sparkContext.defaultParallelism))
    return head.select(F.pmod(F.hash("word"), F.lit(_SLOTS)).alias("b"), "word", _fold(F.col("word"), path).alias("ids")).collect(), longer


def _slots(rows: list, value) -> Column:
    """The dictionary as one literal: an array of small maps, of which a lookup reads one or two entries."""
    slots: list[dict] = [{} for _ in range(_SLOTS)]
    for r in rows:
        slots[r.b][r.word] = value(r.ids)
    kind = "array<map<string,array<int>>>" if not rows or isinstance(value(rows[0].ids), list) else "array<map<string,int>>"
    return _held(json.dumps(slots), kind)


def _spelled(df: DataFrame, text: str, path: str, size_only: bool) -> tuple[DataFrame, Column]:
    """``df`` with helper columns, and what each word of a text becomes: its ids, or with ``size_only`` their number.

    Words of the dictionary are looked up, others folded where they stand; long ones go through the heap in batches.
    No word and no text is shuffled.
    """
    rows, longer = dictionary(df, text, path)
    take = F.size if size_only else (lambda ids: ids)
    words = words_of(F.col(text))
    big = lambda w: F.octet_length(w) > FOLD_BYTES
    if longer:
        # a word of more bytes has at least FOLD_BYTES / 4 characters without or of white space in a row
        run = rf"(?U)\S{{{max(1, FOLD_BYTES // 4)}}}|\s{{{max(1, FOLD_BYTES // 4)}}}"
        df = df.withColumn("__far", F.when(F.col(text).rlike(run), F.array_distinct(F.filter(words, big)))).withColumn("__far_ids", _long_words(path)("__far"))

    def one(w: Column, slots: Column | None) -> Column:
        out = take(_fold(w, path))
        if longer:
            out = F.when(big(w), take(F.element_at("__far_ids", F.array_position("__far", w).cast("int")))).otherwise(out)
        return F.coalesce(F.get(slots, F.pmod(F.hash(w), F.lit(_SLOTS)))[w], out) if slots is not None else out

    if not rows:
        return df, F.transform(words, lambda w: one(w, None))
    return df, _let(_slots(rows, len if size_only else list), lambda slots: F.transform(words, lambda w: one(w, slots)))


def encode_corpus(df: DataFrame, id_col: str, text: str, path: str | None = None) -> DataFrame:
    """``id, ids`` of every distinct row of ``id_col`` and ``text``.

    An empty and a null text both have the ids ``[]``, so every document comes out with an array; special tokens in
    a text are ordinary text. Exact repeats of id and text come out once, an id with two texts once per text, a null
    id as null. An empty table gives none. Only the two columns are read. Words of any length are encoded whole.
    """
    path = path or f"{TOKENIZERS}/{RANK_FILE}"
    texts = df.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    mark = [F.col("id"), F.xxhash64("text").alias("h"), F.length("text").alias("len")]
    repeated = not texts.select(*mark).groupBy("id", "h", "len").count().where("count > 1").isEmpty()
    texts, spelled = _spelled(texts, "text", path, size_only=False)
    out = texts.select(*mark, F.coalesce(F.flatten(spelled), F.array().cast("array<int>")).alias("ids"))
    if repeated:
        out = out.dropDuplicates(["id", "h", "len"])
    return out.select(F.col("id").alias(id_col), "ids")


def with_tokens(df: DataFrame, text: str, out: str = "n_tokens", path: str | None = None) -> DataFrame:
    """``df`` with the number of tokens of ``text``, row by row; empty and null texts have 0."""
    rows, sizes = _spelled(df, text, path or f"{TOKENIZERS}/{RANK_FILE}", size_only=True)
    total = F.aggregate(sizes, F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    return rows.select(*df.columns, F.coalesce(total, F.lit(0).cast("bigint")).alias(out))


def count_tokens(df: DataFrame, id_col: str, text: str, path: str | None = None) -> DataFrame:
    """``id, n_tokens`` of each row."""
    return with_tokens(df.select(F.col(id_col), F.col(text).alias("__text")), "__text", path=path).drop("__text")


def decode(ids: Column, path: str | None = None) -> Column:
    """The text of ids: their pieces one after another, as UTF-8."""
    by_id = sorted(ranks(path or f"{TOKENIZERS}/{RANK_FILE}").items(), key=lambda x: x[1])
    pieces = _held(json.dumps([p.decode("latin-1") for p, _ in by_id]), "array<string>")
    return _let(pieces, lambda all_: F.decode(F.encode(F.array_join(F.transform(ids, lambda i: F.get(all_, i)), ""), "ISO-8859-1"), "UTF-8"))
