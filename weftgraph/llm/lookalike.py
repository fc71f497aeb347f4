"""One form for texts that look the same.

Distinct pieces of texts with any character beyond ASCII are exploded to positioned code points. A broadcast table,
which is made from the Unicode data by rule and has a fixed size, gives each code point its parts: canonical
decompositions, widths, ligatures, blanks, hyphens, look-alike letters, and nothing for invisible characters. Marks are
then ordered by combining class behind their base, recomposed, and the strings rebuilt. ASCII texts are their own form.

Letters in another type (mathematical bold, italic, script and the like) are drawn differently, so they are kept as
another look; so are raised digits, quotes and dashes.
"""

from __future__ import annotations

import json
import sys
import unicodedata
import zlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.operators.blocks import pairs_within
from weftgraph.session import cut

# fixed values: letters of other scripts that look like a Latin letter
_ALIKE = {
    # Cyrillic
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ӏ": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ԛ": "Q", "Ѕ": "S", "Т": "T", "У": "Y", "Ү": "Y", "Ѵ": "V", "Ԝ": "W", "Х": "X",
    # Greek
    "ο": "o", "ν": "v", "ρ": "p", "υ": "u", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Ϳ": "J", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C",
    # Armenian
    "օ": "o", "ս": "u", "հ": "h", "ո": "n", "ց": "g", "Օ": "O", "Ս": "U", "Տ": "S",
    # Cherokee
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꭱ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꭹ": "Y", "Ꮓ": "Z",
    # Lisu
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
    # Coptic
    "Ⲃ": "B", "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "Ⲣ": "P", "Ⲥ": "C", "Ⲧ": "T", "Ⲩ": "Y", "Ⲭ": "X", "ⲟ": "o", "ⲣ": "p", "ⲥ": "c",
    # Latin letters of the phonetic alphabet, and the micro sign
    "ɡ": "g", "ɑ": "a", "µ": "μ",
}
_ODD = r"[^\x00-\x7F]"
_BREAK = r"(?=[ \t\n\r\p{IsHan}])"
HOT = 1000
_HYPHENS = "‐‑﹣－"
_LIGATURES = [*range(0xFB00, 0xFB07), *range(0xFB13, 0xFB18), 0x132, 0x133, *range(0x1C4, 0x1CD), *range(0x1F1, 0x1F4), *range(0x2160, 0x2180)]


def _invisible(ch: str) -> bool:
    return unicodedata.category(ch) == "Cf" or ch in "͏ᅟᅠ឴឵ㅤﾠ" or 0xFE00 <= ord(ch) <= 0xFE0F or 0x180B <= ord(ch) <= 0x180F or 0xE0100 <= ord(ch) <= 0xE01EF


@lru_cache(maxsize=1)
def parts_table() -> dict[int, list[int]]:
    """Code points that change, with what they become; by rule from the Unicode data of this Python."""
    ligatures, out = set(_LIGATURES), {}
    for cp in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= cp <= 0xDFFF:
            continue
        ch = chr(cp)
        kind = unicodedata.decomposition(ch)
        if _invisible(ch):
            parts = ""
        elif unicodedata.category(ch) == "Zs":
            parts = " "
        elif ch in _HYPHENS:
            parts = "-"
        elif kind and (not kind.startswith("<") or kind.startswith(("<wide>", "<narrow>", "<noBreak>")) or cp in ligatures):
            parts = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", ch) if kind.startswith("<") else ch)
        elif 0xAC00 <= cp <= 0xD7A3:
            parts = unicodedata.normalize("NFD", ch)
        else:
            parts = ch
        parts = "".join(unicodedata.normalize("NFD", _ALIKE.get(p, p)) for p in parts)
        if parts != ch:
            out[cp] = [ord(p) for p in parts]
    return out


@lru_cache(maxsize=1)
def _classes() -> list[int]:
    return [cp for cp in range(0x300, sys.maxunicode + 1) if unicodedata.combining(chr(cp))]


@lru_cache(maxsize=1)
def _pairs_json() -> str:
    """Base and mark to composed letter, in buckets by CRC-32."""
    buckets: list[dict[str, str]] = [{} for _ in range(1024)]
    for cp in range(0xC0, 0x30000):
        ch = chr(cp)
        kind = unicodedata.decomposition(ch)
        if kind and not kind.startswith("<") and " " in kind and unicodedata.normalize("NFC", ch) == ch:
            pair = "".join(chr(int(x, 16)) for x in kind.split())
            buckets[zlib.crc32(pair.encode()) % 1024][pair] = ch
    return json.dumps(buckets)


def code_point_table(spark: SparkSession) -> DataFrame:
    """``ch, parts``: one row per character that changes or combines; some 20,000 rows, fixed by Unicode."""
    rows = {cp: [(chr(p), unicodedata.combining(chr(p))) for p in parts] for cp, parts in parts_table().items()}
    for cp in _classes():
        rows.setdefault(cp, [(chr(cp), unicodedata.combining(chr(cp)))])
    part = pa.struct([("c", pa.string()), ("k", pa.int32())])
    columns = {"ch": pa.array([chr(cp) for cp in rows]), "parts": pa.array([[{"c": c, "k": k} for c, k in parts] for parts in rows.values()], pa.list_(part))}
    return spark.createDataFrame(pa.table(columns))


def _compose(cluster: Column, pairs: Column) -> Column:
    """A base and its ordered marks as one string; a mark joins the base unless a mark of its class stands between."""

    def step(acc: Column, x: Column) -> Column:
        key = F.concat(acc["base"], x["c"])
        made = F.get(pairs, (F.crc32(F.encode(key, "UTF-8")) % 1024).cast("int"))[key]
        free = (acc["last"] < x["k"]) & made.isNotNull()
        return F.struct(
            F.when(free, made).otherwise(acc["base"]).alias("base"),
            F.when(free, acc["rest"]).otherwise(F.concat(acc["rest"], x["c"])).alias("rest"),
            F.when(free, acc["last"]).otherwise(x["k"]).alias("last"),
        )

    start = F.struct(F.get(cluster, 0)["c"].alias("base"), F.lit("").alias("rest"), F.lit(-1).alias("last"))
    folded = F.aggregate(F.slice(cluster, 2, F.size(cluster)), start, step, lambda a: F.concat(a["base"], a["rest"]))
    return F.when(F.size(cluster) == 1, F.get(cluster, 0)["c"]).otherwise(folded)


def canonical_forms(texts: DataFrame, text: str) -> DataFrame:
    """``tid, canonical`` of each distinct text that is not plain ASCII; ``tid`` is the MD5 of the text.

    Null texts have no row. An empty form (only invisible characters) is ``''``. Texts of any length are handled whole:
    each is cut before blanks and ideographs, which no mark of another piece can change, and only the distinct pieces
    that are not ASCII are exploded. Texts look their pieces up: those in at least ``1 / HOT`` of the places, so at
    most ``HOT``, by broadcast, the others by a join on the piece.
    """
    odd = texts.select(F.col(text).alias("text")).where(F.col("text").rlike(_ODD)).distinct().select(F.md5("text").alias("tid"), "text")
    cut_ = F.transform(F.split("text", _BREAK), lambda p, i: F.struct(i.alias("pos"), p.alias("s")))
    places = odd.select("tid", F.inline(F.filter(cut_, lambda x: x["s"].rlike(_ODD))))
    counts = cut(places.groupBy("s").agg(F.count("*").alias("n")))
    forms = cut(counts.join(_piece_forms(counts.select(F.col("s").alias("tid"))), counts["s"] == F.col("tid"), "left").select("s", "n", F.coalesce("canonical", F.lit("")).alias("form")))
    total = forms.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.col("n") * HOT >= total
    probed = places.join(F.broadcast(forms.where(hot).select("s", "form")), "s", "left")
    found = probed.where("form is not null").select("tid", "pos", "form").unionAll(probed.where("form is null").drop("form").join(forms.where(~hot).select("s", "form"), "s").select("tid", "pos", "form"))
    changed = found.groupBy("tid").agg(F.collect_list(F.struct("pos", F.col("form").alias("s"))).alias("m"))
    plain = F.filter(cut_, lambda x: ~x["s"].rlike(_ODD))
    whole = F.array_join(F.transform(F.array_sort(F.concat(plain, F.col("m"))), lambda x: x["s"]), "")
    return odd.join(changed, "tid").select("tid", whole.alias("canonical"))


def _piece_forms(pieces: DataFrame) -> DataFrame:
    """``tid, canonical`` of distinct pieces ``tid``; none for pieces of invisible characters only."""
    points = pieces.select("tid", F.posexplode(F.split("tid", "")).alias("pos", "ch"))
    table = F.broadcast(code_point_table(pieces.sparkSession))
    plain = F.array(F.struct(F.col("ch").alias("c"), F.lit(0).alias("k")))
    parts = points.join(table, "ch", "left").select("tid", "pos", F.coalesce("parts", plain).alias("parts"))
    # one row per part, numbered by the base it stands behind
    each = parts.select("tid", "pos", F.posexplode("parts").alias("sub", "p")).select("tid", "pos", "sub", "p.c", "p.k")
    spans = each.withColumn("base", F.sum((F.col("k") == 0).cast("int")).over(_by_place()))
    ordered = spans.groupBy("tid", "base").agg(F.array_sort(F.collect_list(F.struct("k", "pos", "sub", "c"))).alias("m"))
    pairs = F.from_json(F.lit(_pairs_json()), "array<map<string,string>>")
    composed = ordered.select("tid", "base", F.when(F.size("m") == 1, F.get("m", 0)["c"]).otherwise(F.element_at(F.transform(F.array(pairs), lambda p: _compose(F.col("m"), p)), 1)).alias("s"))
    return composed.groupBy("tid").agg(F.array_sort(F.collect_list(F.struct("base", "s"))).alias("a")).select("tid", F.array_join(F.col("a.s"), "").alias("canonical"))


def _by_place():
    return Window.partitionBy("tid").orderBy("pos", "sub").rowsBetween(Window.unboundedPreceding, 0)


def canonicalise(df: DataFrame, text: str, out: str = "canonical") -> DataFrame:
    """``df`` with the one form of ``text`` in column ``out``; null stays null, ASCII and empty texts stay as they are.

    Rows, repeats and other columns are kept. An empty table stays empty.
    """
    tid = "__tid"
    forms = canonical_forms(df, text).select(F.col("tid").alias(tid), F.col("canonical").alias("__form"))
    return df.withColumn(tid, F.when(F.col(text).rlike(r"[^\x00-\x7F]"), F.md5(F.col(text)))).join(forms, tid, "left").withColumn(out, F.coalesce("__form", F.col(text))).drop(tid, "__form")


def _keyed(rows: DataFrame) -> DataFrame:
    """``field_name, id, look, raw`` of distinct rows ``field_name, id, text`` with a letter."""
    rows = rows.where("text is not null and id is not null").distinct()
    keyed = canonicalise(rows, "text").where(F.col("canonical").rlike(r"\p{L}"))
    return cut(keyed.select("field_name", "id", F.md5("canonical").alias("look"), F.md5("text").alias("raw")))


def same_look_pairs(rows: DataFrame, block_rows: int = 2_000) -> DataFrame:
    """``field_name, id_a, id_b`` (id_a < id_b): rows of a field whose texts look alike but differ in characters.

    ``rows`` has ``field_name, id, text``. Null texts, texts without a letter and null ids give no pair; exact repeats
    of a row count once. Rows of a look are paired in cells of two blocks, so a look may be shared by any share of the
    rows. :func:`look_classes` says the same without writing pairs out.
    """
    keyed = _keyed(rows)
    mixed = keyed.groupBy("field_name", "look").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).where("lo <> hi").select("field_name", "look")
    pairs = pairs_within(keyed.join(mixed, ["field_name", "look"], "left_semi"), ["field_name", "look"], "id", block_rows)
    return pairs.where("raw_a <> raw_b").select("field_name", "id_a", "id_b").distinct()


def look_classes(rows: DataFrame) -> DataFrame:
    """``field_name, id, look, links`` of every row with a letter: the class of its look and how many rows of the field
    look like it but differ in characters. As :func:`same_look_pairs` in every other case."""
    keyed = _keyed(rows)
    texts = keyed.groupBy("field_name", "look", "raw").agg(F.count_distinct("id").alias("same"))
    looks = texts.groupBy("field_name", "look").agg(F.sum("same").alias("whole"))
    links = texts.join(looks, ["field_name", "look"]).select("field_name", "look", "raw", (F.col("whole") - F.col("same")).alias("links"))
    return keyed.join(links, ["field_name", "look", "raw"]).select("field_name", "id", "look", "links")
