"""Several values packed in one field.

A parsing expression grammar, tried in this order at every place::

    field   <- ws '[' list ']' ws EOF / list
    list    <- value (delim value)*
    value   <- quoted / bare
    quoted  <- ws ('"' ('""' / !'"' .)* '"' / '“' (!'”' .)* '”') ws &(delim / EOF)
    bare    <- ('\\' delim / !delim .)*
    delim   <- strong / comma

If ``quoted`` fails (no closing quote, or text after it), the parser goes back to where the quote opened and takes
``bare``, in which a quote is an ordinary character. If any strong delimiter stands between values, commas belong to
the values; otherwise they separate.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: what separates, in any width
STRONG = ";；﹔︔|｜￨\n\r\x0b\x0c\x85  "
COMMA = ",，﹐"
_DELIM = f"[{re.escape(STRONG + COMMA)}]"
_WS = rf"(?:(?!{_DELIM})\s)*+"
_QUOTED = re.compile(rf'{_WS}(?:"(?P<s>(?:""|[^"])*+)"|“(?P<c>[^”]*+)”){_WS}(?={_DELIM}|\Z)')
_BARE = re.compile(rf"(?:\\{_DELIM}|(?!{_DELIM}).)*+", re.S)
_ESCAPE = re.compile(rf"\\({_DELIM})")
_OPENS = re.compile(rf'{_WS}["“]')


def parse(text: str | None) -> list[tuple[int, str, str | None]]:
    """The values of one field as ``(position from 1, value, error)``.

    Null, blank and ``-`` have none. Values lose outer white space; empty ones are dropped and do not count, repeated
    ones stay. ``error`` is ``malformed_quote`` for a value that opens with a quote the grammar could not close.
    """
    if text is None:
        return []
    text = text.strip()
    if text[:1] == "[" and text[-1:] == "]" and len(text) > 1:
        text = text[1:-1]
    if text.strip() in ("", "-"):
        return []
    # (text without the escapes of bare values, unquoted or None, delimiter after it)
    parts: list[tuple[str, str | None, str]] = []
    at, strong = 0, False
    while True:
        m = _QUOTED.match(text, at)
        if m:
            inner = m["s"].replace('""', '"') if m["s"] is not None else m["c"]
        else:
            m, inner = _BARE.match(text, at), None
        delim = text[m.end() : m.end() + 1]
        strong |= delim != "" and delim in STRONG
        parts.append((m.group() if inner is not None else _ESCAPE.sub(r"\1", m.group()), inner, delim))
        if not delim:
            break
        at = m.end() + 1
    if strong:
        joined: list[tuple[str, str | None, str]] = []
        fresh = True
        for raw, inner, delim in parts:
            if fresh:
                joined.append((raw, inner, delim))
            else:
                joined[-1] = (joined[-1][0] + joined[-1][2] + raw, None, delim)
            fresh = delim in STRONG
        parts = joined
    out: list[tuple[int, str, str | None]] = []
    for raw, inner, _ in parts:
        value = (raw if inner is None else inner).strip()
        if value:
            out.append((len(out) + 1, value, "malformed_quote" if inner is None and _OPENS.match(raw) else None))
    return out


def unpack(df: DataFrame, id_col: str, field: str, name: str | None = None) -> DataFrame:
    """One row per value of ``field``: ``field_name, row_id, pos, item, error``.

    A null, blank or ``-`` field gives no row, an empty table gives none; repeated rows give repeated values; a null
    id comes out as null; texts of any length are parsed whole, in time linear in their length. Only the id and the
    field are read, so other columns may have any name. No shuffle.
    """
    schema = "row_id bigint, pos bigint, item string, error string"
    kind = pa.schema([("row_id", pa.int64()), ("pos", pa.int64()), ("item", pa.string()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, pos, items, errors, held = [], [], [], [], 0
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for p, item, error in parse(text):
                    ids.append(i), pos.append(p), items.append(item), errors.append(error)
                    held += len(item)
                if held > 8_000_000 or len(ids) > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((ids, pos, items, errors), kind)], schema=kind)
                    ids, pos, items, errors, held = [], [], [], [], 0
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((ids, pos, items, errors), kind)], schema=kind)

    rows = df.select(F.col(id_col).cast("bigint").alias("row_id"), F.col(field).cast("string").alias("text")).where("text is not null")
    return rows.mapInArrow(run, schema).select(F.lit(name or field).alias("field_name"), "row_id", "pos", "item", "error")
