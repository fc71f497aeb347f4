"""Normalised identifier keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EDGE = r"^[\s\p{Z}\x{FEFF}\x{200B}]+|[\s\p{Z}\x{FEFF}\x{200B}]+$"


def strip(text: Column) -> Column:
    """Outer white space of any kind removed."""
    return F.regexp_replace(text, _EDGE, "")


def key(text: Column) -> Column:
    """One spelling per identifier: upper case, no outer white space, ``:`` for ``_``.

    Null, blank and ``-`` refer to nothing and give null.
    """
    out = F.translate(F.upper(strip(text)), "_", ":")
    return F.when((out != "") & (out != "-"), out)
