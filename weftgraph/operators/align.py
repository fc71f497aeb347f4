"""Local alignment of sequence pairs and what its scores mean."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the public BLOSUM62 table, of the amino acids and B, Z, X and *
BLOSUM62 = """
   A  R  N  D  C  Q  E  G  H  I  L  K  M  F  P  S  T  W  Y  V  B  Z  X  *
A  4 -1 -2 -2  0 -1 -1  0 -2 -1 -1 -1 -1 -2 -1  1  0 -3 -2  0 -2 -1  0 -4
R -1  5  0 -2 -3  1  0 -2  0 -3 -2  2 -1 -3 -2 -1 -1 -3 -2 -3 -1  0 -1 -4
N -2  0  6  1 -3  0  0  0  1 -3 -3  0 -2 -3 -2  1  0 -4 -2 -3  3  0 -1 -4
D -2 -2  1  6 -3  0  2 -1 -1 -3 -4 -1 -3 -3 -1  0 -1 -4 -3 -3  4  1 -1 -4
C  0 -3 -3 -3  9 -3 -4 -3 -3 -1 -1 -3 -1 -2 -3 -1 -1 -2 -2 -1 -3 -3 -2 -4
Q -1  1  0  0 -3  5  2 -2  0 -3 -2  1  0 -3 -1  0 -1 -2 -1 -2  0  3 -1 -4
E -1  0  0  2 -4  2  5 -2  0 -3 -3  1 -2 -3 -1  0 -1 -3 -2 -2  1  4 -1 -4
G  0 -2  0 -1 -3 -2 -2  6 -2 -4 -4 -2 -3 -3 -2  0 -2 -2 -3 -3 -1 -2 -1 -4
H -2  0  1 -1 -3  0  0 -2  8 -3 -3 -1 -2 -1 -2 -1 -2 -2  2 -3  0  0 -1 -4
I -1 -3 -3 -3 -1 -3 -3 -4 -3  4  2 -3  1  0 -3 -2 -1 -3 -1  3 -3 -3 -1 -4
L -1 -2 -3 -4 -1 -2 -3 -4 -3  2  4 -2  2  0 -3 -2 -1 -2 -1  1 -4 -3 -1 -4
K -1  2  0 -1 -3  1  1 -2 -1 -3 -2  5 -1 -3 -1  0 -1 -3 -2 -2  0  1 -1 -4
M -1 -1 -2 -3 -1  0 -2 -3 -2  1  2 -1  5  0 -2 -1 -1 -1 -1  1 -3 -1 -1 -4
F -2 -3 -3 -3 -2 -3 -3 -3 -1  0  0 -3  0  6 -4 -2 -2  1  3 -1 -3 -3 -1 -4
P -1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4  7 -1 -1 -4 -3 -2 -2 -1 -2 -4
S  1 -1  1  0 -1  0  0  0 -1 -2 -2  0 -1 -2 -1  4  1 -3 -2 -2  0  0  0 -4
T  0 -1  0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1  1  5 -2 -2  0 -1 -1  0 -4
W -3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1  1 -4 -3 -2 11  2 -3 -4 -3 -2 -4
Y -2 -2 -2 -3 -2 -1 -2 -3  2 -1 -1 -2 -1  3 -3 -2 -2  2  7 -1 -3 -2 -1 -4
V  0 -3 -3 -3 -1 -2 -2 -3 -3  3  1 -2  1 -1 -2 -2  0 -3 -1  4 -3 -2 -1 -4
B -2 -1  3  4 -3  0  1 -1  0 -3 -4  0 -3 -3 -2  0 -1 -4 -3 -3  4  1 -1 -4
Z -1  0  0  1 -3  3  4 -2  0 -3 -3  1 -1 -3 -1  0 -1 -3 -2 -2  1  4 -1 -4
X  0 -1 -1 -1 -2 -1 -1 -1 -1 -1 -1 -1 -1 -1 -2  0  0 -2 -1 -1 -1 -1 -1 -4
* -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4  1
"""
LAMBDA, K, SIGNIFICANT = 0.267, 0.041, 1e-3


def read_matrix(text: str) -> tuple[str, np.ndarray]:
    """Alphabet and scores of a symmetric matrix: full rows under a header of letters, or a lower triangle without one.

    Comments and blank lines are skipped; a row of another width raises.
    """
    lines = [x.split() for x in text.splitlines() if x.strip() and not x.startswith("#")]
    full = len(lines) > 1 and len(lines[0]) == len(lines) - 1 and not lines[0][-1].lstrip("-").isdigit()
    rows = lines[1:] if full else lines
    letters = "".join(r[0] for r in rows)
    if full and list(letters) != lines[0]:
        raise ValueError("matrix rows and header differ")
    out = np.zeros((len(rows), len(rows)), dtype=np.int64)
    for i, r in enumerate(rows):
        if len(r) != (len(rows) if full else i + 1) + 1:
            raise ValueError(f"row {r[0]} has {len(r) - 1} scores")
        out[i, : len(r) - 1] = [int(x) for x in r[1:]]
    return letters, out if full else np.tril(out) + np.tril(out, -1).T


@dataclass(frozen=True)
class Local:
    """A local alignment: rows with gaps, and 0-based positions of both sequences (-1 in a gap)."""

    score: int
    a: str
    b: str
    at: tuple[tuple[int, int], ...]


def align(a: str, b: str, score: Callable[[str, str], int] | None = None, gap_open: int = 2, gap_extend: int = 2) -> Local:
    """Best local alignment; a gap of n costs ``gap_open + (n - 1) gap_extend``.

    Ties: the first best cell in row order; then a match, a gap in ``b``'s row, a gap in ``a``'s row with linear costs,
    and the other gap first with affine costs; opening before extending.
    """
    table = {}
    linear = gap_open == gap_extend
    n, m = len(a), len(b)
    sub = score or (lambda x, y: 2 if x == y else -1)
    for x in set(a):
        for y in set(b):
            table[x, y] = sub(x, y)
    low = -(10**9)
    H = np.zeros((n + 1, m + 1), dtype=np.int64)
    U = np.full((n + 1, m + 1), low, dtype=np.int64)  # gap in b: steps down a
    L = np.full((n + 1, m + 1), low, dtype=np.int64)  # gap in a: steps along b
    codes = {y: np.array([table[x, y] if (x, y) in table else 0 for x in a], dtype=np.int64) for y in set(b)}
    rows = np.stack([codes[y] for y in b], axis=1) if n and m else np.zeros((n, m), dtype=np.int64)
    # by anti-diagonals: every cell of one needs only the two before it
    for d in range(2, n + m + 1):
        i = np.arange(max(1, d - m), min(n, d - 1) + 1)
        if not len(i):
            continue
        j = d - i
        U[i, j] = np.maximum(H[i - 1, j] - gap_open, U[i - 1, j] - gap_extend)
        L[i, j] = np.maximum(H[i, j - 1] - gap_open, L[i, j - 1] - gap_extend)
        H[i, j] = np.maximum.reduce([np.zeros(len(i), dtype=np.int64), H[i - 1, j - 1] + rows[i - 1, j - 1], U[i, j], L[i, j]])
    if H.max(initial=0) <= 0:
        return Local(0, "", "", ())
    i, j = divmod(int(H.argmax()), m + 1)
    best, out_a, out_b, at, state = int(H[i, j]), [], [], [], "H"
    while True:
        if state == "H":
            if H[i, j] == 0:
                break
            if H[i, j] == H[i - 1, j - 1] + rows[i - 1, j - 1]:
                i, j = i - 1, j - 1
                out_a.append(a[i]), out_b.append(b[j]), at.append((i, j))
                continue
            state = ("U" if H[i, j] == U[i, j] else "L") if linear else ("L" if H[i, j] == L[i, j] else "U")
        if state == "U":
            state = "H" if U[i, j] == H[i - 1, j] - gap_open else "U"
            i -= 1
            out_a.append(a[i]), out_b.append("-"), at.append((i, -1))
        else:
            state = "H" if L[i, j] == H[i, j - 1] - gap_open else "L"
            j -= 1
            out_a.append("-"), out_b.append(b[j]), at.append((-1, j))
    return Local(best, "".join(out_a[::-1]), "".join(out_b[::-1]), tuple(at[::-1]))


_LETTERS, _SCORES = read_matrix(BLOSUM62)
_INDEX = {x: i for i, x in enumerate(_LETTERS)}


def blosum62(x: str, y: str) -> int:
    return int(_SCORES[_INDEX[x], _INDEX[y]])


METHODS: dict[str, tuple] = {"linear": (None, 2, 2), "blosum62_affine": (blosum62, 12, 1)}
_SCHEMA = "a_id string, b_id string, method string, score bigint, paired bigint, identical bigint, gaps bigint, identity double, coverage_a double, coverage_b double, row_a string, row_b string, positions array<struct<a:int,b:int>>"


def measures(found: Local, n: int, m: int) -> dict:
    """Counts, percent identity over paired columns and percent coverage of each sequence."""
    paired = [(i, j) for i, j in found.at if i >= 0 and j >= 0]
    same = sum(x == y for x, y in zip(found.a, found.b))
    return {
        "score": found.score, "paired": len(paired), "identical": same, "gaps": len(found.at) - len(paired),
        "identity": 100.0 * same / len(paired) if paired else 0.0,
        "coverage_a": 100.0 * sum(i >= 0 for i, _ in found.at) / n if n else 0.0, "coverage_b": 100.0 * sum(j >= 0 for _, j in found.at) / m if m else 0.0,
    }


def align_pairs(pairs: DataFrame, methods: tuple[str, ...] = ("linear", "blosum62_affine")) -> DataFrame:
    """One row per pair and method; ``pairs`` has ``a_id, a, b_id, b``. An unknown letter of a matrix method raises."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                for name in methods:
                    score, gap_open, gap_extend = METHODS[name]
                    if score is not None and (bad := sorted((set(r.a) | set(r.b)) - _INDEX.keys())):
                        raise ValueError(f"letters {bad} of {r.a_id} or {r.b_id} are not in the matrix")
                    got = align(r.a, r.b, score, gap_open, gap_extend)
                    out.append({"a_id": r.a_id, "b_id": r.b_id, "method": name, **measures(got, len(r.a), len(r.b)), "row_a": got.a, "row_b": got.b, "positions": [{"a": i, "b": j} for i, j in got.at]})
            if out:
                yield pd.DataFrame(out)

    return pairs.select("a_id", "a", "b_id", "b").mapInPandas(run, _SCHEMA)


def expect(score: Column, m: Column, n: Column) -> Column:
    """E-value of a raw score between sequences of m and n residues."""
    return F.lit(K) * m * n * F.exp(F.lit(-LAMBDA) * score)


def bits(score: Column) -> Column:
    return (F.lit(LAMBDA) * score - F.log(F.lit(K))) / F.log(F.lit(2.0))


def interpretation(identity: Column, coverage: Column) -> Column:
    """What percent identity and the smaller percent coverage suggest."""
    # fixed values
    strong = "stronger sequence-homology signal; inspect domains and structure"
    partial = "partial sequence-similarity lead; do not infer shared disease mechanism"
    low = "low or localized sequence similarity; retain pathway and phenotype evidence separately"
    return F.when((identity >= 30) & (coverage >= 50), strong).when((identity >= 20) & (coverage >= 30), partial).otherwise(low)


def significant(evalue: str) -> Column:
    """Whether the text of an E-value is below the threshold; null, not false, where it is blank."""
    return F.expr(f"try_cast(`{evalue}` AS double)") < SIGNIFICANT
