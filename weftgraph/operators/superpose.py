"""Rigid superposition of paired points.

Sums over points are plain aggregates, with map-side combine, so a pair of traces may be of any length; only the nine
covariances and two norms of each pair reach Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: gates of the structure comparison
CONFIDENT, LEAST_PAIRS, LEAST_COVERAGE = 70.0, 30, 25.0


def best_rotation(cov: np.ndarray) -> tuple[np.ndarray, float]:
    """Rotation from source to target and the largest eigenvalue, by Horn's quaternion; ``cov[i, j] = Σ s_i t_j``."""
    skew = np.array([cov[1, 2] - cov[2, 1], cov[2, 0] - cov[0, 2], cov[0, 1] - cov[1, 0]])
    key = np.empty((4, 4))
    key[0, 0] = np.trace(cov)
    key[0, 1:] = key[1:, 0] = skew
    key[1:, 1:] = cov + cov.T - np.trace(cov) * np.eye(3)
    values, vectors = np.linalg.eigh(key)
    w, v = vectors[0, -1], vectors[1:, -1]
    cross = np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]])
    return (w * w - v @ v) * np.eye(3) + 2 * np.outer(v, v) + 2 * w * cross, float(values[-1])


def superpose(points: DataFrame, by: str = "pair") -> DataFrame:
    """``by, n, rmsd, rotation, translation`` from rows ``by, sx, sy, sz, tx, ty, tz``.

    Rows with a null coordinate are left out; pairs with fewer than three points have null results.
    """
    s, t = ("sx", "sy", "sz"), ("tx", "ty", "tz")
    whole = points.dropna(subset=[*s, *t])
    sums = [F.avg(c).alias(f"m_{c}") for c in (*s, *t)] + [F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for a in s for b in t]
    sums += [F.sum(sum((F.col(c) * F.col(c) for c in side), F.lit(0.0))).alias(f"q_{side[0]}") for side in (s, t)]
    rows = whole.groupBy(by).agg(F.count("*").alias("n"), *sums)
    kind = points.schema[by].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.to_dict("records"):
                n = r["n"]
                if n < 3:
                    out.append({by: r[by], "n": n, "rmsd": None, "rotation": None, "translation": None})
                    continue
                ms, mt = np.array([r[f"m_{c}"] for c in s]), np.array([r[f"m_{c}"] for c in t])
                cov = np.array([[r[f"{a}_{b}"] for b in t] for a in s]) - n * np.outer(ms, mt)
                turn, top = best_rotation(cov)
                left = r["q_sx"] - n * ms @ ms + r["q_tx"] - n * mt @ mt - 2 * top
                out.append({by: r[by], "n": n, "rmsd": float(np.sqrt(max(left, 0.0) / n)), "rotation": turn.ravel().tolist(), "translation": (mt - turn @ ms).tolist()})
            yield pd.DataFrame(out, columns=[by, "n", "rmsd", "rotation", "translation"])

    return rows.mapInPandas(run, f"{by} {kind}, n bigint, rmsd double, rotation array<double>, translation array<double>")


def gate(pairs: DataFrame) -> DataFrame:
    """Adds ``status``: why a pair is not fitted, or ``computed``; the gates are tried in this order."""
    status = (
        F.when((F.col("mapped") < LEAST_PAIRS) | (F.col("coverage") < LEAST_COVERAGE), "insufficient_mapping")
        .when((F.col("plddt_a") < CONFIDENT) | (F.col("plddt_b") < CONFIDENT) | F.col("plddt_a").isNull() | F.col("plddt_b").isNull(), "low_confidence")
        .when(F.col("confident") < LEAST_PAIRS, "too_few_confident_pairs")
        .otherwise("computed")
    )
    return pairs.withColumn("status", status)


def pair_traces(columns: DataFrame, traces_a: DataFrame, traces_b: DataFrame) -> DataFrame:
    """Aligned columns ``pair, a, b`` (0-based, -1 in a gap) with the points of both traces ``pair, i, x, y, z, plddt``."""
    a = traces_a.select("pair", F.col("i").alias("a"), F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("z").alias("sz"), F.col("plddt").alias("plddt_a"))
    b = traces_b.select("pair", F.col("i").alias("b"), F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("z").alias("tz"), F.col("plddt").alias("plddt_b"))
    return columns.where("a >= 0 and b >= 0").join(a, ["pair", "a"]).join(b, ["pair", "b"])


def centre_trace(points: DataFrame, by: str = "trace") -> DataFrame:
    """Coordinates around their mean, in whole tenths."""
    means = points.groupBy(by).agg(*(F.avg(c).alias(f"__{c}") for c in "xyz"))
    return points.join(means, by).select(*(c for c in points.columns if c not in "xyz"), *(F.bround((F.col(c) - F.col(f"__{c}")) * 10).cast("int").alias(c) for c in "xyz"))
