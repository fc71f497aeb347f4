"""Operators over a multi-parent ontology held as an edge table ``child, parent``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.session import cut


def closure(edges: DataFrame, reflexive: bool = True, most_steps: int = 1_000) -> DataFrame:
    """``node, ancestor`` of every node, itself included if ``reflexive``.

    Semi-naive: each step joins only the pairs found in the step before, drops those already known (so cycles end)
    and is written to the checkpoint folder. The number of steps is the depth of the ontology.
    """
    edges = cut(edges.select("child", "parent").where("child is not null and parent is not null").distinct())
    nodes = edges.select(F.col("child").alias("node")).union(edges.select("parent")).distinct()
    known = cut(nodes.select("node", F.col("node").alias("ancestor")))
    parts, fresh = [known], cut(edges.select(F.col("child").alias("node"), F.col("parent").alias("ancestor")).where("node <> ancestor"))
    for _ in range(most_steps):
        if fresh.isEmpty():
            break
        parts.append(fresh)
        known = known.union(fresh)
        step = fresh.join(edges.withColumnRenamed("child", "ancestor"), "ancestor").select("node", F.col("parent").alias("ancestor")).distinct()
        fresh = cut(step.join(known, ["node", "ancestor"], "left_anti"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out if reflexive else out.where("node <> ancestor")


def propagate(annotations: DataFrame, closed: DataFrame) -> DataFrame:
    """``entity, term`` with every ancestor of every term; unknown terms drop out."""
    return annotations.join(closed.withColumnRenamed("node", "term"), "term").select("entity", F.col("ancestor").alias("term")).distinct()


def information_content(propagated: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """``term, n, ic`` with ``ic = -ln(n / N)``, N the entities with a term (or the rows of ``entities``)."""
    total = (entities if entities is not None else propagated.select("entity").distinct()).agg(F.count("*").alias("total"))
    counts = propagated.groupBy("term").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(total)).select("term", "n", (-F.log(F.col("n") / F.col("total"))).alias("ic"))


def exclude_branch(annotations: DataFrame, closed: DataFrame, roots: list[str]) -> DataFrame:
    """Annotation rows whose term is under none of ``roots``; repeated rows stay."""
    inside = closed.where(F.col("ancestor").isin(roots)).select(F.col("node").alias("term")).distinct()
    return annotations.join(inside, "term", "left_anti")


def resolve_aliases(rows: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """``column`` replaced by its current id where ``aliases`` (``alias, current``) has it."""
    alias = aliases.groupBy("alias").agg(F.min("current").alias("__current"))
    return rows.join(alias, rows[column] == alias["alias"], "left").withColumn(column, F.coalesce("__current", column)).drop("alias", "__current")


def most_specific(shared: DataFrame, closed: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``keys, term`` whose term is no proper ancestor of another term of the same keys."""
    proper = closed.where("node <> ancestor").select(F.col("node").alias("__below"), F.col("ancestor").alias("term"))
    covered = shared.withColumnRenamed("term", "__below").join(proper, "__below").select(*keys, "term").distinct()
    return shared.join(covered, [*keys, "term"], "left_anti")


def direct_links(links: DataFrame) -> DataFrame:
    """Of ``child, parent, relation`` the direct ``is_a`` rows, and transitive ones only of children without any."""
    direct = links.where("relation = 'is_a'")
    rest = links.where("relation = 'is_a_transitive'").join(direct.select("child").distinct(), "child", "left_anti")
    return direct.unionByName(rest)
