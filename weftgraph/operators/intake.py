"""Intake of annotations, gene links, structure models and hierarchies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.ranking import first


def counts_as_observed(aspect: Column, qualifier: Column) -> Column:
    """Annotations of the phenotype aspect that are not negated, whatever the case; a null qualifier is none."""
    return (aspect == "P") & (F.upper(F.coalesce(qualifier, F.lit(""))) != "NOT")


def known_terms(annotations: DataFrame, terms: DataFrame, closed: DataFrame, root: str) -> DataFrame:
    """Rows of ``annotations`` whose ``term`` is a live one of ``terms`` (``id, obsolete``) at or under ``root``.

    ``closed`` is the reflexive closure ``node, ancestor``. Repeated rows stay, null and unknown terms drop out.
    """
    live = terms.where(~F.coalesce("obsolete", F.lit(False))).select(F.col("id").alias("term")).distinct()
    under = closed.where(F.col("ancestor") == root).select(F.col("node").alias("term")).distinct()
    return annotations.join(live, "term", "left_semi").join(under, "term", "left_semi")


def curated_use(association: Column, symbol: Column, curated: Column) -> Column:
    """Whether a link counts: Mendelian with a symbol and, where a panel lists genes (``a;b``), one of those."""
    named = F.filter(F.transform(F.split(F.coalesce(curated, F.lit("")), ";"), lambda g: F.btrim(g)), lambda g: (g != "") & (g != "-"))
    sound = (F.upper(F.coalesce(association, F.lit(""))) == "MENDELIAN") & ~F.coalesce(symbol, F.lit("")).isin("", "-")
    return sound & ((F.coalesce(curated, F.lit("")) == "") | F.coalesce(F.array_contains(named, symbol), F.lit(False)))


def full_length_model(models: DataFrame, by: str = "accession") -> DataFrame:
    """The first model by ``place`` of each accession that is a single fragment over its whole length.

    ``models`` has ``model_id, start, end, length, place``; a null or zero length fits any end.
    """
    whole = F.col("model_id").endswith("-F1") & (F.col("start") == 1) & ((F.coalesce("length", F.lit(0)) == 0) | (F.col("end") == F.col("length")))
    return first(models.where(whole), [by], ["place"])


def pathway_sizes(mapping: DataFrame) -> DataFrame:
    """``pathway_id, size, background``: distinct accessions, without isoform suffix, of a pathway and of all."""
    rows = mapping.select("pathway_id", F.substring_index("accession", "-", 1).alias("accession")).where("pathway_id is not null and accession is not null").distinct()
    whole = rows.agg(F.count_distinct("accession").alias("background"))
    return rows.groupBy("pathway_id").agg(F.count("*").alias("size")).join(F.broadcast(whole))


def anchored_hierarchy(closed: DataFrame, links: DataFrame, members: DataFrame, anchors: DataFrame) -> DataFrame:
    """``child_id, parent_id, relation, grouping``: the proper ancestors of ``members`` (``id``) that are members or
    ``anchors`` (``id, grouping``); others group a series. A link of ``links`` (``child, parent``) is direct."""
    kept = anchors.select("id", "grouping").unionByName(members.select("id", F.lit("series").alias("grouping"))).groupBy("id").agg(F.min("grouping").alias("grouping"))
    up = closed.where("node <> ancestor").select(F.col("node").alias("child_id"), F.col("ancestor").alias("parent_id"))
    up = up.join(members.select(F.col("id").alias("child_id")), "child_id", "left_semi").join(kept.withColumnRenamed("id", "parent_id"), "parent_id")
    direct = links.select(F.col("child").alias("child_id"), F.col("parent").alias("parent_id"), F.lit(True).alias("d")).distinct()
    return up.join(direct, ["child_id", "parent_id"], "left").select("child_id", "parent_id", F.when(F.col("d"), "is_a").otherwise("is_a_transitive").alias("relation"), "grouping")


def first_reason(reasons: list[tuple[str, Column]]) -> Column:
    """The name of the first condition that holds, else empty; a null condition does not hold."""
    out = F.lit("")
    for name, condition in reversed(reasons):
        out = F.when(condition, name).otherwise(out)
    return out


def names_any(text: Column, alternatives: str) -> Column:
    """Whether any of the alternatives, parted by bars, is in a text, whatever the case."""
    return F.exists(F.split(F.lower(F.lit(alternatives)), r"\|"), lambda x: F.contains(F.lower(text), x))
