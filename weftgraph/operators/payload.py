"""What a graph looks like outside: decorated nodes, flat properties, rows that a copy has too many."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.graph import _props

# fixed values: the fields of a study that a node shows
STUDY = ("brief_title", "official_title", "overall_status", "study_type", "phases", "conditions", "lead_sponsor", "study_start_date", "primary_completion_date", "minimum_age", "maximum_age", "source_url", "retrieved_at")


def _listed(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ";"), lambda x: F.btrim(x)), lambda x: x != "")


def decorated_nodes(nodes: DataFrame, seeds: DataFrame, studies: DataFrame, wording: DataFrame) -> DataFrame:
    """``id, kind, label, external_id, source_url, status, props, synonyms, xrefs, study, wording, search`` of every node.

    ``seeds`` has ``disease_id, synonyms, xrefs`` (joined by ``;``), ``studies`` ``nct_id`` and the fields of
    :data:`STUDY`, ``wording`` ``evidence_id, wording``; each has a key once. A study that is not there may stand in a
    node's properties. Each side is joined once, on the node's id.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    s = seeds.select(F.col("disease_id").alias("node_id"), F.col("synonyms").alias("__syn"), F.col("xrefs").alias("__xr"))
    t = studies.select(F.concat(F.lit("NCT:"), "nct_id").alias("node_id"), F.struct(*(empty(c).alias(c) for c in STUDY)).alias("__study"))
    w = wording.select(F.concat(F.lit("EVIDENCE:"), "evidence_id").alias("node_id"), F.col("wording").alias("__w"))
    own = F.coalesce(F.from_json(F.get_json_object("properties_json", "$.synonyms"), "array<string>"), F.array().cast("array<string>"))
    inside = F.from_json(F.get_json_object("properties_json", "$.study"), ", ".join(f"{c} string" for c in STUDY))
    rows = nodes.join(s, "node_id", "left").join(t, "node_id", "left").join(w, "node_id", "left")
    rows = rows.withColumn("synonyms", F.array_sort(F.array_distinct(F.concat(own, _listed(F.col("__syn"))))))
    search = F.array_sort(F.array_distinct(F.filter(F.concat(F.array("label", "node_id", "external_id"), "synonyms"), lambda x: x != "")))
    return rows.select(
        F.col("node_id").alias("id"), F.col("node_type").alias("kind"), "label", "external_id", "source_url", "status", F.col("properties_json").alias("props"), "synonyms",
        F.when(F.col("__xr").isNotNull(), _listed(F.col("__xr"))).alias("xrefs"), F.coalesce("__study", inside).alias("study"), F.when(F.col("node_type") == "Evidence", F.col("__w")).alias("wording"), search.alias("search"),
    )


def payload(nodes: DataFrame, edges: DataFrame, version: DataFrame) -> DataFrame:
    """One row per part of an export, ``part, place, json``: nodes by kind and label, edges by id, then the metadata.

    Rows carry their order, so that a writer streams them in range partitions and no list of the graph is ever built.
    """
    n = nodes.select(F.lit("node").alias("part"), F.concat_ws("\x1f", "kind", F.lower("label"), "id").alias("place"), F.to_json(F.struct(*nodes.columns)).alias("json"))
    e = edges.select(F.lit("edge").alias("part"), F.col("edge_id").alias("place"), F.to_json(F.struct(*edges.columns)).alias("json"))
    counts = nodes.agg(F.count("*").alias("node_count")).join(F.broadcast(edges.agg(F.count("*").alias("edge_count")))).join(F.broadcast(version))
    return n.unionAll(e).unionAll(counts.select(F.lit("metadata"), F.lit(""), F.to_json(F.struct("edge_count", "graph_version", "node_count"))))


def flat_properties(rows: DataFrame, id_col: str) -> DataFrame:
    """``id, key, value, kind`` of the non-empty columns of a row and its properties: scalars and lists of scalars as
    they are, nested values as JSON text."""
    plain = [c for c in rows.columns if c not in (id_col, "properties_json")]
    cells = F.array(*(F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value"), F.lit("scalar").alias("kind")) for c in plain))
    text = lambda v: F.to_json(v)
    kind = lambda t: F.when(t.rlike(r"^\{"), "nested").when(t.rlike(r"^\[.*[\[{]"), "nested").when(t.rlike(r"^\["), "list").otherwise("scalar")
    shown = lambda t: F.when(t.rlike(r'^"'), F.get(F.from_json(F.concat(F.lit("["), t, F.lit("]")), "array<string>"), 0)).otherwise(t)
    extra = F.transform(F.map_entries(_props(F.col("properties_json"))), lambda e: F.struct(e["key"].alias("key"), shown(text(e["value"])).alias("value"), kind(text(e["value"])).alias("kind")))
    return rows.select(F.col(id_col).alias("id"), F.inline(F.concat(cells, extra))).where("value is not null and value <> ''")


def surplus(copy: DataFrame, source: DataFrame, id_col: str) -> DataFrame:
    """Ids of a copy that the source no longer has, to be pruned from the copy."""
    return copy.select(id_col).distinct().join(source.select(id_col), id_col, "left_anti")


def hierarchy_layer(hierarchy: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of parents that are not ``known`` (``node_id``), with the evidence of the hierarchy, and IS_A edges.

    ``hierarchy`` has ``child_id, parent_id, parent_label, relation``; a transitive link counts only for a child
    without a direct one.
    """
    from weftgraph.operators.graph import as_edges, as_nodes
    from weftgraph.operators.layers import OWNED
    from weftgraph.operators.ontology import direct_links

    links = direct_links(hierarchy.select(F.col("child_id").alias("child"), F.col("parent_id").alias("parent"), "relation").distinct())
    labels = hierarchy.groupBy(F.col("parent_id").alias("parent")).agg(F.max("parent_label").alias("label"))
    new = links.select("parent").distinct().join(known.select(F.col("node_id").alias("parent")), "parent", "left_anti").join(labels, "parent", "left")
    nodes = new.select(F.col("parent").alias("node_id"), F.lit("Disease").alias("node_type"), F.coalesce("label", "parent").alias("label"), F.col("parent").alias("external_id"), F.lit(OWNED).alias("status"), F.lit('{"disease_group":true}').alias("properties_json"))
    proof = hierarchy.limit(1).select(F.lit("EVIDENCE:CLX-MONDO").alias("node_id"), F.lit("Evidence").alias("node_type"), F.lit("disease hierarchy").alias("label"), F.lit("CLX-MONDO").alias("external_id"), F.lit(OWNED).alias("status"))
    edges = links.select(F.concat_ws("-", F.lit("EDGE:CLX-ISA"), "child", "parent").alias("edge_id"), F.col("child").alias("source_id"), F.lit("IS_A").alias("edge_type"), F.col("parent").alias("target_id"), F.lit("curated").alias("assertion_level"), F.lit("CLX-MONDO").alias("evidence_id"), F.lit("high").alias("confidence"))
    return as_nodes(nodes).unionByName(as_nodes(proof)), as_edges(edges)
