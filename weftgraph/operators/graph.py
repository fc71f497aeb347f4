"""Maintenance of a property graph in two tables.

``nodes(node_id, node_type, label, external_id, source_url, status, properties_json)`` and
``edges(edge_id, source_id, edge_type, target_id, assertion_level, evidence_id, confidence, source_url, notes,
limitations, properties_json)``; missing values are empty strings.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODE_COLUMNS = ("node_id", "node_type", "label", "external_id", "source_url", "status", "properties_json")
EDGE_COLUMNS = ("edge_id", "source_id", "edge_type", "target_id", "assertion_level", "evidence_id", "confidence", "source_url", "notes", "limitations", "properties_json")
# fixed values
RELATION = r"^[A-Z][A-Z0-9_]*$"
EDGE_OF = {
    "same_gene_similar_presentation": ("SHARES_CAUSAL_GENE", "high"),
    "same_gene_different_presentation": ("SHARES_CAUSAL_GENE", "high"),
    "mechanism_and_phenotype_neighbor": ("MECHANISM_NEIGHBOR", "medium"),
    "mechanism_neighbor_different_presentation": ("MECHANISM_NEIGHBOR", "low"),
    "phenotype_neighbor_weak_mechanism": ("PHENOTYPE_NEIGHBOR", "medium"),
    "phenotype_lookalike_different_mechanism": ("PHENOTYPE_LOOKALIKE", "low"),
}


def _fill(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    return df.select(*((F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("")).alias(c) for c in columns))


def as_nodes(df: DataFrame) -> DataFrame:
    return _fill(df, NODE_COLUMNS)


def as_edges(df: DataFrame) -> DataFrame:
    return _fill(df, EDGE_COLUMNS)


def edge_kind(relation: Column) -> Column:
    """``struct(edge_type, confidence)`` of a relation class; null where it makes no edge."""
    out = F.lit(None).cast("struct<edge_type:string,confidence:string>")
    for name, (kind, confidence) in EDGE_OF.items():
        out = F.when(relation == name, F.struct(F.lit(kind).alias("edge_type"), F.lit(confidence).alias("confidence"))).otherwise(out)
    return out


@dataclass(frozen=True)
class Layer:
    """What a layer owns, and how its properties meet those of nodes that are there already."""

    status: str
    edge_prefix: str
    evidence_prefix: str
    fill: tuple[str, ...] = ("synonyms", "hpo_disease_id", "ncbi_gene_id", "family", "disease_group")
    refresh: tuple[str, ...] = ("protein", "cluster")
    downstream_prefix: str = "EDGE:CUR-"


CLUSTER = Layer("cluster_expansion", "EDGE:CLX-", "EVIDENCE:CLX-")


#: Values of properties stay JSON of any depth: a variant each, never text within text.
_MAP = "map<string,variant>"


def _props(text: Column) -> Column:
    return F.coalesce(F.from_json(F.nullif(text, F.lit("")), _MAP), F.create_map().cast(_MAP))


def _dump(props: Column) -> Column:
    """JSON with its keys in order; values as they are."""
    entries = F.array_sort(F.map_keys(props))
    return F.when(F.size(props) > 0, F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda k: F.concat(F.to_json(F.array(k)).substr(F.lit(2), F.length(F.to_json(F.array(k))) - 2), F.lit(":"), F.to_json(props[k]))), ","), F.lit("}"))).otherwise("")


def replace_layer(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame, layer: Layer = CLUSTER) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The graph with the layer's nodes and edges replaced, and the new edges without an end (``edge_id``).

    Applying it to its own result changes nothing. Nodes of other layers keep their place: keys of ``fill`` are set
    where absent, those of ``refresh`` always. A new edge that repeats a retained (source, type, target) is left out;
    links of the downstream layer lose those whose end is gone. Each side is joined once, on its id. Values of properties
    may be nested and keep their form.
    """
    kept = nodes.where((F.col("status") != layer.status) & ~F.startswith(F.col("node_id"), F.lit(layer.evidence_prefix)))
    fresh = new_nodes.select(*(F.col(c).alias(f"n_{c}") for c in NODE_COLUMNS))
    met = kept.join(fresh, F.col("node_id") == F.col("n_node_id"), "full")
    old = F.map_filter(_props(F.col("properties_json")), lambda k, _: ~k.isin(*layer.refresh))
    incoming = _props(F.col("n_properties_json"))
    added = F.map_filter(incoming, lambda k, _: k.isin(*layer.refresh) | (k.isin(*layer.fill) & ~F.array_contains(F.map_keys(old), k)))
    merged = _dump(F.map_concat(old, added))
    here, isnew = F.col("node_id").isNotNull(), F.col("n_node_id").isNotNull()
    columns = {c: F.when(here, F.col(c)).otherwise(F.col(f"n_{c}")) for c in NODE_COLUMNS}
    columns["properties_json"] = F.when(here, merged).otherwise(F.col("n_properties_json"))
    columns["external_id"] = F.when(here & isnew & (F.col("external_id") == ""), F.col("n_external_id")).otherwise(columns["external_id"])
    all_nodes = met.select(*(columns[c].alias(c) for c in NODE_COLUMNS))
    ids = all_nodes.select("node_id")
    keep = edges.where(~F.startswith(F.col("edge_id"), F.lit(layer.edge_prefix)))
    triple = ["source_id", "edge_type", "target_id"]
    fresh_edges = new_edges.select(*EDGE_COLUMNS).join(keep.select(*triple).distinct(), triple, "left_anti").select(*EDGE_COLUMNS)
    whole = with_both_ends(fresh_edges, ids)
    missing = fresh_edges.select("edge_id").join(whole.select("edge_id"), "edge_id", "left_anti")
    down = F.startswith(F.col("edge_id"), F.lit(layer.downstream_prefix))
    kept_edges = keep.where(~down).unionByName(with_both_ends(keep.where(down), ids))
    return all_nodes, kept_edges.unionByName(whole), missing


def with_both_ends(edges: DataFrame, ids: DataFrame) -> DataFrame:
    at_source = edges.join(ids.select(F.col("node_id").alias("source_id")).distinct(), "source_id", "left_semi")
    return at_source.join(ids.select(F.col("node_id").alias("target_id")).distinct(), "target_id", "left_semi").select(*edges.columns)


def violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``rank, kind, subject, detail`` in the order of the checks: duplicate nodes, duplicate edges, missing ends,
    relation names, missing evidence. Empty for a valid graph."""
    twice = lambda df, c: df.groupBy(c).agg(F.count("*").alias("n")).where("n > 1").select(F.col(c).alias("subject"), F.col("n").cast("string").alias("detail"))
    ids = nodes.select("node_id").distinct()
    ends = edges.select("edge_id", F.explode(F.array("source_id", "target_id")).alias("node_id")).join(ids, "node_id", "left_anti")
    proof = nodes.where("node_type = 'Evidence'").select(F.regexp_replace("node_id", "^EVIDENCE:", "").alias("evidence_id")).distinct()
    parts = [
        ("duplicate_node", twice(nodes, "node_id")),
        ("duplicate_edge", twice(edges, "edge_id")),
        ("missing_endpoint", ends.select(F.col("edge_id").alias("subject"), F.col("node_id").alias("detail"))),
        ("invalid_relation", edges.where(~F.col("edge_type").rlike(RELATION)).select(F.col("edge_id").alias("subject"), F.col("edge_type").alias("detail"))),
        ("missing_evidence", edges.where("evidence_id <> ''").join(proof, "evidence_id", "left_anti").select(F.col("edge_id").alias("subject"), F.col("evidence_id").alias("detail"))),
    ]
    out = [df.select(F.lit(i).cast("bigint").alias("rank"), F.lit(k).alias("kind"), "subject", "detail") for i, (k, df) in enumerate(parts, 1)]
    whole = out[0]
    for p in out[1:]:
        whole = whole.unionByName(p)
    return whole


def row_text(columns: list[str]) -> Column:
    """One text per row whatever the order of columns: name and value of each, a null as nothing."""
    return F.concat_ws("\x1f", *(F.concat(F.lit(c + "="), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in sorted(columns)))


def fingerprint(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``graph_version``: ``g`` and ten hex digits of the content, the same for any order of rows.

    Row hashes are added up in 2**128 as four sums of 32 bits, so no list of all rows is ever built.
    """
    rows = nodes.select(F.lit("n").alias("t"), row_text(nodes.columns).alias("x")).unionAll(edges.select(F.lit("e"), row_text(edges.columns)))
    hashed = rows.select(F.sha2(F.concat("t", F.lit("\x1e"), "x"), 256).alias("h"))
    sums = [F.sum(F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("decimal(38,0)")).cast("string").alias(f"s{i}") for i in range(4)]
    total = hashed.agg(F.count("*").cast("string").alias("n"), *sums)
    text = F.concat_ws("|", "n", *(F.coalesce(f"s{i}", F.lit("0")) for i in range(4)))
    return total.select(F.concat(F.lit("g"), F.left(F.sha2(text, 256), F.lit(10))).alias("graph_version"))


def search_terms(nodes: DataFrame) -> DataFrame:
    """``node_id, terms``: label, id, external id and synonyms, distinct and sorted, without empty ones."""
    synonyms = F.coalesce(F.from_json(F.get_json_object("properties_json", "$.synonyms"), "array<string>"), F.array().cast("array<string>"))
    return nodes.select("node_id", F.array_sort(F.array_distinct(F.filter(F.concat(F.array("label", "node_id", "external_id"), synonyms), lambda t: t != ""))).alias("terms"))


def known_ids(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.select(F.col("node_id").alias("id")).union(edges.select("edge_id")).distinct()


def neighbours(edges: DataFrame, start: DataFrame) -> DataFrame:
    """``node_id, edge_type, neighbour, direction`` one hop from the ``node_id`` of ``start``."""
    s = start.select("node_id").distinct()
    out = edges.join(s.withColumnRenamed("node_id", "source_id"), "source_id").select(F.col("source_id").alias("node_id"), "edge_type", F.col("target_id").alias("neighbour"), F.lit("out").alias("direction"))
    into = edges.join(s.withColumnRenamed("node_id", "target_id"), "target_id").select(F.col("target_id").alias("node_id"), "edge_type", F.col("source_id").alias("neighbour"), F.lit("in").alias("direction"))
    return out.unionByName(into)


def follow(edges: DataFrame, start: DataFrame, steps: list[tuple[str, str]]) -> DataFrame:
    """Paths ``n0, n1, …`` from ``start`` along ``(edge_type, 'out' | 'in' | 'any')`` steps."""
    path = start.select(F.col("node_id").alias("n0")).distinct()
    for i, (kind, way) in enumerate(steps):
        e = edges.where(F.col("edge_type") == kind)
        out = e.select(F.col("source_id").alias(f"n{i}"), F.col("target_id").alias(f"n{i + 1}"))
        back = e.select(F.col("target_id").alias(f"n{i}"), F.col("source_id").alias(f"n{i + 1}"))
        path = path.join({"out": out, "in": back, "any": out.unionByName(back)}[way], f"n{i}")
    return path.select(*(f"n{i}" for i in range(len(steps) + 1)))


def export_rows(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """JSON text of each node (by kind and lower-case label) and edge (by id)."""
    n = nodes.orderBy("node_type", F.lower("label"), "node_id").select(F.to_json(F.struct(*NODE_COLUMNS)).alias("value"))
    return n, edges.orderBy("edge_id").select(F.to_json(F.struct(*EDGE_COLUMNS)).alias("value"))


def flat_properties(rows: DataFrame, id_col: str) -> DataFrame:
    """``id, key, value`` of scalar and nested properties, nested ones as JSON text, empty ones dropped."""
    each = rows.select(id_col, F.explode(_props(F.col("properties_json"))).alias("key", "value"))
    return each.where("value is not null and value not in ('', '[]', '{}')")
