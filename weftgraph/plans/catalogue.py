"""All queries outside the optional subpackage, with their oracle SQL."""

from __future__ import annotations

from weftgraph.plans import data_quality, disease_queries, graph_queries, intake_queries, layer_queries, similarity_queries, table_queries

_MODULES = (data_quality, similarity_queries, table_queries, graph_queries, layer_queries, intake_queries, disease_queries)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: s for m in _MODULES for k, s in m.ORACLE.items()}
FLAGSHIP = similarity_queries.relation_classes
