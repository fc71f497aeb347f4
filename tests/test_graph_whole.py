from weftgraph.plans import catalogue
from weftgraph.session import table


def test_no_supplier_is_left_out(spark, data):
    n = table(spark, data, "supplier").count()
    run = lambda name: catalogue.QUERIES[name](spark, data)
    assert run("graph_nodes").where("node_type = 'Supplier'").count() == n
    kinds = {r.edge_type: r["count"] for r in run("graph_edges").groupBy("edge_type").count().collect()}
    assert kinds["LOCATED_IN"] == kinds["SUPPORTS"] == n
    assert run("multi_hop_path").select("supplier").distinct().count() == n
    assert run("neighbourhood").where("edge_type = 'SUPPORTS'").count() == n
    assert run("search_index").where("node_id like 'SUPPLIER:%'").count() == n
    assert not any("% 5" in catalogue.ORACLE[name] for name in ("graph_nodes", "graph_edges", "graph_version", "multi_hop_path", "neighbourhood", "search_index"))
