from pyspark.sql import functions as F

from weftgraph.operators import community, evaluate, graph, intake, payload
from weftgraph.operators.blocks import pairs_within


def test_pairs_within_hot_groups(spark):
    rows = [("h", i) for i in range(90)] + [("x", 1), ("x", 2), ("y", 5), (None, 1), (None, 2), ("h", None)]
    df = spark.createDataFrame(rows, "k string, id int")
    got = sorted(tuple(r) for r in pairs_within(df, ["k"], "id", 7).collect())
    assert got == sorted([("h", a, b) for a in range(90) for b in range(a + 1, 90)] + [("x", 1, 2)])
    assert pairs_within(df.limit(0), ["k"], "id").count() == 0


def test_curated_use_and_reasons(spark):
    rows = [("mendelian", "A", ""), ("MENDELIAN", "A", "A; B"), ("MENDELIAN", "C", "A;B"), ("MENDELIAN", "-", ""), (None, "A", None), ("MENDELIAN", None, "A"), ("MENDELIAN", "A", "-")]
    df = spark.createDataFrame(rows, "t string, g string, c string")
    assert [r.u for r in df.select(intake.curated_use(F.col("t"), F.col("g"), F.col("c")).alias("u")).collect()] == [True, True, False, False, False, False, False]
    r = df.select(intake.first_reason([("type", F.upper("t") != "MENDELIAN"), ("gene", F.col("g") == "-")]).alias("r"), intake.names_any(F.col("t"), "x|Mend").alias("n")).collect()
    assert [x.r for x in r][3] == "gene" and r[0].n and r[4].n is None


def test_full_length_model(spark):
    rows = [("P1", "AF-P1-F2", 1, 9, 9, 1), ("P1", "AF-P1-F1", 2, 9, 9, 2), ("P1", "AF-P1-F1", 1, 9, 9, 4), ("P1", "AF-P1-F1", 1, 9, 9, 3), ("P2", "AF-P2-F1", 1, 5, None, 1), ("P3", "AF-P3-F1", 1, 5, 6, 1)]
    got = intake.full_length_model(spark.createDataFrame(rows, "accession string, model_id string, start int, end int, length int, place int")).collect()
    assert sorted((r.accession, r.place) for r in got) == [("P1", 3), ("P2", 1)]


def test_verdicts(spark):
    kind = "i int, answer string, facts array<map<string,string>>, fact_ids array<string>, switch_to string, switched array<string>, must_cite array<map<string,string>>, must_mention array<string>, defer_to array<string>, abstain boolean, from_facts boolean"
    facts = [{"id": "F1", "kind": "Study", "text": "Registry of X"}, {"id": "F2", "kind": "Gene", "text": "ABCD1"}]
    cite = [{"kind": "study", "text": "registry"}]
    rows = [
        (1, "The registry of X is open.", facts, ["F1"], None, None, cite, ["REGISTRY"], None, False, True),
        (2, "The registry of X is open.", facts, ["F2"], "", [], cite, ["trial"], ["care team"], True, True),
        (3, "The facts here don’t give a number.", facts, [], None, None, None, None, None, True, None),
        (4, "x", None, None, "disease Y", ["Disease Y page"], None, None, None, None, None),
        (5, None, None, None, None, ["Z"], None, None, None, True, False),
        (6, "It can cure this.", None, None, "Q", None, None, None, None, None, None),
    ]
    got = {r.i: (r.problems, r.passed) for r in evaluate.verdicts(spark.createDataFrame(rows, kind), ["cure"]).collect()}
    assert got == {1: ([], True), 2: (["cites", "mentions", "abstains", "defers"], False), 3: ([], True), 4: ([], True), 5: (["answers"], False), 6: (["switch", "forbidden"], False)}


def test_together_and_known(spark):
    g = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("b", "z"), ("c", "q")], "name string, member string")
    c = spark.createDataFrame([("x", "1"), ("y", "1"), ("z", "2")], "member string, cluster string")
    assert sorted((r.name, r.ok) for r in evaluate.together(g, c).collect()) == [("a", True), ("b", False), ("c", False)]
    assert sorted((r.name, r.ok) for r in evaluate.all_known(g.withColumnRenamed("member", "item"), c.withColumnRenamed("member", "item")).collect()) == [("a", True), ("b", True), ("c", False)]


def test_nested_properties_survive_a_sync_twice(spark):
    props = '{"cluster":{"combined":"1"},"synonyms":["x","y"],"k":{"z":1.5,"t":[1,{"a":null}]},"s":"say \\"hi\\"","n":3,"b":true}'
    nodes = graph.as_nodes(spark.createDataFrame([("D:1", "Disease", "d", "seed", props)], "node_id string, node_type string, label string, status string, properties_json string"))
    edges = graph.as_edges(spark.createDataFrame([("E:1", "D:1", "IS_A", "D:1")], "edge_id string, source_id string, edge_type string, target_id string"))
    new = nodes.withColumns({"status": F.lit("cluster_expansion"), "properties_json": F.lit('{"cluster":{"combined":"2","x":[1]},"synonyms":["no"],"family":"f"}')})
    once = graph.replace_layer(nodes, edges, new, edges.limit(0))
    twice = graph.replace_layer(once[0], once[1], new, edges.limit(0))
    import json

    first, second = (x[0].first()["properties_json"] for x in (once, twice))
    want = json.loads(props) | {"cluster": {"combined": "2", "x": [1]}, "family": "f"}
    assert json.loads(first) == want and first == second
    flat = {r.key: (r.value, r.kind) for r in payload.flat_properties(once[0].select("node_id", "properties_json"), "node_id").collect()}
    assert flat["s"] == ('say "hi"', "scalar") and flat["synonyms"] == ('["x","y"]', "list") and flat["k"][1] == "nested" and flat["n"] == ("3", "scalar")


def test_payload(spark):
    nodes = graph.as_nodes(spark.createDataFrame([("NCT:1", "Study", "s", '{"study":{"phases":"2"}}'), ("EVIDENCE:E1", "Evidence", "e", ""), ("D:1", "Disease", "d", '{"synonyms":["b"]}')], "node_id string, node_type string, label string, properties_json string"))
    seeds = spark.createDataFrame([("D:1", "a; b", "X:1;X:2")], "disease_id string, synonyms string, xrefs string")
    studies = spark.createDataFrame([("9", *("v",) * len(payload.STUDY))], "nct_id string, " + ", ".join(f"{c} string" for c in payload.STUDY))
    words = spark.createDataFrame([("E1", "worded")], "evidence_id string, wording string")
    out = payload.decorated_nodes(nodes, seeds, studies, words)
    got = {r.id: r for r in out.collect()}
    assert got["D:1"].synonyms == ["a", "b"] and got["D:1"].xrefs == ["X:1", "X:2"] and got["D:1"].search == ["D:1", "a", "b", "d"]
    assert got["NCT:1"].study.phases == "2" and got["EVIDENCE:E1"].wording == "worded" and got["NCT:1"].wording is None
    edges = graph.as_edges(spark.createDataFrame([("E:1", "D:1", "D:1")], "edge_id string, source_id string, target_id string"))
    rows = payload.payload(out, edges, graph.fingerprint(nodes, edges)).collect()
    assert [r.part for r in rows].count("node") == 3 and '"node_count":3' in next(r.json for r in rows if r.part == "metadata")
    assert [r.node_id for r in payload.surplus(nodes, nodes.where("node_type <> 'Study'"), "node_id").collect()] == ["NCT:1"]


def test_communities_of_a_large_component_agree_with_one_task(spark):
    clique = lambda base: [(base + i, base + j, 1.0) for i in range(6) for j in range(i + 1, 6)]
    edges = clique(0) + clique(10) + clique(20) + [(0, 10, 0.1), (10, 20, 0.1)] + clique(100) + [(50, 51, 0.0), (60, 61, None)]
    df = spark.createDataFrame(edges, "a bigint, b bigint, weight double")
    nodes = spark.createDataFrame([(i,) for i in [*range(6), *range(10, 16), *range(20, 26), *range(100, 106), 50, 51]], "node bigint")
    groups = lambda out: sorted(sorted(r.node for r in rows) for rows in _by(out.collect()).values())
    small, large = community.louvain(nodes, df), community.louvain(nodes, df, task_edges=20)
    assert groups(small) == groups(large) == sorted([list(range(6)), list(range(10, 16)), list(range(20, 26)), list(range(100, 106)), [50], [51]])


def _by(rows):
    out = {}
    for r in rows:
        out.setdefault(r.community, []).append(r)
    return out


def test_matrix_has_every_letter():
    from weftgraph.operators import align

    letters, scores = align.read_matrix(align.BLOSUM62)
    assert letters == "ARNDCQEGHILKMFPSTWYVBZX*" and (scores == scores.T).all() and scores[letters.index("X"), letters.index("A")] == 0
