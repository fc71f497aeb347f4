import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftgraph.operators import align, community, feedback, graph, ontology, ranking, retrieval, similarity, superpose, variants


# ------------------------------------------------------------------ ontology and similarity
def test_closure_with_cycle_and_many_parents(spark):
    e = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a"), ("x", "y"), (None, "y"), ("x", "y")], "child string, parent string")
    got = {(r.node, r.ancestor) for r in ontology.closure(e).collect()}
    assert got == {(p, q) for p in "abcd" for q in "abcd"} | {("x", "x"), ("x", "y"), ("y", "y")}
    assert all(p != q for p, q in ((r.node, r.ancestor) for r in ontology.closure(e, reflexive=False).collect()))


def test_most_specific_and_direct_links(spark):
    closed = ontology.closure(spark.createDataFrame([("leaf", "mid"), ("mid", "top")], "child string, parent string"))
    shared = spark.createDataFrame([("p", "leaf"), ("p", "mid"), ("q", "mid"), ("q", "top")], "k string, term string")
    assert sorted(map(tuple, ontology.most_specific(shared, closed, ["k"]).collect())) == [("p", "leaf"), ("q", "mid")]
    links = spark.createDataFrame([("a", "x", "is_a"), ("a", "y", "is_a_transitive"), ("b", "y", "is_a_transitive")], "child string, parent string, relation string")
    assert sorted((r.child, r.parent) for r in ontology.direct_links(links).collect()) == [("a", "x"), ("b", "y")]


def test_common_features_in_blocks(spark):
    rows = [(i, f) for i in range(60) for f in ("hot", f"f{i % 7}")]
    df = spark.createDataFrame(rows, "entity bigint, feature string")
    want = {(a, b, f) for a, f in rows for b, g in rows if a < b and f == g}
    assert {tuple(r) for r in similarity.common_features(df, block_rows=7).collect()} == want


def test_simgic_is_symmetric_and_one_for_equal_sets(spark):
    rows = [(1, "t"), (1, "u"), (2, "t"), (2, "u"), (3, "u"), (3, "v"), (4, "w")]
    df = spark.createDataFrame(rows, "entity bigint, term string")
    got = {(r.a, r.b): r.score for r in similarity.simgic(df, ontology.information_content(df)).collect()}
    assert got[1, 2] == pytest.approx(1) and 0 < got[1, 3] < 1 and (1, 4) not in got


@pytest.mark.parametrize("gene,mechanism,high,want", [(True, 0, True, 0), (True, 0, False, 1), (False, 0.25, True, 2), (False, 0.3, False, 3), (False, 0.05, True, 4), (False, 0.1, True, 5), (False, 0.2, False, 6)])
def test_classes(spark, gene, mechanism, high, want):
    got = spark.range(1).select(similarity.classify(F.lit(gene), F.lit(float(mechanism)), F.lit(high)).alias("c")).first().c
    assert got == similarity.CLASSES[want]


def test_sparse_midrank_equals_all_pairs(spark):
    rng = random.Random(3)
    family = {i: str(i % 3) for i in range(12)}
    scores = {(a, b): rng.choice([0, 0.1, 0.2, 0.5]) for a in range(12) for b in range(a + 1, 12)}
    scope = {p: family[p[0]] if family[p[0]] == family[p[1]] else "cross" for p in scores}
    pooled = [s for p, s in scores.items() if scope[p] != "cross"]
    want = {}
    for p, s in scores.items():
        ref = pooled if scope[p] == "cross" else [x for q, x in scores.items() if scope[q] == scope[p]]
        want[p] = (sum(x < s for x in ref) + 0.5 * sum(x == s for x in ref)) / len(ref)
    df = spark.createDataFrame([(a, b, scope[a, b], float(s)) for (a, b), s in scores.items() if s > 0], "a bigint, b bigint, scope string, score double")
    sizes = similarity.scope_sizes(spark.createDataFrame(list(family.items()), "entity bigint, scope string"))
    got = {(r.a, r.b): r.pct for r in similarity.midrank_sparse(df, sizes).collect()}
    assert got == pytest.approx({p: want[p] for p, s in scores.items() if s > 0})
    alone = df.where("scope = 'cross'")
    singles = similarity.scope_sizes(spark.createDataFrame([(i, str(i)) for i in range(12)], "entity bigint, scope string"))
    assert all(0 < r.pct <= 1 for r in similarity.midrank_sparse(alone, singles).collect())


# ------------------------------------------------------------------ ranks
def test_latest_first_and_cutoff(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 3, 1.0), ("a", 2, 9.0), ("b", 1, None)], "k string, t bigint, v double")
    assert sorted((r.k, r.t, r.v) for r in ranking.latest(df, ["k"], ["t"]).collect()) == [("a", 3, 1.0), ("b", 1, None)]
    assert sorted((r.k, r.v) for r in ranking.first(df, ["k"], ["t"]).collect()) == [("a", 5.0), ("b", None)]
    assert {r.k: r.cutoff for r in ranking.nearest_rank(df, "v", ["k"]).collect()} == {"a": 9.0}


# ------------------------------------------------------------------ communities
def q_of(edges, label, gamma=1.0):
    m = sum(w for *_, w in edges)
    deg, inside = {}, {}
    for a, b, w in edges:
        deg[label[a]] = deg.get(label[a], 0) + w
        deg[label[b]] = deg.get(label[b], 0) + w
        if label[a] == label[b]:
            inside[label[a]] = inside.get(label[a], 0) + w
    return sum(inside.get(c, 0) / m - gamma * (k / (2 * m)) ** 2 for c, k in deg.items())


def test_louvain_finds_planted_groups(spark):
    edges = [(g * 10 + i, g * 10 + j, 1.0) for g in range(4) for i in range(8) for j in range(i)] + [(0, 10, 0.1), (10, 20, 0.1), (20, 30, 0.1), (1, 2, -5.0)]
    label = community.louvain_partition(range(100), edges)
    assert all(len({label[g * 10 + i] for i in range(8)}) == 1 for g in range(4)) and len({label[g * 10] for g in range(4)}) == 4
    df = spark.createDataFrame([tuple(map(float, ())) or (a, b, w) for a, b, w in edges], "a bigint, b bigint, weight double")
    nodes = spark.range(40).select(F.col("id").alias("node"))
    got = {r.node: r.community for r in community.louvain(nodes, df).collect()}
    assert len(got) == 40 and got[0] == 1 and got[10] == 2 and len(set(got.values())) == 4 + 8
    assigned = spark.createDataFrame(list(got.items()), "node bigint, community bigint")
    assert community.modularity(df, assigned).first().q == pytest.approx(q_of([e for e in edges if e[2] > 0], got))
    assert len(set(r.community for r in community.louvain(nodes, df.where("weight > 99")).collect())) == 40


def test_louvain_never_below_singletons():
    rng = random.Random(1)
    for _ in range(20):
        edges = list({(min(a, b), max(a, b)): (min(a, b), max(a, b), rng.random()) for a, b in ((rng.randrange(15), rng.randrange(15)) for _ in range(40)) if a != b}.values())
        label = community.louvain_partition(range(15), edges)
        assert q_of(edges, label) >= q_of(edges, {i: i for i in range(15)}) - 1e-9


# ------------------------------------------------------------------ alignment
def best_score(a, b, sub, first, more):
    """The recurrence with every gap length tried."""
    gap = lambda k: first + (k - 1) * more
    H = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            H[i][j] = max([0, H[i - 1][j - 1] + sub(a[i - 1], b[j - 1])] + [H[i - k][j] - gap(k) for k in range(1, i + 1)] + [H[i][j - k] - gap(k) for k in range(1, j + 1)])
    return max(map(max, H))


def rescored(r, sub, first, more):
    total, gap = 0, ""
    for x, y in zip(r.a, r.b):
        if "-" in (x, y):
            side = "a" if x == "-" else "b"
            total -= more if gap == side else first
            gap = side
        else:
            total, gap = total + sub(x, y), ""
    return total


def test_alignment_goldens():
    assert align.align("AR", "AR", align.blosum62, 12, 1).score == 9
    r = align.align("ACGT", "AGT")
    assert (r.score, r.a, r.b) == (4, "GT", "GT")
    assert align.align("", "A").score == 0 and align.align("A", "C").at == ()
    assert align.blosum62("W", "W") == 11 and align.blosum62("A", "R") == align.blosum62("R", "A") == -1
    assert math.isclose(0.041 * 529 * 556 * math.exp(-0.267 * 1568), 1.825e-178, rel_tol=1e-2)
    letters, m = align.read_matrix("   A B\nA  1 2\nB  2 3\n")
    assert letters == "AB" and m.tolist() == [[1, 2], [2, 3]]
    with pytest.raises(ValueError):
        align.read_matrix("A 1\nB 2 3 4\n")


@given(st.text("ARND", max_size=12), st.text("ARND", max_size=12), st.sampled_from(sorted(align.METHODS)))
@settings(max_examples=150, deadline=None)
def test_alignment_is_best(a, b, method):
    sub, first, more = align.METHODS[method]
    got = align.align(a, b, sub, first, more)
    sub = sub or (lambda x, y: 2 if x == y else -1)
    assert got.score == best_score(a, b, sub, first, more) == rescored(got, sub, first, more)


def test_alignment_rows(spark):
    df = spark.createDataFrame([("p", "HEAGAWGHEE", "q", "PAWHEAE")], "a_id string, a string, b_id string, b string")
    rows = {r.method: r for r in align.align_pairs(df).collect()}
    assert set(rows) == set(align.METHODS) and rows["linear"].identical == rows["linear"].row_a.count("") - 1 - sum(x != y for x, y in zip(rows["linear"].row_a, rows["linear"].row_b))
    bad = spark.createDataFrame([("p", "A?", "q", "A")], "a_id string, a string, b_id string, b string")
    with pytest.raises(Exception, match="not in the matrix"):
        align.align_pairs(bad).collect()


# ------------------------------------------------------------------ superposition
def test_superposition_recovers_motion(spark):
    rng = np.random.default_rng(5)
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    quarter = np.array([[0, -1, 0], [1, 0, 0], [0, 0, 1.0]])
    rows = []
    for name, turn, shift in (("quarter", quarter, [3, -2, 5]), ("any", q, [1, 2, 3])):
        for p in rng.normal(size=(9, 3)):
            rows.append((name, *map(float, p), *map(float, turn @ p + shift)))
    rows += [("two", *[0.0] * 6), ("two", *[1.0] * 6)]
    df = spark.createDataFrame(rows, "pair string, sx double, sy double, sz double, tx double, ty double, tz double")
    got = {r.pair: r for r in superpose.superpose(df).collect()}
    assert got["quarter"].rmsd < 1e-6 and np.allclose(np.reshape(got["quarter"].rotation, (3, 3)), quarter) and np.allclose(got["quarter"].translation, [3, -2, 5])
    assert got["any"].rmsd < 1e-6 and np.allclose(np.reshape(got["any"].rotation, (3, 3)), q)
    assert got["two"].rmsd is None


# ------------------------------------------------------------------ variants
def record(**kw):
    base = dict(kind="Pathogenic", what=["missense variant"], genes=["G1"], type="single nucleotide variant", name="NM_1(G1):c.1A>G (p.Arg2Cys)")
    base |= kw
    return (kw.get("uid", "1"), "", [(g,) for g in base["genes"]], base["what"], (base["kind"], "", "2024/05/06 00:00", [("b",), ("a",), ("a",), ("",)]), [(base["name"], base["type"])])


def test_variant_records(spark):
    rows = [record(), record(kind="Benign"), record(what=["nonsense"]), record(genes=["G2"]), record(type="Deletion"), record(name="NM_1(G2):c.1 (p.Arg2Cys)"), record(name="x (G1): (p.Arg2Arg)"), record(name="(G1): (p.Arg2Ter)")]
    df = spark.createDataFrame([("G1", r) for r in rows], f"gene string, r struct<{', '.join(x.replace(' ', ':', 1) for x in variants.RECORD.split(', '))}>")
    got = variants.select_records(df).collect()
    assert [(r.change, r.position, r.ref, r.alt, r.last_evaluated, r.conditions) for r in got] == [("Arg2Cys", 2, "R", "C", "2024-05-06", "a; b")]


def test_shift_and_placement(spark):
    seq = "MKTAYIAKQRQISFVKSHFSRQ"
    s = spark.createDataFrame([("G", seq, list(range(80, 80 + len(seq))), 1)], "gene string, seq string, plddt array<int>, first_residue int")
    v = [("G", i + 3, seq[i + 4], "x", "c1; c2") for i in range(0, 15)] + [("G", 500, "A", "y", "")]
    df = spark.createDataFrame(v, "gene string, position bigint, ref string, change string, conditions string")
    places = variants.residues(s)
    shifts = variants.best_shift(df, places)
    assert shifts.first().shift == 2
    kept, rejected = variants.place(df, places, shifts)
    assert kept.count() == 15 and rejected.count() == 1
    assert variants.best_shift(df.limit(5), places).first().shift == 0
    r = variants.roll_up(kept).orderBy("position").first()
    assert (r.position, r.n, r.changes, r.conditions) == (5, 1, "x", "c1; c2")


def test_enrichment(spark):
    df = spark.createDataFrame([(10, 6, 50, 100), (1, 1, 1, 1), (0, 0, 0, 0)], "n bigint, hits bigint, k bigint, t bigint")
    r = variants.enrichment(df).first()
    assert (r.observed, r.expected) == (7, 6.0) and r.variance == pytest.approx(10 * 50 * 50 * 90 / (100 * 100 * 99))
    assert variants.enrichment(df.where("t = 0")).first().ratio is None


# ------------------------------------------------------------------ graph
def small_graph(spark):
    n = graph.as_nodes(spark.createDataFrame([("A", "Disease", "a", "", "seed", '{"cluster":"old","k":"v"}'), ("B", "Gene", "b", "X", "seed", ""), ("C", "Gene", "c", "", "cluster_expansion", ""), ("EVIDENCE:CLX-1", "Evidence", "", "", "seed", "")], "node_id string, node_type string, label string, external_id string, status string, properties_json string"))
    e = graph.as_edges(spark.createDataFrame([("E1", "A", "HAS", "B"), ("EDGE:CLX-1", "A", "HAS", "C"), ("EDGE:CUR-1", "C", "HELPS", "A")], "edge_id string, source_id string, edge_type string, target_id string"))
    return n, e


def test_layer_is_idempotent(spark):
    n, e = small_graph(spark)
    new_n = graph.as_nodes(spark.createDataFrame([("A", "EXT", "cluster_expansion", '{"cluster":"new","family":"f","zzz":"1"}'), ("D", "", "cluster_expansion", "")], "node_id string, external_id string, status string, properties_json string"))
    new_e = graph.as_edges(spark.createDataFrame([("EDGE:CLX-9", "A", "HAS", "B"), ("EDGE:CLX-8", "A", "HAS", "D"), ("EDGE:CLX-7", "A", "HAS", "ZZ")], "edge_id string, source_id string, edge_type string, target_id string"))
    n1, e1, missing = graph.replace_layer(n, e, new_n, new_e)
    rows = {r.node_id: r for r in n1.collect()}
    assert set(rows) == {"A", "B", "D"} and rows["A"].properties_json == '{"cluster":"new","family":"f","k":"v"}' and rows["A"].external_id == "EXT" and rows["A"].status == "seed"
    assert sorted(r.edge_id for r in e1.collect()) == ["E1", "EDGE:CLX-8"] and [r.edge_id for r in missing.collect()] == ["EDGE:CLX-7"]
    n2, e2, _ = graph.replace_layer(n1, e1, new_n, new_e)
    assert sorted(map(tuple, n2.collect())) == sorted(map(tuple, n1.collect())) and sorted(map(tuple, e2.collect())) == sorted(map(tuple, e1.collect()))


def test_fingerprint_and_violations(spark):
    n, e = small_graph(spark)
    v = graph.fingerprint(n, e).first()[0]
    assert v.startswith("g") and len(v) == 11 and graph.fingerprint(n.orderBy(F.desc("label")).select(*reversed(n.columns)), e).first()[0] == v
    assert graph.fingerprint(n.where("node_id <> 'B'"), e).first()[0] != v
    assert graph.fingerprint(n.limit(0), e.limit(0)).first()[0].startswith("g")
    assert graph.violations(n, e).count() == 0
    bad = e.unionAll(e.limit(1)).withColumn("evidence_id", F.lit("none"))
    assert {r.kind for r in graph.violations(n.unionAll(n.limit(1)), bad).collect()} == {"duplicate_node", "duplicate_edge", "missing_evidence"}


# ------------------------------------------------------------------ retrieval
def packed(text, limit):
    out, cur = [], ""
    for p in (x.strip(" \t\n\r") for x in text.split("\n")):
        if not p:
            continue
        if cur and len(cur) + len(p) + 1 > limit:
            out.append(cur)
            cur = ""
        cur = f"{cur}\n{p}" if cur else p
    return out + [cur] if cur else out


def test_chunks_equal_a_loop(spark):
    rng = random.Random(2)
    texts = ["", "\n\n", "x" * 300] + ["\n".join("w" * rng.randrange(40) for _ in range(rng.randrange(30))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "i bigint, t string")
    got = {r.i: r.c for r in df.select("i", retrieval.chunks(F.col("t"), 50, r"\n", "\n").alias("c")).collect()}
    assert got == {i: packed(t, 50) for i, t in enumerate(texts)}


def test_bm25_equals_the_formula(spark):
    docs = ["a b c", "a a b", "b b b", "c", "", None, "a"]
    query = "a c c"
    toks = [d.split() for d in docs if d is not None]
    n, avg = len(toks), sum(map(len, toks)) / len(toks)
    df = {t: sum(t in d for d in toks) for t in "abc"}
    idf = {t: math.log(n - k + 0.5) - math.log(k + 0.5) for t, k in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    score = lambda d: sum((idf[t] if idf[t] >= 0 else floor) * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for t in query.split())
    rows = retrieval.bm25(spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string"), spark.createDataFrame([(1, query)], "query_id bigint, text string"), None).collect()
    assert {r.doc_id: r.score for r in rows} == pytest.approx({i: score(d.split()) for i, d in enumerate(docs) if d and set(d.split()) & set(query.split())})


def test_citations_and_forbidden(spark):
    df = spark.createDataFrame([("x [F1, F2] y [F9] z [F10]", ["F1", "F10"]), (None, []), ("none", None)], "a string, v array<string>")
    assert [(r.clean, r.cited) for r in retrieval.filter_citations(df, "a", "v").collect()] == [("x [F1] y  z [F10]", ["F1", "F10"]), (None, None), ("none", [])]
    t = spark.createDataFrame([("We cannot tell whether she can join.",), ("Not now. She can join.",), ("It’s fine",)], "a string")
    assert [r.f for r in retrieval.forbidden_hits(t, "a", ["can join"], "f").collect()] == [None, "can join", None]
    assert [r.x for r in t.select(retrieval.abstains(F.col("a")).alias("x")).collect()] == [True, False, False]


def test_clean_facts(spark):
    rows = [(1, 0, "F1", " text ", ["a", "b"]), (1, 1, "F1234", "t", ["a"]), (1, 2, "F2", " ", ["a"]), (1, 3, "F3", "t", ["zz"]), (1, 4, "F4", "t", []), (1, 60, "F5", "t", ["a"])]
    got = retrieval.clean_facts(spark.createDataFrame(rows, "request_id bigint, place bigint, id string, text string, refs array<string>"), spark.createDataFrame([("a",), ("b",)], "id string")).collect()
    assert [(r.id, r.text) for r in got] == [("F1", "text")]


# ------------------------------------------------------------------ feedback
@given(st.lists(st.floats(0, 300), max_size=80), st.integers(1, 5))
@settings(max_examples=100, deadline=None)
def test_limiter(times, most):
    times = sorted(times)
    ok = feedback.admit(times, 60, most)
    taken = []
    for t, accepted in zip(times, ok):
        assert accepted == (sum(t - x <= 60 for x in taken) < most)
        if accepted:
            taken.append(t)


def test_feedback_validation(spark):
    rows = spark.createDataFrame(
        [("useful", "edge", "E1", "A", "g1", None, None), ("nonsense", "edge", "E1", "A", "g1", None, None), ("useful", "page", "E1", "", "", None, None), ("useful", "edge", "GENE", "", "", None, None), ("useful", "gene", "GENE", "??", "bad version!", None, None), ("useful", "answer", "A", "", "", ["F1", "x"], "elsewhere")],
        "category string, target_kind string, target_id string, focus_id string, graph_version string, fact_ids array<string>, answer_source string",
    ).withColumn("received_at", F.lit("t"))
    known, genes = spark.createDataFrame([("E1",), ("A",)], "id string"), spark.createDataFrame([("GENE",)], "label string")
    got = sorted((r.target_kind, r.target_id, r.focus_id, r.page_graph_version, r.fact_ids, r.answer_source) for r in feedback.validate(rows, known, genes, "g9").collect())
    assert got == [("answer", "A", "", "", ["F1"], ""), ("edge", "E1", "A", "g1", None, None), ("gene", "GENE", "", "", None, None)]


def test_rate_limit_stream_equals_batch(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, rng.choice("ab"), float(rng.randrange(200))) for i in range(120)]
    spark.createDataFrame(rows, "id bigint, k string, s double").withColumn("ts", F.timestamp_seconds("s")).coalesce(1).write.parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    want = {(r.id, r.accepted) for r in feedback.rate_limited(batch, "k", "ts", "id", 60, 5).collect()}
    try:
        import google.protobuf  # noqa: F401
    except ImportError:
        pytest.skip("the stateful runner needs protobuf")
    from weftgraph.streaming.limiter import limit_stream

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = limit_stream(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in")), "k", "ts", "id", 60, 5)
    q = stream.writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.id, r.accepted) for r in spark.table("limited").collect()} == want
