import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import cells, ontology, similarity
from weftgraph.plans import catalogue
from weftgraph.session import checkpoint_dir


@pytest.mark.parametrize("families", [3, None])
def test_cells_equal_the_chain_of_joins(spark, monkeypatch, families):
    monkeypatch.setattr(cells, "BLOCK_ROWS", 150)
    monkeypatch.setattr(cells, "RANGE_PAIRS", 100)
    rnd = random.Random(1)
    ents = [(e, f"s{e % families if families else e}", rnd.choice(["x", "y", None]), rnd.choice([f"t{e // 4}", None])) for e in range(1, 61)]
    d = spark.createDataFrame(ents, "entity bigint, scope string, role string, series string")
    links = spark.createDataFrame(sorted({(rnd.randrange(1, 61), f"g{int(rnd.paretovariate(0.7)) % 40}") for _ in range(260)} | {(e, "g0") for e in range(1, 61)}), "entity bigint, gene string")
    group = F.concat(F.lit("F:"), F.pmod(F.xxhash64("gene"), F.lit(9)))
    terms = links.select("entity", F.col("gene").alias("term")).union(links.select("entity", group.alias("term"))).distinct()
    scoring = links.where("pmod(xxhash64(entity, gene), 3) > 0")
    features = scoring.select("entity", group.alias("feature")).distinct()
    scopes = scoring.join(d, "entity").select(F.col("gene").alias("item"), "scope").union(scoring.select(F.col("gene").alias("item"), F.lit("cross")))
    weights = similarity.rarity(scoring.select(F.col("gene").alias("item"), group.alias("feature")).distinct(), scopes)
    genes = scoring.select("entity", F.col("gene").alias("feature"))
    series, roles = d.where("series is not null").select("entity", F.col("series").alias("feature")), d.where("role is not null").select("entity", F.col("role").alias("feature"))
    ic, es = ontology.information_content(terms), d.select("entity", "scope")
    want = similarity.relate(es, similarity.simgic(terms, ic), similarity.weighted_jaccard(features, es, weights), similarity.common_features(genes).select("a", "b").distinct(), series, roles)
    got = similarity.judged(cells.scored_pairs(d, cells.tokens(d, terms, ic, features, weights, genes, series)))
    plain = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.drop("scope").collect())
    assert plain(got) == plain(want) and got.count() > 300


def test_relations_of_many_pairs_write_little(spark, tmp_path):
    ids = spark.range(700).withColumn("disease_id", F.concat(F.lit("D:"), F.lpad(F.col("id").cast("string"), 4, "0")))
    ids.select("disease_id", F.lit("f").alias("family"), F.lit("l 1").alias("label"), F.lit("r").alias("panel_role")).write.parquet(f"{tmp_path}/disease_clusters.parquet")
    links = ids.where("id < 500").select("disease_id", F.lit("HOT1").alias("gene_symbol"))
    links = links.unionAll(ids.select("disease_id", F.concat(F.lit("G"), "id").alias("gene_symbol")))
    links.select("disease_id", "gene_symbol", F.lit(True).alias("used_for_scoring"), F.lit("x").alias("association_type")).write.parquet(f"{tmp_path}/cluster_disease_genes.parquet")
    folder = Path(checkpoint_dir(spark).removeprefix("file:"))
    size = lambda: sum(p.stat().st_size for p in folder.rglob("*") if p.is_file())
    before = size()
    pairs = catalogue.QUERIES["disease_relations"](spark, str(tmp_path)).count()
    assert pairs > 500 * 499 // 2 - 1 and size() - before < 5 * pairs
