from weftgraph.plans import catalogue
from weftgraph.session import table


def test_entities_are_the_diseases_of_the_project(spark, data):
    pairs = catalogue.QUERIES["disease_gene_pairs"](spark, data)
    named = pairs.select("a").union(pairs.select("b")).distinct()
    assert named.join(table(spark, data, "cluster_disease_genes").selectExpr("disease_id as a").distinct(), "a", "left_anti").count() == 0
    assert named.count() > 25 and pairs.where("a >= b or score <= 0 or score > 1").count() == 0
