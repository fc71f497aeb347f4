"""Verdicts on answers and on a graph's known truths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.retrieval import abstains, forbidden_hits


def fits(fact: Column, selector: Column) -> Column:
    """Whether a fact (``map<string,string>``) has each text of a selector (a map as well) within the field it names."""
    return F.forall(F.map_entries(selector), lambda e: F.contains(F.lower(F.coalesce(F.element_at(fact, e["key"]), F.lit(""))), F.lower(e["value"])))


def _any_in(text: Column, terms: Column) -> Column:
    return F.exists(terms, lambda t: F.contains(F.lower(text), F.lower(t)))


def verdicts(cases: DataFrame, forbidden: list[str] | None = None) -> DataFrame:
    """``cases`` with ``problems`` (the checks that failed, in order) and ``passed``.

    Columns: ``answer``; ``facts`` (sent, each a map with ``id``); ``fact_ids`` cited; ``switch_to`` asked for and
    ``switched`` offered; ``must_cite`` (selectors), ``must_mention``, ``defer_to``; ``abstain``; ``from_facts``. Null or
    empty requirements are no check. ``forbidden`` are patterns that no answer may state without a negation.
    """
    answer = F.translate(F.coalesce("answer", F.lit("")), "’‘", "''")
    cited = F.filter("facts", lambda f: F.array_contains("fact_ids", f["id"]))
    asked = F.coalesce("switch_to", F.lit("")) != ""
    offered = F.coalesce(F.size("switched"), F.lit(0)) > 0
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    selected = F.forall("must_cite", lambda s: F.exists(cited, lambda f: fits(f, s)))
    faults = [
        F.when(asked & ~F.coalesce(F.exists("switched", lambda x: F.contains(F.lower(x), F.lower("switch_to"))), F.lit(False)), "switch"),
        F.when(~asked & offered, "answers"),
        F.when(some("must_cite") & ~F.coalesce(selected, F.lit(False)), "cites"),
        F.when(some("must_mention") & ~_any_in(answer, F.col("must_mention")), "mentions"),
        F.when(F.coalesce("abstain", F.lit(False)) & ~(F.coalesce(~F.col("from_facts"), F.lit(False)) | abstains(answer)), "abstains"),
        F.when(some("defer_to") & ~_any_in(answer, F.col("defer_to")), "defers"),
    ]
    rows = cases
    if forbidden:
        rows = forbidden_hits(rows, "answer", forbidden, "__hit")
        faults.append(F.when(F.col("__hit").isNotNull(), "forbidden"))
    out = rows.withColumn("problems", F.array_compact(F.array(*faults)))
    return out.select(*cases.columns, "problems", (F.size("problems") == 0).alias("passed"))


def same_version(facts: Column, graph: Column) -> Column:
    """The version that facts and graph share; raises where they differ, as such answers cannot be judged."""
    return F.when(facts.eqNullSafe(graph), graph).otherwise(F.raise_error(F.concat(F.lit("facts are of graph "), F.coalesce(facts, F.lit("?")), F.lit(", the graph is "), F.coalesce(graph, F.lit("?")))).cast("string"))


def together(groups: DataFrame, assignment: DataFrame) -> DataFrame:
    """``name, ok, detail``: whether all members of each group (``name, member``) are in one cluster of ``assignment``
    (``member, cluster``); a member without a cluster fails it. ``detail`` has the number of clusters."""
    rows = groups.join(assignment.select("member", "cluster").distinct(), "member", "left")
    out = rows.groupBy("name").agg(F.count_distinct("cluster").alias("n"), F.count_if(F.col("cluster").isNull()).alias("none"))
    return out.select("name", ((F.col("n") == 1) & (F.col("none") == 0)).alias("ok"), F.col("n").cast("string").alias("detail"))


def all_known(lists: DataFrame, known: DataFrame) -> DataFrame:
    """``name, ok, missing``: whether every item of a list (``name, item``) is in ``known`` (``item``)."""
    found = lists.join(known.select("item").distinct().withColumn("k", F.lit(True)), "item", "left")
    return found.groupBy("name").agg((F.count_if(F.col("k").isNull()) == 0).alias("ok"), F.count_if(F.col("k").isNull()).alias("missing"))
