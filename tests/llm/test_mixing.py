import math
import random

import pytest

from weftgraph.llm import mixing

TARGETS = [("a", 0.5, 2), ("b", 0.3, 4), ("c", 0.2, 1)]


def frames(spark, docs, targets=TARGETS):
    return spark.createDataFrame(docs, "id bigint, source string, size bigint"), spark.createDataFrame(targets, "source string, target_share double, max_repeats bigint")


def corpus(n=3000, seed=3):
    rng = random.Random(seed)
    return [(i, rng.choice("aaaaabbccccccccd") if i % 50 else None, int(rng.lognormvariate(5, 1))) for i in range(n)]


def test_shares_and_caps(spark):
    docs, targets = frames(spark, corpus())
    mixed = mixing.mix(docs, targets)
    got = {r.source: r for r in mixing.shares(mixed, targets).collect()}
    for s, share, most in TARGETS:
        assert abs(got[s].reached_share - share) < 0.001 and got[s].most_copies <= most
    rows = mixed.collect()
    assert len({r.id for r in rows}) == len(rows) and {r.source for r in rows} == {"a", "b", "c"}
    assert mixing.repeat(mixed).count() == sum(r.copies for r in rows)


def test_plan_solves_the_dual(spark):
    rows = corpus()
    docs, _ = frames(spark, rows)
    state = mixing.plan(docs.where("source in ('a','b','c')").selectExpr("source", "size", "1 n"), {s: (x, m) for s, x, m in TARGETS})
    for s, x in state.items():
        got = sum(z * (x["cap"] if x["full"] else min(x["cap"], math.exp(x["lambda"] * z / x["mean"]))) for _, t, z in rows if t == s)
        assert got == pytest.approx(x["budget"], rel=1e-6)


def test_hot_size_and_repeats(spark):
    docs = [(i, "a" if i % 3 else "b", 7) for i in range(2000)] + [(5000 + i, "c", 1 + i % 3) for i in range(4000)]
    d, t = frames(spark, docs)
    got = {r.source: r for r in mixing.shares(mixing.mix(d, t), t).collect()}
    assert all(abs(got[s].reached_share - x) < 0.002 for s, x, _ in TARGETS)


def test_nulls_missing_sources_and_empty_tables(spark):
    d, t = frames(spark, [(1, "a", 10), (2, None, 5), (3, "zz", 5), (4, "a", None), (5, "a", 0)])
    rows = {r.id: r.copies for r in mixing.mix(d, t).collect()}
    assert set(rows) == {1, 4, 5} and all(v <= 2 for v in rows.values())
    assert mixing.mix(d.limit(0), t).count() == 0 and mixing.mix(d, t.limit(0)).count() == 0
    report = {r.source: r for r in mixing.shares(mixing.mix(d, t), t).collect()}
    assert report["a"].reached_share == 1.0 and report["b"].tokens == 0
    assert all(r.reached_share == 0 for r in mixing.shares(mixing.mix(d.limit(0), t), t).collect())


def test_total(spark):
    d, t = frames(spark, corpus())
    got = mixing.shares(mixing.mix(d, t, total=20_000), t).collect()
    assert abs(sum(r.tokens for r in got) - 20_000) < 300
