import datetime as dt

import pytest
from pyspark.sql import functions as F

from weftgraph.operators.orphans import orphan_references, orphan_report, parents

DAY = dt.datetime(2025, 1, 1)
at = lambda n: None if n is None else DAY + dt.timedelta(days=n)


def frames(spark, refs, par, dead):
    r = spark.createDataFrame([(i, k, at(t), "v1") for i, k, t in refs], "id bigint, k string, t timestamp_ntz, period string")
    p = spark.createDataFrame([(k, at(t)) for k, t in par], "k string, seen timestamp_ntz")
    d = spark.createDataFrame([(k, at(t)) for k, t in dead], "old_id string, retired_at timestamp_ntz")
    return r, p, d


def found(spark, refs, par, dead=(), **kw):
    r, p, d = frames(spark, refs, par, dead)
    out = orphan_references(r, "id", "k", parents(p, "k", "seen", d), at="t", period=F.col("period"), **kw)
    return sorted((x.ref_id, x.reason) for x in out.collect())


def test_reasons_and_spelling(spark):
    refs = [(1, " mondo_1 ", 5), (2, "MONDO:2", 5), (3, "MONDO:3", 5), (4, "MONDO:4", 5), (5, "-", 5), (6, "", 5), (7, None, 5), (8, "MONDO:9", None), (9, "MONDO:3", None), (None, "MONDO:8", 1)]
    par = [("MONDO:1", 5), ("Mondo:2\t", 6), ("MONDO:3", 9), ("MONDO:3", 1), ("MONDO:4", 0), (None, 0)]
    assert found(spark, refs[:-1], par, [("mondo_4", 5), ("MONDO:3", 6)]) == [(2, "arrives_later"), (4, "retired"), (8, "missing")]
    assert (None, "missing") in [(x, y) for x, y in found(spark, refs[-1:], par)]


def test_empty_tables(spark):
    assert found(spark, [], [("A", 1)]) == []
    assert found(spark, [(1, "A", 1), (2, "B", 1)], []) == [(1, "missing"), (2, "missing")]


@pytest.mark.parametrize("range_keys,cell_rows", [(3, 10), (1000, 7), (5, 100_000)])
def test_against_brute_force_with_a_hot_key(spark, range_keys, cell_rows):
    refs = [(i, f"K{i % 40}" if i % 3 else "K7", i % 11) for i in range(300)]
    par = [(f"k{i}", i % 9) for i in range(0, 40, 2)] + [("K7", 3)]
    dead = [(f"K{i}", i % 10) for i in range(0, 40, 5)]
    born, gone = {}, {}
    for k, t in par:
        born[k.upper()] = min(t, born.get(k.upper(), 99))
    for k, t in dead:
        gone[k] = t
    want = sorted(i for i, k, t in refs if k not in born or born[k] > t or gone.get(k, 99) <= t)
    assert [i for i, _ in found(spark, refs, par, dead, range_keys=range_keys, cell_rows=cell_rows)] == want


def test_report_and_clashing_columns(spark):
    r = spark.createDataFrame([(1, "A", 1, 2, 3)], "id bigint, k string, r int, cell int, at int")
    p = spark.createDataFrame([("B", "x")], "k string, ks string")
    out = orphan_references(r, "id", "k", parents(p, "k", None))
    assert [tuple(x) for x in orphan_report(out).collect()] == [(None, "missing", 1)]


def test_large_ids_beside_null_ones(spark):
    refs = [(9007199254740993, "A", 1), (None, "A", 1), (9223372036854775807, "B", 1), (4, "C", 1)]
    r, p, d = frames(spark, refs, [("C", 0)], [])
    got = [(x.ref_id, x.period) for x in orphan_references(r, "id", "k", parents(p, "k", "seen", d), at="t", period=F.col("period")).collect()]
    assert sorted(got, key=str) == sorted([(9007199254740993, "v1"), (None, "v1"), (9223372036854775807, "v1")], key=str)


def test_ranges_in_two_steps_and_sub_ranges(spark, monkeypatch):
    from weftgraph.operators import orphans

    par = [(f"K{i:04d}", 0) for i in range(0, 1200, 2)]
    refs = [(i, f"K{i:04d}", 5) for i in range(1200)] + [(2000 + i, "K0001", 5) for i in range(500)]
    want = [i for i in range(1, 1200, 2)] + [2000 + i for i in range(500)]
    for ranges in (4096, 3):  # 300 bounds in two steps, and three ranges cut by a hash of the key
        monkeypatch.setattr(orphans, "RANGES", ranges)
        assert [i for i, _ in found(spark, refs, par, range_keys=2, cell_rows=40)] == want
