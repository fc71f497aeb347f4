import random

import pytest

from weftgraph.llm import setjoin


def test_calibration_promises_what_it_says():
    for t in (0.5, 0.6, 0.8):
        for b in (10, 14, 18):
            m, head, whole = setjoin.calibrate(t, b, 0.999)
            rng = random.Random(1)
            p, hit = (1 - t) / 2, 0
            for _ in range(300):
                d = [rng.random() < p for _ in range(setjoin.BITS)]
                k = sum(d)
                same = 1.0
                for i in range(b):
                    same *= (setjoin.BITS - k - i) / (setjoin.BITS - i)
                hit += (1 - (1 - same) ** m) * (k <= whole) * (sum(d[: setjoin.HEAD]) <= head)
            assert hit / 300 > 0.99
    assert setjoin.calibrate(1.0, 12, 0.999) == (1, 0, 0)


def records(seed, n=250):
    rng = random.Random(seed)
    out = {}
    for i in range(n):
        base = [f"g{rng.randrange(400)}" for _ in range(rng.randrange(1, 25))]
        if out and rng.random() < 0.6:
            base = list(rng.choice(list(out.values())))
            for _ in range(rng.randrange(4)):
                if base and rng.random() < 0.5:
                    base.pop(rng.randrange(len(base)))
                else:
                    base.append(f"g{rng.randrange(400)}")
        out[f"k{i:03d}"] = base
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_all_pairs_equal_brute_force(spark, seed):
    recs = records(seed)
    sets = {k: set(v) for k, v in recs.items() if len(set(v)) >= 4}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}
    rows = [(k, g) for k, v in recs.items() for g in v] + [("k000", None), (None, "g1")] + [("k001", g) for g in recs["k001"]]
    df = spark.createDataFrame(rows, "key string, item string")
    pairs, members = setjoin.similar_records(df, 0.6, least=4, recall=0.9999)
    got = {tuple(r) for r in setjoin.record_pairs(pairs, members).collect()}
    assert got == want and len(want) > 50


def test_empty_and_single(spark):
    df = spark.createDataFrame([("a", str(i)) for i in range(5)], "key string, item string")
    for frame in (df, df.limit(0)):
        pairs, members = setjoin.similar_records(frame, 0.6)
        assert setjoin.record_pairs(pairs, members).count() == 0


def test_recall_on_the_data(spark):
    from weftgraph.llm.queries import ORACLE, p4_found
    import oracle

    con = oracle.connect("/root/testdata/sf0.01")
    ours, theirs = oracle.differences(spark, con, p4_found, ORACLE["p4_found"], "/root/testdata/sf0.01")
    assert ours == [] and theirs == []
