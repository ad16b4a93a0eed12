import itertools
import math

import numpy as np
import pytest

from recmill.llm import setjoin
from recmill.llm.setjoin import distinct_sets, expand_pairs, plan_forest, similar_sets


def _families(rng, families: int, size: int) -> list[list[int]]:
    """Crowds of sets that differ in a few members."""
    out = []
    for f in range(families):
        core = rng.choice(5_000, 30, replace=False) + 10_000 * f
        for _ in range(size):
            keep = core[rng.random(30) > 0.12]
            out.append(sorted({int(x) for x in keep} | {int(x) for x in rng.integers(0, 10**12, 3)}))
    return out


def _brute(sets, t):
    return {(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if len(set(sets[a]) & set(sets[b])) >= t * len(set(sets[a]) | set(sets[b]))}


@pytest.mark.parametrize("t", [0.5, 0.75])
def test_crowded_neighbourhoods(spark, monkeypatch, t):
    """Crowds that deepen, are cut in mid-run and go through a second round lose no pair beyond the stated chance."""
    monkeypatch.setattr(setjoin, "CROWD", 4)
    monkeypatch.setattr(setjoin, "HELD", 60)
    monkeypatch.setattr(setjoin, "TARGET_RECALL", 0.99)
    sets = _families(np.random.default_rng(2), 4, 30) + [list(range(k, k + 9)) for k in range(0, 2_000, 40)]
    df = spark.createDataFrame(list(enumerate(sets)), "id int, m array<long>")
    s, _ = distinct_sets(df, "id", "m")
    got = {(r["a"], r["b"]) for r in similar_sets(s, t, 0.99).collect()}
    want = _brute(sets, t)
    # at most the stated chance of 0.01 for each pair, and its spread
    assert got <= want and len(want) > 100 and len(want - got) <= 0.01 * len(want) + 3.5 * math.sqrt(0.01 * len(want))


def test_recall_at_threshold(spark):
    """Pairs exactly at a threshold are found with the planned chance."""
    rng = np.random.default_rng(4)
    sets = []
    for k in range(600):
        both = rng.integers(10**6 * k, 10**6 * (k + 1), 10).tolist()
        sets += [both + list(range(-10 * k - 5, -10 * k)), both + list(range(-10 * k - 10, -10 * k - 5))]
    df = spark.createDataFrame(list(enumerate(sets)), "id int, m array<long>")
    s, _ = distinct_sets(df, "id", "m")
    want = {(2 * k, 2 * k + 1) for k in range(600) if len(set(sets[2 * k]) & set(sets[2 * k + 1])) * 2 >= len(set(sets[2 * k]) | set(sets[2 * k + 1]))}
    assert len(want) > 590 and len({(r["a"], r["b"]) for r in similar_sets(s, 0.5).collect()} & want) >= len(want) - 3


def test_plan():
    for t in (0.3, 0.5, 0.75, 0.9375, 1.0):
        depth, trees = plan_forest(t)
        assert t == 1 or (1 - t**depth) ** trees <= 1 - setjoin.TARGET_RECALL


def test_odd_sets(spark):
    rows = [(1, [1, 2, 2, None]), (2, [2, 1]), (3, []), (4, None), (None, [1, 2]), (5, [1, 2]), (5, [1, 2]), (6, [None]), (7, list(range(3_000)))]
    df = spark.createDataFrame(rows, "id int, members array<int>").selectExpr("*", "'clash' as h")
    s, copies = distinct_sets(df, "id", "members")
    assert {(r["id"], r["n"]) for r in s.collect()} == {(1, 2), (7, 3_000)}
    assert sorted((r["id"], r["record"]) for r in copies.collect()) == [(1, 1), (1, 2), (1, 5), (7, 7)]
    assert {(r["record_a"], r["record_b"]) for r in expand_pairs(similar_sets(s, 0.9), copies).collect()} == {(1, 2), (1, 5), (2, 5)}
    empty, none = distinct_sets(df.where("false"), "id", "members")
    assert similar_sets(empty, 0.5).count() == 0 and none.count() == 0
