"""Pairs within groups and joins of which one key holds half of all rows."""

from collections import Counter
from itertools import combinations

import numpy as np
import pandas as pd
import pytest

from recmill.operators import pairs as pr
from recmill.operators import stats


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(5)
    rows = {(0, int(i)) for i in rng.choice(500, 150, replace=False)} | {(int(g), int(i)) for g, i in zip(rng.integers(1, 30, 150), rng.integers(0, 500, 150), strict=True)}
    return sorted(rows), spark.createDataFrame(sorted(rows), "g int, i int")


def _wanted(rows):
    groups = {}
    for g, i in rows:
        groups.setdefault(g, []).append(i)
    return Counter(p for items in groups.values() for p in combinations(sorted(items), 2))


@pytest.mark.parametrize("piece", [7, 40, 1000])
def test_group_pairs(skewed, piece):
    rows, df = skewed
    got = pr.group_pairs(df, "g", ["i"], piece).collect()
    assert Counter((min(r["i_l"], r["i_r"]), max(r["i_l"], r["i_r"])) for r in got) == _wanted(rows)
    assert pr.group_pairs(df.where("false"), "g", ["i"], piece).count() == 0


def test_side_pairs(spark, skewed):
    rows, df = skewed
    other = df.selectExpr("g", "i as j").unionByName(spark.createDataFrame([(None, 1)], "g int, j int"))
    got = Counter(map(tuple, pr.side_pairs(df, other, "g", ["i"], ["j"], 11).collect()))
    by = {}
    for g, i in rows:
        by.setdefault(g, []).append(i)
    assert got == Counter((g, i, j) for g, items in by.items() for i in items for j in items)


def test_join_groups(spark, skewed, monkeypatch):
    _, df = skewed
    groups = df.groupBy("g").count()
    want = sorted(map(tuple, df.join(groups, "g").collect()))
    assert sorted(map(tuple, pr.join_groups(df, groups, ["g"], "count").collect())) == want
    monkeypatch.setattr(pr, "BROADCAST_ROWS", 2)
    monkeypatch.setattr(pr, "HOT_ROWS", 50)
    assert sorted(map(tuple, pr.join_groups(df, groups, ["g"], "count").collect())) == want


def test_cooccurrence_of_hot_group(spark, skewed, monkeypatch):
    rows, df = skewed
    monkeypatch.setattr(pr, "PIECE_ROWS", 9)
    got = {(r["item_a"], r["item_b"]): r["n"] for r in stats.cooccurrence(df, "g", "i").collect()}
    want = _wanted(rows)
    assert {k: n for k, n in got.items() if k[0] < k[1]} == dict(want) and len(got) == 2 * len(want)
    log = [(g, i % 5, k % 3) for k, (g, i) in enumerate(rows)]
    ordered = {(r["item_a"], r["item_b"]): r["n"] for r in stats.ordered_cooccurrence(spark.createDataFrame(log, "g int, i int, o int"), "g", "i", ["o"]).collect()}
    brute = Counter()
    by = {}
    for g, i, o in log:
        by.setdefault(g, []).append((o, i))
    for items in by.values():
        for (_, a), (_, b) in combinations(sorted(items), 2):
            brute[a, b] += 1
    assert ordered == dict(brute)


def test_value_stats(spark):
    pdf = pd.DataFrame({"k": ["a"] * 7 + ["b"] * 4 + [None] * 2, "v": [3.0, 1, 2, None, 9, float("nan"), 4, 5, 5, 1, 2, 7, 8]})
    df = spark.createDataFrame([(k, None if v is None else float(v)) for k, v in zip(pdf["k"], pdf["v"], strict=True)], "k string, v double")
    got = {r["k"]: r for r in stats.value_stats(df, "v", ["k"]).collect()}
    assert got["a"]["median"] == 3 and got["b"]["median"] == 3.5 and got[None]["median"] == 7.5 and got["a"]["n"] == 5
    assert stats.value_stats(df, "v").first()["median"] == 4
    assert stats.value_stats(df.where("false"), "v").first()["median"] is None
