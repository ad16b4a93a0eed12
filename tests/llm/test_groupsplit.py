from collections import Counter, defaultdict

import numpy as np
import pytest

from recmill.llm import groupsplit as gs

SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}


@pytest.fixture(scope="module")
def rows(spark):
    """Groups of very uneven sizes that each keep to a few neighbouring labels; one group has a sixth of all rows."""
    rng = np.random.default_rng(21)
    out = []
    for g in range(1_500):
        centre = rng.integers(0, 12)
        out += [(g, int((centre + x) % 12)) for x in rng.integers(0, 3, 1 + int(rng.pareto(1.2) * 4) % 200)]
    out += [(9_999, int(x)) for x in rng.integers(0, 12, len(out) // 5)]
    return out, spark.createDataFrame(out, "g int, l int").withColumnRenamed("l", "label").selectExpr("*", "'clash' as split", "1 as h")


def _deviation(rows, split):
    have, total = Counter(), Counter()
    for g, x in rows:
        have[split[g], x] += 1
        total[x] += 1
    off = {(s, x): have[s, x] - share * total[x] for x in total for s, share in SHARES.items()}
    squared = sum(v**2 / total[x] for (_, x), v in off.items())
    return max(abs(v) / total[x] for (_, x), v in off.items()), squared, Counter(split[g] for g, _ in rows)


def test_shares_of_every_label(rows, monkeypatch):
    pairs, df = rows
    got = gs.assign_splits(df, "g", "label", SHARES).collect()
    split = {r["g"]: r["split"] for r in got}
    assert len(got) == len(split) == len({g for g, _ in pairs})
    worst, squared, sizes = _deviation(pairs, split)
    assert worst < 0.02 and all(abs(sizes[s] / len(pairs) - share) < 0.01 for s, share in SHARES.items())
    monkeypatch.setattr(gs, "MOVE_ROUNDS", 0)
    _, plain, _ = _deviation(pairs, {r["g"]: r["split"] for r in gs.assign_splits(df, "g", "label", SHARES).collect()})
    assert squared < plain / 2
    again = {r["g"]: r["split"] for r in gs.assign_splits(df.repartition(3), "g", "label", SHARES).collect()}
    assert again == {r["g"]: r["split"] for r in gs.assign_splits(df, "g", "label", SHARES).collect()}


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (1, 2), (None, 2), (2, None)], "g int, l int")
    assert sorted(r["g"] for r in gs.assign_splits(df, "g", "l", SHARES).collect()) == [1, 2]
    assert gs.assign_splits(df.where("false"), "g", "l", SHARES).count() == 0


def test_too_many_labels(spark, monkeypatch):
    monkeypatch.setattr(gs, "MAX_LABELS", 3)
    with pytest.raises(ValueError):
        gs.assign_splits(spark.createDataFrame([(i, i) for i in range(5)], "g int, l int"), "g", "l", SHARES)


def test_labels_against_union_find(spark, monkeypatch):
    """Components of a random graph with an entity that a third of the records share, with and without broadcasts."""
    from recmill.operators import pairs as pr

    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in zip(rng.integers(0, 900, 700), rng.integers(0, 800, 700), strict=True)] + [(r, 5_000) for r in range(0, 900, 3)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for r, e in edges:
        parent[root(("e", e))] = root(("r", r))
    least = defaultdict(list)
    for r, _ in edges:
        least[root(("r", r))].append(r)
    degree = Counter(e for _, e in set(edges))
    want = {r: min(v) for v in least.values() for r in v}
    df = spark.createDataFrame([*edges, (None, 1), (3, None)], "record int, entity long")
    for rows_ in (pr.BROADCAST_ROWS, 5):
        monkeypatch.setattr(pr, "BROADCAST_ROWS", rows_)
        monkeypatch.setattr(pr, "HOT_ROWS", 50)
        got = {r["record"]: r["label"] for r in gs.min_labels(df).collect()}
        assert all(got[r] == want[r] for r in got) and set(got) == {r for r, e in edges if degree[e] > 1}


def test_shared_events_of_a_crowd(spark):
    """Pairs with five equal events among users of whom half share one event."""
    rng = np.random.default_rng(3)
    events = {(u, 0) for u in range(0, 200, 2)} | {(int(u), int(e)) for u, e in zip(rng.integers(0, 200, 3_000), rng.integers(1, 90, 3_000), strict=True)}
    by = defaultdict(set)
    for u, e in events:
        by[u].add(e)
    want = {(a, b) for a in by for b in by if a < b and len(by[a] & by[b]) >= 5}
    df = spark.createDataFrame(sorted(events) + [(1, None)], "u int, e int")
    got = [tuple(r) for r in gs.shared_event_pairs(df, "u", ["e"]).collect()]
    assert set(got) == want and len(got) == len(set(got))
