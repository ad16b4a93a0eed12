"""Findings of round 2: whole results without products, quadratic joins or training in the driver."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recmill.models import factor, linear
from recmill.models.knn import AssociationScorer, ItemKNNScorer, UserKNNScorer
from recmill.models.linear import SLIMScorer
from recmill.operators import held, lists
from recmill.plans.pipeline import topn_pipeline
from recmill.session import cut


def test_candidate_counts_without_the_product(spark):
    seen = spark.createDataFrame([(1, 5), (1, 6), (1, 7), (2, 5), (2, 99), (None, 5), (4, None)], "user_id int, item_id int")
    users, items = spark.createDataFrame([(1,), (2,), (2,), (3,), (None,), (4,)], "user_id int"), spark.createDataFrame([(5,), (6,), (7,), (None,)], "item_id int")
    for given in (seen, None):
        for some in (items, items.where("item_id is not null"), items.limit(0)):
            want = lists.candidates(users, some, given).groupBy("user_id").agg(F.count("*").alias("n"))
            assert sorted(map(str, lists.candidate_counts(users, some, given).collect())) == sorted(map(str, want.collect()))
    many = spark.range(300_000).select(F.col("id").alias("user_id")), spark.range(300_000).select(F.col("id").alias("item_id"))
    assert lists.candidate_counts(*many, None).agg(F.sum("n")).first()[0] == 90_000_000_000


#: Models that are trained in one task, by query.
TRAINED = {
    "flexmf_warp": lambda: factor.FlexMFImplicitScorer(preset="warp", embedding_size=4, epochs=2, batch_size=32),
}


@pytest.fixture(scope="module")
def log(spark):
    rng = np.random.default_rng(5)
    return spark.createDataFrame([(u, i, float(rng.integers(1, 6))) for u in range(30) for i in range(20) if rng.random() < 0.4], "user_id int, item_id int, rating double")


@pytest.mark.parametrize("name", TRAINED)
def test_nothing_is_trained_in_the_driver(spark, log, name, monkeypatch):
    def refuse(*_, **__):
        raise AssertionError("rows went through the driver")

    monkeypatch.setattr(type(log), "toPandas", refuse)
    monkeypatch.setattr(type(log), "toArrow", refuse)
    monkeypatch.setattr(type(spark), "createDataFrame", refuse)
    s = TRAINED[name]().train(log)
    got = s.score(log).collect()
    assert len(got) == log.count() and all(np.isfinite(r["score"]) for r in got)
    assert {r["user_id"] for r in s.tables["user"].select("user_id").collect()} == {r["user_id"] for r in got}
    monkeypatch.setattr(factor, "MAX_CELLS", len(got) - 1)
    with pytest.raises(ValueError, match="use ALS"):
        TRAINED[name]().train(log)


def test_adam_in_steps():
    rng = np.random.default_rng(2)
    a, at = rng.standard_normal((50, 3)), np.array([3, 8, 41])
    opt, want, m, v = factor.Adam({"a": a.copy()}, 0.1, 0.02, 0.3), a.copy(), 0.0, 0.0
    for t in range(1, 4):
        rows = rng.standard_normal((3, 3))
        g = 0.3 * want / 50
        g[at] += rows
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        want = want - 0.1 * (m / (1 - 0.9**t) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8) + 0.02 * want)
        factor.STEP_CELLS, old = 21, factor.STEP_CELLS
        opt.step({"a": (at, rows)})
        factor.STEP_CELLS = old
    assert opt.p["a"] == pytest.approx(want, abs=1e-12)


NEAR = {
    "item_knn_implicit": lambda: ItemKNNScorer(feedback="implicit", max_nbrs=3),
    "item_knn": lambda: ItemKNNScorer(max_nbrs=3, min_nbrs=2),
    "user_knn": lambda: UserKNNScorer(max_nbrs=3),
    "user_knn_implicit": lambda: UserKNNScorer(feedback="implicit", max_nbrs=3),
    "association": AssociationScorer,
    "association_lift": lambda: AssociationScorer(method="lift", damping=0.5),
    "association_max": lambda: AssociationScorer(max_nbrs=1),
}


@pytest.mark.parametrize("name", NEAR)
def test_neighbours_from_held_cells(spark, log, name, monkeypatch):
    """The same scores as by joins, with a plan in which no pairs of items or users are joined."""
    asked = spark.createDataFrame([(u, i) for u in range(0, 33, 2) for i in range(22)] + [(2, 3), (None, 3), (2, None)], "user_id int, item_id int")
    s = NEAR[name]().train(log)
    got = s.score(asked)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and not any(x in plan for x in ("sims-", "rules-", "_kl"))
    monkeypatch.setattr(held, "MAX_HELD", 0)
    want = NEAR[name]().train(log).score(asked)
    assert "MapInArrow" not in want._jdf.queryExecution().optimizedPlan().toString()
    key = lambda r: str((r["user_id"], r["item_id"]))
    a, b = (sorted(x.collect(), key=key) for x in (got, want))
    assert [tuple(r)[:2] for r in a] == [tuple(r)[:2] for r in b] and any(r["score"] is not None for r in a)
    for x, y in zip(a, b, strict=True):
        assert y["score"] is not None and x["score"] == pytest.approx(y["score"], rel=1e-5) if x["score"] is not None else y["score"] is None
        assert "nbr_count" not in got.columns or x["nbr_count"] == y["nbr_count"]


@pytest.mark.parametrize(("damping", "lift", "top"), [(0.0, False, False), (0.5, True, False), (0.0, False, True)])
@pytest.mark.parametrize(("rows", "shared"), [(1, 1), (6, 1), (6, 99), (50, 2)])
def test_best_by_rules(damping, lift, top, rows, shared, monkeypatch):
    """The best unseen items of the definition, whatever part of the rules is kept in sorted rows."""
    rng = np.random.default_rng(rows)
    x = (rng.random((60, 50)) < np.r_[[0.6, 0.5, 0.3], np.full(37, 0.05), np.full(10, 0.01)]).astype(float)
    u, i = np.nonzero(x)
    cells = held.Cells(pa.table({"user_id": (u * 2).astype(np.int32), "item_id": (i * 3).astype(np.int32)}), ())
    monkeypatch.setattr(held, "ROW_BYTES", rows * 8 * len(cells.items))
    monkeypatch.setattr(held.BestByRules, "SHARED", shared)
    x = x[np.ix_(cells.users // 2, cells.items // 3)]
    together, n = x.T @ x, x.sum(0)
    np.fill_diagonal(together, 0)
    rules = together / (n[:, None] + damping) * (len(x) / (n[None, :] + damping) if lift else 1)
    ids = np.append(cells.users, 9_999).astype(np.int32)
    users, items = held.BestByRules(cells, 4, damping, lift, top)(ids)
    for row, user in enumerate(ids[:-1]):
        score = ((x[row][:, None] * rules).max(0) if top else x[row] @ rules / x[row].sum()).astype(np.float32)
        fresh = np.flatnonzero(x[row] == 0)
        assert items[users == user].tolist() == cells.items[fresh[np.lexsort((fresh, -score[fresh]))[:4]]].tolist()
    assert items[users == 9_999].tolist() == cells.items[:4].tolist()


def test_recommendations_join_no_rules(spark, log, monkeypatch):
    asked = spark.createDataFrame([(u,) for u in range(33)], "user_id int")

    def run():
        p = topn_pipeline(AssociationScorer(), 5)
        p.train(log)
        return p.run("recommender", query=asked).select("user_id", "item_id", "rank")

    got = run()
    assert "_kl" not in got._jdf.queryExecution().optimizedPlan().toString() and "rules" not in got._jdf.queryExecution().optimizedPlan().toString()
    got = sorted(map(tuple, got.collect()))
    monkeypatch.setattr(held, "MAX_HELD", 0)
    assert got == sorted(map(tuple, run().collect())) and len(got) > 100


@pytest.mark.parametrize(("most", "many", "step"), [(0, 0, 64), (3, 9, 2), (99, 0, 1)])
@pytest.mark.parametrize("explicit", [True, False])
def test_users_near(most, many, step, explicit, monkeypatch):
    """The nearest users of the definition, whichever items have dense columns."""
    rng = np.random.default_rng(most)
    u, i = np.nonzero(rng.random((60, 25)) < np.r_[[0.7, 0.5, 0.4], np.full(22, 0.12)])
    c = rng.integers(-2, 3, len(u)).astype(float) if explicit else np.ones(len(u))
    norm = np.sqrt(np.bincount(u, c * c, 60))[u]
    cells = held.Cells(pa.table({"user_id": u, "item_id": i, "u": c / np.maximum(norm, 1e-38), "c": c}), ("u", "c"))
    for k, v in (("MOST", most), ("MANY", many), ("STEP", step)):
        monkeypatch.setattr(held.UsersNear, k, v)
    x, value = np.zeros((60, 25)), np.full((60, 25), np.nan)
    x[u, i], value[u, i] = c / np.maximum(norm, 1e-38), c
    x, value = x[cells.users], value[cells.users]
    near = held.UsersNear(cells, 1e-6, 4)
    for user in range(len(cells.users)):
        sim = x @ x[user]
        sim[user] = 0
        seg, got, votes = near(user, np.arange(25))
        for item in range(25):
            there = np.flatnonzero(~np.isnan(value[:, item]) & (sim >= 1e-6))
            want = there[np.lexsort((there, -sim[there].round(12)))[:4]]
            assert got[seg == item] == pytest.approx(sim[want], abs=1e-9)
            if explicit is False or len(set(sim[there].round(9))) == len(there):
                assert votes[seg == item].tolist() == value[want, item].tolist()
    assert not near.sums.any()


def test_few_ids_in_many_tasks(spark):
    """Ids that are partitioned and few are still spread over all parts."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cells = cut(spark.range(400).select(F.col("id").alias("user_id"), F.lit(1).alias("item_id")), "cells")
    got = held.over_keys(spark.range(400).selectExpr("id as user_id").distinct(), "user_id long, n long", lambda _: lambda ids: [ids, np.full(len(ids), len(ids))], cells._recmill_path)
    rows = got.collect()
    assert sorted(r["user_id"] for r in rows) == list(range(400))
    assert sum(1 / r["n"] for r in rows) == pytest.approx(parts)


def test_slim_from_held_cells(spark, monkeypatch):
    """The same weights as by joins, without a table of items that occur together."""
    rng = np.random.default_rng(8)
    x = rng.random((70, 24)) < np.r_[[0.7, 0.5, 0.4], np.full(21, 0.15)]
    log = spark.createDataFrame([(int(u), int(i) * 2) for u, i in zip(*np.nonzero(x), strict=True)], "user_id int, item_id int")
    weights = lambda s: {(r["ref"], r["item_id"]): r["w"] for r in s.train(log).tables["weights"].collect()}
    cut_as = []
    monkeypatch.setattr(linear, "cut", lambda df, name: cut_as.append(name) or cut(df, name))
    got = weights(SLIMScorer(max_nbrs=6))
    assert cut_as == ["history", "weights"]
    monkeypatch.setattr(held, "MAX_HELD", 0)
    want = weights(SLIMScorer(max_nbrs=6))
    assert len(got) > 30 and got.keys() == want.keys() and list(got.values()) == pytest.approx([want[k] for k in got], abs=1e-9)
    # and with columns of who has the most frequent items
    monkeypatch.setattr(linear.SLIMHeld, "MANY", 12)
    monkeypatch.setattr(linear.SLIMHeld, "GROUP", 5)
    u, i = np.nonzero(x)
    ref, item, w = linear.SLIMHeld(held.Cells(pa.table({"user_id": u, "item_id": i * 2}), ()), SLIMScorer(max_nbrs=6).config)(np.unique(i * 2))
    assert dict(zip(zip(ref.tolist(), item.tolist(), strict=True), w, strict=True)) == pytest.approx(want, abs=1e-9)
