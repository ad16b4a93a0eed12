"""Pipelines: candidates without a product, histories of new users, typed and lazy inputs, saving."""

import numpy as np
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recmill.models.als import BiasedMFScorer, ImplicitMFScorer
from recmill.models.basic import BiasScorer, PopScorer
from recmill.models.knn import AssociationScorer, ItemKNNScorer, UserKNNScorer
from recmill.models.linear import EASEScorer, SLIMScorer
from recmill.plans.pipeline import Component, Lazy, PipelineBuilder, PipelineError, accepts, topn_builder, topn_pipeline
from recmill.plans.store import load_pipeline, save_pipeline


@pytest.fixture(scope="module")
def log(spark):
    rng = np.random.default_rng(12)
    cells = {(int(u), int(i)) for u, i in zip(rng.integers(0, 30, 400), (rng.pareto(1, 400) * 3).astype(int) % 40, strict=True)}
    return spark.createDataFrame([(u, i, float(rng.integers(1, 11)) / 2) for u, i in sorted(cells)], "user_id int, item_id int, rating double").repartition(3)


def _lists(df):
    return sorted((r["user_id"], r["rank"], r["item_id"]) for r in df.collect())


@pytest.mark.parametrize("make", [PopScorer, lambda: PopScorer(score="count"), AssociationScorer, ItemKNNScorer, lambda: SLIMScorer(max_nbrs=10), EASEScorer, lambda: BiasedMFScorer(embedding_size=4, epochs=2), lambda: ImplicitMFScorer(embedding_size=4, epochs=2)], ids=["pop", "count", "rules", "item-knn", "slim", "ease", "als", "implicit"])
def test_reach_holds_the_best(spark, log, make):
    """Lists from reachable candidates equal those from the product of users and items."""
    p = topn_pipeline(make(), 7)
    p.train(log)
    users = log.select("user_id").distinct()
    fast = p.run("recommender", query=users)
    assert "Cartesian" not in fast._jdf.queryExecution().executedPlan().toString() and "BroadcastNestedLoop" not in p.run("candidate-selector", query=users)._jdf.queryExecution().executedPlan().toString()
    p.nodes["candidate-selector"].value.scorer = None
    assert _lists(fast) == _lists(p.run("recommender", query=users))


def test_history_of_new_users(spark, log):
    """A history that comes with the query reaches scorers and candidates."""
    past = spark.createDataFrame([(900, 0, 5.0), (900, 1, 4.5), (900, 2, 1.0)], "user_id int, item_id int, rating double")
    users = spark.createDataFrame([(900,), (3,)], "user_id int")
    for make in (AssociationScorer, ItemKNNScorer, UserKNNScorer, lambda: BiasedMFScorer(embedding_size=4, epochs=2)):
        p = topn_pipeline(make(), 5)
        p.train(log)
        cold = p.run("scorer", query=users.where("user_id = 900"), past=None)
        warm = p.run("recommender", query=users, past=past)
        assert {r["user_id"] for r in warm.collect()} == {900, 3}
        got = {r["item_id"]: r["score"] for r in p.run("scorer", query=users.where("user_id = 900"), past=past).collect()}
        assert not set(got) & {0, 1, 2}
        assert got != {r["item_id"]: r["score"] for r in cold.collect()} and any(v is not None for v in got.values())
    b = topn_builder(PopScorer(), 5, fallback=BiasScorer()).build()
    b.train(log)
    kind = past.withColumn("rating", F.lit(5.0))
    high, low = (b.run("fallback-predictor", query=users.where("user_id = 900"), past=x).agg(F.avg("score")).first()[0] for x in (kind, kind.withColumn("rating", F.lit(0.5))))
    assert high > low + 3


def test_save_and_load(spark, log, tmp_path):
    users = log.select("user_id").distinct()
    for k, make in enumerate((ItemKNNScorer, lambda: BiasedMFScorer(embedding_size=4, epochs=2))):
        p = topn_builder(make(), 5, fallback=BiasScorer()).build()
        p.train(log)
        save_pipeline(p, spark, str(tmp_path / f"p{k}"))
        again = load_pipeline(spark, str(tmp_path / f"p{k}"))
        assert _lists(again.run("recommender", query=users)) == _lists(p.run("recommender", query=users))
        assert again.builder.build_config()["meta"]["hash"] == p.builder.build_config()["meta"]["hash"]


def test_types_and_state():
    b = PipelineBuilder()
    n = b.create_input("n", int, None)
    b.create_input("x", float)
    b.add_component("double", lambda n: None if n is None else 2 * n, n=n)
    b.alias("twice", "double")
    b.default_component("double")
    p = b.build()
    got = p.run_all(n=3)
    assert got["twice"] == got["double"] == got.default_value == 6 and "twice" in got and "other" not in got
    assert p.run(n=None) is None
    with pytest.raises(PipelineError):
        p.run(n="three")
    assert accepts((float,), 2) and accepts((list[int],), [1]) and accepts((), object()) and not accepts((int, None), "x") and not accepts((DataFrame,), 1)
    assert PipelineBuilder.from_config({**b.build_config(), "components": {}, "aliases": {}}).nodes["n"].types == (int, None)


class _Maybe(Component):
    def __call__(self, first: int, other: Lazy) -> int:
        return first if first else other.get()


def test_lazy_inputs():
    ran = []
    b = PipelineBuilder()
    n = b.create_input("n", int)
    other = b.add_component("other", lambda n: ran.append(n) or 7, n=n)
    b.add_component("maybe", _Maybe(), first=n, other=other)
    p = b.build()
    assert p.run("maybe", n=1) == 1 and not ran
    assert p.run("maybe", n=0) == 7 and ran == [0]


def test_measured_profile(spark, log, tmp_path):
    p = topn_pipeline(PopScorer(), 3).measure()
    p.train(log)
    p.run("recommender", query=log.select("user_id").distinct())
    assert {r["node"] for r in p.profile} >= {"history-lookup", "candidate-selector", "scorer", "ranker"}
    assert next(r["ns"] for r in p.profile if r["node"] == "ranker") > 1_000_000
    p.write_profile(str(tmp_path / "profile.csv"))
    assert (tmp_path / "profile.csv").read_text().startswith("node,ns\n")
