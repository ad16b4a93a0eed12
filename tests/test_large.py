"""Findings of round 2 on larger tables: models trained from cells in one task, rules and neighbours, EASE of many items."""

import numpy as np
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recmill.models import linear
from recmill.models.basic import BiasScorer
from recmill.models.factor import BiasedSVDScorer, FunkSVDScorer
from recmill.models.linear import EASEScorer


@pytest.fixture(scope="module")
def log(spark):
    rng = np.random.default_rng(6)
    rows = [(u, i, float(rng.integers(1, 6))) for u in range(30) for i in range(20) if rng.random() < 0.4]
    return spark.createDataFrame(rows + rows[::7] + [(3, 99, None), (None, 3, 1.0)], "user_id int, item_id int, rating double")


ON_BIAS = {"biased_svd": lambda: BiasedSVDScorer(embedding_size=3), "funksvd": lambda: FunkSVDScorer(embedding_size=3, epochs=4)}


@pytest.mark.parametrize("name", ON_BIAS)
def test_biases_are_found_where_the_model_is_trained(spark, log, name, monkeypatch):
    """Training joins nothing; scores are the biases of all ratings, also of repeated ones, and the factors' part."""
    with monkeypatch.context() as m:
        m.setattr(DataFrame, "join", lambda *_, **__: pytest.fail("training joins"))
        s = ON_BIAS[name]().train(log)
    asked = spark.createDataFrame([(u, i) for u in (0, 5, 77) for i in (1, 8, 99)], "user_id int, item_id int")
    plain = {(r["user_id"], r["item_id"]): r["score"] for r in BiasScorer(damping=5.0).train(log).score(asked).collect()}
    vec = [{r[f"{side}_id"]: np.array(r["vec"]) for r in s.tables[side].collect()} for side in ("user", "item")]
    got = s.score(asked).collect()
    assert len(got) == 9
    for r in got:
        u, i = vec[0].get(r["user_id"]), vec[1].get(r["item_id"])
        assert r["score"] == pytest.approx(plain[r["user_id"], r["item_id"]] + (0 if u is None or i is None else u @ i), abs=1e-5)
    empty = ON_BIAS[name]().train(log.where(F.col("user_id") > 1_000))
    assert all(r["score"] is None for r in empty.score(asked).collect())


@pytest.mark.parametrize("group", [1, 7, 99])
def test_ease_of_many_items(spark, log, group, monkeypatch, tmp_path):
    """The scores of the dense weights, also for a history of its own and after loading; every item reaches every other."""
    asked = spark.createDataFrame([(u, i) for u in (0, 5, 77) for i in (*range(20), 99, 100)] + [(None, 3), (2, None)], "user_id int, item_id int")
    own = spark.createDataFrame([(5, 2), (5, 3), (77, 4), (77, 100)], "user_id int, item_id int")

    def scores(s, history=None):
        return {(r["user_id"], r["item_id"]): r["score"] for r in s.score(asked, history).collect()}

    dense = EASEScorer(regularization=2.0).train(log)
    want = scores(dense), scores(dense, own)
    monkeypatch.setattr(linear, "MAX_DENSE_ITEMS", 5)
    monkeypatch.setattr(linear.Columns, "GROUP", group)
    s = EASEScorer(regularization=2.0).train(log)
    assert "weights" not in s.tables and s.reach(asked, log, 3) is None
    s.save(str(tmp_path))
    again = EASEScorer(regularization=2.0)
    again.load(spark, str(tmp_path), list(s.tables))
    for got, ref in ((scores(s), want[0]), (scores(s, own), want[1]), (scores(again), want[0])):
        assert got.keys() == ref.keys() and sum(v is not None for v in ref.values()) > 20
        assert {k for k, v in got.items() if v is None} == {k for k, v in ref.items() if v is None}
        assert [got[k] for k in got if got[k] is not None] == pytest.approx([ref[k] for k in got if got[k] is not None], abs=1e-6)
    with pytest.raises(ValueError, match="positive"):
        EASEScorer(regularization=0.0).train(log)


def test_funksvd_is_not_trained_in_the_driver(spark, log, monkeypatch):
    """Training brings one row at most to the driver and sends none; every user and item that is rated gets a vector."""
    rated = log.where("user_id is not null and rating is not null")
    want = {side: {r[0] for r in rated.select(f"{side}_id").distinct().collect()} for side in ("user", "item")}
    whole = type(log).collect

    def one(df):
        assert len(rows := whole(df)) <= 1, "rows went through the driver"
        return rows

    with monkeypatch.context() as m:
        for owner, name in ((log, "toPandas"), (log, "toArrow"), (log, "toLocalIterator"), (spark, "createDataFrame")):
            m.setattr(type(owner), name, lambda *_, **__: pytest.fail("rows go through the driver"))
        m.setattr(type(log), "collect", one)
        s = FunkSVDScorer(embedding_size=3, epochs=4).train(log)
    for side, ids in want.items():
        got = s.tables[side].collect()
        assert len(got) == len(ids) and {r[f"{side}_id"] for r in got} == ids
        assert all(len(r["vec"]) == 3 and np.isfinite(r["vec"]).all() and np.isfinite(r["b"]) for r in got)
