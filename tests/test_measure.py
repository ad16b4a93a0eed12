"""Quick measurements, weights from fields, settings, task records."""

import json
import time

import numpy as np
import pytest

from recmill.errors import ConfigError
from recmill.metrics import ranking as mr
from recmill.metrics.quick import call_metric, mean_of, measure_list, quick_measure_model
from recmill.models.als import BiasedMFScorer
from recmill.models.basic import BiasScorer, PopScorer
from recmill.models.knn import ItemKNNScorer
from recmill.settings import load_settings
from recmill.tasks import Progress, Stopwatch, Task, current_task


@pytest.fixture(scope="module")
def ratings(spark):
    """Ratings from known factors with noise of a third of a star."""
    rng = np.random.default_rng(3)
    p, q, b = rng.standard_normal((120, 2)), rng.standard_normal((60, 2)), rng.standard_normal(60) / 2
    cells = [(u, i) for u in range(120) for i in range(60) if rng.random() < 0.5]
    return spark.createDataFrame([(u, i, float(3 + b[i] + 0.7 * p[u] @ q[i] + rng.normal(0, 0.33))) for u, i in cells], "user_id int, item_id int, rating double")


def test_quick_measure(ratings):
    bias = quick_measure_model(BiasScorer(damping=5), ratings, predicts_ratings=True)
    als = quick_measure_model(BiasedMFScorer(embedding_size=4, epochs=6), ratings, predicts_ratings=True)
    plain, learned = mean_of(bias, "RMSE"), mean_of(als, "RMSE")
    assert learned < 0.65 < plain < 1.3
    assert als.overall.first()["n"] > 100
    knn = quick_measure_model(ItemKNNScorer(feedback="implicit"), ratings)
    got = {r["metric"]: r["mean"] for r in knn.list_summary().collect()}
    assert set(got) == {"RBP", "NDCG", "RecipRank", "Hit", "Precision", "Recall"} and 0 < got["NDCG"] <= 1
    assert mean_of(quick_measure_model(PopScorer(), ratings), "Hit") > 0.5


def test_measure_list(spark):
    assert measure_list(spark, mr.Precision, [1, 2, 3, 4], [2, 9]) == 0.25
    # both first places weigh 1, so the great gain must stand third to be discounted
    assert measure_list(spark, mr.NDCG(), ["a", "c", "b"], {"a": 1.0, "b": 3.0}, gain=True) == pytest.approx((1 + 3 / np.log2(3)) / 4)
    assert measure_list(spark, mr.Recall, [], []) is None
    with pytest.warns(DeprecationWarning):
        assert call_metric(spark, mr.Hit, [1], [1]) == 1


def test_rbp_of_field(spark):
    recs = spark.createDataFrame([(1, 10, 1, 0.5), (1, 11, 2, 0.3), (1, 12, 3, None), (1, 13, 4, 0.2)], "q int, item_id int, rank int, w double")
    test = spark.createDataFrame([(1, 11), (1, 12)], "q int, item_id int")
    assert mr.Hits(recs, test, ["q"]).measure(mr.RBP(weight_field="w")).first()["RBP"] == pytest.approx(0.3)
    with pytest.raises(ValueError):
        mr.RBP(weight_field="w", normalize=True)


def test_settings(tmp_path):
    (tmp_path / "recmill.toml").write_text('[tuning]\njobs = 3\nmetric = "NDCG"\n[datasets]\nsmall = "/data/small"\n')
    (tmp_path / "recmill.local.toml").write_text("[tuning]\njobs = 4\n")
    s = load_settings(directory=tmp_path, environ={"RECMILL_RANDOM__SEED": "7", "RECMILL_CLUSTER__SHUFFLE_PARTITIONS": "9", "OTHER": "x"}, tuning={"metric": "RBP"})
    assert (s.tuning.jobs, s.tuning.metric, s.random.seed, s.cluster.shuffle_partitions, s.datasets) == (4, "RBP", 7, 9, {"small": "/data/small"})
    for bad in ({"RECMILL_TUNING__JOBS": "many"}, {"RECMILL_NOTHING": "1"}, {"RECMILL_TUNING": "1"}):
        with pytest.raises(ConfigError):
            load_settings([], bad)


def test_tasks(spark, tmp_path):
    file = tmp_path / "task.json"
    with Task("outer", spark, file, who="test") as outer:
        with Task("inner") as inner:
            assert current_task() is inner
            spark.range(10).count()
        with pytest.raises(RuntimeError), Task("bad"):
            raise RuntimeError("no")
    got = json.loads(file.read_text())
    assert current_task() is None and outer.status == "finished" and got["data"] == {"who": "test"}
    assert [(t["label"], t["status"]) for t in got["subtasks"]] == [("inner", "finished"), ("bad", "failed")]
    assert got["jobs"] >= 1 and got["seconds"] >= got["subtasks"][0]["seconds"] and "RuntimeError" in got["subtasks"][1]["data"]["error"]


def test_stopwatch(caplog):
    w = Stopwatch()
    first = w.stop()
    time.sleep(0.01)
    assert w.elapsed() == first and str(w).endswith("ms")
    with caplog.at_level("INFO", "recmill"), Progress("steps", 3) as p:
        for _ in range(3):
            p.update(loss=1)
    assert "steps: 3 of 3, loss=1" in caplog.text
