"""Queries with items of their own, checks, accumulators, streams."""

import datetime as dt

import pytest

from recmill.data.checks import arrow_names, check_columns, check_lengths
from recmill.errors import DataError
from recmill.metrics.accumulate import ErrorAccumulator, ObjectListAccumulator, ValueStatAccumulator
from recmill.models.knn import ItemKNNScorer
from recmill.plans.pipeline import topn_pipeline
from recmill.plans.query import Invocation, Queries, invoke
from recmill.streaming.popularity import windowed_counts


def test_query_items(spark):
    df = spark.createDataFrame([(1, [5], None, [7, 8]), (2, None, [6], [9]), (3, None, None, [4]), (4, None, None, None)], "user_id int, context_items array<int>, session_items array<int>, history_items array<int>")
    q = Queries.create(spark, df)
    items = lambda *a: {r["user_id"]: r["items"] for r in q.with_items(*a).collect()}
    assert items() == {1: [5], 2: [6], 3: [4], 4: None}
    assert items("history") == {1: [7, 8], 2: [9], 3: [4], 4: None} and items(["session", "context"])[1] == [5]
    assert sorted(map(tuple, q.past().collect())) == [(1, 5), (2, 6), (3, 4)]
    assert Queries.create(spark, {7: [1, 2]}).past().count() == 2 and Queries.create(spark, [0, 1]).past() is None
    assert Queries.create(spark, "x").frame.first()["user_id"] == "x" and Queries.create(spark, None).frame.count() == 1
    assert Queries.create(spark, spark.createDataFrame([(3,)], "query_id int")).frame.first()["user_id"] == 3 and Queries.create(spark, q) is q
    with pytest.raises(DataError):
        Queries(spark.createDataFrame([(3,)], "x int"))
    with pytest.raises(ValueError):
        q.with_items("other")


def test_invocations(spark):
    log = spark.createDataFrame([(u, i) for u in range(8) for i in range(6) if (u + i) % 3], "user_id long, item_id long")
    p = topn_pipeline(ItemKNNScorer(feedback="implicit"), 3)
    p.train(log)
    test = spark.createDataFrame([(0, 0), (0, 3), (5, 1)], "user_id long, item_id long")
    got = invoke(p, spark, {0: [1, 2], 99: [4]}, [Invocation("recommend", {"recommender": "recs"}), Invocation("score", {"scorer": "scores"}, "test-items")], test)
    assert {r["user_id"] for r in got["recs"].collect()} == {0, 99}
    assert {(r["user_id"], r["item_id"]) for r in got["scores"].collect()} == {(0, 0), (0, 3)}
    with pytest.raises(DataError):
        invoke(p, spark, [0], [Invocation("score", {"scorer": "scores"}, "test-items")])
    with pytest.raises(ValueError):
        Invocation("x", {}, "others")


def test_checks(spark):
    df = spark.createDataFrame([(1, "a", [1.0, 2.0]), (2, None, None)], "user_id int, item_id string, v array<double>")
    assert check_columns(df, {"user_id": "integer", "item_id": "id", "v": "array"}) and check_lengths(df, "v", 2)
    assert not check_columns(df, {"item_id": "number"}, "return") and not check_lengths(df, "v", 3, "return")
    with pytest.raises(TypeError, match="no column x"):
        check_columns(df, {"x": "id"})
    assert arrow_names(df) == {"user_id": "int32", "item_id": "utf8", "v": "array<double>"}


def test_accumulators(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", -3.0), ("b", None), ("b", float("nan")), ("b", 2.0)], "k string, e double")
    got = {r["k"]: r for r in ErrorAccumulator().accumulate(df, "e", ["k"]).collect()}
    assert got["a"]["MAE"] == 2 and got["a"]["RMSE"] == pytest.approx(5**0.5) and got["b"]["n"] == 1
    assert ValueStatAccumulator().accumulate(df, "e", ["k"]).where("k = 'a'").first()["median"] == -1
    assert ObjectListAccumulator().accumulate(df, "e", ["k"]).where("k = 'a'").first()["values"] == [-3.0, 1.0]


def test_stream(spark, tmp_path):
    """A stream of files gives the counts that a table gives."""
    t = dt.datetime(2024, 1, 1)
    rows = [(k % 3, t + dt.timedelta(hours=5 * k)) for k in range(20)]
    df = spark.createDataFrame(rows, "user_id int, ts timestamp")
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = windowed_counts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "user_id")
    q = stream.writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, windowed_counts(df, "user_id").collect()))
