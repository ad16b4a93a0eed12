"""Vocabularies, numbers that stay, exports, seeds."""

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from recmill.data.builder import DatasetBuilder
from recmill.data.export import csr, is_sorted, to_scipy, to_torch
from recmill.data.vocabulary import Vocabulary, negative_mask
from recmill.errors import DataError
from recmill.functions import seeds


@pytest.fixture(scope="module")
def log(spark):
    return spark.createDataFrame([("b", 5, 3.0, 10), ("a", 7, None, 20), ("b", 7, 4.0, 30), ("b", 5, 2.0, 40)], "user_id string, item_id long, rating double, timestamp long")


def _built(spark, log):
    b = DatasetBuilder(spark, "t")
    b.add_interactions("rating", log, entities=["user", "item"], missing="insert", default=True)
    return b


def test_numbers_stay(spark, log):
    b = _built(spark, log)
    old = {r["item_id"]: r["item_num"] for r in b.build().numbering("item").collect()}
    assert old == {5: 0, 7: 1}
    b.add_entities("item", [1, 9])
    again = DatasetBuilder(spark, start=b.build())
    again.add_entities("item", [0])
    got = {r["item_id"]: r["item_num"] for r in again.build().numbering("item").collect()}
    assert got == {5: 0, 7: 1, 1: 2, 9: 3, 0: 4}
    with pytest.raises(DataError):
        again.add_entities("item", [5])


def test_numbers_survive_storage(spark, log, tmp_path):
    from recmill.data.dataset import Dataset

    b = _built(spark, log)
    b.add_entities("item", [1])
    ds = b.build()
    ds.save(str(tmp_path / "ds"))
    got = {r["item_id"]: r["item_num"] for r in Dataset.load(spark, str(tmp_path / "ds")).numbering("item").collect()}
    assert got == {5: 0, 7: 1, 1: 2}


def test_export(spark, log):
    r = _built(spark, log).build().interactions()
    rows, cols, values, shape = r.coo()
    assert (rows.tolist(), cols.tolist(), values.tolist(), shape) == ([0, 1, 1], [1, 0, 1], [1, 1, 1], (2, 2))
    rows, cols, values, _ = r.coo("rating")
    assert (rows.tolist(), cols.tolist(), values.tolist()) == ([1, 1], [0, 1], [2, 4])
    at, _, _ = csr(rows, cols, values, shape)
    assert at.tolist() == [0, 0, 2]
    for f, name in ((to_scipy, "scipy"), (to_torch, "torch")):
        try:
            __import__(name)
        except ImportError:
            with pytest.raises(ImportError):
                f(r)
        else:
            assert f(r).shape == (2, 2)


def test_is_sorted(spark):
    df = spark.createDataFrame([(i, i // 10, i % 10) for i in range(200)], "at int, r int, c int").repartition(5)
    assert is_sorted(df, "r", "c", order="at")
    assert not is_sorted(df.withColumn("c", F.when(F.col("at") == 150, 0).otherwise(F.col("c"))).withColumn("r", F.when(F.col("at") == 150, 14).otherwise(F.col("r"))), "r", "c", order="at")
    assert not is_sorted(df.withColumn("c", F.lit(0)), "r", "c", order="at") and is_sorted(df.where("false"), "r", "c", order="at")


def test_vocabulary(spark):
    ids = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "x string")
    v = Vocabulary.of(ids)
    assert len(v) == 2 and v.number("b") == 1 and v.id(0) == "a" and v.number("z") is None
    w = v.add(spark.createDataFrame([("0",), ("a",)], "x string"))
    assert w.number("0") == 2 and w.number("b") == 1 and w != v and v == Vocabulary.of(ids.repartition(3))
    got = {r["x"]: r["num"] for r in w.numbers(spark.createDataFrame([("b",), ("q",)], "x string"), "x", missing="null").collect()}
    assert got == {"b": 1, "q": None}
    assert w.numbers(spark.createDataFrame([("q",)], "x string"), "x", missing="filter").count() == 0
    with pytest.raises(Exception, match="unknown id q"):
        w.numbers(spark.createDataFrame([("q",)], "x string"), "x").collect()
    with pytest.raises(DataError):
        v.id(5)
    assert [r["id"] for r in w.ids(spark.createDataFrame([(2,), (7,)], "n long"), "n").orderBy("n").collect()] == ["0", None]
    mask = negative_mask(w.table, v.table, ["id"])
    assert {r["id"]: r["mask"] for r in mask.collect()} == {"a": False, "b": False, "0": True}


def test_seeds(tmp_path):
    assert seeds.make_seed(1, "a").entropy != seeds.make_seed("a", 1).entropy
    assert seeds.seed_number("x") == seeds.seed_number("x") != seeds.seed_number(uuid.uuid5(uuid.NAMESPACE_DNS, "x"))
    with pytest.raises(TypeError):
        seeds.make_seed(1.5)
    by_user, fixed = seeds.query_seeds((4, "user")), seeds.query_seeds(4)
    assert by_user(1) != by_user(2) and fixed(1) == fixed(2)
    (tmp_path / "s.toml").write_text("[random]\nseed = 42\n")
    assert seeds.load_seed(str(tmp_path / "s.toml")).entropy == seeds.make_seed(42).entropy
    n = seeds.init_global_seed(5)
    first = np.random.random()
    assert seeds.init_global_seed(5) == n == seeds.global_seed() and np.random.random() == first
    seeds._held.clear()
