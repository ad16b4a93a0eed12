import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from recmill.data.builder import DatasetBuilder
from recmill.data.dataset import Dataset
from recmill.errors import DataError
from recmill.metrics import ranking as mr
from recmill.models.als import ImplicitMFScorer
from recmill.models.basic import BiasScorer, PopScorer, TimeBoundedPopScorer
from recmill.operators import lists as li
from recmill.operators import splitting as sp
from recmill.operators.fair import minimum_table
from recmill.operators.order import exact_quantile, number_rows, running_sum
from recmill.operators.skew import key_summaries
from recmill.plans.pipeline import PipelineBuilder, PipelineError, merge_configs, topn_builder

SIMPLE = [(1, 10, 4.0), (1, 12, 3.0), (2, 10, 5.0), (3, 13, 2.0)]


@pytest.fixture(scope="module")
def simple(spark):
    return spark.createDataFrame(SIMPLE, "item_id int, user_id int, rating double")


def test_bias(spark, simple):
    b = BiasScorer().train(simple)
    assert b.tables["global"].first()["b"] == 3.5
    assert {r["item_id"]: r["b"] for r in b.tables["item"].collect()} == {1: 0.0, 2: 1.5, 3: -1.5}
    unknown = b.score(spark.createDataFrame([(99, 1), (10, 99)], "user_id int, item_id int")).collect()
    assert all(r["score"] is not None for r in unknown)


def test_time_bounded_popularity(spark):
    t = dt.datetime(2020, 1, 10)
    d = dt.timedelta(days=1)
    log = spark.createDataFrame([(1, 10, 4, t), (2, 12, 3, t - d), (2, 10, 5, t - d), (3, 13, 2, t - d)], "item_id int, user_id int, rating int, timestamp timestamp_ntz")
    got = lambda **k: [r["score"] for r in TimeBoundedPopScorer(**k).train(log).tables["pop"].orderBy("item_id").collect()]
    assert got(cutoff=t - d) == [1, 0, 0]
    assert got(cutoff=t - 2 * d) == [0.25, 1.0, 0.5]
    assert got(cutoff=t - 2 * d, score="rank") == [1.5, 3.0, 1.5]
    assert got(cutoff=t - 2 * d, score="count") == [1, 2, 1]


CLICKS = [("a", "x", 10, 3, 1), ("a", "y", 20, 4, 2), ("b", "z", 30, 5, 3), ("c", "x", 40, 4, 4), ("c", "y", 50, 3, 5), ("c", "z", 60, 2, 6), ("b", "z", 70, 3, 7)]


def test_repeats(spark, tmp_path):
    df = spark.createDataFrame(CLICKS, "user_id string, item_id string, timestamp long, rating int, count int")
    b = DatasetBuilder(spark)
    b.add_interactions("click", df, entities=["user", "item"], missing="insert", default=True)
    ds = b.build()
    assert ds.interactions().log.count() == 7
    m = {(r["user_id"], r["item_id"]): r for r in ds.interactions().matrix().collect()}
    assert len(m) == 6 and m["b", "z"]["count"] == 10 and m["b", "z"]["rating"] == 3 and m["b", "z"]["first_timestamp"] == 30
    assert {r["user_id"]: r["item_count"] for r in ds.user_stats().collect()} == {"a": 2, "b": 1, "c": 3}
    ds.save(str(tmp_path / "ds"))
    again = Dataset.load(spark, str(tmp_path / "ds"))
    assert again.schema == ds.schema and again.interactions().count() == 28
    c = DatasetBuilder(spark)
    with pytest.raises(DataError):
        c.add_interactions("click", df, entities=["user", "item"], missing="insert", allow_repeats=False)
    c = DatasetBuilder(spark)
    c.add_interactions("click", df, entities=["user", "item"], missing="insert", remove_repeats=True)
    assert c.relations["click"].where("user_id = 'b'").first()["timestamp"] == 70
    with pytest.raises(DataError):
        c.add_relationships("click", df.withColumn("user_id", F.lit("new")))


def test_als_of_hot_key(spark, monkeypatch):
    """A key whose rows are summed in parts has the same vector as one summed at once."""
    import recmill.models.als as als

    log = spark.createDataFrame([(u, i) for u in range(12) for i in range(9) if (u * i) % 4 != 1], "user_id int, item_id int")
    vec = lambda: {r["user_id"]: r["vec"] for r in ImplicitMFScorer(embedding_size=3, epochs=1).train(log).tables["user"].collect()}
    whole = vec()
    monkeypatch.setattr(als, "PART", 2)
    for u, v in vec().items():
        assert v == pytest.approx(whole[u], rel=1e-6)


def _hits(spark, recs, truth, gain=None):
    r = spark.createDataFrame([(1, x, i + 1) for i, x in enumerate(recs)], "q int, item_id int, rank int")
    t = spark.createDataFrame([(1, x, float(g)) for x, g in truth.items()], "q int, item_id int, rating double")
    return mr.Hits(r, t, ["q"], gain, spark.createDataFrame([(1,)], "q int"))


def _value(spark, metric, recs, truth, gain=None):
    return _hits(spark, recs, truth, gain).measure(metric).first()[metric.label()]


def test_metrics(spark):
    ones = dict.fromkeys([1, 2, 3], 1)
    assert _value(spark, mr.NDCG(), [], ones) == 0
    assert _value(spark, mr.NDCG(), [1, 2, 3], {}) is None
    assert _value(spark, mr.NDCG(), [2, 3, 1], ones) == pytest.approx(1)
    assert _value(spark, mr.NDCG(), [1, 2], {1: 3, 2: 5, 3: 4}, "rating") == pytest.approx((3 + 5) / (5 + 4 + 3 / math.log2(3)))
    assert _value(spark, mr.AveragePrecision(), [1, 2, 3], {1: 1, 3: 1}) == pytest.approx((1 + 2 / 3) / 2)
    assert _value(spark, mr.AveragePrecision(3), [1, 2, 3, 4, 5], {1: 1, 3: 1, 5: 1}) == pytest.approx((1 + 2 / 3) / 3)
    assert _value(spark, mr.Precision(), [], ones) is None
    assert _value(spark, mr.Recall(), [], ones) == 0
    assert _value(spark, mr.Hit(), [], {}) is None


def test_two_rankings(spark):
    f = lambda xs: spark.createDataFrame([(1, x, i + 1) for i, x in enumerate(xs)], "q int, item_id int, rank int")
    assert mr.least_item_promoted(f([1, 2, 3, 4, 5, 6]), f([6, 2, 3, 1]), ["q"], 3).first()["LIP"] == 2
    assert mr.rank_biased_overlap(f([1, 2]), f([3, 4]), ["q"]).first()["RBO"] == 0


def test_fair_table():
    m = minimum_table(9, 0.5, 0.1)
    assert m == sorted(m) and m[2] == 0 and m[3] == 1 and m[-1] >= 2


def test_lists(spark):
    s = spark.createDataFrame([(1, 1, 0.5), (1, 2, float("nan")), (1, 3, 0.5), (1, 4, None), (1, 5, 0.9)], "q int, item_id int, score double")
    assert [r["item_id"] for r in li.rank_lists(s, ["q"], n=2).orderBy("rank").collect()] == [5, 1]
    assert li.rank_lists(s, ["q"], n=-1).count() == 3
    c = li.ListCollection.from_dict(spark, {1: [7, 8], 2: []}, ["user_id"])
    assert len(c) == 2 and {r["user_id"]: len(r["items"]) for r in c.nested().collect()} == {1: 2, 2: 0}
    old = spark.createDataFrame([(1, 1, 5.0), (1, 3, 6.0)], "q int, item_id int, f double")
    new = spark.createDataFrame([(1, 1, None), (1, 9, 1.0)], "q int, item_id int, f double")
    assert {r["item_id"]: r["f"] for r in li.update_lists(old, new, ["q"]).collect()} == {1: None, 3: 6.0}


def test_splits(spark):
    log = spark.createDataFrame([(u, i, dt.datetime(2020, 1, 1 + (u + i) % 20)) for u in range(20) for i in range(11)], "user_id int, item_id int, timestamp timestamp_ntz")
    assert sorted(s.test_size() for s in sp.crossfold_records(log, 3)) == [73, 73, 74]
    s = sp.sample_users(log, 5, sp.sample_n(2))
    assert s.test_size() == 10 and s.train.count() == 210 and s.test.join(s.train, ["user_id", "item_id"]).isEmpty()
    t = sp.split_global_time(log, dt.datetime(2020, 1, 10, tzinfo=dt.UTC))
    assert t.train.count() + t.test_size() == 220 and t.train.agg(F.max("timestamp")).first()[0] < dt.datetime(2020, 1, 10)
    assert sp.last_frac(0.01)(log, "user_id").where("_test").count() == 220  # rounds to 0: everything


def test_order(spark):
    df = spark.createDataFrame([(x,) for x in [5, 3, 9, 1, 7]], "x long")
    assert {r["x"]: r["num"] for r in number_rows(df, "x").collect()} == {1: 0, 3: 1, 5: 2, 7: 3, 9: 4}
    assert {r["x"]: r["s"] for r in running_sum(df, "x", value="x", name="s").collect()} == {1: 1, 3: 4, 5: 9, 7: 16, 9: 25}
    assert exact_quantile(df, "x", 0.9) == pytest.approx(8.2) and exact_quantile(df.where("x > 99"), "x", 0.5) is None


def test_key_summaries(spark):
    rows = [(1 if i % 3 else i, None if i % 7 == 0 else float(i % 5), dt.datetime(2020, 1, 1) + dt.timedelta(hours=i)) for i in range(300)] + [(None, 1.0, None), (1, float("nan"), None)]
    df = spark.createDataFrame(rows, "k int, v double, t timestamp_ntz").withColumns({"key": F.lit("clash"), "chunk": F.lit(0), "o": F.lit(1)})
    got = {r["key_value"]: r for r in key_summaries(df, ["k"], "v", "t", chunk_rows=17).collect()}
    mine = [v for k, v, _ in rows[:-2] if k == 1]
    known = [v for v in mine if v is not None]
    assert got[1]["n_rows"] == len(mine) + 1 and got[1]["n_values"] == len(known)
    assert got[1]["mean_value"] == pytest.approx(sum(known) / len(known)) and got[1]["last_value"] == known[-1]
    # rises as plain Python counts them over known neighbours within and across chunks
    assert got[1]["rises"] > 0 and None not in got
    assert key_summaries(df.where("false"), ["k"], "v", "t").count() == 0


def test_key_summaries_of_split_files(spark):
    """Files of the cut that are read in many pieces give the same summaries as whole ones."""
    rng = np.random.default_rng(3)
    key = np.where(rng.random(60_000) < 0.4, 0, rng.integers(1, 20, 60_000))
    pdf = pd.DataFrame({"k": key, "v": rng.integers(0, 6, 60_000) / 2, "t": rng.permutation(60_000)})
    df = spark.createDataFrame(pdf, "k int, v double, t long")
    whole = sorted(map(tuple, key_summaries(df, ["k"], "v", "t", chunk_rows=700).collect()))
    small = {"spark.sql.files.maxPartitionBytes": "8192", "spark.sql.files.openCostInBytes": "0", "spark.sql.shuffle.partitions": "3"}
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    was = {k: spark.conf.get(k) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        for k in ("parquet.block.size", "parquet.page.size"):
            hadoop.set(k, "16384")
        hadoop.set("parquet.page.size.row.check.min", "10")
        hadoop.set("parquet.page.size.row.check.max", "100")
        hadoop.set("parquet.block.size.row.check.min", "100")
        split = sorted(map(tuple, key_summaries(df, ["k"], "v", "t", chunk_rows=700).collect()))
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
        for k in ("parquet.block.size", "parquet.page.size", "parquet.page.size.row.check.min", "parquet.page.size.row.check.max", "parquet.block.size.row.check.min"):
            hadoop.unset(k)
    assert split == whole
    order = pdf.sort_values(["k", "t"])
    for k, g in order.groupby("k"):
        v = g["v"].to_numpy()
        row = next(r for r in whole if r[1] == k)
        assert row[2:4] == (len(v), len(v)) and row[5:7] == (int((np.diff(v) > 0).sum()), v[-1]) and row[8] == (len(v) - 1) // 700


def test_pipeline(spark, simple):
    b = topn_builder(PopScorer(), 2, fallback=BiasScorer())
    p = b.build()
    p.train(simple)
    out = p.run("recommender", query=spark.createDataFrame([(10,), (13,), (0,)], "user_id int")).collect()
    assert {r["item_id"] for r in out if r["user_id"] == 10} == {3} and sum(r["user_id"] == 0 for r in out) == 2
    again = PipelineBuilder.from_config(b.build_config())
    assert again.build_config()["meta"]["hash"] == b.build_config()["meta"]["hash"]
    assert "scorer" in p.mermaid()
    c = PipelineBuilder()
    c.literal(1, "a")
    c.use_first_of("f", "a", "g")
    c.use_first_of("g", "f", "a")
    with pytest.raises(PipelineError):
        c.validate()
    assert merge_configs({"a": {"code": "x", "config": {"k": 1}}}, {"a": {"code": "y"}}) == {"a": {"code": "y"}}


def test_negatives(spark, simple):
    got = li.sample_negatives(simple.select("user_id", F.col("item_id").alias("positive")), simple, simple, 2, attempts=60).collect()
    seen = {(u, i) for i, u, _ in SIMPLE}
    assert len(got) == 8 and all((r["user_id"], r["item_id"]) not in seen for r in got)


def test_queries_see_whole_lists(spark, tmp_path):
    from recmill.queries.common import recs
    from recmill.queries.lists import QUERIES as LISTS
    from recmill.queries.metrics import QUERIES as METRICS

    d = str(tmp_path)
    spark.createDataFrame([("pop", 1, i, float(50 - i)) for i in range(50)], "algorithm string, user_id int, item_id int, score float").write.parquet(f"{d}/item_lists.parquet")
    spark.createDataFrame([(1, 4, 3.0), (1, 44, 5.0)], "user int, item int, rating float").write.parquet(f"{d}/topn_java_ratings.parquet")
    assert recs(spark, d).count() == 50 and LISTS["list_top_n"](spark, d).count() == 20
    r = METRICS["metrics_relevance"](spark, d).first()
    assert (r["N"], r["Recall"], r["AveragePrecision"]) == (50, 1.0, round((1 / 5 + 2 / 45) / 2, 6))
    assert METRICS["metrics_unique_items"](spark, d).first()[0] == 50
    assert LISTS["list_slice"](spark, d).count() == 45


def test_missing_variants_are_refused(simple):
    from recmill.models.factor import NMFScorer
    from recmill.plans.tuning import PipelineTuner

    for setting in ({"beta_loss": "kullback-leibler"}, {"method": "minibatch"}):
        with pytest.raises(NotImplementedError):
            NMFScorer(**setting).train(simple)
    with pytest.raises(ValueError):
        PipelineTuner({}, lambda c: 0.0, method="grid")
