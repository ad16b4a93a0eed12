"""Queries of train/test splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from recmill.operators import splitting as sp
from recmill.queries.common import LOG, TASTES, log, registry, tastes
from recmill.session import table

QUERIES, SQL, register = registry()

_PLACE = f"""{TASTES},
p as (select *, row_number() over (order by md5(concat_ws('|', user_id, item_id, '0')), user_id, item_id) - 1 as place, count(*) over () as n from tastes)"""


def _fold(k: int) -> str:
    return f"(case when place < (n % {k}) * (n // {k} + 1) then place // (n // {k} + 1) else n % {k} + (place - (n % {k}) * (n // {k} + 1)) // (n // {k}) end)::int"


@register(f"with {_PLACE} select user_id, item_id, {_fold(5)} as fold from p")
def crossfold_records(spark, d):
    return sp.record_folds(tastes(spark, d), 5, ["user_id", "item_id"]).select("user_id", "item_id", "fold")


@register(f"with {_PLACE} select user_id, item_id from p where place < 500")
def sample_records(spark, d):
    return sp.sample_records(tastes(spark, d), 500).test.select("user_id", "item_id")


@register(f"""with {TASTES}, u as (select user_id, row_number() over (order by md5(concat_ws('|', user_id, '0')), user_id) - 1 as place, count(*) over () as n from (select distinct user_id from tastes))
select user_id, {_fold(4)} as fold from u""")
def crossfold_users(spark, d):
    return sp.user_folds(tastes(spark, d), 4).select("user_id", "fold")


_RANDOM = f"""{TASTES}, r as (select *, row_number() over (partition by user_id order by md5(concat_ws('|', user_id, item_id, '0')), item_id) as r, count(*) over (partition by user_id) as n from tastes)"""


@register(f"with {_RANDOM} select user_id, item_id, r <= 5 as in_test from r")
def holdout_sample_n(spark, d):
    return sp.sample_n(5)(tastes(spark, d), "user_id").select("user_id", "item_id", F.col("_test").alias("in_test"))


@register(f"with {_RANDOM} select user_id, item_id, r <= round_even(n * 0.25::double, 0) as in_test from r")
def holdout_sample_frac(spark, d):
    return sp.sample_frac(0.25)(tastes(spark, d), "user_id").select("user_id", "item_id", F.col("_test").alias("in_test"))


_LATE = f"""{LOG}, m as (select user_id, item_id, max(timestamp) as timestamp from log group by 1, 2),
r as (select *, row_number() over (partition by user_id order by timestamp desc nulls last, item_id desc) as r, count(*) over (partition by user_id) as n from m)"""


def _latest(spark, d):
    return log(spark, d).groupBy("user_id", "item_id").agg(F.max("timestamp").alias("timestamp"))


@register(f"with {_LATE} select user_id, item_id, r <= 3 as in_test from r")
def holdout_last_n(spark, d):
    return sp.last_n(3)(_latest(spark, d), "user_id").select("user_id", "item_id", F.col("_test").alias("in_test"))


@register(f"with {_LATE} select user_id, item_id, (round_even(n * 0.2::double, 0) = 0 or r <= round_even(n * 0.2::double, 0)) as in_test from r")
def holdout_last_frac(spark, d):
    return sp.last_frac(0.2)(_latest(spark, d), "user_id").select("user_id", "item_id", F.col("_test").alias("in_test"))


@register(f"""with {TASTES}, u as (select user_id from (select user_id, row_number() over (order by md5(concat_ws('|', user_id, '0')), user_id) as k from (select distinct user_id from tastes)) where k <= 100),
r as (select *, row_number() over (partition by user_id order by md5(concat_ws('|', user_id, item_id, '0')), item_id) as r from tastes)
select user_id, item_id, user_id in (select user_id from u) and r <= 5 as in_test from r""")
def sample_users(spark, d):
    s = sp.sample_users(tastes(spark, d), 100, sp.sample_n(5))
    return s.test.select("user_id", "item_id", F.lit(True).alias("in_test")).unionByName(s.train.select("user_id", "item_id", F.lit(False).alias("in_test")))


@register(f"""with {LOG}, tr as (select user_id, count(*) as n from log where timestamp < timestamp '2012-01-01' group by 1)
select user_id, item_id, timestamp from log where timestamp >= timestamp '2012-01-01' and timestamp < timestamp '2014-01-01' and user_id in (select user_id from tr where n >= 3)""")
def split_global_time(spark, d):
    return sp.split_global_time(log(spark, d), "2012-01-01T00:00:00+00:00", "2014-01-01T00:00:00+00:00", filter_test_users=3).test.select("user_id", "item_id", "timestamp")


@register(f"""with {LOG}, q as (select quantile_cont(epoch_us(timestamp)::double, 0.8) as t from log where timestamp is not null)
select user_id, count(*) filter (where epoch_us(timestamp) < t) as n_train, count(*) filter (where epoch_us(timestamp) >= t) as n_test from log, q where timestamp is not null group by user_id""")
def split_temporal_fraction(spark, d):
    s = sp.split_temporal_fraction(log(spark, d), 0.2)
    both = s.train.select("user_id", F.lit(0).alias("t")).unionByName(s.test.select("user_id", F.lit(1).alias("t")))
    return both.groupBy("user_id").agg(F.sum(1 - F.col("t")).alias("n_train"), F.sum("t").alias("n_test"))


@register("select quantile_cont(epoch_us(o_orderdate)::double, 0.9) as q from orders")
def time_quantile(spark, d):
    from recmill.operators.order import exact_quantile

    us = table(spark, d, "orders").select(F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("us"))
    return spark.createDataFrame([(exact_quantile(us, "us", 0.9),)], "q double")
