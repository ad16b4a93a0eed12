"""Queries of problem 2: results per key of ``movielens`` although a few keys own most of its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recmill.operators.skew import key_summaries
from recmill.session import table


def _summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "movielens").withColumn("loaded_us", F.unix_micros(F.col("loaded_at").cast("timestamp")))
    return key_summaries(log, ["item_id", "user_id"], "rating", "timestamp", ["loaded_us"])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = table(spark, sf_dir, "movielens").count()
    return _summaries(spark, sf_dir).where(F.col("n_rows") * 50 >= total).select("key_field", F.col("key_value").cast("int").alias("key_value"))


def p2_key_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summaries(spark, sf_dir).select(
        "key_field", F.col("key_value").cast("int").alias("key_value"), "n_rows", "n_values", F.round("mean_value", 6).alias("mean_value"), "rises", "last_value", F.col("last_order").alias("last_us")
    )


QUERIES = {"p2_found": p2_found, "p2_key_summaries": p2_key_summaries}

_ROWS = """
  select 'item_id' as key_field, item_id as key_value, rating, timestamp, loaded_at from movielens where item_id is not null
  union all
  select 'user_id', user_id, rating, timestamp, loaded_at from movielens where user_id is not null
"""

SQL = {
    "p2_found": f"""
with r as ({_ROWS})
select key_field, key_value from r group by key_field, key_value
having count(*) * 50 >= (select count(*) from movielens)
""",
    "p2_key_summaries": f"""
with r as ({_ROWS}),
known as (
  select *, lag(rating) over (partition by key_field, key_value order by timestamp nulls first, loaded_at, rating) as prev
  from r where rating is not null and not isnan(rating)
),
k as (
  select key_field, key_value, count(*) as n_values, avg(rating::double) as mean_value,
         count(*) filter (where rating > prev) as rises,
         arg_max(rating::double, (coalesce(epoch_us(timestamp), -9000000000000000000), epoch_us(loaded_at), rating)) as last_value
  from known group by key_field, key_value
)
select a.key_field, a.key_value, a.n_rows, coalesce(k.n_values, 0) as n_values, round(k.mean_value, 6) as mean_value,
       coalesce(k.rises, 0) as rises, k.last_value, a.last_us
from (select key_field, key_value, count(*) as n_rows, max(epoch_us(timestamp)) as last_us from r group by key_field, key_value) a
left join k using (key_field, key_value)
""",
}
