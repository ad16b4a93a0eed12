from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recmill.llm.topn import top_n
from recmill.session import table


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "topn_java_ratings").where("user is not null").select(F.col("user").alias("user_id")).distinct()
    return table(spark, sf_dir, "item_lists").join(users, "user_id", "left_semi").join(table(spark, sf_dir, "topn_config"), "algorithm")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_n(_lists(spark, sf_dir), ["algorithm", "user_id"], "item_id", "score", "n").drop("score")


def p6_top_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best items with the score that each is there for."""
    return top_n(_lists(spark, sf_dir), ["algorithm", "user_id"], "item_id", "score", "n")


QUERIES = {"p6_found": p6_found, "p6_top_scores": p6_top_scores}

_BEST = """
with l as (
  select algorithm, user_id, item_id, max(score + 0) as score
  from item_lists where score is not null and not isnan(score) and item_id is not null and user_id is not null
  group by all
),
r as (
  select l.*, c.n, row_number() over (partition by l.algorithm, user_id order by score desc, item_id) as k
  from l join topn_config c using (algorithm)
  where user_id in (select "user" from topn_java_ratings)
)
"""
SQL = {
    "p6_found": _BEST + "select algorithm, user_id, item_id from r where n is null or n < 0 or k <= n",
    "p6_top_scores": _BEST + "select algorithm, user_id, item_id, score from r where n is null or n < 0 or k <= n",
}
