"""Frames that several queries start from, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recmill.session import no_nan, table


def registry() -> tuple[dict, dict, callable]:
    """(QUERIES, SQL, register): ``@register(sql)`` adds a function under its own name."""
    queries: dict = {}
    sql: dict = {}

    def register(text: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if text is not None:
                sql[f.__name__] = text
            return f

        return add

    return queries, sql, register


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rating log without rows whose user or item is unknown, in arrival order."""
    df = no_nan(table(spark, sf_dir, "movielens")).where("user_id is not null and item_id is not null")
    order = F.struct(F.coalesce(F.unix_micros(F.col("timestamp").cast("timestamp")), F.lit(-(2**62))).alias("t"), F.unix_micros(F.col("loaded_at").cast("timestamp")).alias("l"), F.coalesce("rating", F.lit(-1.0)).alias("r"))
    return df.withColumn("_ord", order)


LOG = f"""
log as (select *, row(coalesce(epoch_us(timestamp), {-(2**62)}), epoch_us(loaded_at), coalesce(rating, -1)) as ord
        from movielens where user_id is not null and item_id is not null)"""


def tastes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, item_id, rating) of the ratings of users' lists, one row per pair: the highest rating."""
    t = table(spark, sf_dir, "topn_java_ratings").where("user is not null and item is not null")
    return t.groupBy(F.col("user").alias("user_id"), F.col("item").alias("item_id")).agg(F.max("rating").alias("rating"))


TASTES = """
tastes as (select "user" as user_id, item as item_id, max(rating) as rating from topn_java_ratings
           where "user" is not null and item is not null group by 1, 2)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(algorithm, user_id, item_id, score): lists with each item's highest score."""
    d = no_nan(table(spark, sf_dir, "item_lists")).where("algorithm is not null and user_id is not null and item_id is not null and score is not null")
    return d.groupBy("algorithm", "user_id", "item_id").agg((F.max("score") + F.lit(0).cast("float")).alias("score"))


SCORED = """
scored as (select algorithm, user_id, item_id, max(score) + 0::float as score from item_lists
           where algorithm is not null and user_id is not null and item_id is not null and score is not null and not isnan(score)
           group by all)"""

#: The length to which ``list_top_n`` cuts.
LENGTH = 20

RECS = f"""{SCORED},
recs as (select *, row_number() over (partition by algorithm, user_id order by score desc, item_id)::int as rank from scored)"""


def recs(spark: SparkSession, sf_dir: str, n: int | None = None) -> DataFrame:
    """The ranked lists, whole unless ``n`` is given."""
    from recmill.operators.lists import rank_lists

    return rank_lists(scored(spark, sf_dir), ["algorithm", "user_id"], n=n)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, item_id) of all lists: what scorers are asked to score."""
    return scored(spark, sf_dir).select("user_id", "item_id").distinct()


def genres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, genres array): null or empty lists stay null or empty."""
    return table(spark, sf_dir, "movies").select("item_id", F.when(F.col("genres") == "", F.array().cast("array<string>")).otherwise(F.split("genres", r"\|")).alias("genres"))


GENRES = "genres as (select item_id, case when genres = '' then [] else string_split(genres, '|') end as genres from movies)"
