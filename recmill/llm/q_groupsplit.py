from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recmill.llm.groupsplit import STAND_INS, assign_splits, people
from recmill.session import cut, table

SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return people(table(spark, sf_dir, "accounts"), table(spark, sf_dir, "movielens"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _people(spark, sf_dir)


def _assigned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    persons = cut(_people(spark, sf_dir), "people")
    log = table(spark, sf_dir, "movielens").where("user_id is not null").select("user_id", F.year("timestamp").alias("period"))
    log = log.join(persons, "user_id", "left").withColumn("person", F.coalesce("group_id", "user_id"))
    return log, assign_splits(log, "person", "period", SHARES)


def p1_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user of the log with the split that all rows of its person are in."""
    log, splits = _assigned(spark, sf_dir)
    return log.select("user_id", "person").distinct().join(splits, "person").select("user_id", "person", "split")


def p1_split_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each period in each split, with the share that was reached."""
    log, splits = _assigned(spark, sf_dir)
    n = log.groupBy("person", "period").agg(F.count("*").alias("n")).join(splits, "person").groupBy("period", "split").agg(F.sum("n").alias("n_rows"))
    return n.withColumn("share", F.round(F.col("n_rows") / F.sum("n_rows").over(Window.partitionBy("period")), 6))


def p1_split_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each split's share of all rows to two decimals, which must be its target, and how many rows and persons all
    splits hold together, which must be all."""
    log, splits = _assigned(spark, sf_dir)
    n = log.groupBy("person").agg(F.count("*").alias("n")).join(splits, "person").groupBy("split").agg(F.sum("n").alias("n"), F.count("*").alias("persons"))
    every = Window.partitionBy()  # one row for each split
    return n.select("split", F.round(F.col("n") / F.sum("n").over(every), 2).alias("share"), F.sum("n").over(every).alias("all_rows"), F.sum("persons").over(every).alias("all_persons"))


QUERIES = {"p1_found": p1_found, "p1_split_totals": p1_split_totals, "p1_splits": p1_splits, "p1_split_shares": p1_split_shares}

_stand_ins = ", ".join(f"'{x}'" for x in STAND_INS)
_wide = "".join(chr(x) for x in range(0xFF01, 0xFF5F))
_narrow = "".join(chr(x - 0xFEE0) for x in range(0xFF01, 0xFF5F)).replace("'", "''")

_PERSONS = f"""
with recursive h as (
  select distinct user_id, lower(regexp_replace(translate(steam_id, '{_wide}', '{_narrow}'), '[^\\p{{L}}\\p{{N}}]', '', 'g')) as h
  from accounts where user_id is not null and steam_id is not null
),
hh as (select * from h where h not in ({_stand_ins}) and length(replace(h, h[1], '')) > 0),
e as (select distinct user_id, item_id, rating, timestamp from movielens
      where user_id is not null and item_id is not null and rating is not null and timestamp is not null),
t as (select a.user_id as a, b.user_id as b from e a join e b
      on a.item_id = b.item_id and a.rating = b.rating and a.timestamp = b.timestamp and a.user_id <> b.user_id
      group by 1, 2 having count(*) >= 5),
g as (select a.user_id as a, b.user_id as b from hh a join hh b on a.h = b.h and a.user_id <> b.user_id union select a, b from t),
r as (select a as user_id, b as other from g union select r.user_id, g.b from r join g on g.a = r.other),
p as (select user_id, least(user_id, min(other))::int as group_id from r group by user_id having count(*) filter (where other <> user_id) > 0)
"""
_targets = ", ".join(f"('{name}', {share}::double)" for name, share in SHARES.items())

SQL = {
    "p1_found": _PERSONS + "select * from p",
    "p1_split_totals": _PERSONS + f""",
l as (select coalesce(p.group_id, m.user_id) as person from movielens m left join p using (user_id) where m.user_id is not null)
select t.split, t.share, count(*) as all_rows, count(distinct person) as all_persons from (values {_targets}) t(split, share), l group by t.split, t.share
""",
}
