from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recmill.llm.setjoin import distinct_sets, expand_pairs, least_threshold, similar_sets
from recmill.session import cut, table

#: Tasks that may share one search.
MAX_TASKS = 1_000


def _pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    tasks = table(spark, sf_dir, "item_sim_tasks").where("task_id is not null and min_sim is not null")
    least = least_threshold([tasks.agg(F.min("min_sim")).first()[0]])
    sets, copies = distinct_sets(table(spark, sf_dir, "iu_ratings"), "item_id", "user_ids")
    return tasks, cut(similar_sets(sets, least if least is not None else 1.0), "pairs"), copies


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of the least strict task, given to every task that they satisfy."""
    tasks, pairs, copies = _pairs(spark, sf_dir)
    given = tasks.select("task_id", F.col("min_sim").cast("double").alias("min_sim")).distinct().limit(MAX_TASKS + 1).collect()
    if len(given) > MAX_TASKS:
        raise ValueError(f"more than {MAX_TASKS} tasks")
    every = F.array(*[F.struct(F.lit(r["task_id"]).alias("task_id"), F.lit(r["min_sim"]).alias("min_sim")) for r in given]) if given else F.array().cast("array<struct<task_id:int,min_sim:double>>")
    found = expand_pairs(pairs, copies).withColumn("t", F.explode(F.filter(every, lambda t: F.col("sim") >= t["min_sim"])))
    return found.select("t.task_id", F.col("record_a").cast("int").alias("item_a"), F.col("record_b").cast("int").alias("item_b"))


def p4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per item: its class of equal sets, the class's size and the number of similar other classes."""
    _, pairs, copies = _pairs(spark, sf_dir)
    links = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n_links"))
    sizes = copies.groupBy("id").agg(F.count("*").alias("class_size"))
    out = copies.join(sizes, "id").join(links, "id", "left")
    return out.select(F.col("record").cast("int").alias("item_id"), F.col("id").cast("int").alias("class_id"), "class_size", F.coalesce("n_links", F.lit(0)).alias("n_links"))


QUERIES = {"p4_found": p4_found, "p4_classes": p4_classes}

_SETS = """
with s as (select distinct item_id, unnest(user_ids) as u from iu_ratings),
d as (select * from s where u is not null and item_id is not null),
n as (select item_id, count(*) as n, list_sort(list(u)) as members from d group by item_id),
"""
SQL = {
    "p4_found": _SETS
    + """
p as (select a.item_id as item_a, b.item_id as item_b, count(*) as c from d a join d b on a.u = b.u and a.item_id < b.item_id group by 1, 2)
select task_id, item_a, item_b from p join n x on x.item_id = item_a join n y on y.item_id = item_b
join item_sim_tasks t on c / (x.n + y.n - c)::double >= t.min_sim::double
""",
    "p4_classes": _SETS
    + """
k as (select members, min(item_id) as class_id, count(*) as class_size from n group by members),
e as (select k.class_id, unnest(members) as u, len(members) as n from k),
p as (select a.class_id as a, b.class_id as b, count(*) as c, any_value(a.n) as na, any_value(b.n) as nb
      from e a join e b on a.u = b.u and a.class_id <> b.class_id group by 1, 2),
l as (select a as class_id, count(*) as n_links from p where c / (na + nb - c)::double >= (select min(min_sim)::double from item_sim_tasks) group by a)
select item_id, class_id, class_size, coalesce(n_links, 0) as n_links from n join k using (members) left join l using (class_id)
""",
}
