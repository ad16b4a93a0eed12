from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recmill.llm.cooccur import basket_pairs, counter_pairs
from recmill.session import table


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = basket_pairs(table(spark, sf_dir, "topn_java_ratings"), "user", "item", 10, 4.0)
    counted = counter_pairs(table(spark, sf_dir, "pair_counter_rows"), "row_item", "col_item", "hits", 15, 5.0)
    return lists.select(F.lit("topn_java_ratings").alias("table_name"), "item_a", "item_b").unionByName(counted.select(F.lit("pair_counter_rows").alias("table_name"), "item_a", "item_b"))


def p5_basket_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair that is in a list, with its measures."""
    out = basket_pairs(table(spark, sf_dir, "topn_java_ratings"), "user", "item")
    return out.withColumn("lift", F.round("lift", 6)).withColumn("log_odds", F.round("log_odds", 6))


def p5_counter_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = counter_pairs(table(spark, sf_dir, "pair_counter_rows"), "row_item", "col_item", "hits")
    return out.withColumn("lift", F.round("lift", 6)).withColumn("log_odds", F.round("log_odds", 6))


QUERIES = {"p5_found": p5_found, "p5_basket_pairs": p5_basket_pairs, "p5_counter_pairs": p5_counter_pairs}

_WITH = """
with d as (select distinct "user" as g, item as i from topn_java_ratings where "user" is not null and item is not null),
s as (select i, count(*) as n from d group by i),
bp as (select x.i as item_a, y.i as item_b, count(*) as n_both from d x join d y on x.g = y.g and x.i < y.i group by 1, 2),
b as (select bp.*, sa.n as n_a, sb.n as n_b, (select count(distinct g) from d) as n_baskets
      from bp join s sa on sa.i = item_a join s sb on sb.i = item_b),
e as (select row_item as r, col_item as c, coalesce(hits, 1) as h from (select distinct * from pair_counter_rows)
      where row_item is not null and col_item is not null and row_item <> col_item),
m as (select i, sum(h)::bigint as m from (select r as i, h from e union all select c, h from e) group by i),
cp as (select least(r, c) as item_a, greatest(r, c) as item_b, sum(h)::bigint as hits from e group by 1, 2),
k as (select cp.*, ma.m as hits_a, mb.m as hits_b, (select sum(h)::bigint from e) as hits_all
      from cp join m ma on ma.i = item_a join m mb on mb.i = item_b)
"""


def _odds(c: str, a: str, b: str, n: str) -> str:
    return f"round(ln((({c} + 0.5::double) * (greatest({n} - {a} - {b} + {c}, 0) + 0.5::double)) / (({a} - {c} + 0.5::double) * ({b} - {c} + 0.5::double))), 6)"


SQL = {
    "p5_found": _WITH
    + """
select 'topn_java_ratings' as table_name, item_a, item_b from b where n_both >= 10 and n_both * n_baskets >= 4 * n_a * n_b
union all
select 'pair_counter_rows', item_a, item_b from k where hits >= 15 and hits * hits_all >= 5 * hits_a * hits_b
""",
    "p5_basket_pairs": _WITH + f"select *, round(n_both * n_baskets / (n_a * n_b)::double, 6) as lift, {_odds('n_both', 'n_a', 'n_b', 'n_baskets')} as log_odds from b",
    "p5_counter_pairs": _WITH + f"select *, round(hits * hits_all / (hits_a * hits_b)::double, 6) as lift, {_odds('hits', 'hits_a', 'hits_b', 'hits_all')} as log_odds from k",
}
