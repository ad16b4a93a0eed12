"""Queries of datasets: cleaning, coalescing, statistics, attributes, co-occurrence."""

from __future__ import annotations

from pyspark.sql import functions as F

from recmill.data.builder import DatasetBuilder, drop_exact, keep_last
from recmill.operators import stats
from recmill.operators.order import number_rows
from recmill.queries.common import GENRES, LOG, TASTES, genres, log, registry, tastes
from recmill.session import table

QUERIES, SQL, register = registry()


def _built(spark, d):
    b = DatasetBuilder(spark, "movies")
    b.add_entities("item", table(spark, d, "movies"))
    b.add_interactions("rating", log(spark, d).drop("loaded_at"), entities=["user", "item"], missing="insert", default=True)
    # the table's own order, not that of the scan, decides what is last
    b.relations["rating"] = log(spark, d).drop("loaded_at")
    return b.build()


@register(f"with {LOG} select user_id, item_id, rating::double as rating, timestamp, loaded_at from (select *, row_number() over (partition by user_id, item_id order by ord desc) as k from log) where k = 1")
def remove_repeats(spark, d):
    return keep_last(log(spark, d), ["user_id", "item_id"], "_ord", "_ord").select("user_id", "item_id", F.col("rating").cast("double").alias("rating"), "timestamp", "loaded_at")


@register("select user_id, count(*) as n_rows from (select distinct * from movielens) group by user_id")
def remove_exact_duplicates(spark, d):
    return drop_exact(table(spark, d, "movielens")).groupBy("user_id").agg(F.count("*").alias("n_rows"))


@register(f"with {LOG} select user_id, item_id, timestamp from log where timestamp >= timestamp '2008-01-01' and timestamp < timestamp '2012-07-01'")
def filter_by_time(spark, d):
    b = DatasetBuilder(spark)
    b.relations["rating"] = log(spark, d)
    b.filter_interactions("rating", "2008-01-01T00:00:00+00:00", "2012-07-01T00:00:00+00:00")
    return b.relations["rating"].select("user_id", "item_id", "timestamp")


@register(f"with {LOG} select user_id, item_id, timestamp from log where (user_id, item_id) not in (select (\"user\", item) from topn_java_ratings where \"user\" is not null and item is not null)")
def remove_listed(spark, d):
    b = DatasetBuilder(spark)
    b.relations["rating"] = log(spark, d)
    b.filter_interactions("rating", remove=tastes(spark, d).select("user_id", "item_id"))
    return b.relations["rating"].select("user_id", "item_id", "timestamp")


@register(f"with {LOG} select user_id, item_id, rating::double as rating from log where rating >= 3.5")
def binarize_remove(spark, d):
    b = DatasetBuilder(spark)
    b.relations["rating"] = log(spark, d)
    b.binarize_ratings("rating", 3.5, "remove")
    return b.relations["rating"].select("user_id", "item_id", F.col("rating").cast("double").alias("rating"))


@register(f"with {LOG} select user_id, item_id, case when rating >= 3.5 then 1.0 else 0.0 end::double as rating from log")
def binarize_zero(spark, d):
    b = DatasetBuilder(spark)
    b.relations["rating"] = log(spark, d)
    b.binarize_ratings("rating", 3.5, "zero")
    return b.relations["rating"].select("user_id", "item_id", F.col("rating").cast("double").alias("rating"))


@register(f"with {LOG} select item_id, (row_number() over (order by item_id) - 1)::int as item_num from (select item_id from movies union select item_id from log)")
def item_numbers(spark, d):
    return _built(spark, d).numbering("item")


@register(f"""with {LOG} select user_id, item_id, arg_max(coalesce(rating, -1), ord)::double as rating, count(*) as count, min(timestamp) as first_timestamp, max(timestamp) as timestamp
from log group by user_id, item_id""")
def interaction_matrix(spark, d):
    m = _built(spark, d).interactions().matrix()
    return m.select("user_id", "item_id", F.coalesce("rating", F.lit(-1.0)).cast("double").alias("rating"), "count", "first_timestamp", "timestamp")


@register(f"with {LOG} select count(*) as count from log")
def interaction_count(spark, d):
    return stats.interaction_count(log(spark, d))


_MATRIX = f"""{LOG},
m as (select user_id, item_id, nullif(arg_max(coalesce(rating, -1), ord), -1)::double as rating, count(*) as n, max(timestamp) as timestamp from log group by user_id, item_id)"""


@register(f"""with {_MATRIX}, s as (
select item_id, count(*) as record_count, sum(n)::bigint as count, count(distinct user_id) as user_count, count(rating) as rating_count,
       round(avg(rating), 6) as mean_rating, min(timestamp) as first_time, max(timestamp) as last_time from m group by item_id)
select item_id, coalesce(record_count, 0) as record_count, coalesce(count, 0) as count, coalesce(user_count, 0) as user_count, coalesce(rating_count, 0) as rating_count, mean_rating, first_time, last_time
from (select item_id from movies union select item_id from log) left join s using (item_id)""")
def item_stats(spark, d):
    return _built(spark, d).item_stats().withColumn("mean_rating", F.round("mean_rating", 6))


@register(f"""with {_MATRIX} select user_id, count(*) as record_count, sum(n)::bigint as count, count(distinct item_id) as item_count, count(rating) as rating_count,
round(avg(rating), 6) as mean_rating, min(timestamp) as first_time, max(timestamp) as last_time from m group by user_id""")
def user_stats(spark, d):
    return _built(spark, d).user_stats().withColumn("mean_rating", F.round("mean_rating", 6))


@register(f"""with {LOG}, u as (select user_id, list_sort(list(distinct item_id)) as items from log group by user_id)
select user_id, len(items)::int as n_items, items[1] as first_item, items[-1] as last_item from u""")
def user_item_lists(spark, d):
    lists = _built(spark, d).interactions().item_lists()
    return lists.select("user_id", F.size("items").alias("n_items"), F.try_element_at("items", F.lit(1)).alias("first_item"), F.try_element_at("items", F.lit(-1)).alias("last_item"))


@register(f"with {LOG}, m as (select item_id, user_id, count(*) as count from log group by 1, 2) select item_id, count(*) as n_users, sum(count)::bigint as n_rows from m group by item_id")
def transposed_matrix(spark, d):
    m = _built(spark, d).interactions().matrix("item", "user")
    return m.groupBy("item_id").agg(F.count("*").alias("n_users"), F.sum("count").alias("n_rows"))


@register(f"with {TASTES} select a.item_id as item_a, b.item_id as item_b, count(*) as n from tastes a join tastes b on a.user_id = b.user_id and a.item_id <> b.item_id group by 1, 2")
def cooccurrences(spark, d):
    return stats.cooccurrence(tastes(spark, d), "user_id", "item_id")


@register(f"with {TASTES} select a.item_id as item_a, b.item_id as item_b, count(*) as n from tastes a join tastes b on a.user_id = b.user_id group by 1, 2")
def cooccurrence_gram(spark, d):
    return stats.cooccurrence(tastes(spark, d), "user_id", "item_id", diagonal=True)


@register("""with l as (select l_orderkey as g, l_partkey as i, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey) as r from lineitem)
select a.i as item_a, b.i as item_b, count(*) as n from l a join l b on a.g = b.g and a.r < b.r group by 1, 2""")
def ordered_cooccurrences(spark, d):
    return stats.ordered_cooccurrence(table(spark, d, "lineitem"), "l_orderkey", "l_partkey", ["l_linenumber"])


@register("select item_id, u as user_id from (select item_id, unnest(user_ids) as u from iu_ratings)")
def explode_lists(spark, d):
    return stats.explode_list(table(spark, d, "iu_ratings").select("item_id", "user_ids"), "user_ids", "user_id")


@register(f"with {GENRES} select distinct item_id, g as category, 1.0::double as value from (select item_id, unnest(genres) as g from genres) where g is not null")
def genre_matrix(spark, d):
    return stats.category_matrix(genres(spark, d), "item_id", "genres", "list")


@register(f"""with {GENRES}, c as (select distinct item_id, g as category from (select item_id, unnest(genres) as g from genres) where g is not null)
select item_id, category, round(1 / sqrt(count(*) over (partition by item_id)), 6) as value from c""")
def genre_matrix_unit(spark, d):
    return stats.category_matrix(genres(spark, d), "item_id", "genres", "list", normalize="unit").withColumn("value", F.round("value", 6))


@register(f"""with {GENRES}, c as (select distinct item_id, g as category from (select item_id, unnest(genres) as g from genres) where g is not null)
select item_id, category, round(1.0::double / count(*) over (partition by item_id), 6) as value from c""")
def genre_matrix_distribution(spark, d):
    return stats.category_matrix(genres(spark, d), "item_id", "genres", "list", normalize="distribution").withColumn("value", F.round("value", 6))


@register("select p_partkey as item_id, p_brand as category, 1.0::double as value from part where p_brand is not null")
def scalar_matrix(spark, d):
    return stats.category_matrix(table(spark, d, "part").withColumnRenamed("p_partkey", "item_id"), "item_id", "p_brand")


@register("""with v as (select vec_id, (unnest(generate_series(1, len(embedding))) - 1)::int as dim, unnest(embedding)::double as x from embeddings),
n as (select vec_id, sqrt(sum(x * x)) as s from v group by vec_id)
select vec_id, dim::varchar as category, round(x / s, 6) as value from v join n using (vec_id) where x <> 0""")
def vector_matrix_unit(spark, d):
    return stats.category_matrix(table(spark, d, "embeddings"), "vec_id", "embedding", "vector", normalize="unit").withColumn("value", F.round("value", 6))


@register("""with g as (select unnest(case when genres = '' then [] else string_split(genres, '|') end) as tag from movies)
select lower(tag) as tag, count(*) as n from g where tag is not null group by 1""")
def tag_counts(spark, d):
    from recmill.sources.movielens import tag_counts as count

    tags = stats.explode_list(genres(spark, d), "genres", "tag")
    return count(tags.withColumn("item_id", F.lit(0))).select("tag", "n")


@register("select l_returnflag, count(l_quantity) as n, round(avg(l_quantity), 6) as mean, median(l_quantity) as median, round(stddev_pop(l_quantity), 6) as std from lineitem group by l_returnflag")
def value_statistics(spark, d):
    s = stats.value_stats(table(spark, d, "lineitem"), "l_quantity", ["l_returnflag"])
    return s.select("l_returnflag", "n", F.round("mean", 6).alias("mean"), "median", F.round("std", 6).alias("std"))


@register("select row_number() over (order by steam_id, user_id, seen_at nulls first, items_count nulls first) - 1 as num, steam_id, user_id from accounts where steam_id is not null")
def account_numbers(spark, d):
    a = table(spark, d, "accounts").where("steam_id is not null")
    return number_rows(a, "steam_id", "user_id", "seen_at", "items_count").select("num", "steam_id", "user_id")


@register("select time_bucket(interval 1 day, ts) as start, event_type, count(*) as n from events where event_type is not null and ts is not null group by 1, 2")
def event_popularity(spark, d):
    from recmill.streaming.popularity import windowed_counts

    return windowed_counts(table(spark, d, "events"), "event_type")
