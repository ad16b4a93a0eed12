"""Queries of evaluation: the lists against the ratings of the same users."""

from __future__ import annotations

from pyspark.sql import functions as F

from recmill.functions.weights import GeometricRankWeight
from recmill.metrics import ranking as mr
from recmill.metrics.collect import MeasurementCollector, summarize
from recmill.metrics.predict import align_scores, prediction_errors
from recmill.queries.common import GENRES, RECS, TASTES, genres, recs, registry, scored, tastes
from recmill.operators.stats import category_matrix
from recmill.session import table

QUERIES, SQL, register = registry()
KEYS = ["algorithm", "user_id"]

_HITS = f"""{RECS}, {TASTES}, nt as (select user_id, count(*) as nt from tastes group by 1),
h as (select r.algorithm, r.user_id, r.item_id, r.rank, case when t.item_id is null then 0 else 1 end as rel, coalesce(t.rating, 0)::double as gain, coalesce(nt.nt, 0) as nt,
      sum(case when t.item_id is null then 0 else 1 end) over (partition by r.algorithm, r.user_id order by r.rank) as so_far,
      ln(2) / ln(greatest(r.rank, 2)) as w, pow(0.85, r.rank - 1) as g
      from recs r left join tastes t using (user_id, item_id) left join nt using (user_id))"""


def _measure(spark, d, *metrics, gain=None):
    out = mr.Hits(recs(spark, d), tastes(spark, d), KEYS, gain).measure(*metrics)
    return out.select(*KEYS, *[F.round(F.col(f"`{m.label()}`").cast("double"), 6).alias(m.label().replace("@", "_at_")) for m in metrics])


@register(f"""with {_HITS} select algorithm, user_id, count(*)::double as N, max(nt)::double as TestItemCount, case when max(nt) > 0 then max(rel)::double end as Hit,
round(sum(rel)::double / count(*), 6) as Precision, round(sum(rel)::double / nullif(max(nt), 0), 6) as Recall,
round(case when max(nt) > 0 then coalesce(1.0::double / min(rank) filter (where rel = 1), 0) end, 6) as RecipRank,
round(case when max(nt) > 0 then coalesce(sum(so_far::double / rank) filter (where rel = 1), 0) / least(max(nt), count(*)) end, 6) as AveragePrecision from h group by 1, 2""")
def metrics_relevance(spark, d):
    return _measure(spark, d, mr.ListLength(), mr.TestItemCount(), mr.Hit(), mr.Precision(), mr.Recall(), mr.RecipRank(), mr.AveragePrecision())


@register(f"""with {_HITS}, s as (select * from h where rank <= 10) select algorithm, user_id, case when max(nt) > 0 then max(rel)::double end as Hit_at_10,
round(sum(rel)::double / count(*), 6) as Precision_at_10, round(sum(rel)::double / nullif(least(max(nt), 10), 0), 6) as Recall_at_10,
round(case when max(nt) > 0 then coalesce(1.0::double / min(rank) filter (where rel = 1), 0) end, 6) as RecipRank_at_10 from s group by 1, 2""")
def metrics_relevance_at_10(spark, d):
    return _measure(spark, d, mr.Hit(10), mr.Precision(10), mr.Recall(10), mr.RecipRank(10))


@register(f"""with {_HITS}, i as (select user_id, sum(greatest(rating, 0) * ln(2) / ln(greatest(k, 2))) as ideal from (select user_id, coalesce(rating, 0)::double as rating, row_number() over (partition by user_id order by coalesce(rating, 0) desc, item_id) as k from tastes) group by 1)
select algorithm, h.user_id, round(case when max(nt) > 0 then sum(greatest(gain, 0) * w) end, 6) as DCG,
round(case when max(nt) > 0 then case when max(ideal) > 0 then sum(greatest(gain, 0) * w) / max(ideal) else 0 end end, 6) as NDCG from h left join i on i.user_id = h.user_id group by 1, 2""")
def metrics_dcg_graded(spark, d):
    return _measure(spark, d, mr.DCG(), mr.NDCG(), gain="rating")


@register(f"""with {_HITS}, i as (select user_id, sum(ln(2) / ln(greatest(k, 2))) as ideal from (select user_id, row_number() over (partition by user_id order by item_id) as k from tastes) where k <= 10 group by 1)
select algorithm, h.user_id, round(case when max(nt) > 0 then coalesce(sum(rel * w) filter (where rank <= 10), 0) / max(ideal) end, 6) as NDCG_at_10 from h left join i on i.user_id = h.user_id group by 1, 2""")
def metrics_ndcg_at_10(spark, d):
    return _measure(spark, d, mr.NDCG(10))


@register(f"with {_HITS} select algorithm, user_id, round(case when max(nt) > 0 then sum(rel * g) * 0.15 end, 6) as RBP from h group by 1, 2")
def metrics_rbp(spark, d):
    return _measure(spark, d, mr.RBP())


@register(f"with {_HITS} select algorithm, user_id, round(case when max(nt) > 0 then sum(rel * g) / ((1 - pow(0.85, least(max(nt), count(*)))) / 0.15) end, 6) as RBP from h group by 1, 2")
def metrics_rbp_normalized(spark, d):
    return _measure(spark, d, mr.RBP(normalize=True))


_PER_LIST = f"""{_HITS}, l as (select algorithm, user_id, sum(rel)::double / count(*) as p, sum(rel)::double / nullif(max(nt), 0) as r, case when max(nt) > 0 then coalesce(1.0::double / min(rank) filter (where rel = 1), 0) end as rr from h group by 1, 2),
v as (select algorithm, unnest(['Precision', 'Recall', 'RecipRank']) as metric, unnest([p, r, rr]) as value from l)"""


@register(f"with {_PER_LIST} select metric, count(value) as n, round(avg(value), 6) as mean, round(median(value), 6) as median, round(stddev_pop(value), 6) as std from v group by 1")
def run_summary(spark, d):
    c = MeasurementCollector(KEYS)
    for m in (mr.Precision(), mr.Recall(), mr.RecipRank()):
        c.add_metric(m)
    s = c.summary(recs(spark, d), tastes(spark, d))
    return s.select("metric", "n", *[F.round(x, 6).alias(x) for x in ("mean", "median", "std")])


@register(f"with {_PER_LIST} select algorithm, metric, count(value) as n, round(avg(value), 6) as mean, round(median(value), 6) as median, round(stddev_samp(value), 6) as std from v group by 1, 2")
def run_summary_by_algorithm(spark, d):
    per = mr.Hits(recs(spark, d), tastes(spark, d), KEYS).measure(mr.Precision(), mr.Recall(), mr.RecipRank())
    return summarize(per, KEYS, ["algorithm"], True).select("algorithm", "metric", "n", *[F.round(x, 6).alias(x) for x in ("mean", "median", "std")])


@register(f"with {RECS} select count(distinct item_id) as unique_items from recs")
def metrics_unique_items(spark, d):
    return mr.unique_items(recs(spark, d))


def _ranks(spark, d):
    return mr.popularity_ranks(tastes(spark, d).groupBy("item_id").agg(F.count("*").alias("count")))


@register(f"""with {RECS}, {TASTES}, c as (select item_id, count(*) as n from tastes group by 1), p as (select item_id, (rank() over (order by n) + (count(*) over (partition by n) - 1) / 2.0::double) / count(*) over () as pr from c)
select algorithm, user_id, round(avg(coalesce(pr, 0)), 6) as MeanPopRank from recs left join p using (item_id) group by 1, 2""")
def metrics_popularity(spark, d):
    return mr.mean_pop_rank(recs(spark, d), _ranks(spark, d), KEYS).withColumn("MeanPopRank", F.round("MeanPopRank", 6))


def _gini(x: str) -> str:
    return f"""with {RECS}, x as (select m.item_id, coalesce(sum({x}) filter (where r.item_id is not null), 0)::double as x from (select distinct item_id from movies) m left join recs r using (item_id) group by 1),
k as (select x, row_number() over (order by x, item_id) as k, count(*) over () as n from x) select round(greatest(sum((2 * k - n - 1) * x) / (max(n) * sum(x)), 0), 6) as gini from k"""


@register(_gini("1"))
def metrics_list_gini(spark, d):
    return mr.gini(recs(spark, d), table(spark, d, "movies")).withColumn("gini", F.round("gini", 6))


@register(_gini("pow(0.85, rank - 1)"))
def metrics_exposure_gini(spark, d):
    return mr.gini(recs(spark, d), table(spark, d, "movies"), weight=GeometricRankWeight()).withColumn("gini", F.round("gini", 6))


def _entropy(w: str) -> str:
    return f"""with {RECS}, {GENRES}, c as (select distinct item_id, g from (select item_id, unnest(genres) as g from genres) where g is not null),
l as (select distinct algorithm, user_id from recs), s as (select algorithm, user_id, g, sum({w}) as s from recs join c using (item_id) group by 1, 2, 3),
a as (select l.*, gg.g, coalesce(s.s, 0) + 1e-6::double as x from l cross join (select distinct g from c) gg left join s on s.algorithm = l.algorithm and s.user_id = l.user_id and s.g = gg.g),
t as (select *, x / sum(x) over (partition by algorithm, user_id) as p from a) select algorithm, user_id, round(-sum(p * log2(p)), 5) as Entropy from t group by 1, 2"""


@register(_entropy("1.0::double"))
def metrics_entropy(spark, d):
    cats = category_matrix(genres(spark, d), "item_id", "genres", "list")
    return mr.list_entropy(recs(spark, d), cats, KEYS).withColumn("Entropy", F.round("Entropy", 5))


@register(_entropy("pow(0.85, rank - 1)"))
def metrics_rank_biased_entropy(spark, d):
    cats = category_matrix(genres(spark, d), "item_id", "genres", "list")
    return mr.list_entropy(recs(spark, d), cats, KEYS, weight=GeometricRankWeight()).withColumn("Entropy", F.round("Entropy", 5))


@register(f"""with {RECS}, {GENRES}, c as (select distinct item_id, g from (select item_id, unnest(genres) as g from genres) where g is not null), u as (select item_id, g, 1 / sqrt(count(*) over (partition by item_id)) as v from c),
pr as (select a.algorithm, a.user_id, a.item_id as i, b.item_id as j from recs a join recs b on a.algorithm = b.algorithm and a.user_id = b.user_id and a.item_id < b.item_id),
cs as (select algorithm, user_id, i, j, coalesce(sum(x.v * y.v), 0) as c from pr left join u x on x.item_id = i left join u y on y.item_id = j and y.g = x.g group by 1, 2, 3, 4)
select r.algorithm, r.user_id, round(case when count(*) = 1 then 1 else any_value(m) end, 6) as ILS from recs r left join (select algorithm, user_id, avg(c) as m from cs group by 1, 2) k using (algorithm, user_id) group by 1, 2""")
def metrics_intra_list_similarity(spark, d):
    vec = category_matrix(genres(spark, d), "item_id", "genres", "list").withColumnRenamed("category", "dim")
    return mr.intra_list_similarity(recs(spark, d), vec, KEYS).withColumn("ILS", F.round("ILS", 6))


_TWO = f"""{RECS}, a as (select user_id, item_id, rank from recs where algorithm = 'pop'), b as (select user_id, item_id, rank from recs where algorithm = 'itemknn')"""


def _two(spark, d):
    r = recs(spark, d)
    return [r.where(F.col("algorithm") == x).select("user_id", "item_id", "rank") for x in ("pop", "itemknn")]


@register(f"""with {_TWO}, u as (select distinct user_id from a intersect select distinct user_id from b), o as (select a.user_id, greatest(a.rank, b.rank) as d from a join b using (user_id, item_id) where greatest(a.rank, b.rank) <= 10),
k as (select unnest(generate_series(1, 10)) as k), x as (select u.user_id, k.k, (select count(*) from o where o.user_id = u.user_id and o.d <= k.k) as n from u, k)
select user_id, round(sum(pow(0.85, k - 1) * n / k) / sum(pow(0.85, k - 1)), 6) as RBO from x group by 1""")
def metrics_rank_biased_overlap(spark, d):
    return mr.rank_biased_overlap(*_two(spark, d), ["user_id"]).withColumn("RBO", F.round("RBO", 6))


@register(f"with {_TWO} select b.user_id, (greatest(coalesce(max(a.rank - 1), 0), 5) - 5)::int as LIP from b left join a using (user_id, item_id) where b.rank <= 5 group by 1")
def metrics_least_item_promoted(spark, d):
    return mr.least_item_promoted(*_two(spark, d), ["user_id"], 5)


_ERRORS = f"""{RECS}, {TASTES}, e as (select s.algorithm, s.user_id, s.score::double - t.rating::double as e from scored s join tastes t using (user_id, item_id) where t.rating is not null)"""


def _aligned(spark, d):
    s = scored(spark, d)
    truth = tastes(spark, d).where("rating is not null").join(s.select("algorithm", "user_id").distinct(), "user_id")
    return align_scores(s, truth, ["algorithm", "user_id", "item_id"], missing_scores="ignore", missing_truth="ignore")


@register(f"with {_ERRORS} select algorithm, user_id, count(*) as n, round(sqrt(avg(e * e)), 5) as RMSE, round(avg(abs(e)), 5) as MAE from e group by 1, 2")
def prediction_error_by_list(spark, d):
    e = prediction_errors(_aligned(spark, d), KEYS)
    return e.select(*KEYS, "n", F.round("RMSE", 5).alias("RMSE"), F.round("MAE", 5).alias("MAE"))


@register(f"with {_ERRORS} select algorithm, count(*) as n, round(sqrt(avg(e * e)), 5) as RMSE, round(avg(abs(e)), 5) as MAE from e group by 1")
def prediction_error_overall(spark, d):
    e = prediction_errors(_aligned(spark, d), ["algorithm"])
    return e.select("algorithm", "n", F.round("RMSE", 5).alias("RMSE"), F.round("MAE", 5).alias("MAE"))
