"""Queries of scorers: every pair of the lists is scored by a model of the ratings."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from recmill.models.als import BiasedMFScorer, ImplicitMFScorer
from recmill.models.basic import BiasScorer, KnownRatingScorer, PopScorer, RandomScorer, TimeBoundedPopScorer
from recmill.models.factor import BiasedSVDScorer, BPRScorer, FlexMFExplicitScorer, FlexMFImplicitScorer, FunkSVDScorer, HPFScorer, LightGCNScorer, NMFScorer
from recmill.models.knn import AssociationScorer, ItemKNNScorer, UserKNNScorer
from recmill.models.linear import EASEScorer, SLIMScorer
from recmill.operators.recommend import best_unseen
from recmill.plans.pipeline import predict_pipeline, score as score_batch, topn_pipeline
from recmill.queries.common import LOG, SCORED, TASTES, log, pairs, registry, tastes
from recmill.session import table

QUERIES, SQL, register = registry()
PAIRS = f"{SCORED}, pairs as (select distinct user_id, item_id from scored)"


def _scored_by(spark, d, scorer, digits: int = 5):
    out = scorer.train(tastes(spark, d)).score(pairs(spark, d))
    return out.select("user_id", "item_id", F.round(F.col("score").cast("double"), digits).alias("score"))


@register("""with o as (select o_custkey as user_id, l_partkey as item_id from orders join lineitem on o_orderkey = l_orderkey),
pop as (select item_id, count(*) as n from o group by 1),
q as (select item_id, round(sum(n) over (order by n, item_id)::double / sum(n) over (), 6) as score, row_number() over (order by sum_n desc, item_id) as place
      from (select *, sum(n) over (order by n, item_id) as sum_n from pop)),
c as (select u.user_id, q.*, row_number() over (partition by u.user_id order by place)::int as rank from (select distinct user_id from o) u, q
      where (u.user_id, q.item_id) not in (select (user_id, item_id) from o))
select user_id, item_id, score, rank from c where rank <= 10""")
def recommend_popular(spark, d):
    """The ten most popular parts that each customer has not bought."""
    o = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"))
    pop = PopScorer().train(o).tables["pop"]
    return best_unseen(pop, o, o, 10).withColumn("score", F.round("score", 6))


@register(f"with {LOG} select item_id, count(*)::double as score from log group by 1")
def popularity_count(spark, d):
    return PopScorer(score="count").train(log(spark, d)).tables["pop"]


@register(f"with {LOG}, p as (select item_id, count(*) as n from log group by 1) select item_id, rank() over (order by n) + (count(*) over (partition by n) - 1) / 2.0::double as score from p")
def popularity_rank(spark, d):
    return PopScorer(score="rank").train(log(spark, d)).tables["pop"]


@register(f"with {LOG}, p as (select item_id, count(*) as n from log group by 1) select item_id, round(sum(n) over (order by n, item_id)::double / sum(n) over (), 6) as score from p")
def popularity_quantile(spark, d):
    return PopScorer().train(log(spark, d)).tables["pop"].withColumn("score", F.round("score", 6))


@register(f"with {LOG} select item_id, count(*) filter (where timestamp > timestamp '2013-01-01')::double as score from log group by 1")
def popularity_recent(spark, d):
    return TimeBoundedPopScorer(score="count", cutoff=dt.datetime(2013, 1, 1)).train(log(spark, d)).tables["pop"]


_BIAS = f"""{PAIRS}, {TASTES}, r as (select user_id, item_id, rating::double as r from tastes where rating is not null and not isnan(rating)),
g as (select avg(r) as b from r),
i as (select item_id, sum(r - b) / (count(*) + 5) as b from r, g group by 1),
u as (select user_id, sum(r - g.b - i.b) / (count(*) + 5) as b from r join i using (item_id), g group by 1)"""


@register(f"with {_BIAS} select user_id, item_id, round(g.b + coalesce(i.b, 0) + coalesce(u.b, 0), 5) as score from pairs left join i using (item_id) left join u using (user_id), g")
def score_bias(spark, d):
    return _scored_by(spark, d, BiasScorer(damping=5.0))


@register(f"with {PAIRS}, {TASTES} select user_id, item_id, rating::double as score from pairs left join (select * from tastes where rating is not null) using (user_id, item_id)")
def score_known_rating(spark, d):
    return _scored_by(spark, d, KnownRatingScorer())


@register(f"with {PAIRS}, {TASTES} select user_id, item_id, case when t.item_id is null then 0 else 1 end::double as score from pairs left join tastes t using (user_id, item_id)")
def score_known_indicator(spark, d):
    return _scored_by(spark, d, KnownRatingScorer(score="indicator"))


_RULES = f"""{PAIRS}, {TASTES}, t as (select user_id, item_id from tastes), n as (select item_id, count(*) as n from t group by 1),
c as (select a.item_id as ref, b.item_id as item_id, count(*) as c from t a join t b on a.user_id = b.user_id and a.item_id <> b.item_id group by 1, 2),
r as (select c.ref, c.item_id, c.c::double / na.n as p, c.c::double / na.n * (select count(distinct user_id) from t) / nb.n as l from c join n na on na.item_id = ref join n nb on nb.item_id = c.item_id),
s as (select p.user_id, p.item_id, sum(r.p) as sp, max(r.p) as mp, sum(r.l) as sl from pairs p join t on t.user_id = p.user_id join r on r.ref = t.item_id and r.item_id = p.item_id group by 1, 2),
k as (select user_id, count(*) as k from t group by 1)"""


@register(f"with {_RULES} select p.user_id, p.item_id, round((case when n.n is not null then coalesce(sp, 0) / k end)::float::double, 5) as score from pairs p left join s using (user_id, item_id) left join k using (user_id) left join n using (item_id)")
def score_association(spark, d):
    return _scored_by(spark, d, AssociationScorer())


@register(f"with {_RULES} select p.user_id, p.item_id, round((case when n.n is not null then coalesce(sl, 0) / k end)::float::double, 4) as score from pairs p left join s using (user_id, item_id) left join k using (user_id) left join n using (item_id)")
def score_association_lift(spark, d):
    return _scored_by(spark, d, AssociationScorer(method="lift"), 4)


@register(f"with {_RULES} select p.user_id, p.item_id, round((case when n.n is not null and k > 0 then coalesce(mp, 0) end)::float::double, 5) as score from pairs p left join s using (user_id, item_id) left join k using (user_id) left join n using (item_id)")
def score_association_max(spark, d):
    return _scored_by(spark, d, AssociationScorer(max_nbrs=1))


def _knn(item: str, user: str, explicit: bool) -> str:
    value = "rating::double" if explicit else "1.0::double"
    where = "where rating is not null and not isnan(rating)" if explicit else ""
    centre = f"avg(r) over (partition by {item})" if explicit else "0.0::double"
    return f"""{PAIRS}, {TASTES}, a as (select user_id, item_id, {value} as r from tastes {where}), m as (select *, {centre} as m from a), v as (select *, r - m as c from m),
u as (select *, c / greatest(sqrt(sum(c * c) over (partition by {item})), 1.1754943508222875e-38) as u from v),
sims as (select x.{item} as i, y.{item} as j, sum(x.u * y.u) as sim from u x join u y on x.{user} = y.{user} and x.{item} <> y.{item} where x.u <> 0 and y.u <> 0 group by 1, 2 having sum(x.u * y.u) >= 1e-6)"""


_ITEM_NEAR = """, near as (select p.user_id, p.item_id, s.sim, v.c, row_number() over (partition by p.user_id, p.item_id order by s.sim desc, s.j) as k
from pairs p join v on v.user_id = p.user_id join sims s on s.i = p.item_id and s.j = v.item_id)"""


@register(f"""with {_knn("item_id", "user_id", True)}{_ITEM_NEAR}, g as (select user_id, item_id, sum(sim * c) / sum(sim) as s from near where k <= 20 group by 1, 2)
select p.user_id, p.item_id, round((g.s + m.m)::float::double, 4) as score from pairs p left join g using (user_id, item_id) left join (select item_id, any_value(m) as m from m group by 1) m using (item_id)""")
def score_item_knn(spark, d):
    return _scored_by(spark, d, ItemKNNScorer(), 4)


@register(f"""with {_knn("item_id", "user_id", False)}{_ITEM_NEAR}, g as (select user_id, item_id, sum(sim) as s from near where k <= 20 group by 1, 2)
select p.user_id, p.item_id, round(g.s::float::double, 4) as score from pairs p left join g using (user_id, item_id)""")
def score_item_knn_implicit(spark, d):
    return _scored_by(spark, d, ItemKNNScorer(feedback="implicit"), 4)


_USER_NEAR = """, near as (select p.user_id, p.item_id, s.sim, v.c, row_number() over (partition by p.user_id, p.item_id order by s.sim desc, s.j) as k
from pairs p join v on v.item_id = p.item_id join sims s on s.i = p.user_id and s.j = v.user_id)"""


@register(f"""with {_knn("user_id", "item_id", True)}{_USER_NEAR}, g as (select user_id, item_id, sum(sim * c) / sum(sim) as s from near where k <= 20 group by 1, 2)
select p.user_id, p.item_id, round((g.s + m.m)::float::double, 4) as score from pairs p left join g using (user_id, item_id) left join (select user_id, any_value(m) as m from m group by 1) m using (user_id)""")
def score_user_knn(spark, d):
    return _scored_by(spark, d, UserKNNScorer(), 4)


@register(f"""with {_knn("user_id", "item_id", False)}{_USER_NEAR}, g as (select user_id, item_id, sum(sim) as s from near where k <= 20 group by 1, 2)
select p.user_id, p.item_id, round(g.s::float::double, 4) as score from pairs p left join g using (user_id, item_id)""")
def score_user_knn_implicit(spark, d):
    return _scored_by(spark, d, UserKNNScorer(feedback="implicit"), 4)


@register(f"""with {_BIAS}, ii as (select item_id, sum(r - b) / count(*) as b from r, g group by 1), uu as (select user_id, sum(r - g.b - ii.b) / count(*) as b from r join ii using (item_id), g group by 1)
select user_id, item_id, round(coalesce(t.r, g.b + coalesce(ii.b, 0) + coalesce(uu.b, 0)), 5) as score from pairs left join r t using (user_id, item_id) left join ii using (item_id) left join uu using (user_id), g""")
def predict_with_fallback(spark, d):
    """A pipeline: the known rating, else the biases."""
    p = predict_pipeline(KnownRatingScorer())
    p.train(tastes(spark, d))
    out = p.run(items=pairs(spark, d))
    return out.select("user_id", "item_id", F.round(F.col("score").cast("double"), 5).alias("score"))


@register(f"""with {_RULES}, q as (select distinct user_id from pairs), todo as (select q.user_id, n.item_id from q, n where (q.user_id, n.item_id) not in (select (user_id, item_id) from t)),
f as (select x.user_id, r.item_id, sum(r.p) as s from t x join q using (user_id) join r on r.ref = x.item_id group by 1, 2),
o as (select c.user_id, c.item_id, row_number() over (partition by c.user_id order by (coalesce(f.s, 0) / k.k)::float desc, c.item_id)::int as rank
      from todo c join k using (user_id) left join f using (user_id, item_id))
select user_id, item_id, rank from o where rank <= 10""")
def pipeline_recommend(spark, d):
    """The standard top-N pipeline with association rules, for all users of the lists at once."""
    p = topn_pipeline(AssociationScorer(), 10)
    p.train(tastes(spark, d))
    return p.run("recommender", query=pairs(spark, d).select("user_id").distinct()).select("user_id", "item_id", "rank")


_MODEL_SQL = {
    # the seed 0 of the model's configuration
    "model_random": f"with {PAIRS} select user_id, item_id, round(((('0x' || substr(md5(concat_ws('|', user_id, item_id, '0')), 1, 12))::bigint + 0.5::double) / 281474976710656)::float::double, 4) as score from pairs",
}


def _model(name: str, make):
    def run(spark, d):
        p = topn_pipeline(make())
        p.train(tastes(spark, d))
        return score_batch(p, pairs(spark, d)).select("user_id", "item_id", F.round(F.col("score").cast("double"), 4).alias("score"))

    run.__name__ = name
    register(_MODEL_SQL.get(name))(run)


for _name, _make in {
    "model_als_explicit": lambda: BiasedMFScorer(embedding_size=8, epochs=3),
    "model_als_implicit": lambda: ImplicitMFScorer(embedding_size=8, epochs=3),
    "model_ease": EASEScorer,
    "model_slim": lambda: SLIMScorer(max_nbrs=50),
    "model_biased_svd": lambda: BiasedSVDScorer(embedding_size=8),
    "model_nmf": lambda: NMFScorer(embedding_size=8, max_iter=50),
    "model_funksvd": lambda: FunkSVDScorer(embedding_size=4, epochs=5),
    "model_hpf": lambda: HPFScorer(embedding_size=8, max_iter=10),
    "model_flexmf_explicit": lambda: FlexMFExplicitScorer(embedding_size=8, epochs=3),
    "model_flexmf_logistic": lambda: FlexMFImplicitScorer(embedding_size=8, epochs=3),
    "model_flexmf_bpr": lambda: BPRScorer(embedding_size=8, epochs=3),
    "model_flexmf_warp": lambda: FlexMFImplicitScorer(preset="warp", embedding_size=8, epochs=3),
    "model_lightgcn": lambda: LightGCNScorer(embedding_size=8, epochs=3),
    "model_random": RandomScorer,
}.items():
    _model(_name, _make)
