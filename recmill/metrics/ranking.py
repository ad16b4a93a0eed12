"""Metrics of ranked lists. ``Hits`` joins output and test lists once; every metric is then an aggregate over that
one frame, so a whole set of metrics costs one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recmill.functions.weights import GeometricRankWeight, LogRankWeight, RankWeight
from recmill.operators.order import average_rank, gini_terms


def _grouped(df: DataFrame, keys: Sequence[str], *aggs: Column) -> DataFrame:
    return df.groupBy(*keys).agg(*aggs)


class Hits:
    """Output lists ``recs(keys, item_id, rank, ...)`` against ``test(test keys, item_id[, gain])``.

    ``test_keys`` (default: the keys that test has) are matched; lists without a test list are measured
    against an empty one. ``lists`` (keys) names lists that may be empty. Items of a test list count once.
    """

    def __init__(self, recs: DataFrame, test: DataFrame, keys: Sequence[str], gain: str | None = None, lists: DataFrame | None = None, item: str = "item_id"):
        self.keys, self.item = list(keys), item
        self.on = [k for k in self.keys if k in test.columns]
        g = F.max(F.coalesce(F.col(gain), F.lit(0.0)).cast("double")) if gain else F.lit(1.0)
        self.truth = test.where(F.col(item).isNotNull()).groupBy(*self.on, item).agg(g.alias("gain"))
        self.sizes = self.truth.groupBy(*self.on).agg(F.count("*").alias("n_test"))
        marked = self.truth.withColumn("rel", F.lit(1))
        self.rows = recs.join(marked, [*self.on, item], "left").withColumn("rel", F.coalesce("rel", F.lit(0))).withColumn("gain", F.coalesce("gain", F.lit(0.0)))
        self.lists = (lists if lists is not None else recs).select(*self.keys).distinct()

    def measure(self, *metrics: ListMetric) -> DataFrame:
        """(keys, one column per metric): null where a metric is undefined for a list."""
        base = self.lists.join(self.sizes, self.on, "left").withColumn("n_test", F.coalesce("n_test", F.lit(0)))
        n_max = [m.n for m in metrics]
        rows = self.rows if None in n_max else self.rows.where(F.col("rank") <= max(n_max))
        rows = rows.withColumn("hits_so_far", F.sum("rel").over(Window.partitionBy(*self.keys).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)))
        parts = [p.alias(f"{m.label()}::{i}") for m in metrics for i, p in enumerate(m.partials())]
        found = rows.groupBy(*self.keys).agg(*parts) if parts else rows.select(*self.keys).distinct()
        out = base.join(found, self.keys, "left")
        for m in {m.weight_key(): m for m in metrics if isinstance(m, NDCG)}.values():
            ideal = m.ideal(self)
            out = out.join(ideal, self.on, "left")
        return out.select(*self.keys, *[m.final(lambda i, m=m: F.coalesce(F.col(f"`{m.label()}::{i}`"), F.lit(0)), F.col("n_test")).alias(m.label()) for m in metrics])


class ListMetric:
    """partials(): aggregates over a list's rows; final(part, n_test): the value from them."""

    def __init__(self, n: int | None = None):
        self.n = n

    def label(self) -> str:
        return type(self).__name__ + (f"@{self.n}" if self.n else "")

    def inside(self, x: Column) -> Column:
        return x if self.n is None else F.when(F.col("rank") <= self.n, x)

    def length(self) -> Column:
        return F.count(self.inside(F.lit(1)))

    def partials(self) -> list[Column]:
        return []

    def final(self, part, n_test: Column) -> Column:
        raise NotImplementedError


class ListLength(ListMetric):
    def label(self) -> str:
        return "N"

    def partials(self):
        return [self.length()]

    def final(self, part, n_test):
        return part(0)


class TestItemCount(ListMetric):
    __test__ = False

    def final(self, part, n_test):
        return n_test


class Hit(ListMetric):
    def partials(self):
        return [F.max(self.inside(F.col("rel")))]

    def final(self, part, n_test):
        return F.when(n_test > 0, part(0).cast("double"))


class Precision(ListMetric):
    def partials(self):
        return [F.sum(self.inside(F.col("rel"))), self.length()]

    def final(self, part, n_test):
        return F.try_divide(part(0), part(1))


class Recall(ListMetric):
    def partials(self):
        return [F.sum(self.inside(F.col("rel")))]

    def final(self, part, n_test):
        return F.try_divide(part(0), F.least(n_test, F.lit(self.n)) if self.n else n_test)


class RecipRank(ListMetric):
    def partials(self):
        return [F.min(self.inside(F.when(F.col("rel") == 1, F.col("rank"))))]

    def final(self, part, n_test):
        return F.when(n_test > 0, F.when(part(0) > 0, 1 / part(0)).otherwise(0.0))


class AveragePrecision(ListMetric):
    def partials(self):
        return [F.sum(self.inside(F.when(F.col("rel") == 1, F.col("hits_so_far") / F.col("rank")))), self.length()]

    def final(self, part, n_test):
        return F.when(n_test > 0, F.try_divide(part(0), F.least(n_test, part(1))))


class DCG(ListMetric):
    def __init__(self, n: int | None = None, weight: RankWeight | None = None):
        super().__init__(n)
        self.weight = weight or LogRankWeight()

    def partials(self):
        return [F.sum(self.inside(F.greatest("gain", F.lit(0.0)) * self.weight.weight(F.col("rank"))))]

    def final(self, part, n_test):
        return F.when(n_test > 0, part(0).cast("double"))


class NDCG(DCG):
    def weight_key(self) -> str:
        return f"_ideal_{self.label()}"

    def ideal(self, hits: Hits) -> DataFrame:
        w = Window.partitionBy(*hits.on).orderBy(F.desc("gain"), hits.item)
        best = hits.truth.withColumn("rank", F.row_number().over(w))
        if self.n:
            best = best.where(F.col("rank") <= self.n)
        return best.groupBy(*hits.on).agg(F.sum(F.greatest("gain", F.lit(0.0)) * self.weight.weight(F.col("rank"))).alias(self.weight_key()))

    def final(self, part, n_test):
        ideal = F.col(f"`{self.weight_key()}`")
        return F.when(n_test > 0, F.when(ideal > 0, part(0) / ideal).otherwise(0.0))


class RBP(ListMetric):
    """Weighted hits, over the series sum, or (normalize) over what the test items could reach. With ``weight_field``
    the lists bring their own weights, and the hits' share of their list's weights is measured."""

    def __init__(self, n: int | None = None, patience: float = 0.85, normalize: bool = False, weight: RankWeight | None = None, weight_field: str | None = None):
        super().__init__(n)
        if weight_field is not None and normalize:
            raise ValueError("weights of a field have no known best sum to normalize by")
        self.weight, self.normalize, self.weight_field = weight or GeometricRankWeight(patience), normalize, weight_field

    def partials(self):
        w = self.weight.weight(F.col("rank")) if self.weight_field is None else F.coalesce(F.col(self.weight_field).cast("double"), F.lit(0.0))
        return [F.sum(self.inside(F.when(F.col("rel") == 1, w))), F.sum(self.inside(w)), self.length()]

    def final(self, part, n_test):
        norm = self.weight.series_sum() if self.weight_field is None else None
        best = self.weight.first(F.least(n_test, part(2))) if self.normalize else F.lit(norm) if norm else part(1)
        return F.when(n_test > 0, F.coalesce(F.try_divide(part(0), best), F.lit(0.0)))


# -- metrics of items and whole runs


def popularity_ranks(counts: DataFrame, item: str = "item_id", count: str = "count") -> DataFrame:
    """Mean rank among items with a positive count, over their number: most popular 1; others 0."""
    seen = average_rank(counts.where(F.col(count) > 0), count, "_r")
    n = seen.agg(F.count("*").alias("_n"))
    return counts.select(item).join(seen.crossJoin(F.broadcast(n)).select(item, (F.col("_r") / F.col("_n")).alias("pop_rank")), item, "left").fillna(0.0, ["pop_rank"])


def mean_pop_rank(recs: DataFrame, ranks: DataFrame, keys: Sequence[str], n: int | None = None, item: str = "item_id") -> DataFrame:
    r = recs if n is None else recs.where(F.col("rank") <= n)
    return r.join(ranks, item, "left").groupBy(*keys).agg(F.avg(F.coalesce("pop_rank", F.lit(0.0))).alias("MeanPopRank"))


def list_entropy(recs: DataFrame, categories: DataFrame, keys: Sequence[str], n: int | None = None, weight: RankWeight | None = None, item: str = "item_id", smooth: float = 1e-6) -> DataFrame:
    """Base-2 entropy of a list's (weighted) category sums; every category, also an absent one, is smoothed."""
    r = recs if n is None else recs.where(F.col("rank") <= n)
    w = weight.weight(F.col("rank")) if weight else F.lit(1.0)
    every = categories.select("category").distinct()
    n_cats = every.agg(F.count("*").alias("_k"))
    sums = r.withColumn("_w", w).join(categories, item).groupBy(*keys, "category").agg(F.sum(F.col("_w") * F.col("value")).alias("s"))
    total = sums.groupBy(*keys).agg(F.sum("s").alias("t"), F.count("*").alias("m"), F.sum((F.col("s") + smooth) * F.log2(F.col("s") + smooth)).alias("sl"))
    lists = r.select(*keys).distinct().join(total, list(keys), "left").fillna(0, ["t", "m", "sl"]).crossJoin(F.broadcast(n_cats))
    # sum over all categories of -(x/T) log2(x/T), absent ones holding x = smooth
    T = F.col("t") + F.col("_k") * smooth
    xlogx = F.col("sl") + (F.col("_k") - F.col("m")) * smooth * F.log2(F.lit(smooth))
    return lists.select(*keys, (F.log2(T) - xlogx / T).alias("Entropy"))


def intra_list_similarity(recs: DataFrame, vectors: DataFrame, keys: Sequence[str], n: int | None = None, item: str = "item_id") -> DataFrame:
    """Mean cosine over the pairs of a list, from the squared length of the sum of unit vectors (no pairs are made);
    lists of one item give 1. ``vectors(item, dim, value)``."""
    r = recs if n is None else recs.where(F.col("rank") <= n)
    size = F.sqrt(F.sum(F.col("value") * F.col("value")).over(Window.partitionBy(item)))
    unit = vectors.select(item, "dim", F.try_divide(F.col("value"), size).alias("v"))
    joined = r.join(unit, item)
    per_dim = joined.groupBy(*keys, "dim").agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    sums = per_dim.groupBy(*keys).agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.sum("q").alias("qq"))
    counts = r.groupBy(*keys).agg(F.count("*").alias("n"))
    return counts.join(sums, list(keys), "left").select(*keys, F.when(F.col("n") <= 1, 1.0).otherwise((F.coalesce("ss", F.lit(0.0)) - F.coalesce("qq", F.lit(0.0))) / (F.col("n") * (F.col("n") - 1))).alias("ILS"))


def gini(recs: DataFrame, items: DataFrame, n: int | None = None, weight: RankWeight | None = None, item: str = "item_id") -> DataFrame:
    """Gini coefficient over all ``items`` of how often (or, with a weight, how prominently) they are listed."""
    r = recs if n is None else recs.where(F.col("rank") <= n)
    w = weight.weight(F.col("rank")) if weight else F.lit(1.0)
    per = r.groupBy(item).agg(F.sum(w).alias("_x"))
    return gini_terms(items.select(item).distinct().join(per, item, "left"), "_x")


def unique_items(recs: DataFrame, item: str = "item_id") -> DataFrame:
    return recs.agg(F.count_distinct(item).alias("unique_items"))


# -- comparing two rankings


def rank_biased_overlap(a: DataFrame, b: DataFrame, keys: Sequence[str], n: int = 10, weight: RankWeight | None = None, item: str = "item_id") -> DataFrame:
    """sum of w(d) |A_d and B_d| / d over depths 1..n, over the sum of w(d)."""
    weight = weight or GeometricRankWeight()
    lists = a.select(*keys).distinct().join(b.select(*keys).distinct(), list(keys))
    both = a.where(F.col("rank") <= n).select(*keys, item, F.col("rank").alias("ra")).join(b.where(F.col("rank") <= n).select(*keys, item, F.col("rank").alias("rb")), [*keys, item]).withColumn("d", F.greatest("ra", "rb"))
    # an item common from depth d on adds w(k)/k for each k >= d
    tail = F.aggregate(F.sequence(F.col("d"), F.lit(n)), F.lit(0.0), lambda s, k: s + weight.weight(k) / k)
    total = weight.first(F.lit(n))
    per = both.groupBy(*keys).agg(F.sum(tail).alias("s"))
    return lists.join(per, list(keys), "left").select(*keys, (F.coalesce("s", F.lit(0.0)) / total).alias("RBO"))


def least_item_promoted(a: DataFrame, b: DataFrame, keys: Sequence[str], n: int = 10, item: str = "item_id") -> DataFrame:
    """How far down the reference list ``a`` the first n items of ``b`` reach below place n."""
    top = b.where(F.col("rank") <= n).select(*keys, item)
    return top.join(a.select(*keys, item, F.col("rank").alias("ra")), [*keys, item], "left").groupBy(*keys).agg((F.greatest(F.coalesce(F.max(F.col("ra") - 1), F.lit(0)), F.lit(n)) - n).alias("LIP"))
