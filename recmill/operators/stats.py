"""Aggregations over interaction logs: coalescing, counts, statistics, co-occurrence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recmill.operators.order import group_medians
from recmill.operators.pairs import group_pairs


def row_count(df: DataFrame, count: str = "count") -> Column:
    """What a row counts: the count attribute, null being 1, or 1."""
    return F.coalesce(F.col(count), F.lit(1)).cast("long") if count in df.columns else F.lit(1).cast("long")


def coalesce_repeats(df: DataFrame, row: str, col: str, order: str = "_ord") -> DataFrame:
    """One row per (row, col): sum of counts, first and last time, and of the other attributes the last stored
    non-null-safe value (the row's that comes last in ``order``)."""
    other = [c for c in df.columns if c not in (row, col, order, "timestamp", "count")]
    aggs = [F.sum(row_count(df)).alias("count")]
    if "timestamp" in df.columns:
        aggs += [F.min("timestamp").alias("first_timestamp"), F.max("timestamp").alias("timestamp")]
    if other:
        aggs.append(F.max_by(F.struct(*other), F.col(order)).alias("_last"))
    out = df.where(F.col(row).isNotNull() & F.col(col).isNotNull()).groupBy(row, col).agg(*aggs)
    return out.select(row, col, *[F.col(f"_last.{c}").alias(c) for c in other], *[c for c in ("count", "first_timestamp", "timestamp") if c in out.columns])


def interaction_count(df: DataFrame) -> DataFrame:
    return df.agg(F.coalesce(F.sum(row_count(df)), F.lit(0)).alias("count"))


def entity_stats(entities: DataFrame, matrix: DataFrame, key: str, other: str) -> DataFrame:
    """Per entity of ``entities(key)``: record_count, count, <other>_count, and rating and time statistics of the
    coalesced ``matrix``, which has one row per (key, other); entities that never occur have zero counts, a null
    mean and null times."""
    name = other.removesuffix("_id") + "_count"
    aggs = [F.count("*").alias("record_count"), F.sum(row_count(matrix)).alias("count"), F.count(other).alias(name)]
    if "rating" in matrix.columns:
        aggs += [F.count("rating").alias("rating_count"), F.avg("rating").alias("mean_rating")]
    if "timestamp" in matrix.columns:
        aggs += [F.min("timestamp").alias("first_time"), F.max("timestamp").alias("last_time")]
    stats = matrix.groupBy(key).agg(*aggs)
    counts = [c for c in stats.columns if c.endswith("count")]
    return entities.select(key).join(stats, key, "left").fillna(0, counts)


def cooccurrence(df: DataFrame, group: str, item: str, diagonal: bool = False) -> DataFrame:
    """Symmetric (item_a, item_b, n): in how many groups both occur. Pairs are made once (a < b), hot groups in many
    tasks, counted before the shuffle and mirrored afterwards; the diagonal holds each item's groups."""
    d = df.where(F.col(group).isNotNull() & F.col(item).isNotNull()).select(F.col(group).alias("g"), F.col(item).alias("i")).distinct()
    half = group_pairs(d, "g", ["i"]).select(F.least("i_l", "i_r").alias("item_a"), F.greatest("i_l", "i_r").alias("item_b")).groupBy("item_a", "item_b").agg(F.count("*").alias("n"))
    out = half.unionByName(half.select(F.col("item_b").alias("item_a"), F.col("item_a").alias("item_b"), "n"))
    if diagonal:
        out = out.unionByName(d.groupBy("i").agg(F.count("*").alias("n")).select(F.col("i").alias("item_a"), F.col("i").alias("item_b"), "n"))
    return out


def ordered_cooccurrence(df: DataFrame, group: str, item: str, order: Sequence[str]) -> DataFrame:
    """(item_a, item_b, n): how often b comes anywhere after a in a group; equal order values are told apart by the
    later columns of ``order``, then by the item. No group is sorted: a pair's own order values say which is first."""
    names = [f"o{j}" for j in range(len(order))]
    d = df.where(F.col(group).isNotNull() & F.col(item).isNotNull()).select(F.col(group).alias("g"), F.col(item).alias("i"), *[F.col(o).alias(n) for o, n in zip(order, names, strict=True)])
    d = d.groupBy("g", *names, "i").agg(F.count("*").alias("c"))
    at = lambda side: F.struct(*[F.col(f"{n}_{side}").alias(n) for n in (*names, "i")])
    first = at("l") < at("r")
    pairs = group_pairs(d, "g", [*names, "i", "c"]).select(F.when(first, F.col("i_l")).otherwise(F.col("i_r")).alias("item_a"), F.when(first, F.col("i_r")).otherwise(F.col("i_l")).alias("item_b"), (F.col("c_l") * F.col("c_r")).alias("n"))
    alike = d.where("c > 1").select(F.col("i").alias("item_a"), F.col("i").alias("item_b"), F.expr("c * (c - 1) div 2").alias("n"))
    return pairs.unionByName(alike).groupBy("item_a", "item_b").agg(F.sum("n").alias("n"))


def value_stats(df: DataFrame, value: str, keys: Sequence[str] = (), sample_std: bool = False) -> DataFrame:
    """n, mean, median and standard deviation of the values that are neither null nor NaN."""
    keys = list(keys)
    v = F.nanvl(F.col(value).cast("double"), F.lit(None))
    std = F.stddev_samp(v) if sample_std else F.stddev_pop(v)
    out = df.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), std.alias("std"))
    middle = group_medians(df.select(*keys, v.alias("_v")).where("_v is not null"), keys, "_v", "median")
    joined = out.join(F.broadcast(middle), how="left") if not keys else out.alias("o").join(middle.alias("m"), [F.col(f"o.{k}").eqNullSafe(F.col(f"m.{k}")) for k in keys], "left").select("o.*", "m.median")
    return joined.select(*keys, "n", "mean", "median", "std")


def explode_list(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """One row per member; empty and null lists vanish."""
    return df.select(*[c for c in df.columns if c != column], F.explode(column).alias(name or column))


def category_matrix(df: DataFrame, key: str, column: str, layout: str = "scalar", names: Sequence[str] | None = None, normalize: str | None = None) -> DataFrame:
    """(key, category, value): one-hot for scalars, multi-hot for lists, the members for vectors and sparse vectors."""
    kind = dict(df.dtypes)[column]
    d = df.where(F.col(column).isNotNull())
    if layout == "scalar":
        if kind in ("float", "double"):
            raise TypeError("real values are no categories")
        out = d.select(key, F.col(column).cast("string").alias("category"), F.lit(1.0).alias("value"))
    elif layout == "list":
        out = d.select(key, F.explode(F.array_distinct(F.col(column).cast("array<string>"))).alias("category"), F.lit(1.0).alias("value")).where("category is not null")
    else:
        pairs = d.select(key, F.posexplode(column).alias("dim", "value")) if layout == "vector" else d.select(key, F.explode(column).alias("x")).select(key, F.col("x.index").alias("dim"), F.col("x.value").alias("value"))
        label = F.element_at(F.array(*map(F.lit, names)), F.col("dim") + 1) if names else F.col("dim").cast("string")
        out = pairs.select(key, label.alias("category"), F.col("value").cast("double").alias("value")).where("value <> 0")
    return normalize_rows(out, key, "value", normalize)


def normalize_rows(df: DataFrame, key: str, value: str, how: str | None) -> DataFrame:
    """unit: by the L2 norm; distribution: by the sum (no negative values). Rows of zeros stay."""
    if how is None:
        return df
    w = Window.partitionBy(key)
    if how == "unit":
        size = F.sqrt(F.sum(F.col(value) * F.col(value)).over(w))
    elif how == "distribution":
        size = F.sum(F.when(F.col(value) < 0, F.raise_error(F.lit("negative value in a distribution")).cast("double")).otherwise(F.col(value))).over(w)
    else:
        raise ValueError(f"unknown normalisation {how}")
    return df.withColumn(value, F.when(size > 0, F.col(value) / size).otherwise(F.col(value)))
