"""Operators on a total order that never bring all rows to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recmill.operators.pairs import join_groups
from recmill.session import cut


def _in_files(df: DataFrame, order: list) -> DataFrame:
    """``df`` range-partitioned and sorted, with ``_part`` and ``_row``, the place of each row in its part."""
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = cut(df.repartitionByRange(n, *order).sortWithinPartitions(*order), "ordered")
    part = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)-", 1).cast("int")
    return ordered.select("*", part.alias("_part"), F.col("_metadata.row_index").alias("_row"))


def _offsets(placed: DataFrame, total) -> DataFrame:
    """What comes before each part: as many rows as there are parts."""
    return placed.groupBy("_part").agg(total.alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")


def number_rows(df: DataFrame, *order, name: str = "num", start: int = 0) -> DataFrame:
    """Dense numbers from ``start`` in the order of ``order``, which should be total."""
    placed = _in_files(df, list(order))
    return placed.join(F.broadcast(_offsets(placed, F.count("*"))), "_part").withColumn(name, (F.col("_before") + F.col("_row") + start).cast("long")).drop("_part", "_row", "_before")


def running_sum(df: DataFrame, *order, value: str, name: str) -> DataFrame:
    """Inclusive running sum of ``value`` in the order of ``order``."""
    placed = _in_files(df, list(order))
    inside = F.sum(value).over(Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0))
    return placed.join(F.broadcast(_offsets(placed, F.sum(value))), "_part").withColumn(name, F.col("_before") + inside).drop("_part", "_row", "_before")


def average_rank(df: DataFrame, value: str, name: str) -> DataFrame:
    """Rank from 1 by ascending ``value``, ties sharing their mean rank; only distinct values are ordered."""
    counts = running_sum(df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_c")), value, value="_c", name="_upto")
    return df.join(counts.select(value, (F.col("_upto") - (F.col("_c") - 1) / 2).alias(name)), value, "left")


def carry_forward(df: DataFrame, *order, value: str, name: str) -> DataFrame:
    """The last non-null ``value`` up to each row, in the order of ``order``; null before the first one."""
    placed = _in_files(df, list(order))
    inside = F.last(value, ignorenulls=True).over(Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0))
    lasts = placed.groupBy("_part").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col("_row"))).alias("_l"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part
    carried = lasts.withColumn("_c", F.last("_l", ignorenulls=True).over(earlier)).drop("_l")
    return placed.join(F.broadcast(carried), "_part").withColumn(name, F.coalesce(inside, F.col("_c"))).drop("_part", "_row", "_c")


def group_medians(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """(keys, name): exact median of ``value``, which has no nulls, for every group. All rows are numbered in the order
    of (keys, value), so a group's middle is at known numbers; no group is sorted or held in one task."""
    names = [f"_k{i}" for i in range(len(keys))]
    d = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.struct(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.lit(0).alias("_")).alias("_g"), F.col(value).alias("_v"))
    placed = cut(number_rows(d, *names, "_v", name="_at"), "placed")
    groups = cut(placed.groupBy("_g").agg(F.min("_at").alias("_lo"), F.count("*").alias("_n")), "groups")
    middle = join_groups(placed.select("_g", "_v", "_at"), groups, ["_g"], "_n").where(F.col("_at").between(F.col("_lo") + F.expr("(_n - 1) div 2"), F.col("_lo") + F.expr("_n div 2")))
    return middle.groupBy("_g").agg(F.avg("_v").alias(name)).select(*[F.col(f"_g.{n}").alias(k) for k, n in zip(keys, names, strict=True)], name)


def _kth(df: DataFrame, column: str, k: int, lo: int, hi: int, slots: int = 4096) -> int:
    """k-th smallest (from 0) of a bigint column by counting in ever narrower slots."""
    while lo < hi:
        step = max(1, -(-(hi - lo + 1) // slots))
        counts = sorted((r["s"], r["n"]) for r in df.where(F.col(column).between(lo, hi)).groupBy(F.expr(f"({column} - ({lo}L)) div {step}L").alias("s")).agg(F.count("*").alias("n")).collect())
        for s, n in counts:
            if k < n:
                lo, hi = lo + s * step, min(hi, lo + (s + 1) * step - 1)
                break
            k -= n
    return lo


def exact_quantile(df: DataFrame, column: str, q: float) -> float | None:
    """Linearly interpolated quantile of a bigint column, exact; None without values. Each round counts
    rows in a bounded number of slots, so no task or driver holds the values."""
    s = df.where(F.col(column).isNotNull()).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).first()
    if not s["n"]:
        return None
    place = q * (s["n"] - 1)
    low = _kth(df, column, int(place), s["lo"], s["hi"])
    part = place - int(place)
    if not part:
        return float(low)
    high = _kth(df, column, int(place) + 1, s["lo"], s["hi"])
    return low + (high - low) * part


def gini_terms(df: DataFrame, value: str) -> DataFrame:
    """One row with the Gini coefficient of ``value`` over all rows: sum((2k - n - 1) x) / (n sum(x)), at least 0.

    Rows are counted by value first; only distinct values are ordered. Null values count as 0. All-zero
    values and no rows give null.
    """
    counts = df.groupBy(F.coalesce(value, F.lit(0)).cast("double").alias("x")).agg(F.count("*").alias("c"))
    placed = running_sum(counts, "x", value="c", name="upto")
    n, total = F.sum("c"), F.sum(F.col("c") * F.col("x"))
    # sum of 2k over a value's ranks upto-c+1 .. upto
    weighted = F.sum(F.col("x") * F.col("c") * (2 * F.col("upto") - F.col("c") + 1))
    return placed.agg(F.greatest(F.try_divide(weighted - (n + 1) * total, n * total), F.lit(0.0)).alias("gini"))
