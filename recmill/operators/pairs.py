"""Pairs of rows that share a group, with hot groups split over many tasks; joins with sides of checked size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a group that meet in one task when pairs are made.
PIECE_ROWS = 1024
#: A side of a join is broadcast up to this many rows (of a few small columns each); beyond it rows are shuffled.
BROADCAST_ROWS = 200_000
#: Rows of one key above which a join doesn't bring them together.
HOT_ROWS = 1_000_000


def small_side(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it is counted to have at most ``most`` rows; unmarked otherwise. For narrow frames only."""
    return F.broadcast(df) if len(df.limit(most + 1).select(F.lit(1)).take(most + 1)) <= most else df


def join_groups(rows: DataFrame, groups: DataFrame, keys: Sequence[str], size: str) -> DataFrame:
    """Inner join of ``rows`` with ``groups``, one narrow row per key with the number ``size`` of its rows.

    Few groups are broadcast after they are counted. Otherwise the groups above HOT_ROWS (there are fewer
    than all rows divided by that) are broadcast and only the others are shuffled, so no hot key's rows
    meet in one task. ``groups`` is counted, so it should be a written table.
    """
    keys = list(keys)
    n = groups.agg(F.count("*").alias("n"), F.count(F.when(F.col(size) > HOT_ROWS, 1)).alias("hot")).first()
    if n["n"] <= BROADCAST_ROWS:
        return rows.join(F.broadcast(groups), keys)
    if not n["hot"] or n["hot"] > 10 * BROADCAST_ROWS:
        return rows.join(groups, keys)
    hot, rest = groups.where(F.col(size) > HOT_ROWS), groups.where(F.col(size) <= HOT_ROWS)
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(hot), keys).unionByName(cold.join(rest, keys))


def _pieces(df: DataFrame, group: str, spread_by: Sequence[str | Column], piece_rows: int) -> DataFrame:
    """``df`` with ``_k``, the number of pieces of a row's group, and ``_p``, the row's piece."""
    many = df.groupBy(group).agg(F.ceil(F.count("*") / piece_rows).cast("int").alias("_k")).where("_k > 1")
    return df.join(small_side(many), group, "left").withColumn("_k", F.coalesce("_k", F.lit(1))).withColumn("_p", F.pmod(F.xxhash64(*spread_by), F.col("_k").cast("long")).cast("int"))


def group_pairs(df: DataFrame, group: str, cols: Sequence[str], piece_rows: int | None = None) -> DataFrame:
    """(group, <col>_l and <col>_r for each of ``cols``): every unordered pair of different rows of a group once.

    Rows of a group are told apart by ``cols`` together, which must be distinct in it. A group above
    ``piece_rows`` rows (PIECE_ROWS unless given) is divided by hash, and each pair of its pieces is a join key of its own, so a hot
    group's pairs are made in as many tasks as its size asks for. Smaller groups are joined as they are.
    Rows with a null group pair with nothing. Which of two rows is left and which right is not defined.
    """
    d = _pieces(df.where(F.col(group).isNotNull()).select(group, *cols), group, list(cols), piece_rows or PIECE_ROWS)
    left = d.select(group, *[F.col(c).alias(f"{c}_l") for c in cols], F.col("_p").alias("_i"), F.explode(F.sequence("_p", F.col("_k") - 1)).alias("_j"))
    right = d.select(group, *[F.col(c).alias(f"{c}_r") for c in cols], F.explode(F.sequence(F.lit(0), "_p")).alias("_i"), F.col("_p").alias("_j"))
    # within one piece a pair is met in both orders and kept in one of them
    lower = F.struct(*[F.col(f"{c}_l").alias(c) for c in cols]) < F.struct(*[F.col(f"{c}_r").alias(c) for c in cols])
    return left.join(right, [group, "_i", "_j"]).where((F.col("_i") < F.col("_j")) | lower).drop("_i", "_j")


def side_pairs(left: DataFrame, right: DataFrame, on: str, left_cols: Sequence[str], right_cols: Sequence[str], piece_rows: int | None = None) -> DataFrame:
    """Inner join of two frames on ``on`` in which a key above ``piece_rows`` rows on either side is divided into a
    grid of pieces, each a join key of its own. Column names of the two sides must differ."""
    l, r = left.where(F.col(on).isNotNull()).select(on, *left_cols), right.where(F.col(on).isNotNull()).select(on, *right_cols)
    piece_rows = piece_rows or PIECE_ROWS
    pieces = lambda d, name: d.groupBy(on).agg(F.ceil(F.count("*") / piece_rows).cast("int").alias(name)).where(F.col(name) > 1)
    grid = small_side(pieces(l, "_kl").join(pieces(r, "_kr"), on, "full").na.fill(1, ["_kl", "_kr"]))
    place = lambda cols, k: F.pmod(F.xxhash64(*cols), F.col(k).cast("long")).cast("int")
    l, r = (d.join(grid, on, "left").na.fill(1, ["_kl", "_kr"]) for d in (l, r))
    l = l.select(on, *left_cols, place(left_cols, "_kl").alias("_i"), F.explode(F.sequence(F.lit(0), F.col("_kr") - 1)).alias("_j"))
    r = r.select(on, *right_cols, F.explode(F.sequence(F.lit(0), F.col("_kl") - 1)).alias("_i"), place(right_cols, "_kr").alias("_j"))
    return l.join(r, [on, "_i", "_j"]).drop("_i", "_j")
