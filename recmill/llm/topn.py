"""Problem 6: the N best items of every group by simultaneous bisection.

Score and identifier are packed into one order-preserving 64-bit code, so ties have an order and no two
items of a group are equal. Every group looks for the code above which exactly N of its rows lie: in
each round the rows that are still in question are counted above the midpoints of their group's
interval, for all groups at once, and the interval shrinks to the part that holds the cutoff. Only
counts are shuffled, at most 256 for each open group and map task. Rows meet their group's interval by a
broadcast of the groups, or of the hot ones among them (``join_groups``), so no hot group is sorted or collected.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType, LongType

from recmill.operators.pairs import join_groups
from recmill.session import cut

#: Bits that one round decides: 2 ** BITS - 1 midpoints.
BITS = 8


@F.pandas_udf(LongType())
def rank_code(score: pd.Series, item: pd.Series) -> pd.Series:
    """Greater for a higher float32 score, then for a smaller int32 item; both zeros are equal."""
    bits = (score.to_numpy(np.float32) + np.float32(0)).view(np.int32).astype(np.int64)
    ordered = np.where(bits < 0, bits ^ 0x7FFFFFFF, bits)
    return pd.Series((ordered << 32) | (0xFFFFFFFF - (item.to_numpy(np.int64) + 2**31)))


def code_item(code: Column) -> Column:
    return (F.lit(2**31 - 1) - code.bitwiseAND(F.lit(0xFFFFFFFF))).cast("int")


@F.pandas_udf(FloatType())
def code_score(code: pd.Series) -> pd.Series:
    ordered = (code.to_numpy(np.int64) >> 32).astype(np.int64)
    return pd.Series(np.where(ordered < 0, ordered ^ 0x7FFFFFFF, ordered).astype(np.int32).view(np.float32))


def cutoffs(coded: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, cutoff, c): the rows of ``coded(keys, code, n)`` with code >= cutoff are the n greatest of their
    group; c is the group's size.

    Codes must be distinct within a group. n null or negative means all. Groups with n = 0 have no cutoff.
    """
    keys = list(keys)
    start = coded.groupBy(*keys).agg(F.first("n").alias("n"), F.count("*").alias("c"), F.min("code").alias("lo"), F.max("code").alias("hi"))
    start = cut(start, "groups")
    closed = start.where("n is null or n < 0 or c <= n").select(*keys, F.col("lo").alias("cutoff"), "c")
    active = start.where("n > 0 and c > n").select(*keys, F.col("n").alias("need"), "lo", "hi", "c", F.col("c").alias("size"))
    done = [closed]
    while not active.isEmpty():
        # within [lo, hi] the codes agree above their highest differing bit; the next BITS bits make the parts
        s = F.greatest(F.length(F.bin(F.col("lo").bitwiseXOR(F.col("hi")))) - BITS, F.lit(0))
        rows = join_groups(coded.select(*keys, "code"), active.drop("c").withColumn("s", s), keys, "size").where("code between lo and hi")
        part = F.expr(f"cast(shiftrightunsigned(code ^ {-(2**63)}L, s) & {2**BITS - 1} as int)")
        counts = rows.groupBy(*keys, part.alias("part")).agg(F.first("need").alias("need"), F.first("size").alias("size"), F.count("*").alias("c"), F.min("code").alias("lo"), F.max("code").alias("hi"))
        w = Window.partitionBy(*keys).orderBy(F.desc("part"))
        counts = counts.withColumn("through", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("need", F.col("need") - (F.col("through") - F.col("c")))
        hit = cut(counts.where("need > 0 and need <= c").select(*keys, "need", "size", "c", "lo", "hi"), "round")
        done.append(hit.where("need = c").select(*keys, F.col("lo").alias("cutoff"), F.col("size").alias("c")))
        active = hit.where("need < c").select(*keys, "need", "lo", "hi", "c", "size")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def top_n(rows: DataFrame, keys: Sequence[str], item: str, score: str, n: str) -> DataFrame:
    """(keys, item, score): the first ``n`` items of every group by score descending, then item ascending.

    ``n`` names a column that is constant in a group; null or negative means all items, zero none. An item
    counts once per group, with its highest score; -0.0 equals 0.0. Rows with a null key or item, or a
    null or NaN score, are left out. Scores are float32 and items int32, as in the code they share; an
    empty table gives no rows. Other columns of ``rows`` are not read.
    """
    keys = list(keys)
    known = rows.where(F.col(score).isNotNull() & ~F.isnan(score) & F.col(item).isNotNull())
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    best = known.select(*keys, F.col(item).cast("int").alias("_i"), rank_code(F.col(score).cast("float"), F.col(item).cast("int")).alias("code"), F.col(n).alias("n")).groupBy(*keys, "_i").agg(F.max("code").alias("code"), F.first("n").alias("n"))
    coded = cut(best.select(*keys, "code", "n"), "codes")
    at = cut(cutoffs(coded, keys), "cutoffs")
    kept = join_groups(coded.select(*keys, "code"), at, keys, "c").where("code >= cutoff")
    return kept.select(*keys, code_item(F.col("code")).alias(item), code_score("code").alias(score))
