"""Reranking with a minimum number of protected items in every prefix."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _quantile(alpha: float, n: int, p: float) -> int:
    """Smallest k with P(Binomial(n, p) <= k) >= alpha."""
    total = 0.0
    for k in range(n + 1):
        total += math.comb(n, k) * p**k * (1 - p) ** (n - k)
        if total >= alpha - 1e-12:
            return k
    return n


def minimum_table(n: int, p: float, alpha: float) -> list[int]:
    """Protected items that each prefix of length 1..n must hold at least."""
    return [_quantile(alpha, i, p) for i in range(1, n + 1)]


def fail_probability(table: Sequence[int], p: float) -> float:
    """Chance that a fair ranking breaks the table somewhere: the survivors' counts, place by place."""
    alive = {0: 1.0}
    for need in table:
        new: dict[int, float] = {}
        for have, q in alive.items():
            new[have] = new.get(have, 0.0) + q * (1 - p)
            new[have + 1] = new.get(have + 1, 0.0) + q * p
        alive = {h: q for h, q in new.items() if h >= need}
    return 1 - sum(alive.values())


def adjusted_alpha(n: int, p: float, alpha: float) -> float:
    """The significance for single prefixes at which the whole table fails with probability alpha, by bisection."""
    lo, hi = 0.0, alpha
    for _ in range(40):
        mid = (lo + hi) / 2
        if fail_probability(minimum_table(n, p, mid), p) > alpha:
            hi = mid
        else:
            lo = mid
    return lo


def fair_rerank(df: DataFrame, keys: Sequence[str], n: int, p: float = 0.5, alpha: float = 0.1, protected: str = "protected", adjust: bool = True, item: str = "item_id", configured: int | None = None) -> DataFrame:
    """The best n of each list so that every prefix holds enough protected items.

    Lists without enough protected items take what there is. The j-th protected item has its place where
    better items leave it (j and the better unprotected ones), or at its deadline, the first prefix that
    must hold j; the others fill the places between. Only the best n of either kind of a list take part.
    """
    from recmill.operators.lists import missing_to_null

    if configured is not None and n > configured:
        raise ValueError(f"n is above the configured {configured}")
    table = minimum_table(n, p, adjusted_alpha(n, p, alpha) if adjust else alpha)
    # first prefix that must hold j protected items; needs grow by one at most, so deadlines ascend
    deadlines = [next(k for k, m in enumerate(table, 1) if m >= j) for j in range(1, table[-1] + 1)] if table else []
    known = df.where(missing_to_null(F.col("score")).isNotNull()).drop("rank").withColumn(protected, F.coalesce(F.col(protected).cast("boolean"), F.lit(False)))
    kind, order = Window.partitionBy(*keys, protected), [F.desc("score"), F.col(item)]
    best = known.withColumn("_r", F.row_number().over(kind.orderBy(*order))).where(F.col("_r") <= n)
    whole = Window.partitionBy(*keys)
    better = F.sum((~F.col(protected)).cast("int")).over(whole.orderBy(*order, "_r").rowsBetween(Window.unboundedPreceding, 0))
    deadline = F.get(F.array(*map(F.lit, deadlines)), F.col("_r") - 1) if deadlines else F.lit(None).cast("int")
    # how many unprotected items stand before a protected one; an unprotected one stands after those of its own kind
    after = F.when(F.col(protected), F.least(F.col("_r") + better, deadline) - F.col("_r")).otherwise(F.col("_r"))
    ranked = best.withColumn("_a", after).withColumn("rank", F.row_number().over(whole.orderBy("_a", protected, "_r")).cast("int"))
    return ranked.where(F.col("rank") <= n).drop("_a", "_r")
