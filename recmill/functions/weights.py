"""Rank weights: functions from a rank column to a weight column, with the sum of their series."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


class RankWeight:
    def weight(self, rank: Column) -> Column:
        raise NotImplementedError

    def log_weight(self, rank: Column) -> Column:
        return F.log(self.weight(rank))

    def series_sum(self) -> float | None:
        """Sum over all ranks, None where it is infinite."""
        return None

    def first(self, n: Column) -> Column:
        """Sum of the first n weights (n >= 0)."""
        return F.aggregate(F.sequence(F.lit(1), F.greatest(n.cast("int"), F.lit(1))), F.lit(0.0), lambda a, k: a + self.weight(k)) * (n > 0).cast("double")


class GeometricRankWeight(RankWeight):
    def __init__(self, patience: float = 0.85):
        if not 0 < patience < 1:
            raise ValueError("patience must be between 0 and 1")
        self.patience = patience

    def weight(self, rank: Column) -> Column:
        return F.pow(F.lit(self.patience), rank - 1)

    def log_weight(self, rank: Column) -> Column:
        return (rank - 1) * math.log(self.patience)

    def series_sum(self) -> float:
        return 1 / (1 - self.patience)

    def first(self, n: Column) -> Column:
        return (1 - F.pow(F.lit(self.patience), n)) / (1 - self.patience)


class LogRankWeight(RankWeight):
    def __init__(self, base: float = 2, offset: int = 0):
        self.base, self.offset = base, offset

    def weight(self, rank: Column) -> Column:
        at = rank + self.offset if self.offset > 0 else F.greatest(rank, F.lit(2))
        return math.log(self.base) / F.log(at.cast("double"))


class DiscountWeight(RankWeight):
    """1 / max(discount(rank), 1) for any Column function."""

    def __init__(self, discount: Callable[[Column], Column]):
        self.discount = discount

    def weight(self, rank: Column) -> Column:
        return 1 / F.greatest(self.discount(rank), F.lit(1.0))
