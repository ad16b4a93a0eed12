"""Accumulators: what is kept of many values, as aggregates that combine across partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recmill.operators.stats import value_stats


class Accumulator:
    """``aggregates(value)``: named aggregates of a value column; ``accumulate`` applies them by group."""

    def aggregates(self, value: Column) -> dict[str, Column]:
        raise NotImplementedError

    def accumulate(self, df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
        return df.groupBy(*keys).agg(*[c.alias(n) for n, c in self.aggregates(F.col(value)).items()])


class ValueStatAccumulator(Accumulator):
    """n, mean, median and standard deviation of what is neither null nor NaN."""

    def accumulate(self, df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
        return value_stats(df, value, keys)


class ErrorAccumulator(Accumulator):
    """n, RMSE and MAE of errors."""

    def aggregates(self, value: Column) -> dict[str, Column]:
        e = F.nanvl(value.cast("double"), F.lit(None))
        return {"n": F.count(e), "RMSE": F.sqrt(F.avg(e * e)), "MAE": F.avg(F.abs(e))}


class ObjectListAccumulator(Accumulator):
    """The values themselves, in order; for groups of known small size."""

    def aggregates(self, value: Column) -> dict[str, Column]:
        return {"values": F.array_sort(F.collect_list(value))}
