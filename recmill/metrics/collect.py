"""Measuring whole runs: per-list values and their summaries."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recmill.metrics.ranking import Hits, ListMetric
from recmill.operators.stats import value_stats


def unpivot(per_list: DataFrame, keys: Sequence[str]) -> DataFrame:
    names = [c for c in per_list.columns if c not in keys]
    parts = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").cast("double").alias("value")) for c in names])).alias("x")
    return per_list.select(*keys, parts).select(*keys, "x.metric", "x.value")


def summarize(per_list: DataFrame, keys: Sequence[str], by: Sequence[str] = (), sample_std: bool = False) -> DataFrame:
    """(by, metric, n, mean, median, std) over lists; undefined values are left out, n counts the others.
    Collected runs use the population's standard deviation, summaries by condition the sample's."""
    return value_stats(unpivot(per_list, keys), "value", [*by, "metric"], sample_std)


class MeasurementCollector:
    """Metrics added once, applied to any number of runs."""

    def __init__(self, keys: Sequence[str]):
        self.keys, self.metrics, self.functions = list(keys), [], []

    def add_metric(self, metric: ListMetric | Callable[[Hits], DataFrame]) -> None:
        """A list metric, or a function from the joined lists to (keys, value columns)."""
        (self.metrics if isinstance(metric, ListMetric) else self.functions).append(metric)

    def list_metrics(self, recs: DataFrame, test: DataFrame, gain: str | None = None, lists: DataFrame | None = None) -> DataFrame:
        hits = Hits(recs, test, self.keys, gain, lists)
        out = hits.measure(*self.metrics)
        for f in self.functions:
            out = out.join(f(hits), self.keys, "full_outer")
        return out

    def summary(self, recs: DataFrame, test: DataFrame, gain: str | None = None, by: Sequence[str] = ()) -> DataFrame:
        return summarize(self.list_metrics(recs, test, gain), self.keys, by)
