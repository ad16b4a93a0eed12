"""Measuring one list or one model with little ado."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recmill.metrics import ranking as mr
from recmill.metrics.collect import summarize
from recmill.metrics.predict import align_scores, prediction_errors
from recmill.models.base import Scorer, TrainingOptions
from recmill.operators.splitting import TTSplit, crossfold_users, sample_frac
from recmill.plans.pipeline import predict, recommend, topn_builder
from recmill.session import cut

#: Length of the lists that a quick measurement makes.
LENGTH = 20


def measure_list(spark: SparkSession, metric: mr.ListMetric | type, items: Sequence, test: Sequence | dict | None = None, gain: bool = False):
    """A metric's value for one list of item ids, best first, against test items (or their gains); None where undefined."""
    metric = metric() if isinstance(metric, type) else metric
    truth = dict(test) if isinstance(test, dict) else dict.fromkeys(test or (), 1.0)
    kind = "string" if any(isinstance(x, str) for x in [*items, *truth]) else "long"
    r = spark.createDataFrame([(0, x, i + 1) for i, x in enumerate(items)], f"q int, item_id {kind}, rank int")
    t = spark.createDataFrame([(0, x, float(g)) for x, g in truth.items()], f"q int, item_id {kind}, gain double")
    return mr.Hits(r, t, ["q"], "gain" if gain else None, spark.createDataFrame([(0,)], "q int")).measure(metric).first()[metric.label()]


def call_metric(*args, **kw):
    """Old name of :func:`measure_list`."""
    warnings.warn("call_metric is now measure_list", DeprecationWarning, stacklevel=2)
    return measure_list(*args, **kw)


@dataclass
class RunResult:
    """``lists``: the metrics of every list; ``predictions``: n, RMSE and MAE of every list, and ``overall`` of all of
    them (None without rating prediction)."""

    lists: DataFrame
    predictions: DataFrame | None = None
    overall: DataFrame | None = None

    def list_summary(self, by: Sequence[str] = ()) -> DataFrame:
        """(metric, n, mean, median, std) over lists, those of predictions included."""
        out = summarize(self.lists, ["user_id"], by)
        if self.predictions is not None:
            out = out.unionByName(summarize(self.predictions.drop("n"), ["user_id"], by))
        return out


def standard_metrics(n: int | None = None) -> list[mr.ListMetric]:
    return [m(n) for m in (mr.RBP, mr.NDCG, mr.RecipRank, mr.Hit, mr.Precision, mr.Recall)]


def measure_run(split: TTSplit, recs: DataFrame, predictions: DataFrame | None = None, metrics: Sequence[mr.ListMetric] | None = None) -> RunResult:
    """Measure the lists (and predictions) that were made for a split's test users."""
    lists = mr.Hits(recs, split.test, ["user_id"], lists=split.test_requests()).measure(*(metrics or standard_metrics()))
    if predictions is None:
        return RunResult(lists)
    both = cut(align_scores(predictions, split.test, ["user_id", "item_id"], missing_scores="ignore", missing_truth="ignore"), "aligned")
    return RunResult(lists, prediction_errors(both, ["user_id"]), prediction_errors(both))


def quick_measure_model(model: Scorer, log: DataFrame, predicts_ratings: bool = False, folds: int = 5, test_fraction: float = 0.2, seed=0) -> RunResult:
    """Train on all but a part of the rows of a ``folds``-th of the users, and measure lists of 20 for these users;
    with ``predicts_ratings`` also the ratings, biases standing in where the model has none."""
    from recmill.models.basic import BiasScorer

    split = next(iter(crossfold_users(log, folds, sample_frac(test_fraction, seed=seed), seed=seed)))
    train, test = cut(split.train, "train"), cut(split.test, "test")
    split = TTSplit(train, test, split.name, split.key)
    p = topn_builder(model, LENGTH, fallback=BiasScorer() if predicts_ratings else None).build()
    p.train(train, TrainingOptions(seed=int(seed) if isinstance(seed, int) else 0))
    recs = cut(recommend(p, log.sparkSession, split.test_requests(), LENGTH).select("user_id", "item_id", "score", "rank"), "recs")
    given = predict(p, test.select("user_id", "item_id").distinct()) if predicts_ratings else None
    return measure_run(split, recs, given)


def mean_of(result: RunResult, metric: str) -> float | None:
    """One mean of a result's summary."""
    row = result.list_summary().where(F.col("metric") == metric).first()
    return None if row is None else row["mean"]
