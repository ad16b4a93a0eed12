"""Metrics of predicted ratings, per list and over all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def align_scores(predictions: DataFrame, truth: DataFrame, on: Sequence[str], score: str = "score", rating: str = "rating", missing_scores: str = "error", missing_truth: str = "error") -> DataFrame:
    """(on, score, rating) by a full outer join. What has no counterpart is an error or is left out ("ignore")."""
    if missing_scores not in ("error", "ignore") or missing_truth not in ("error", "ignore"):
        raise ValueError("missing values are an error or ignored")
    p = predictions.select(*on, F.nanvl(F.col(score).cast("double"), F.lit(None)).alias("score"))
    t = truth.select(*on, F.nanvl(F.col(rating).cast("double"), F.lit(None)).alias("rating"))
    both = p.join(t, list(on), "full_outer")
    no = lambda what: F.raise_error(F.lit(f"missing {what}")).cast("double")
    if missing_scores == "error":
        both = both.withColumn("score", F.when(F.col("rating").isNotNull() & F.col("score").isNull(), no("scores")).otherwise(F.col("score")))
    if missing_truth == "error":
        both = both.withColumn("rating", F.when(F.col("score").isNotNull() & F.col("rating").isNull(), no("ratings")).otherwise(F.col("rating")))
    return both.where("score is not null and rating is not null")


def prediction_errors(aligned: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """n, RMSE and MAE per ``keys``, or over all rows without keys."""
    e = F.col("score") - F.col("rating")
    return aligned.groupBy(*keys).agg(F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("RMSE"), F.avg(F.abs(e)).alias("MAE"))
