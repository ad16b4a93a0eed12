"""Bias, popularity, known-rating and random scorers."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recmill.models.base import Scorer, TrainingOptions, float_score, known_pairs
from recmill.operators.lists import uniform
from recmill.operators.order import average_rank, running_sum
from recmill.operators.stats import row_count


def _damping(damping: float | dict, entity: str) -> float:
    return float(damping.get(entity, 0.0)) if isinstance(damping, dict) else float(damping)


@dataclass
class BiasConfig:
    entities: set[str] = field(default_factory=lambda: {"user", "item"})
    damping: Any = 0.0


class BiasScorer(Scorer):
    """Global mean, item and user offsets: b_i = sum(r - b) / (n + damping), then b_u of what is left."""

    config_class = BiasConfig

    def fit(self, log: DataFrame, options: TrainingOptions) -> None:
        r = known_pairs(log, True).select("user_id", "item_id", F.col("rating").cast("double").alias("r"))
        self.tables["global"] = r.agg(F.avg("r").alias("b"))
        left = r.crossJoin(F.broadcast(self.tables["global"])).withColumn("r", F.col("r") - F.col("b")).drop("b")
        for entity in ("item", "user"):
            if entity in self.config.entities:
                key = f"{entity}_id"
                d = F.lit(_damping(self.config.damping, entity))
                self.tables[entity] = left.groupBy(key).agg(F.coalesce(F.try_divide(F.sum("r"), F.count("*") + d), F.lit(0.0)).alias("b"))
                left = left.join(self.tables[entity], key).withColumn("r", F.col("r") - F.col("b")).drop("b")

    def residuals(self, log: DataFrame) -> DataFrame:
        """(user_id, item_id, r): ratings less all biases."""
        rated = known_pairs(log, True).select("user_id", "item_id", F.col("rating").cast("double").alias("_r"))
        return self.score(rated).select("user_id", "item_id", (F.col("_r") - F.col("score").cast("double")).alias("r"))

    def score(self, pairs: DataFrame, history: DataFrame | None = None) -> DataFrame:
        """A user's rated ``history`` overrides its stored bias."""
        out = pairs.crossJoin(F.broadcast(self.tables["global"].withColumnRenamed("b", "_g")))
        item = self.tables.get("item")
        out = out.join(item.withColumnRenamed("b", "_i"), "item_id", "left") if item is not None else out.withColumn("_i", F.lit(0.0))
        users = self.tables.get("user")
        if history is not None and users is not None:
            h = known_pairs(history, True).crossJoin(F.broadcast(self.tables["global"].withColumnRenamed("b", "_g")))
            h = h.join(item.withColumnRenamed("b", "_i"), "item_id", "left") if item is not None else h.withColumn("_i", F.lit(0.0))
            d = F.lit(_damping(self.config.damping, "user"))
            own = h.groupBy("user_id").agg((F.sum(F.col("rating").cast("double") - F.col("_g") - F.coalesce("_i", F.lit(0.0))) / (F.count("*") + d)).alias("b"))
            users = own.unionByName(users.join(own, "user_id", "left_anti"))
        out = out.join(users.withColumnRenamed("b", "_u"), "user_id", "left") if users is not None else out.withColumn("_u", F.lit(0.0))
        total = F.col("_g") + F.coalesce("_i", F.lit(0.0)) + F.coalesce("_u", F.lit(0.0))
        return out.withColumn("score", total).select(*pairs.columns, "score")


@dataclass
class PopConfig:
    score: str = "quantile"


class PopScorer(Scorer):
    """Popularity as count, mean rank, or cumulative share of the counts in ascending order (ties by item)."""

    config_class = PopConfig

    def fit(self, log: DataFrame, options: TrainingOptions) -> None:
        items = log.where("item_id is not null")
        self._fit(items.groupBy("item_id").agg(F.sum(row_count(items)).alias("n")))

    def _fit(self, counts: DataFrame) -> None:
        if self.config.score == "count":
            out = counts.select("item_id", F.col("n").cast("double").alias("score"))
        elif self.config.score == "rank":
            out = average_rank(counts, "n", "score")
        elif self.config.score == "quantile":
            total = counts.agg(F.sum("n").alias("_t"))
            out = running_sum(counts, "n", "item_id", value="n", name="_s").crossJoin(F.broadcast(total)).withColumn("score", F.try_divide(F.col("_s").cast("double"), F.col("_t")))
        else:
            raise ValueError(f"unknown popularity {self.config.score}")
        self.tables["pop"] = out.select("item_id", "score")

    def reach(self, users: DataFrame, history: DataFrame, n: int) -> DataFrame:
        from recmill.operators.recommend import best_unseen

        return best_unseen(float_score(self.tables["pop"]), known_pairs(history), users, n).select("user_id", "item_id")

    def score(self, pairs: DataFrame, history: DataFrame | None = None) -> DataFrame:
        return float_score(pairs.join(self.tables["pop"], "item_id", "left"))


@dataclass
class TimeBoundedPopConfig(PopConfig):
    cutoff: Any = None


class TimeBoundedPopScorer(PopScorer):
    """Popularity of the events after the cutoff; all events where the log has no times. Items that had none
    since count 0."""

    config_class = TimeBoundedPopConfig

    def fit(self, log: DataFrame, options: TrainingOptions) -> None:
        if "timestamp" not in log.columns:
            super().fit(log, options)
            return
        items = log.where("item_id is not null")
        late = F.col("timestamp") > F.lit(self.config.cutoff).cast(dict(log.dtypes)["timestamp"])
        self._fit(items.groupBy("item_id").agg(F.sum(F.when(late, row_count(items)).otherwise(0)).alias("n")))


@dataclass
class KnownRatingConfig:
    score: str | None = None
    source: str = "training"


class KnownRatingScorer(Scorer):
    """The rating in the training data (or the history), or 0/1 for "indicator"; else null."""

    config_class = KnownRatingConfig

    def fit(self, log: DataFrame, options: TrainingOptions) -> None:
        has = "rating" in log.columns and self.config.score != "indicator"
        value = F.max_by(F.col("rating").cast("double"), F.struct(*[c for c in ("timestamp",) if c in log.columns], "rating")) if has else F.lit(1.0)
        self.tables["known"] = known_pairs(log).groupBy("user_id", "item_id").agg(value.alias("score"))

    def score(self, pairs: DataFrame, history: DataFrame | None = None) -> DataFrame:
        known = self.tables["known"]
        if self.config.source == "query" and history is not None:
            known = known_pairs(history).groupBy("user_id", "item_id").agg(F.max(F.col("rating").cast("double") if "rating" in history.columns and self.config.score != "indicator" else F.lit(1.0)).alias("score"))
        out = pairs.join(known, ["user_id", "item_id"], "left")
        return float_score(out.fillna(0.0, ["score"]) if self.config.score == "indicator" else out)


@dataclass
class RandomConfig:
    seed: Any = 0


class RandomScorer(Scorer):
    config_class = RandomConfig

    def fit(self, log: DataFrame, options: TrainingOptions) -> None:
        self.tables["items"] = log.select("item_id").distinct()

    def score(self, pairs: DataFrame, history: DataFrame | None = None) -> DataFrame:
        return float_score(pairs.withColumn("score", uniform(self.config.seed, "user_id", "item_id")))
