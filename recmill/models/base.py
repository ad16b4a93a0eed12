"""The contract of all scorers: fit(log) keeps model tables; score(queries, history) gives (key, item_id, score).

``queries`` holds (user_id, item_id) pairs to be scored. The result has the same pairs; unknown users or
items get a null score, never an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class TrainingOptions:
    retrain: bool = True
    seed: int = 0
    environment: dict | None = None


class Scorer:
    """A configuration (a dataclass) and, once fitted, model tables by name in ``tables``."""

    config_class: type = None
    #: Further names for configuration fields.
    aliases: dict[str, str] = {}
    #: The log of the last training.
    trained_on: DataFrame | None = None

    def __init__(self, config=None, **kw):
        for old, new in self.aliases.items():
            if old in kw:
                kw[new] = kw.pop(old)
        if "embedding_size_exp" in kw:
            kw["embedding_size"] = 2 ** kw.pop("embedding_size_exp")
        if config is not None:
            kw = {**asdict(config), **kw}
        known = {f.name for f in fields(self.config_class)}
        if unknown := set(kw) - known:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        self.config = self.config_class(**kw)
        self.tables: dict[str, DataFrame] = {}

    @property
    def is_trained(self) -> bool:
        return bool(self.tables)

    def train(self, log: DataFrame, options: TrainingOptions | None = None) -> Scorer:
        options = options or TrainingOptions()
        if options.retrain or not self.is_trained:
            self.fit(log, options)
            self.trained_on = log
        return self

    def fit(self, log: DataFrame, options: TrainingOptions) -> None:
        raise NotImplementedError

    def train_epochs(self, log: DataFrame, options: TrainingOptions | None = None) -> Iterator[dict]:
        """Train and give a record after every epoch, when the model can be used as it is by then. Models without epochs
        give one record."""
        self.fit(log, options or TrainingOptions())
        yield {"epoch": 1}

    def score(self, pairs: DataFrame, history: DataFrame | None = None) -> DataFrame:
        raise NotImplementedError

    def reach(self, users: DataFrame, history: DataFrame, n: int) -> DataFrame | None:
        """(user_id, item_id) pairs, none of them in ``history``, among which are each user's best ``n``; None where
        only the product of users and items would do."""
        return None

    def reach_trained(self, users: DataFrame, history: DataFrame, n: int) -> DataFrame | None:
        """The same where ``history`` has all rows of these users in the log ``trained_on``, and no others."""
        return self.reach(users, history, n)

    def parameters(self) -> dict[str, DataFrame]:
        return dict(self.tables)

    def load_parameters(self, tables: dict[str, DataFrame]) -> None:
        self.tables = dict(tables)

    def save(self, path: str) -> None:
        for name, df in self.tables.items():
            df.write.mode("overwrite").parquet(f"{path}/{name}")

    def load(self, spark, path: str, names: list[str]) -> None:
        self.tables = {n: spark.read.parquet(f"{path}/{n}") for n in names}


def reach_by_rules(rules: DataFrame, items: DataFrame | None, users: DataFrame, history: DataFrame, n: int) -> DataFrame:
    """Pairs that ``rules(ref, item_id)`` lead to from the users' history; with ``items``, which score 0 unreached,
    also each user's n least items that are neither seen nor reached."""
    from recmill.operators.recommend import best_unseen

    seen = known_pairs(history).select("user_id", "item_id").distinct()
    led = seen.select("user_id", F.col("item_id").alias("ref")).join(rules.select("ref", "item_id"), "ref").select("user_id", "item_id").distinct()
    fresh = led.join(seen, ["user_id", "item_id"], "left_anti").join(users.select("user_id").distinct(), "user_id", "left_semi")
    if items is None:
        return fresh
    rest = best_unseen(items.select("item_id", F.lit(0.0).alias("score")), seen.unionByName(fresh), users, n)
    return fresh.unionByName(rest.select("user_id", "item_id"))


def known_pairs(log: DataFrame, rated: bool = False) -> DataFrame:
    """Rows with a user and an item (and a rating)."""
    df = log.where("user_id is not null and item_id is not null")
    return df.where(F.nanvl(F.col("rating").cast("double"), F.lit(None)).isNotNull()) if rated else df


def float_score(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.col("score").cast("float"))
