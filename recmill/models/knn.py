"""Neighbourhood models as joins: item and user k-NN, association rules."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recmill.models.base import Scorer, TrainingOptions, float_score, known_pairs, reach_by_rules
from recmill.operators.held import BestByRules, Cells, Together, UsersNear, by_key, held_path, nearest, over_keys, ragged, voted
from recmill.operators.pairs import group_pairs, side_pairs
from recmill.operators.stats import cooccurrence
from recmill.session import cut

#: Norms are at least this (the smallest normal float32).
TINY = 1.1754943508222875e-38


def _ratings(log: DataFrame, explicit: bool) -> DataFrame:
    """(user_id, item_id, r), one row per pair: the last rating, or 1."""
    rows = known_pairs(log, explicit)
    value = F.max_by(F.col("rating").cast("double"), F.struct(*[c for c in ("timestamp",) if c in log.columns], "rating")) if explicit else F.lit(1.0)
    return rows.groupBy("user_id", "item_id").agg(value.alias("r"))


def _unit(df: DataFrame, key: str, centre: bool) -> DataFrame:
    w = Window.partitionBy(key)
    d = df.withColumn("m", F.avg("r").over(w) if centre else F.lit(0.0)).withColumn("c", F.col("r") - F.col("m"))
    return d.withColumn("u", F.col("c") / F.greatest(F.sqrt(F.sum(F.col("c") * F.col("c")).over(w)), F.lit(TINY)))


@dataclass
class ItemKNNConfig:
    max_nbrs: int = 20
    min_nbrs: int = 1
    min_sim: float = 1e-6
    save_nbrs: int | None = None
    feedback: str = "explicit"


class ItemKNNScorer(Scorer):
    """Cosine between (for explicit feedback centred) item vectors by a self-join on users; scores from the
    ``max_nbrs`` most similar items of the history."""

    config_class = ItemKNNConfig
    aliases = {"k": "max_nbrs", "nnbrs": "max_nbrs"}
    _held: str | None = None

    def fit(self, log: DataFrame, options: TrainingOptions) -> None:
        explicit = self.config.feedback == "explicit"
        r = cut(_unit(_ratings(log, explicit), "item_id", explicit), "ratings")
        self.tables["ratings"] = r.select("user_id", "item_id", "r")
        self.tables["means"] = r.groupBy("item_id").agg(F.first("m").alias("m"))
        i, j = F.least("item_id_l", "item_id_r"), F.greatest("item_id_l", "item_id_r")
        half = group_pairs(r.where("u <> 0"), "user_id", ["item_id", "u"]).groupBy(i.alias("i"), j.alias("j")).agg(F.sum(F.col("u_l") * F.col("u_r")).alias("sim")).where(F.col("sim") >= self.config.min_sim)
        sims = half.unionByName(half.select(F.col("j").alias("i"), F.col("i").alias("j"), "sim"))
        if self.config.save_nbrs:
            w = Window.partitionBy("i").orderBy(F.desc("sim"), "j")
            sims = sims.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= self.config.save_nbrs).drop("_k")
        self._held = held_path(r) if self.config.min_sim > 0 and not self.config.save_nbrs else None
        self.tables["sims"] = sims if self._held else cut(sims, "sims")  # not needed for scores by held cells

    def load_parameters(self, tables: dict[str, DataFrame]) -> None:
        super().load_parameters(tables)
        self._held = None

    def load(self, spark, path: str, names: list[str]) -> None:
        super().load(spark, path, names)
        self._held = None

    def reach(self, users: DataFrame, history: DataFrame, n: int) -> DataFrame:
        return reach_by_rules(self.tables["sims"].select(F.col("j").alias("ref"), F.col("i").alias("item_id")), None, users, history, n)

    def _by_held(self, todo: DataFrame) -> DataFrame:
        cfg = self.config

        def run(cells: Cells):
            sums, (start, many, refs, vals) = Together(cells, "u"), cells.user

            def one(item, users):
                sims = sums.at(item)
                flat = ragged(start[users], many[users])
                seg, sim = np.repeat(np.arange(len(users)), many[users]), sims[refs[flat]]
                best = nearest(seg, sim, refs[flat], cfg.min_sim, cfg.max_nbrs)
                return voted(seg[best], sim[best], vals["c"][flat][best] if cfg.feedback == "explicit" else None, len(users))

            return one

        return by_key(todo, "item_id", "score double, nbr_count long", run, self._held, ("u", "c"))

    def score(self, pairs: DataFrame, history: DataFrame | None = None) -> DataFrame:
        """Also gives nbr_count. Too few neighbours give null."""
        explicit = self.config.feedback == "explicit"
        if history is None and self._held:
            got = self._by_held(pairs.select("user_id", "item_id").distinct())
        else:
            got = self._by_joins(pairs, history, explicit)
        out = pairs.join(got.where(F.col("nbr_count") >= self.config.min_nbrs), ["user_id", "item_id"], "left")
        if explicit:
            out = out.join(self.tables["means"], "item_id", "left").withColumn("score", F.col("score") + F.col("m")).drop("m")
        return float_score(out.fillna(0, ["nbr_count"]))

    def _by_joins(self, pairs: DataFrame, history: DataFrame | None, explicit: bool) -> DataFrame:
        past = (_ratings(history, explicit) if history is not None else self.tables["ratings"]).select("user_id", F.col("item_id").alias("ref"), "r")
        past = past.join(self.tables["means"].withColumnRenamed("item_id", "ref"), "ref").withColumn("v", F.col("r") - F.col("m")).select("user_id", "ref", "v")
        todo = pairs.select("user_id", "item_id").distinct()
        # a user's pairs meet its history first: items meet all their neighbours in no step
        near = side_pairs(todo, past, "user_id", ["item_id"], ["ref", "v"]).join(self.tables["sims"].select(F.col("i").alias("item_id"), F.col("j").alias("ref"), "sim"), ["item_id", "ref"])
        w = Window.partitionBy("user_id", "item_id").orderBy(F.desc("sim"), "ref")
        best = near.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= self.config.max_nbrs)
        value = F.sum(F.col("sim") * F.col("v")) / F.sum("sim") if explicit else F.sum("sim")
        return best.groupBy("user_id", "item_id").agg(value.alias("score"), F.count("*").alias("nbr_count"))


@dataclass
class UserKNNConfig:
    max_nbrs: int = 20
    min_nbrs: int = 1
    min_sim: float = 1e-6
    feedback: str = "explicit"


class UserKNNScorer(Scorer):
    """Neighbours of the querying user by the dot product of unit vectors; a query with a history of its own is
    centred by its mean but not made a unit vector."""

    config_class = UserKNNConfig
    aliases = {"k": "max_nbrs", "nnbrs": "max_nbrs"}
    _held: str | None = None

    def fit(self, log: DataFrame, options: TrainingOptions) -> None:
        explicit = self.config.feedback == "explicit"
        self.tables["vectors"] = cut(_unit(_ratings(log, explicit), "user_id", explicit).select("user_id", "item_id", "c", "u", "m"), "vectors")
        self._held = held_path(self.tables["vectors"]) if self.config.min_sim > 0 else None

    def load_parameters(self, tables: dict[str, DataFrame]) -> None:
        super().load_parameters(tables)
        self._held = None

    def load(self, spark, path: str, names: list[str]) -> None:
        super().load(spark, path, names)
        self._held = None

    def _by_held(self, todo: DataFrame) -> DataFrame:
        cfg = self.config

        def run(cells: Cells):
            near = UsersNear(cells, cfg.min_sim, cfg.max_nbrs)

            def one(user, items):
                seg, sim, value = near(user, items)
                return voted(seg, sim, value if cfg.feedback == "explicit" else None, len(items))

            return one

        return by_key(todo, "user_id", "score double, nbr_count long", run, self._held, ("u", "c"))

    def score(self, pairs: DataFrame, history: DataFrame | None = None) -> DataFrame:
        explicit, vec = self.config.feedback == "explicit", self.tables["vectors"]
        users = pairs.select("user_id").distinct()
        if history is None:
            mine = vec.join(users, "user_id", "left_semi").select("user_id", "item_id", F.col("u").alias("q"), "m")
        else:
            mine = _unit(_ratings(history, explicit), "user_id", explicit).select("user_id", "item_id", F.col("c").alias("q"), "m")
        todo = pairs.select("user_id", "item_id").distinct()
        if history is None and self._held:
            got = self._by_held(todo)
        else:
            other = vec.where("u <> 0").select(F.col("user_id").alias("nbr"), "item_id", "u")
            sims = side_pairs(mine.where("q <> 0"), other, "item_id", ["user_id", "q"], ["nbr", "u"]).where("user_id <> nbr").groupBy("user_id", "nbr").agg(F.sum(F.col("q") * F.col("u")).alias("sim")).where(F.col("sim") >= self.config.min_sim)
            votes = side_pairs(todo, vec.select(F.col("user_id").alias("nbr"), "item_id", "c"), "item_id", ["user_id"], ["nbr", "c"]).join(sims, ["user_id", "nbr"])
            w = Window.partitionBy("user_id", "item_id").orderBy(F.desc("sim"), "nbr")
            best = votes.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= self.config.max_nbrs)
            value = F.sum(F.col("sim") * F.col("c")) / F.sum("sim") if explicit else F.sum("sim")
            got = best.groupBy("user_id", "item_id").agg(value.alias("score"), F.count("*").alias("nbr_count"))
        out = pairs.join(got.where(F.col("nbr_count") >= self.config.min_nbrs), ["user_id", "item_id"], "left")
        if explicit:
            means = mine.groupBy("user_id").agg(F.first("m").alias("m"))
            out = out.join(means, "user_id", "left").withColumn("score", F.col("score") + F.col("m")).drop("m")
        return float_score(out.fillna(0, ["nbr_count"]))


@dataclass
class AssociationConfig:
    method: str = "probability"
    damping: float = 0.0
    max_nbrs: int | None = None


class AssociationScorer(Scorer):
    """Score of a target: mean over all history items (those without it counting 0) of P(target | item) or of its
    lift; their maximum with max_nbrs=1. Users without history get null."""

    config_class = AssociationConfig
    _held: str | None = None

    def fit(self, log: DataFrame, options: TrainingOptions) -> None:
        if self.config.max_nbrs not in (None, 1):
            raise NotImplementedError("max_nbrs must be 1 or none")
        d = cut(known_pairs(log).select("user_id", "item_id").distinct(), "history")
        self._held = held_path(d)
        n = d.groupBy("item_id").agg(F.count("*").alias("n"))
        c = cooccurrence(d, "user_id", "item_id")
        k = F.lit(float(self.config.damping))
        rule = c.join(n.select(F.col("item_id").alias("item_a"), F.col("n").alias("na")), "item_a").withColumn("v", F.col("n") / (F.col("na") + k))
        if self.config.method == "lift":
            users = d.agg(F.count_distinct("user_id").alias("n_users"))
            rule = rule.join(n.select(F.col("item_id").alias("item_b"), F.col("n").alias("nb")), "item_b").crossJoin(F.broadcast(users)).withColumn("v", F.col("v") * F.col("n_users") / (F.col("nb") + k))
        rules = rule.select(F.col("item_a").alias("ref"), F.col("item_b").alias("item_id"), "v")
        self.tables |= {"rules": rules if self._held else cut(rules, "rules"), "items": n.select("item_id"), "history": d}

    def load_parameters(self, tables: dict[str, DataFrame]) -> None:
        super().load_parameters(tables)
        self._held = None

    def load(self, spark, path: str, names: list[str]) -> None:
        super().load(spark, path, names)
        self._held = None

    def _by_held(self, todo: DataFrame) -> DataFrame:
        k, lift = float(self.config.damping), self.config.method == "lift"

        def run(cells: Cells):
            sums, (start, many, refs, _), n = Together(cells), cells.user, cells.item[1]

            def one(item, users):
                count, size = sums.at(item), many[users]
                at = refs[ragged(start[users], size)]
                v = count[at] / (n[at] + k)
                if lift:
                    v = v * len(cells.users) / (n[item] + k)
                return np.arange(len(users)), (np.bincount(np.repeat(np.arange(len(users)), size), v, len(users)), np.maximum.reduceat(v, np.cumsum(size) - size))

            return one

        return by_key(todo, "item_id", "_s double, _m double", run, self._held)

    def reach(self, users: DataFrame, history: DataFrame, n: int) -> DataFrame:
        return reach_by_rules(self.tables["rules"], self.tables["items"], users, history, n)

    def reach_trained(self, users: DataFrame, history: DataFrame, n: int) -> DataFrame:
        if not self._held:
            return self.reach(users, history, n)
        damping, lift, top = float(self.config.damping), self.config.method == "lift", self.config.max_nbrs == 1
        return cut(over_keys(users.select("user_id"), f"user_id {dict(users.dtypes)['user_id']}, item_id {dict(self.tables['items'].dtypes)['item_id']}", lambda cells: BestByRules(cells, n, damping, lift, top), self._held), "reach")

    def score(self, pairs: DataFrame, history: DataFrame | None = None) -> DataFrame:
        past = known_pairs(history).select("user_id", "item_id").distinct() if history is not None else self.tables["history"]
        past = past.join(self.tables["items"], "item_id", "left_semi").select("user_id", F.col("item_id").alias("ref"))
        sizes = past.groupBy("user_id").agg(F.count("*").alias("_n"))
        todo = pairs.select("user_id", "item_id").distinct()
        if history is None and self._held:
            got = self._by_held(todo)
        else:
            # a user's pairs meet its history first: items meet all their rules in no step
            got = side_pairs(todo, past, "user_id", ["item_id"], ["ref"]).join(self.tables["rules"], ["item_id", "ref"]).groupBy("user_id", "item_id").agg(F.sum("v").alias("_s"), F.max("v").alias("_m"))
        out = pairs.join(got, ["user_id", "item_id"], "left").join(sizes, "user_id", "left").join(self.tables["items"].withColumn("_k", F.lit(True)), "item_id", "left")
        value = F.coalesce("_m", F.lit(0.0)) if self.config.max_nbrs == 1 else F.coalesce("_s", F.lit(0.0)) / F.col("_n")
        return float_score(out.withColumn("score", F.when(F.col("_k") & (F.col("_n") > 0), value)).select(*pairs.columns, "score"))
