"""Alternating least squares with distributed normal equations."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recmill.models.base import Scorer, TrainingOptions, float_score, known_pairs
from recmill.models.basic import BiasScorer
from recmill.session import cut, drop_cut

#: Rows of one user or item that are brought together; more are summed in parts.
PART = 20_000


def solve_side(rows: DataFrame, key: str, dim: int, reg: float, scale_by_n: bool, base: np.ndarray | None = None) -> DataFrame:
    """(key, vec): per key the solution of (base + sum w q q' + reg I) x = sum y q over ``rows(key, q, w, y)``.

    The normal equations of a key with more than PART rows are summed in parts, so that a hot key is never
    in one task. scale_by_n multiplies reg with the key's rows.
    """
    parts = rows.groupBy(key).agg(F.ceil(F.count("*") / PART).cast("int").alias("_k")).where("_k > 1")
    salted = rows.join(parts, key, "left").withColumn("_k", F.coalesce("_k", F.lit(1))).withColumn("_s", F.pmod(F.xxhash64("q", "y"), F.col("_k").cast("long")).cast("int"))
    kind = dict(rows.dtypes)[key]

    def solved(a, b, n):
        a = a + (reg * n if scale_by_n else reg) * np.eye(dim)
        return np.linalg.solve(a if base is None else a + base, b)

    def partial(batches):
        held = None  # [key, salt, whole, n, a, b] of the key that goes on

        def finish(h):
            return h[0], h[3], None if h[2] else h[4].ravel(), None if h[2] else h[5], solved(h[4], h[5], h[3]) if h[2] else None

        for batch in batches:
            if not batch.num_rows:
                continue
            ids, salt, many = (batch.column(c).to_numpy(zero_copy_only=False) for c in (key, "_s", "_k"))
            q = batch.column("q").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), dim)
            w, y = batch.column("w").to_numpy(zero_copy_only=False), batch.column("y").to_numpy(zero_copy_only=False)
            edges = np.append(np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (salt[1:] != salt[:-1]))), len(ids))
            rows = []
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                x = q[s:e]
                a, b = (x * w[s:e, None]).T @ x, x.T @ y[s:e]
                if held and held[0] == ids[s] and held[1] == salt[s]:
                    held[3:] = [held[3] + int(e - s), held[4] + a, held[5] + b]
                    continue
                if held:
                    rows.append(finish(held))
                held = [ids[s], salt[s], many[s] == 1, int(e - s), a, b]
            if rows:
                yield _record_batch(rows, key, kind)
        if held:
            yield _record_batch([finish(held)], key, kind)

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, n = sum(pdf["a"]).reshape(dim, dim), sum(pdf["b"]), int(pdf["n"].sum())
        return pd.DataFrame({key: pdf[key].iloc[:1], "vec": [solved(a, b, n)]})

    together = salted.select(key, "_s", "_k", "q", "w", "y").repartition(key, "_s").sortWithinPartitions(key, "_s")
    out = cut(together.mapInArrow(partial, f"{key} {kind}, n long, a array<double>, b array<double>, vec array<double>"), "solved")
    hot = out.where("vec is null").groupBy(key).applyInPandas(total, f"{key} {kind}, vec array<double>")
    return out.where("vec is not null").select(key, "vec").unionByName(hot)


def _record_batch(rows: list[tuple], key: str, kind: str) -> pa.RecordBatch:
    types = (pa.string() if kind == "string" else pa.int32() if kind == "int" else pa.int64(), pa.int64(), *[pa.list_(pa.float64())] * 3)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[key, "n", "a", "b", "vec"])


def gram(vectors: DataFrame, dim: int) -> np.ndarray:
    """Q'Q, summed by partition."""

    def part(batches):
        g = np.zeros((dim, dim))
        for pdf in batches:
            if len(pdf):
                q = np.vstack(pdf["vec"])
                g += q.T @ q
        yield pd.DataFrame({"g": [g.ravel()]})

    rows = vectors.select("vec").mapInPandas(part, "g array<double>").select(F.posexplode("g").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()
    g = np.zeros(dim * dim)
    for r in rows:
        g[r["i"]] = r["x"]
    return g.reshape(dim, dim)


def start_vectors(ids: DataFrame, key: str, dim: int, seed: int, squared: bool) -> DataFrame:
    """Pseudo-random vectors by hash of the id: unit length, or small and positive (squares)."""
    u = lambda j, k: (F.pmod(F.xxhash64(key, F.lit(seed), F.lit(j), F.lit(k)), F.lit(1 << 30)) + 0.5) / (1 << 30)
    normal = [F.sqrt(-2 * F.log(u(j, 0))) * F.cos(2 * np.pi * u(j, 1)) for j in range(dim)]
    d = ids.select(key).distinct().withColumn("vec", F.array(*normal))
    if squared:
        return d.withColumn("vec", F.transform("vec", lambda x: (x * 0.01) * (x * 0.01)))
    size = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
    return d.withColumn("_s", size).withColumn("vec", F.transform("vec", lambda x: x / F.col("_s"))).drop("_s")


def dot(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


@dataclass
class ALSConfig:
    embedding_size: int = 64
    epochs: int = 10
    regularization: float = 0.1
    user_embeddings: bool | str = True


@dataclass
class BiasedMFConfig(ALSConfig):
    damping: float = 5.0


@dataclass
class ImplicitMFConfig(ALSConfig):
    weight: float = 40.0
    use_ratings: bool = False


class _ALS(Scorer):
    aliases = {"features": "embedding_size"}
    squared, scale_by_n = False, True

    def rows(self, log: DataFrame) -> DataFrame:
        """(user_id, item_id, w, y) of a log."""
        raise NotImplementedError

    def base(self, vectors: DataFrame) -> np.ndarray | None:
        return None

    def fit(self, log: DataFrame, options: TrainingOptions) -> None:
        for _ in self.train_epochs(log, options):
            pass

    def train_epochs(self, log: DataFrame, options: TrainingOptions | None = None) -> Iterator[dict]:
        c, options = self.config, options or TrainingOptions()
        rows = cut(self.rows(log), "ratings")
        self.tables["item"] = cut(start_vectors(rows, "item_id", c.embedding_size, options.seed, self.squared), "item")
        self.deltas: list[tuple[float, float]] = []
        self.tables.pop("user", None)
        for e in range(c.epochs):
            self.deltas.append((self._half(rows, "user_id", "item_id"), self._half(rows, "item_id", "user_id")))
            yield {"epoch": e + 1, "user_change": self.deltas[-1][0], "item_change": self.deltas[-1][1]}

    def _half(self, rows: DataFrame, key: str, other: str) -> float:
        """Solve one side from the other; gives the Frobenius norm of the change."""
        side, from_ = key[:-3], self.tables[other[:-3]]
        new = cut(solve_side(rows.join(from_.withColumnRenamed("vec", "q"), other).select(key, "q", "w", "y"), key, self.config.embedding_size, self.config.regularization, self.scale_by_n, self.base(from_)), side)
        old = self.tables.get(side)
        delta = float("inf")
        if old is not None:
            diff = F.aggregate(F.zip_with("vec", "_o", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
            delta = new.join(old.withColumnRenamed("vec", "_o"), key).agg(F.sqrt(F.sum(diff))).first()[0] or 0.0
            drop_cut(old)
        self.tables[side] = new
        return delta

    def _users(self, pairs: DataFrame, history: DataFrame | None) -> DataFrame:
        """Stored vectors, replaced by folded-in ones for users with a history unless "prefer" is set."""
        have = self.tables["user"]
        if history is None or self.config.user_embeddings == "prefer":
            return have
        rows = self.rows(history).join(self.tables["item"].withColumnRenamed("vec", "q"), "item_id").select("user_id", "q", "w", "y")
        own = solve_side(rows, "user_id", self.config.embedding_size, self.config.regularization, self.scale_by_n, self.base(self.tables["item"]))
        return own.unionByName(have.join(own.select("user_id"), "user_id", "left_anti")) if self.config.user_embeddings else own

    def reach(self, users: DataFrame, history: DataFrame, n: int) -> DataFrame | None:
        """Users with a vector of their own; those who would have to be folded in are left to the product."""
        from recmill.operators.recommend import best_products

        if not users.join(self.tables["user"], "user_id", "left_anti").isEmpty():
            return None
        mine = self.tables["user"].join(users.select("user_id").distinct(), "user_id", "left_semi")
        return best_products(mine, self._item_terms(), known_pairs(history), n, self.config.embedding_size)

    def _item_terms(self) -> DataFrame:
        return self.tables["item"].withColumn("b", F.lit(0.0))

    def score(self, pairs: DataFrame, history: DataFrame | None = None) -> DataFrame:
        u, i = self._users(pairs, history).withColumnRenamed("vec", "_u"), self.tables["item"].withColumnRenamed("vec", "_v")
        return float_score(pairs.join(u, "user_id", "left").join(i, "item_id", "left").withColumn("score", dot("_u", "_v")).select(*pairs.columns, "score"))


class BiasedMFScorer(_ALS):
    """Explicit feedback: factors of what the biases leave over; the penalty grows with a row's ratings."""

    config_class = BiasedMFConfig

    def train_epochs(self, log: DataFrame, options: TrainingOptions | None = None) -> Iterator[dict]:
        self.bias = BiasScorer(damping=self.config.damping).train(log)
        yield from super().train_epochs(log, options)

    def _item_terms(self) -> DataFrame:
        bias = self.bias.tables.get("item")
        return super()._item_terms() if bias is None else self.tables["item"].join(bias, "item_id", "left").withColumn("b", F.coalesce("b", F.lit(0.0)))

    def rows(self, log: DataFrame) -> DataFrame:
        return self.bias.residuals(log).groupBy("user_id", "item_id").agg(F.lit(1.0).alias("w"), F.avg("r").alias("y"))

    def score(self, pairs: DataFrame, history: DataFrame | None = None) -> DataFrame:
        rated = history if history is not None and "rating" in history.columns else None
        both = super().score(pairs, rated).withColumnRenamed("score", "_m")
        return float_score(self.bias.score(both, rated).withColumn("score", F.col("score") + F.col("_m").cast("double")).select(*pairs.columns, "score"))


class ImplicitMFScorer(_ALS):
    """Implicit feedback: confidence 1 + weight * value; the penalty does not grow."""

    config_class = ImplicitMFConfig
    squared, scale_by_n = True, False

    def rows(self, log: DataFrame) -> DataFrame:
        value = F.max(F.col("rating").cast("double")) if self.config.use_ratings else F.lit(1.0)
        d = known_pairs(log, self.config.use_ratings).groupBy("user_id", "item_id").agg((value * self.config.weight).alias("w"))
        return d.withColumn("y", F.col("w") + 1)

    def base(self, vectors: DataFrame) -> np.ndarray:
        return gram(vectors, self.config.embedding_size)
