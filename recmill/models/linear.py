"""Item-item linear models: EASE and SLIM."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recmill.models.base import Scorer, TrainingOptions, float_score, known_pairs, reach_by_rules
from recmill.models.factor import Graph
from recmill.operators.held import Cells, Together, cells_of, find, held_path, over_keys, ragged
from recmill.operators.order import number_rows
from recmill.operators.stats import cooccurrence
from recmill.session import cut

#: EASE inverts a dense item x item matrix; above so many items (two matrices of 0.8 GB in a task) the columns that scores
#: need are solved for instead, and weights are not kept.
MAX_DENSE_ITEMS = 10_000


class _Weights(Scorer):
    """score = sum of weights(ref, item) over the history."""

    def reach(self, users: DataFrame, history: DataFrame, n: int) -> DataFrame:
        return reach_by_rules(self.tables["weights"], self.tables["items"], users, history, n)

    def score(self, pairs: DataFrame, history: DataFrame | None = None) -> DataFrame:
        past = known_pairs(history) if history is not None else self.tables["history"]
        past = past.select("user_id", F.col("item_id").alias("ref")).distinct()
        todo = pairs.select("user_id", "item_id").distinct()
        got = self._sums(todo, past)
        out = pairs.join(got, ["user_id", "item_id"], "left").join(self.tables["items"].withColumn("_k", F.lit(True)), "item_id", "left").join(past.select("user_id").distinct().withColumn("_h", F.lit(True)), "user_id", "left")
        return float_score(out.withColumn("score", F.when(F.col("_k") & F.col("_h"), F.coalesce("_s", F.lit(0.0)))).select(*pairs.columns, "score"))

    def _sums(self, todo: DataFrame, past: DataFrame) -> DataFrame:
        """(user_id, item_id, _s): the weights that lead from the user's refs to the item."""
        return todo.join(self.tables["weights"], "item_id").join(past, ["user_id", "ref"]).groupBy("user_id", "item_id").agg(F.sum("w").alias("_s"))


class Columns:
    """Columns of the inverse of Gram + regularization, a few at once by conjugate gradients on the cells.

    Steps are taken in single precision, where a few columns stay in a core's cache; what they leave is found in double
    precision and taken on until it is below ``LEFT`` of the start.
    """

    GROUP, LEFT, STEP_LEFT, ROUNDS, STEPS = 16, 1e-7, 3e-4, 60, 500

    def __init__(self, cells: Cells, reg: float):
        (_, umany, items, _), (_, many, _, _) = cells.user, cells.item
        u = np.repeat(np.arange(len(umany), dtype=np.int32), umany)
        self.size, self.graph, self.reg = len(many), Graph(u, items, len(umany), len(many)), reg
        self.scale = 1 / np.sqrt(many + reg)[:, None]
        self.scale_32, self.ridge_32 = self.scale.astype(np.float32), (reg * self.scale**2).astype(np.float32)

    def _times(self, x: np.ndarray) -> np.ndarray:
        """The matrix, scaled to a diagonal of 1, times x."""
        scale, ridge = (self.scale_32, self.ridge_32) if x.dtype == np.float32 else (self.scale, self.reg * self.scale**2)
        out = Graph.sums(self.graph.of_i, Graph.sums(self.graph.of_u, scale * x))
        out *= scale
        out += ridge * x
        return out

    def _step(self, r: np.ndarray) -> np.ndarray:
        x, p, now = np.zeros_like(r), r.copy(), np.einsum("nk,nk->k", r, r)
        goal = now * self.STEP_LEFT**2
        for _ in range(self.STEPS):
            if (now <= goal).all():
                break
            q = self._times(p)
            a = now / np.maximum(np.einsum("nk,nk->k", p, q), 1e-37)
            x += p * a
            q *= a
            r -= q
            last, now = now, np.einsum("nk,nk->k", r, r)
            p *= now / np.maximum(last, 1e-37)
            p += r
        return x

    def __call__(self, items: np.ndarray) -> np.ndarray:
        """(all items, len(items))"""
        start = np.zeros((self.size, len(items)))
        start[items, np.arange(len(items))] = 1
        x, r = np.zeros_like(start), start
        for _ in range(self.ROUNDS):
            norm = np.maximum(np.sqrt(np.einsum("nk,nk->k", r, r)), 1e-300)
            if (norm <= self.LEFT).all():
                return self.scale * x * self.scale[items, 0]
            x += self._step((r / norm).astype(np.float32)) * norm
            r = start - self._times(x)
        raise ValueError("the inverse can't be found to enough digits: a greater regularization is needed")


@dataclass
class EASEConfig:
    regularization: float = 1.0


class EASEScorer(_Weights):
    """B = -P / diag(P) by column with zero diagonal, P the inverse of Gram + regularization.

    Above ``MAX_DENSE_ITEMS`` items the matrix of weights, dense as it is, is not made: a task solves for the columns of the
    items that it scores, from cells that every worker holds.
    """

    config_class = EASEConfig

    def fit(self, log: DataFrame, options: TrainingOptions) -> None:
        d = cut(known_pairs(log).select("user_id", "item_id").distinct(), "history")
        if d.select("item_id").distinct().limit(MAX_DENSE_ITEMS + 1).count() > MAX_DENSE_ITEMS:
            if self.config.regularization <= 0:
                raise ValueError(f"more than {MAX_DENSE_ITEMS} items need a positive regularization")
            self.tables = {"history": d, "items": d.select("item_id").distinct()}
            return
        items = cut(number_rows(d.select("item_id").distinct(), "item_id", name="num"), "items")
        size, reg = items.count(), self.config.regularization
        at = lambda c, name: F.broadcast(items.select(F.col("item_id").alias(c), F.col("num").alias(name)))
        gram = cooccurrence(d, "user_id", "item_id", True).join(at("item_a", "a"), "item_a").join(at("item_b", "b"), "item_b").select("a", "b", F.col("n").cast("double").alias("n"))

        def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            g = np.zeros((size, size))
            for x in batches:
                g[x.column("a").to_numpy(), x.column("b").to_numpy()] = x.column("n").to_numpy()
            g[np.diag_indices(size)] += reg
            p = np.linalg.inv(g)
            del g
            p /= -np.diag(p)[None, :]
            np.fill_diagonal(p, 0)
            for k in range(size):
                on = np.flatnonzero(p[:, k])
                yield pa.RecordBatch.from_arrays([pa.array(on, pa.int64()), pa.array(np.full(len(on), k, np.int64)), pa.array(p[on, k])], names=["r", "i", "w"])

        # cells stream into the one task that inverts, which holds two matrices of checked size
        wide = cut(gram.coalesce(1).mapInArrow(invert, "r long, i long, w double") if size else gram.select(F.col("a").alias("r"), F.col("b").alias("i"), F.col("n").alias("w")), "inverse")
        self.tables["weights"] = cut(wide.join(at("ref", "r"), "r").join(at("item_id", "i"), "i").select("ref", "item_id", "w"), "weights")
        self.tables |= {"history": d, "items": d.select("item_id").distinct()}

    def reach(self, users: DataFrame, history: DataFrame, n: int) -> DataFrame | None:
        return super().reach(users, history, n) if "weights" in self.tables else None  # every item reaches every other

    def _sums(self, todo: DataFrame, past: DataFrame) -> DataFrame:
        if "weights" in self.tables:
            return super()._sums(todo, past)
        if not hasattr(self.tables["history"], "_recmill_path"):
            self.tables["history"] = cut(self.tables["history"], "history")
        path, reg, kinds = self.tables["history"]._recmill_path, self.config.regularization, dict(todo.dtypes)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            columns = None
            for b in batches:
                if not b.num_rows:
                    continue
                cells = cells_of(path)
                columns = columns or Columns(cells, reg)
                i = cells.codes(b)[1]
                refs = b.column("refs")
                many = refs.value_lengths().to_numpy()
                at = find(cells.items, refs.flatten().to_numpy())
                start = np.cumsum(many) - many
                total, order = np.zeros(len(i)), np.argsort(i, kind="stable")
                some = np.unique(i[i >= 0])
                for a in range(0, len(some), Columns.GROUP):
                    group = some[a : a + Columns.GROUP]
                    p = columns(group)
                    rows = order[slice(*np.searchsorted(i[order], (group[0], group[-1] + 1)))]
                    row, ref = np.repeat(np.arange(len(rows)), many[rows]), at[ragged(start[rows], many[rows])]
                    col = np.searchsorted(group, i[rows])
                    w = -p[ref, col[row]] / p[group, np.arange(len(group))][col[row]]
                    w[(ref < 0) | (ref == i[rows][row])] = 0
                    total[rows] = np.bincount(row, w, len(rows))
                known = pa.array(np.flatnonzero(i >= 0))
                yield pa.RecordBatch.from_arrays([b.column("user_id").take(known), b.column("item_id").take(known), pa.array(total).take(known)], names=["user_id", "item_id", "_s"])

        # by a number of parts: few bytes that stand for much work are else put into few tasks
        parts = max(int(todo.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * todo.sparkSession.sparkContext.defaultParallelism)
        asked = todo.join(past.groupBy("user_id").agg(F.collect_list("ref").alias("refs")), "user_id").select("user_id", "item_id", "refs")
        return asked.repartition(parts, F.xxhash64("item_id")).sortWithinPartitions("item_id").mapInArrow(work, f"user_id {kinds['user_id']}, item_id {kinds['item_id']}, _s double")


def descend(a: np.ndarray, b: np.ndarray, l1: float, l2: float, most_rounds: int) -> np.ndarray:
    """Coordinate descent for many items at once: Gram matrices a (items, k, k), right sides b (items, k)."""
    out, on = np.zeros_like(b), np.arange(len(b))
    x, ax, diag = np.zeros_like(b), np.zeros_like(b), np.einsum("nkk->nk", a).copy()
    for _ in range(most_rounds):
        most = np.zeros(len(on))
        for m in range(b.shape[1]):
            d = np.maximum(0.0, b[:, m] - (ax[:, m] - diag[:, m] * x[:, m]) - l1) / (diag[:, m] + l2) - x[:, m]
            ax += a[:, :, m] * d[:, None]
            x[:, m] += d
            np.maximum(most, np.abs(d), out=most)
        going = most > 1e-3
        if not going.all():
            out[on[~going]] = x[~going]
            on, a, b, x, ax, diag = (z[going] for z in (on, a, b, x, ax, diag))
        if not len(on):
            break
    out[on] = x
    return out


class SLIMHeld:
    """Weights of items from held cells: (ref, item_id, w) for the items by id."""

    #: Items solved together.
    GROUP = 256
    #: Items with a column of who has them: so many with most users, if they have more than so many.
    MOST, MANY = 16, 2_000

    def __init__(self, cells: Cells, cfg: SLIMConfig):
        self.cells, self.cfg, self.sums = cells, cfg, Together(cells)
        start, many, users, _ = cells.item
        hot = np.argsort(-many, kind="stable")[: self.MOST]
        hot = hot[many[hot] > self.MANY]
        self.hot = np.full(len(many), -1)
        self.hot[hot] = np.arange(len(hot))
        self.has = np.zeros((len(hot), len(cells.users)), bool)
        for h, i in enumerate(hot):
            self.has[h, users[start[i] : start[i] + many[i]]] = True
        self.both = np.array([[np.count_nonzero(x & y) for y in self.has] for x in self.has], float).reshape(len(hot), len(hot))

    def __call__(self, ids: np.ndarray) -> list[np.ndarray]:
        todo = []
        for item in np.searchsorted(self.cells.items, ids):
            near, b = self._near(item)
            if len(near):
                todo.append((item, near, b, self._gram(near)))
        todo.sort(key=lambda t: len(t[1]))
        refs, items, ws = [], [], []
        for at in range(0, len(todo), self.GROUP):
            group = todo[at : at + self.GROUP]
            k = len(group[-1][1])
            a, b = np.tile(np.eye(k), (len(group), 1, 1)), np.zeros((len(group), k))
            for g, (_, near, mine, gram) in enumerate(group):
                a[g, : len(near), : len(near)], b[g, : len(near)] = gram, mine
            for (item, near, _, _), x in zip(group, descend(a, b, self.cfg.l1_reg, self.cfg.l2_reg, self.cfg.max_iters), strict=True):
                keep = np.flatnonzero(x[: len(near)] >= 1e-12)
                refs.append(near[keep]), items.append(np.full(len(keep), item)), ws.append(x[keep])
        none = np.empty(0, int)
        return [self.cells.items[np.concatenate([none, *refs])], self.cells.items[np.concatenate([none, *items])], np.concatenate([np.empty(0), *ws])]

    def _near(self, item: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest items by cosine whose weight is not 0 from the start, ascending, and how many users have both."""
        count, many = self.sums.at(item), self.cells.item[1]
        some = np.flatnonzero(count) if len(self.sums.touched) > len(count) / 8 else np.unique(self.sums.touched)
        some = some[some != item]
        b = count[some]
        if len(some) > self.cfg.max_nbrs:
            cos = b / np.sqrt(many[some])
            keep = np.flatnonzero(cos >= np.partition(cos, -self.cfg.max_nbrs)[-self.cfg.max_nbrs])
            keep = np.sort(keep[np.lexsort((some[keep], -cos[keep]))[: self.cfg.max_nbrs]])
            some, b = some[keep], b[keep]
        # as Gram and weights are not negative, a weight never leaves 0 where b is not above l1
        keep = b > self.cfg.l1_reg
        return some[keep], b[keep]

    def _gram(self, near: np.ndarray) -> np.ndarray:
        start, many, users, _ = self.cells.item
        hot = self.hot[near]
        few, wide = np.flatnonzero(hot < 0), np.flatnonzero(hot >= 0)
        of = users[ragged(start[near[few]], many[near[few]])]
        rows, row = np.unique(of, return_inverse=True)
        x = np.zeros((len(rows), len(near)))
        x[row, np.repeat(few, many[near[few]])] = 1
        for k in wide:
            x[:, k] = self.has[hot[k], rows]
        g = x.T @ x
        g[np.ix_(wide, wide)] = self.both[np.ix_(hot[wide], hot[wide])]
        return g


@dataclass
class SLIMConfig:
    l1_reg: float = 1.0
    l2_reg: float = 1.0
    max_iters: int = 100
    max_nbrs: int | None = None


class SLIMScorer(_Weights):
    """Non-negative elastic net for every item by coordinate descent on its neighbours' Gram matrix.

    An item's task holds the Gram of its neighbours: the max_nbrs nearest by cosine, or without max_nbrs all
    items it occurs with. With max_nbrs all this is found from held cells, unless the log is too large for them.
    """

    config_class = SLIMConfig

    def fit(self, log: DataFrame, options: TrainingOptions) -> None:
        cfg = self.config
        d = cut(known_pairs(log).select("user_id", "item_id").distinct(), "history")
        n = d.groupBy("item_id").agg(F.count("*").alias("n"))
        self.tables |= {"history": d, "items": n.select("item_id")}
        held = held_path(d) if cfg.max_nbrs and cfg.l1_reg >= 0 else None
        if held:
            kind = dict(d.dtypes)["item_id"]
            self.tables["weights"] = cut(over_keys(d.select("item_id"), f"ref {kind}, item_id {kind}, w double", lambda cells: SLIMHeld(cells, cfg), held), "weights")
            return
        g = cut(cooccurrence(d, "user_id", "item_id", True).select(F.col("item_a").alias("j"), F.col("item_b").alias("k"), F.col("n").cast("double").alias("g")), "gram")
        near = g.where("j <> k").select(F.col("j").alias("i"), F.col("k").alias("j"), F.col("g").alias("b"))
        if cfg.max_nbrs:
            sizes = n.select(F.col("item_id").alias("j"), F.col("n").alias("nj"))
            w = Window.partitionBy("i").orderBy(F.desc(F.col("b") / F.sqrt(F.col("nj"))), "j")
            near = near.join(sizes, "j").withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= cfg.max_nbrs).select("i", "j", "b")
        near = cut(near, "near")
        pairs = near.join(g, "j").join(near.select("i", F.col("j").alias("k")), ["i", "k"]).select("i", "j", "k", "b", "g")
        kind = dict(d.dtypes)["item_id"]

        def solve(pdf: pd.DataFrame) -> pd.DataFrame:
            ids = np.sort(pdf["j"].unique())
            a, b = np.zeros((len(ids), len(ids))), np.zeros(len(ids))
            j, k = np.searchsorted(ids, pdf["j"]), np.searchsorted(ids, pdf["k"])
            a[j, k] = pdf["g"]
            b[j] = pdf["b"]
            x, ax = np.zeros(len(ids)), np.zeros(len(ids))
            for _ in range(cfg.max_iters):
                most = 0.0
                for m in range(len(ids)):
                    new = max(0.0, b[m] - (ax[m] - a[m, m] * x[m]) - cfg.l1_reg) / (a[m, m] + cfg.l2_reg)
                    if new != x[m]:
                        most = max(most, abs(new - x[m]))
                        ax += a[:, m] * (new - x[m])
                        x[m] = new
                if most <= 1e-3:
                    break
            keep = x >= 1e-12
            return pd.DataFrame({"ref": ids[keep], "item_id": pdf["i"].iloc[0], "w": x[keep]})

        self.tables["weights"] = cut(pairs.groupBy("i").applyInPandas(solve, f"ref {kind}, item_id {kind}, w double"), "weights")
