"""Factor models that are trained in one task with NumPy, for logs whose size is checked first.

Stochastic gradient, NMF, SVD and Poisson factorisation are sequential by nature or need the whole matrix;
``MAX_CELLS`` bounds what is brought to the task. Larger logs are refused: ALS covers them. Nothing of the data
or of the model passes through the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recmill.models.als import dot
from recmill.models.base import Scorer, TrainingOptions, float_score, known_pairs
from recmill.models.basic import _damping
from recmill.session import cut, drop_cut

MAX_CELLS = 20_000_000
#: Rows of vectors in a batch that the training task hands out.
VECTOR_ROWS = 10_000
#: Cells that Poisson factorisation shares out at once.
CELL_ROWS = 500_000


def _codes(ids: list, kind) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct ids and, as int32, each row's place among them."""
    names, at = np.unique(pa.chunked_array(ids, kind).to_numpy(), return_inverse=True)
    return names, at.astype(np.int32)


def trained_in_task(learn: Callable, values: Sequence[str] = ("r",)) -> Callable:
    """For mapInArrow over all cells (user_id, item_id, r) in one task: the rows that ``_Factors._fit_cells`` reads.

    ``learn(u, i, r, m, n)`` gets the cells in the order of (user, item), numbered, and gives the vectors and biases (or
    None) of the m users and n items, and the base. Other ``values`` than r come in their order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us, its, rs = [], [], [[] for _ in values]
        for b in batches:
            us.append(b.column("user_id")), its.append(b.column("item_id"))
            for x, v in zip(rs, values, strict=True):
                x.append(b.column(v).to_numpy(zero_copy_only=False))
        if not us:
            return
        kinds = us[0].type, its[0].type
        vals = [np.concatenate(x) for x in rs]
        (users, u), (items, i) = _codes(us, kinds[0]), _codes(its, kinds[1])
        del us, its, rs
        order = np.lexsort((i, u))
        u, i, vals = u[order], i[order], [x[order] for x in vals]
        del order
        p, q, bu, bi, base = learn(u, i, *vals, len(users), len(items))
        for side, ids, vec, add in ((0, users, p, bu), (1, items, q, bi)):
            for a in range(0, len(ids), VECTOR_ROWS):
                part, v = ids[a : a + VECTOR_ROWS], np.ascontiguousarray(vec[a : a + VECTOR_ROWS], float)
                none = [pa.array(part, kinds[side]) if s == side else pa.nulls(len(part), kinds[s]) for s in (0, 1)]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * v.shape[1]), pa.array(v.ravel()))
                b = pa.array(np.zeros(len(part)) if add is None else add[a : a + VECTOR_ROWS].astype(float))
                yield pa.RecordBatch.from_arrays([*none, lists, b, pa.array(np.full(len(part), float(base)))], names=["user_id", "item_id", "vec", "b", "base"])

    return run


class _Factors(Scorer):
    """score = base + user bias + item bias + u . v"""

    aliases = {"features": "embedding_size", "n_components": "embedding_size"}
    #: The base without any cells.
    none_base: float | None = 0.0

    def _cells(self, log: DataFrame, rated: bool = False) -> DataFrame:
        rows = known_pairs(log, rated)
        value = F.avg(F.col("rating").cast("double")) if rated else F.lit(1.0)
        return rows.groupBy("user_id", "item_id").agg(value.alias("r"))

    def _fit_cells(self, cells: DataFrame, learn: Callable, values: Sequence[str] = ("r",)) -> None:
        """Train in one task of an executor, so that neither cells nor vectors pass through the driver."""
        cells = cut(cells.select("user_id", "item_id", *[F.col(v).cast("double").alias(v) for v in values]), "cells")
        if cells.count() > MAX_CELLS:
            raise ValueError(f"more than {MAX_CELLS} cells: this model is trained in one place, use ALS")
        kinds = dict(cells.dtypes)
        made = cut(cells.coalesce(1).mapInArrow(trained_in_task(learn, values), f"user_id {kinds['user_id']}, item_id {kinds['item_id']}, vec array<double>, b double, base double"), "vectors")
        drop_cut(cells)
        base = made.select("base").first()
        self.base_score = base[0] if base else self.none_base
        self.tables = {side: made.where(F.col(f"{side}_id").isNotNull()).select(f"{side}_id", "vec", "b") for side in ("user", "item")}

    def _beside(self, pairs: DataFrame) -> DataFrame:
        """The pairs with both sides' vectors and biases, null where unknown."""
        u = self.tables["user"].withColumnsRenamed({"vec": "_u", "b": "_bu"})
        i = self.tables["item"].withColumnsRenamed({"vec": "_v", "b": "_bi"})
        return pairs.join(u, "user_id", "left").join(i, "item_id", "left")

    def score(self, pairs: DataFrame, history: DataFrame | None = None) -> DataFrame:
        return float_score(self._beside(pairs).withColumn("score", dot("_u", "_v") + F.col("_bu") + F.col("_bi") + self.base_score).select(*pairs.columns, "score"))


class _OnBias(_Factors):
    """Factors of what the biases (as in ``BiasScorer``) leave; these are found in the task that trains, from the cells
    and how many ratings each stands for. Unknown users or items have no bias and no factors."""

    none_base = None

    def _fit_residuals(self, log: DataFrame, learn: Callable) -> None:
        damping = {side: _damping(self.config.damping, side) for side in ("user", "item")}

        def offset(at, left, many, size, damp):
            n = np.bincount(at, many, size) + damp
            return np.divide(np.bincount(at, left * many, size), n, out=np.zeros(size), where=n != 0)

        def on_bias(u, i, r, many, m, n):
            base = np.average(r, weights=many)
            left = r - base
            bi = offset(i, left, many, n, damping["item"])
            left -= bi[i]
            bu = offset(u, left, many, m, damping["user"])
            left -= bu[u]
            p, q, *_ = learn(u, i, left, m, n)
            return p, q, bu, bi, base

        cells = known_pairs(log, True).groupBy("user_id", "item_id").agg(F.avg(F.col("rating").cast("double")).alias("r"), F.count("*").cast("double").alias("many"))
        self._fit_cells(cells, on_bias, ("r", "many"))

    def score(self, pairs: DataFrame, history: DataFrame | None = None) -> DataFrame:
        out = self._beside(pairs)
        part = F.coalesce(dot("_u", "_v").cast("float").cast("double"), F.lit(0.0))
        total = F.lit(self.base_score).cast("double") + F.coalesce("_bi", F.lit(0.0)) + F.coalesce("_bu", F.lit(0.0)) + part
        return float_score(out.withColumn("score", total).select(*pairs.columns, "score"))


@dataclass
class FunkSVDConfig:
    embedding_size: int = 64
    epochs: int = 100
    learning_rate: float = 0.001
    regularization: float = 0.015
    damping: float = 5.0
    range: tuple | None = None


class FunkSVDScorer(_OnBias):
    """One feature after the other by stochastic gradient in blocks of a shuffled order; later features start from
    what the earlier ones leave, their own remainder being estimated by the start values."""

    config_class = FunkSVDConfig

    def fit(self, log: DataFrame, options: TrainingOptions) -> None:
        c, seed = self.config, options.seed

        def learn(u, i, r, m, n):
            rng = np.random.default_rng(seed)
            p, q = np.full((m, c.embedding_size), 0.1), np.full((n, c.embedding_size), 0.1)
            done = np.zeros(len(r))
            for f in range(c.embedding_size):
                trail = (c.embedding_size - f - 1) * 0.01
                x, y = p[:, f].copy(), q[:, f].copy()
                for _ in range(c.epochs):
                    for block in np.array_split(rng.permutation(len(r)), max(1, len(r) // 1000)):
                        uu, ii = u[block], i[block]
                        err = r[block] - done[block] - x[uu] * y[ii] - trail
                        du = c.learning_rate * (err * y[ii] - c.regularization * x[uu])
                        di = c.learning_rate * (err * x[uu] - c.regularization * y[ii])
                        np.add.at(x, uu, du)
                        np.add.at(y, ii, di)
                p[:, f], q[:, f] = x, y
                done += x[u] * y[i]
            return p, q, None, None, 0.0

        self._fit_residuals(log, learn)

    def score(self, pairs: DataFrame, history: DataFrame | None = None) -> DataFrame:
        out = super().score(pairs, history)
        if self.config.range:
            out = out.withColumn("score", F.greatest(F.least("score", F.lit(float(self.config.range[1])).cast("float")), F.lit(float(self.config.range[0])).cast("float")))
        return out


@dataclass
class BiasedSVDConfig:
    embedding_size: int = 64
    damping: float = 5.0
    algorithm: str = "randomized"
    n_iter: int = 5


def _times(u, i, r, x, n):
    """Sparse matrix (u, i, r) with n rows, times x."""
    return np.stack([np.bincount(u, weights=r * x[i, c], minlength=n) for c in range(x.shape[1])], 1)


class BiasedSVDScorer(_OnBias):
    """Truncated SVD of the bias residuals, missing cells being 0, by randomised subspace iteration."""

    config_class = BiasedSVDConfig

    def fit(self, log: DataFrame, options: TrainingOptions) -> None:
        c, seed = self.config, options.seed

        def learn(u, i, r, m, n):
            k = min(c.embedding_size, m, n)
            rng = np.random.default_rng(seed)
            y = _times(u, i, r, rng.standard_normal((n, min(k + 10, m, n))), m)
            for _ in range(c.n_iter):
                y = _times(u, i, r, np.linalg.qr(_times(i, u, r, np.linalg.qr(y)[0], n))[0], m)
            base = np.linalg.qr(y)[0]
            w, s, vt = np.linalg.svd(_times(i, u, r, base, n).T, full_matrices=False)
            return (base @ w[:, :k]) * s[:k], vt[:k].T, None, None, 0.0

        self._fit_residuals(log, learn)


@dataclass
class NMFConfig:
    beta_loss: str = "frobenius"
    max_iter: int = 200
    embedding_size: int = 64
    alpha_W: float = 0.0
    alpha_H: Any = "same"
    l1_ratio: float = 0.0
    method: str = "full"


class NMFScorer(_Factors):
    """Non-negative factors of the 0/1 matrix by multiplicative updates."""

    config_class = NMFConfig

    def fit(self, log: DataFrame, options: TrainingOptions) -> None:
        c = self.config
        if c.beta_loss != "frobenius" or c.method != "full":
            raise NotImplementedError("beta_loss must be frobenius and method full")
        seed = options.seed

        def learn(u, i, r, m, n):
            rng = np.random.default_rng(seed)
            k = min(c.embedding_size, max(m, 1), max(n, 1))
            level = np.sqrt(len(r) / max(m * n * k, 1))
            w, h = rng.random((m, k)) * 2 * level, rng.random((n, k)) * 2 * level
            aw, ah = c.alpha_W * n, (c.alpha_W if c.alpha_H == "same" else c.alpha_H) * m
            for _ in range(c.max_iter):
                w *= _times(u, i, r, h, m) / np.maximum(w @ (h.T @ h) + aw * (c.l1_ratio + (1 - c.l1_ratio) * w), 1e-12)
                h *= _times(i, u, r, w, n) / np.maximum(h @ (w.T @ w) + ah * (c.l1_ratio + (1 - c.l1_ratio) * h), 1e-12)
            return w, h, None, None, 0.0

        self._fit_cells(self._cells(log), learn)


@dataclass
class HPFConfig:
    count_attribute: str = "count"
    embedding_size: int = 64
    max_iter: int = 50


class HPFScorer(_Factors):
    """Poisson factorisation of counts with gamma priors, by coordinate ascent on the variational parameters."""

    config_class = HPFConfig

    def fit(self, log: DataFrame, options: TrainingOptions) -> None:
        c = self.config
        value = F.sum(F.coalesce(F.col(c.count_attribute), F.lit(1)).cast("double")) if c.count_attribute in log.columns else F.count("*").cast("double")
        seed = options.seed

        def learn(u, i, r, m, n):
            k, rng = c.embedding_size, np.random.default_rng(seed)
            gs, gr = rng.random((m, k)) + 0.3, np.full((m, k), 0.3 + n / max(k, 1) * 0.1)
            ls, lr = rng.random((n, k)) + 0.3, np.full((n, k), 0.3 + m / max(k, 1) * 0.1)
            log_mean = lambda s, q: np.log(np.maximum(s, 1e-9)) - 1 / (2 * np.maximum(s, 0.3)) - np.log(q)
            for _ in range(c.max_iter):
                mu, mi = log_mean(gs, gr), log_mean(ls, lr)
                gs, ls_next = np.full((m, k), 0.3), np.full((n, k), 0.3)
                for a in range(0, len(u), CELL_ROWS):
                    uu, ii = u[a : a + CELL_ROWS], i[a : a + CELL_ROWS]
                    phi = mu[uu] + mi[ii]
                    phi = np.exp(phi - phi.max(1, keepdims=True))
                    phi *= (r[a : a + CELL_ROWS] / phi.sum(1))[:, None]
                    low = uu[0]  # cells are in the order of users
                    for j in range(k):
                        part = np.bincount(uu - low, phi[:, j])
                        gs[low : low + len(part), j] += part
                        ls_next[:, j] += np.bincount(ii, phi[:, j], n)
                gr = 0.3 + (ls / lr).sum(0)[None, :] + np.zeros((m, 1))
                ls = ls_next
                lr = 0.3 + (gs / gr).sum(0)[None, :] + np.zeros((n, 1))
            return gs / gr, ls / lr, None, None, 0.0

        self._fit_cells(known_pairs(log).groupBy("user_id", "item_id").agg(value.alias("r")), learn)


# -- mini-batch gradient models


@dataclass
class FlexMFConfig:
    embedding_size: int = 64
    batch_size: int = 8192
    learning_rate: float = 0.01
    epochs: int = 10
    regularization: float = 0.01
    reg_method: str = "AdamW"


@dataclass
class FlexMFExplicitConfig(FlexMFConfig):
    regularization: float = 0.1
    reg_method: str = "L2"


@dataclass
class FlexMFImplicitConfig(FlexMFConfig):
    preset: str | None = None
    loss: str = "logistic"
    negative_strategy: str | None = None
    negative_count: int = 1
    positive_weight: float = 1.0
    user_bias: bool | None = None
    item_bias: bool = True
    convolution_layers: int = 0

    def __post_init__(self):
        for k, v in {"bpr": {"loss": "pairwise"}, "warp": {"loss": "warp", "negative_strategy": "misranked"}, "lightgcn": {"loss": "pairwise", "convolution_layers": 2, "item_bias": False}, None: {}}[self.preset].items():
            setattr(self, k, v)
        if self.negative_strategy == "misranked" and self.negative_count != 1:
            raise ValueError("misranked negatives need a single negative")


#: Numbers of a parameter that are stepped together, few enough to stay in a core's cache.
STEP_CELLS = 16_384


class Adam:
    """Adam with decoupled weight decay over a dict of arrays. A gradient is an array or (rows, their values), the
    other rows being 0; ``l2`` adds that share of each parameter, divided by its length, to the gradient."""

    def __init__(self, params: dict[str, np.ndarray], rate: float, decay: float, l2: float = 0.0):
        self.p, self.rate, self.decay, self.l2, self.t = params, rate, decay, l2, 0
        self.m, self.v = {k: np.zeros_like(x) for k, x in params.items()}, {k: np.zeros_like(x) for k, x in params.items()}

    def step(self, grads: dict) -> None:
        self.t += 1
        c1, c2 = 1 / (1 - 0.9**self.t), 1 / (1 - 0.999**self.t)
        for k, g in grads.items():
            p, m, v = self.p[k], self.m[k], self.v[k]
            at, rows = g if isinstance(g, tuple) else (None, g)
            size = max(1, STEP_CELLS // int(np.prod(p.shape[1:], dtype=int)))
            for a in range(0, len(p), size):
                x, mm, vv = p[a : a + size], m[a : a + size], v[a : a + size]
                mm *= 0.9
                vv *= 0.999
                lo, hi = np.searchsorted(at, (a, a + size)) if at is not None else (0, 0)
                if at is None or self.l2:
                    d = rows[a : a + size].copy() if at is None else np.zeros_like(x)
                    if at is not None:
                        d[at[lo:hi] - a] += rows[lo:hi]
                    if self.l2:
                        d += x * (self.l2 / max(len(p), 1))
                    mm += 0.1 * d
                    d *= d
                    d *= 0.001
                    vv += d
                elif hi > lo:
                    mm[at[lo:hi] - a] += 0.1 * rows[lo:hi]
                    vv[at[lo:hi] - a] += 0.001 * rows[lo:hi] ** 2
                d = vv * c2
                np.sqrt(d, out=d)
                d += 1e-8
                np.divide(mm, d, out=d)
                d *= self.rate * c1
                if self.decay:
                    x *= 1 - self.rate * self.decay
                x -= d


def _summed(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct ``at`` and the sums of their rows."""
    some, place = np.unique(at, return_inverse=True)
    if rows.ndim == 1:
        return some, np.bincount(place, rows, len(some))
    return some, np.stack([np.bincount(place, rows[:, j], len(some)) for j in range(rows.shape[1])], 1)


class Graph:
    """The 0/1 matrix of cells between m users and n items, symmetrically normalised, times vectors.

    Rows are taken by falling degree. The k-th neighbours of all rows that have so many are one gather and one sum of
    slices; what the rows above ``WIDE`` neighbours have is summed row by row.
    """

    WIDE = 64

    def __init__(self, u: np.ndarray, i: np.ndarray, m: int, n: int):
        self.at_u, self.at_i = (1 / np.sqrt(np.maximum(np.bincount(x, minlength=k), 1))[:, None] for x, k in ((u, m), (i, n)))
        self.of_u, self.of_i = self._rows(u, i, m), self._rows(i, u, n)

    def _rows(self, key, other, size):
        count = np.bincount(key, minlength=size)
        sorted_other = other[np.argsort(key, kind="stable")]
        start = np.cumsum(count) - count
        order = np.argsort(-count, kind="stable")
        wide = [(r, sorted_other[start[r] : start[r] + count[r]]) for r in order[: np.count_nonzero(count > self.WIDE)]]
        rest = order[len(wide) :]
        turns, k = [], 0
        while (many := np.count_nonzero(count[rest] > k)) > 0:
            turns.append(sorted_other[start[rest[:many]] + k])
            k += 1
        return size, wide, rest, turns

    @staticmethod
    def sums(rows, x):
        """Each row's sum over its neighbours in x."""
        size, wide, rest, turns = rows
        held = np.zeros((len(rest), x.shape[1]), x.dtype)
        for turn in turns:
            held[: len(turn)] += x.take(turn, 0)
        out = np.empty((size, x.shape[1]), x.dtype)
        out[rest] = held
        for r, at in wide:
            out[r] = np.ones(len(at), x.dtype) @ x.take(at, 0)
        return out

    def spread(self, p, q, layers: int):
        """The mean over 0 to ``layers`` rounds of propagation."""
        ps, qs, sp, sq = p, q, p, q
        for _ in range(layers):
            ps, qs = self.at_u * self.sums(self.of_u, self.at_i * qs), self.at_i * self.sums(self.of_i, self.at_u * ps)
            sp, sq = sp + ps, sq + qs
        return sp / (layers + 1), sq / (layers + 1)


def _start(c, seed: int, m: int, n: int):
    rng = np.random.default_rng(seed)
    params = {"p": rng.standard_normal((m, c.embedding_size)) * 0.1, "q": rng.standard_normal((n, c.embedding_size)) * 0.1, "bu": np.zeros(m), "bi": np.zeros(n)}
    return rng, params, Adam(params, c.learning_rate, c.regularization if c.reg_method == "AdamW" else 0.0, c.regularization if c.reg_method == "L2" else 0.0)


class FlexMFExplicitScorer(_Factors):
    """Ratings: global mean, biases and factors under squared loss."""

    config_class = FlexMFExplicitConfig

    def fit(self, log: DataFrame, options: TrainingOptions) -> None:
        c, seed = self.config, options.seed

        def learn(u, i, r, m, n):
            mean = r.mean() if len(r) else 0.0
            rng, x, opt = _start(c, seed, m, n)
            for _ in range(c.epochs):
                for b in np.array_split(rng.permutation(len(r)), max(1, -(-len(r) // c.batch_size))):
                    uu, ii = u[b], i[b]
                    e = 2 * (mean + x["bu"][uu] + x["bi"][ii] + (x["p"][uu] * x["q"][ii]).sum(1) - r[b]) / max(len(b), 1)
                    opt.step({"p": _summed(uu, e[:, None] * x["q"][ii]), "q": _summed(ii, e[:, None] * x["p"][uu]), "bu": _summed(uu, e), "bi": _summed(ii, e)})
            return x["p"], x["q"], x["bu"], x["bi"], mean

        self._fit_cells(self._cells(log, True), learn)


class FlexMFImplicitScorer(_Factors):
    """Observed pairs against sampled negatives under logistic, pairwise or WARP loss, optionally with factors
    spread over the user-item graph (mean over layers of symmetric-normalised propagation)."""

    config_class = FlexMFImplicitConfig

    def fit(self, log: DataFrame, options: TrainingOptions) -> None:
        c, seed = self.config, options.seed
        self._fit_cells(self._cells(log), lambda u, i, r, m, n: _learn_implicit(c, seed, u, i, m, n))


def _learn_implicit(c: FlexMFImplicitConfig, seed: int, u: np.ndarray, i: np.ndarray, m: int, n: int):
    rng, x, opt = _start(c, seed, m, n)
    graph = Graph(u, i, m, n) if c.convolution_layers else None
    observed = u.astype(np.int64) * n + i  # sorted, as the cells are
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def known(uu, jj):
        code = uu.astype(np.int64) * n + jj
        at = np.minimum(np.searchsorted(observed, code), len(observed) - 1)
        return observed[at] == code

    def negatives(uu):
        j = rng.integers(0, n, len(uu))
        for _ in range(10):
            bad = known(uu, j)
            if not bad.any():
                break
            j[bad] = rng.integers(0, n, bad.sum())
        return j

    for _ in range(c.epochs):
        for b in np.array_split(rng.permutation(len(u)), max(1, -(-len(u) // c.batch_size))):
            uu, ii = u[b], i[b]
            P, Q = graph.spread(x["p"], x["q"], c.convolution_layers) if graph else (x["p"], x["q"])
            value = lambda a, k: (P[a] * Q[k]).sum(1) + (x["bi"][k] if c.item_bias else 0.0)  # noqa: B023, E731
            pos = value(uu, ii)
            pushed = []

            def push(a, k, g):
                pushed.append((a, k, g, g[:, None] * Q[k], g[:, None] * P[a]))  # noqa: B023

            for _ in range(c.negative_count):
                j, tries = negatives(uu), np.ones(len(b))
                neg = value(uu, j)
                if c.loss == "warp":
                    for t in range(2, 21):
                        low = neg < pos
                        if not low.any():
                            break
                        other = negatives(uu[low])
                        better = value(uu[low], other)
                        better_than = better > neg[low]
                        at = np.flatnonzero(low)
                        j[at[better_than]], neg[at[better_than]] = other[better_than], better[better_than]
                        tries[at] = t
                    rank = np.maximum((n - 1) / tries, 1)
                    weight = (np.log(rank) + 0.5772) * (neg > pos - 1) / max(np.log(max(n, 3)), 1)
                    g = -sig(neg - pos) * weight / len(b)
                    push(uu, ii, g)
                    push(uu, j, -g)
                elif c.loss == "pairwise":
                    g = -sig(neg - pos) / len(b)
                    push(uu, ii, g)
                    push(uu, j, -g)
                else:
                    push(uu, ii, -c.positive_weight * sig(-pos) / len(b) / c.negative_count)
                    push(uu, j, sig(neg) / len(b) / c.negative_count)
            users, items, g, gp, gq = (np.concatenate(z) for z in zip(*pushed, strict=True))
            grads = {"p": _summed(users, gp), "q": _summed(items, gq), **({"bi": _summed(items, g)} if c.item_bias else {})}
            if graph:
                # the propagation is symmetric, so gradients go back through it the same way
                full = {k: np.zeros_like(x[k]) for k in ("p", "q")}
                for k, d in full.items():
                    d[grads[k][0]] = grads[k][1]
                grads["p"], grads["q"] = graph.spread(full["p"], full["q"], c.convolution_layers)
            opt.step(grads)
    P, Q = graph.spread(x["p"], x["q"], c.convolution_layers) if graph else (x["p"], x["q"])
    return P, Q, None, x["bi"] if c.item_bias else None, 0.0


@dataclass
class LightGCNConfig:
    embedding_size: int = 16
    layer_count: int = 2
    batch_size: int = 4096
    learning_rate: float = 0.01
    epochs: int = 10
    regularization: float = 0.01
    loss: str = "pairwise"


class LightGCNScorer(FlexMFImplicitScorer):
    config_class = LightGCNConfig

    def fit(self, log: DataFrame, options: TrainingOptions) -> None:
        own = self.config
        self.config = FlexMFImplicitConfig(own.embedding_size, own.batch_size, own.learning_rate, own.epochs, own.regularization, "AdamW", loss=own.loss, item_bias=False, convolution_layers=own.layer_count)
        try:
            super().fit(log, options)
        finally:
            self.config = own


class BPRScorer(FlexMFImplicitScorer):
    """Pairwise loss with uniform negatives."""

    def __init__(self, config=None, **kw):
        super().__init__(config, **({"preset": "bpr"} | kw))
