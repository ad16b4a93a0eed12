"""Trained models against what defines them, computed with NumPy on small logs."""

import numpy as np
import pytest

from recmill.models.als import BiasedMFScorer, ImplicitMFScorer
from recmill.models.basic import BiasScorer
from recmill.models.factor import BiasedSVDScorer, BPRScorer, FlexMFExplicitScorer, FunkSVDScorer, HPFScorer, LightGCNScorer, NMFScorer
from recmill.models.linear import EASEScorer, SLIMScorer
from recmill.operators.lists import ListCollection

U, I = 40, 18


@pytest.fixture(scope="module")
def cells():
    rng = np.random.default_rng(17)
    p, q = rng.standard_normal((U, 2)), rng.standard_normal((I, 2))
    return [(u, i, float(np.clip(3 + 0.9 * p[u] @ q[i] + rng.normal(0, 0.2), 0.5, 5))) for u in range(U) for i in range(I) if rng.random() < 0.55]


@pytest.fixture(scope="module")
def log(spark, cells):
    return spark.createDataFrame(cells, "user_id int, item_id int, rating double")


@pytest.fixture(scope="module")
def matrix(cells):
    x = np.zeros((U, I))
    for u, i, _ in cells:
        x[u, i] = 1
    return x


def _weights(scorer):
    w = np.zeros((I, I))
    for r in scorer.tables["weights"].collect():
        w[r["ref"], r["item_id"]] = r["w"]
    return w


def _vectors(scorer, side, n):
    out = np.full((n, scorer.config.embedding_size), np.nan)
    for r in scorer.tables[side].collect():
        out[r[f"{side}_id"]] = r["vec"]
    return out


def test_ease(log, matrix):
    p = np.linalg.inv(matrix.T @ matrix + 2.5 * np.eye(I))
    want = -p / np.diag(p)[None, :]
    np.fill_diagonal(want, 0)
    assert _weights(EASEScorer(regularization=2.5).train(log)) == pytest.approx(want, abs=1e-9)


def test_slim_meets_its_conditions(log, matrix):
    """Where a weight is positive the gradient is zero, elsewhere it is not negative."""
    s = SLIMScorer(l1_reg=1.0, l2_reg=2.0, max_iters=2_000).train(log)
    w, g = _weights(s), matrix.T @ matrix
    slope = g @ w - g + 2.0 * w + 1.0
    off = ~np.eye(I, dtype=bool)
    assert (w[~off] == 0).all() and (w >= 0).all() and (w > 0).sum() > I
    assert np.abs(slope[off & (w > 0)]).max() < 0.15 and slope[off & (w == 0)].min() > -0.15


@pytest.mark.parametrize("make", [lambda: BiasedMFScorer(embedding_size=3, epochs=2, regularization=0.2), lambda: ImplicitMFScorer(embedding_size=3, epochs=2, regularization=0.2, weight=20.0)])
def test_als_normal_equations(log, cells, make):
    """The side that was solved last satisfies its normal equations."""
    s = make().train(log)
    p, q = _vectors(s, "user", U), _vectors(s, "item", I)
    if isinstance(s, ImplicitMFScorer):
        rows, base, grow = [(u, i, 20.0, 21.0) for u, i, _ in cells], p.T @ p, False
    else:
        bias = {(r["user_id"], r["item_id"]): r["r"] for r in s.bias.residuals(log).collect()}
        rows, base, grow = [(u, i, 1.0, bias[u, i]) for u, i, _ in cells], np.zeros((3, 3)), True
    for item in range(I):
        mine = [(p[u], w, y) for u, i, w, y in rows if i == item]
        a = base + sum(w * np.outer(x, x) for x, w, _ in mine) + 0.2 * (len(mine) if grow else 1) * np.eye(3)
        assert a @ q[item] == pytest.approx(sum(y * x for x, _, y in mine), abs=1e-8)


def test_epochs(log):
    s, seen = ImplicitMFScorer(embedding_size=3, epochs=4), []
    for record in s.train_epochs(log):
        seen.append((record["epoch"], record["item_change"], s.score(log.limit(1)).first()["score"]))
    assert [x[0] for x in seen] == [1, 2, 3, 4] and seen[3][1] < seen[1][1] and all(x[2] is not None for x in seen)
    assert [r["epoch"] for r in BiasScorer().train_epochs(log)] == [1]


def test_svd(log, cells):
    s = BiasedSVDScorer(embedding_size=4, damping=5.0).train(log)
    r = np.zeros((U, I))
    for x in BiasScorer(damping=5.0).train(log).residuals(log).collect():
        r[x["user_id"], x["item_id"]] = x["r"]
    u, d, vt = np.linalg.svd(r)
    assert _vectors(s, "user", U) @ _vectors(s, "item", I).T == pytest.approx((u[:, :4] * d[:4]) @ vt[:4], abs=1e-4)


def test_nmf_and_hpf(log, matrix):
    s = NMFScorer(embedding_size=5, max_iter=400).train(log)
    w, h = _vectors(s, "user", U), _vectors(s, "item", I)
    assert (w >= 0).all() and (h >= 0).all()
    off = np.linalg.norm(matrix - w @ h.T)
    best = np.sqrt((np.linalg.svd(matrix, compute_uv=False)[5:] ** 2).sum())  # of any factors, also negative ones
    assert best <= off < 1.25 * best
    p = HPFScorer(embedding_size=5, max_iter=30).train(log)
    m = _vectors(p, "user", U) @ _vectors(p, "item", I).T
    assert m[matrix == 1].mean() > 1.2 * m[matrix == 0].mean()


def test_gradient_models_learn(log, cells, matrix):
    rated = np.array([r for _, _, r in cells])
    bias = BiasScorer(damping=5.0).train(log)
    rmse = lambda s: np.sqrt(np.mean([(r["score"] - r["rating"]) ** 2 for r in s.score(log).collect()]))
    plain = rmse(bias)
    assert plain < rated.std()
    assert rmse(FunkSVDScorer(embedding_size=3, epochs=150, learning_rate=0.01).train(log)) < 0.8 * plain
    assert rmse(FlexMFExplicitScorer(embedding_size=4, epochs=60, batch_size=64).train(log)) < plain
    for s in (BPRScorer(embedding_size=8, epochs=60, batch_size=64), LightGCNScorer(embedding_size=8, epochs=60)):
        s.train(log)
        got = np.zeros((U, I))
        every = log.select("user_id").distinct().crossJoin(log.select("item_id").distinct())
        for r in s.score(every).collect():
            got[r["user_id"], r["item_id"]] = r["score"]
        auc = np.mean([(got[u][matrix[u] == 1][:, None] > got[u][matrix[u] == 0][None, :]).mean() for u in range(U) if 0 < matrix[u].sum() < I])
        assert auc > 0.7


def test_list_collections(spark):
    c = ListCollection.from_dict(spark, {k: list(range(k % 5)) for k in range(1, 60)}, ["user_id"])
    batches = list(c.record_batches(25))
    assert [b.num_rows for b in batches] == [25, 25, 9]
    again = ListCollection.from_arrow(spark, c.to_arrow())
    assert len(again) == 59 and sorted(map(tuple, again.rows.select("user_id", "item_id", "rank").collect())) == sorted(map(tuple, c.rows.select("user_id", "item_id", "rank").collect()))
    few = c.sample(20, 3)
    assert len(few) == 20 and len(few.keys) == 2 and few.total_items() == c.sample(20, 3).total_items() and c.sample(99) is c
    with pytest.warns(UserWarning):
        assert c.columns_or_null(["item_id", "score"]).where("score is null").count() == c.total_items()
