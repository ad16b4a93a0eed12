import numpy as np
import pytest

from recmill.llm import nearest as nr


@pytest.fixture(scope="module")
def clustered(spark):
    """Loose clusters, some crowded ones, and vectors without near neighbours."""
    rng = np.random.default_rng(11)
    centres = rng.standard_normal((120, 48))
    v = np.concatenate([centres[rng.integers(0, 120, 5_000)] + 0.45 * rng.standard_normal((5_000, 48)), centres[:4].repeat(200, 0) + 0.01 * rng.standard_normal((800, 48)), rng.standard_normal((400, 48))]).astype(np.float32)
    v *= rng.uniform(0.2, 4, (len(v), 1)).astype(np.float32)
    rows = [("a", i, [float(x) for x in r]) for i, r in enumerate(v)]
    return v, spark.createDataFrame(rows, "kind string, id int, vec array<float>").repartition(6)


def _truth(v, probes, k):
    u = v.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = np.round(u[probes] @ u.T, 6)
    s[np.arange(len(probes)), probes] = -9
    return {(int(p), int(i)) for p, r in zip(probes, s, strict=True) for i in np.lexsort((np.arange(len(u)), -r))[:k]}


@pytest.mark.parametrize("rows", [50_000, 700])
def test_recall_across_ranges(spark, monkeypatch, clustered, rows):
    """Windows far smaller than the table, with and without bounds of ranges between neighbours."""
    monkeypatch.setattr(nr, "RANGE_ROWS", rows)
    monkeypatch.setattr(nr, "WINDOW", 100)
    monkeypatch.setattr(nr, "SAMPLE", 2_000)
    v, df = clustered
    probes = np.arange(0, len(v), 31)
    got = {(r["probe"], r["id"]) for r in nr.nearest(df, df.where("id % 31 = 0").select("kind", "id")).collect()}
    want = _truth(v, probes, 10)
    assert len(got) == len(want) and len(got & want) >= 0.9 * len(want)


def test_curve_is_continuous():
    """Consecutive keys of a Hilbert curve lie in neighbouring cells."""
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    order = cells[np.argsort(nr.hilbert_key(cells, 3))]
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()
