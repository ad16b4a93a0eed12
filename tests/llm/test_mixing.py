import numpy as np
import pytest

from recmill.llm.mixing import _stepped, fit_known, mix


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(6)
    words = {s: [f"{s}word{i}" for i in range(40)] for s in "abc"}
    text = lambda s, n: " ".join(rng.choice(words[s], n))
    rows = [(i, text(s, int(rng.integers(20, 80))), s) for i, s in enumerate("a" * 200 + "b" * 120 + "c" * 40)] + [(1_000 + i, text("c", 60), None) for i in range(20)] + [(2_000 + i, text("a", 50), "aa") for i in range(10)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_rates_and_copies(spark, corpus):
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.3, 2), ("c", 0.4, 2)], "source string, weight double, max_repeats int")
    m = mix(corpus, targets)
    got = {r["source"]: r for r in m.sources.collect()}
    assert all(r["converged"] for r in got.values())
    assert [got[s]["falls_short"] for s in "abc"] == [False, False, True]
    assert got["c"]["rate"] == 2 and got["a"]["expected"] == pytest.approx(got["a"]["target"], rel=1e-3)
    # documents without a source go to the one that they read like, and fill what is missing there
    assert got["c"]["soft_size"] > got["c"]["size"] and got["c"]["expected"] > 2 * got["c"]["size"]
    docs = {r["doc_id"]: r for r in m.documents.collect()}
    assert all(docs[1_000 + i]["rate"] > 1.5 for i in range(20))
    # what the report says was reached are the tokens of the copies
    assert sum(r["reached"] for r in got.values()) == pytest.approx(sum(r["tokens"] * r["copies"] for r in docs.values()), rel=1e-6)
    assert sum(r["share"] for r in got.values()) == pytest.approx(1)


def test_shortfall_of_known_sources():
    """Fitted rates leave a source short just where its cap does; at the cap exactly it is not short."""
    rng = np.random.default_rng(1)
    size, caps = rng.integers(0, 1_000, 300).astype(float), rng.integers(0, 5, 300).astype(float)
    target = rng.uniform(0, 3_000, 300)
    target[:50] = caps[:50] * size[:50]
    rate = fit_known(size, target, caps)
    assert ((rate * size < target * (1 - 1e-9)) == (caps * size < target * (1 - 1e-9))).all() and (rate <= caps).all()
    assert (np.minimum(1.0, caps) * size < target * (1 - 1e-9)).sum() > (caps * size < target * (1 - 1e-9)).sum()  # rates that are not fitted say otherwise


def test_steps_reach_the_least_squares(spark):
    """Projected gradient steps end where no feasible change of a rate lowers the squared residuals."""
    rng = np.random.default_rng(0)
    member = rng.dirichlet([0.3] * 3, 60)
    tokens, caps = rng.integers(10, 100, 60), np.array([1.0, 2.0, 3.0])
    target = np.array([0.2, 0.2, 0.6]) * tokens.sum() * 1.5
    size = tokens @ member
    rate = np.minimum(1.0, member @ caps)
    for _ in range(4_000):
        rate = _stepped(member, rate, caps, [((rate * tokens) @ member - target) / size])
    slope = member @ (((rate * tokens) @ member - target) / size)
    low, high = rate <= 1e-9, rate >= member @ caps - 1e-9
    assert (slope[low] >= -1e-4).all() and (slope[high] <= 1e-4).all() and np.abs(slope[~low & ~high]).max(initial=0) < 1e-3
