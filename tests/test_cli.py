"""The command line end to end, and hyperparameter search."""

import json
import math
import random

import pytest

from recmill.cli import main
from recmill.models.knn import ItemKNNScorer
from recmill.plans.pipeline import topn_builder
from recmill.plans.tuning import PipelineTuner, PlateauStopRule, SearchParam, median_prune, parzen_proposal


def test_command_line(spark, tmp_path, capsys):
    root = ["--root", str(tmp_path)]
    (tmp_path / "ml").mkdir()
    (tmp_path / "ml" / "ratings.csv").write_text("userId,movieId,rating,timestamp\n" + "".join(f"{u},{i},{(u * i) % 5 + 1},{86400 * (u + i)}\n" for u in range(1, 13) for i in range(1, 16) if (u + 2 * i) % 3))
    data, at = str(tmp_path / "data"), lambda x: str(tmp_path / x)
    (tmp_path / "recmill.toml").write_text(f'[datasets]\ntiny = "{data}"\n')
    assert main([*root, "data", "convert", at("ml"), data]) == 0
    main([*root, "data", "describe", "tiny"])
    assert "120 rows" in capsys.readouterr().out
    main([*root, "data", "split", "--fraction", "0.25", data, at("split")])
    train, test = (spark.read.parquet(at(f"split/{x}.parquet")) for x in ("train", "test"))
    assert train.count() + test.count() == 120 and test.count() >= 30
    main([*root, "data", "split", "--folds", "3", "--test-rows", "2", data, at("folds")])
    assert spark.read.parquet(at("folds/2/test.parquet")).count() == 8
    (tmp_path / "pipe.json").write_text(json.dumps(topn_builder(ItemKNNScorer(feedback="implicit"), 4).build_config()))
    main([*root, "pipeline", "diagram", at("pipe.json")])
    assert capsys.readouterr().out.startswith("flowchart")
    main([*root, "pipeline", "expand", at("pipe.json"), "-o", at("full.json")])
    assert json.loads((tmp_path / "full.json").read_text())["components"]["scorer"]["config"]["max_nbrs"] == 20
    main([*root, "train", "--task-file", at("task.json"), at("pipe.json"), "tiny", at("trained")])
    main([*root, "task", at("task.json")])
    assert "train: finished" in capsys.readouterr().out
    main([*root, "recommend", "-n", "3", at("trained"), "1", "2"])
    got = [line.split("\t") for line in capsys.readouterr().out.splitlines()]
    assert len(got) == 6 and {r[0] for r in got} == {"1", "2"}
    main([*root, "recommend", "--users-file", at("split/test.parquet"), "--out", at("recs"), at("trained")])
    assert spark.read.parquet(at("recs")).count() > 20
    main([*root, "data", "convert", "--item-lists", at("recs"), at("lists")])
    main([*root, "data", "subset", "-n", "5", at("lists"), at("few")])
    assert 0 < spark.read.parquet(at("few")).count() <= 5
    main([*root, "config"])
    assert json.loads(capsys.readouterr().out)["datasets"] == {"tiny": data}
    main([*root, "doctor"])
    assert "pyspark: " in capsys.readouterr().out
    (tmp_path / "p.csv").write_text("node,ns\nscorer,3000000\nscorer,1000000\nranker,10\n")
    main([*root, "profile", at("p.csv")])
    assert "scorer\t2\t2.000\t2.000\t4.000" in capsys.readouterr().out
    (tmp_path / "spec.json").write_text(json.dumps({"model": "recmill.models.knn:ItemKNNScorer", "config": {"feedback": "implicit"}, "space": {"max_nbrs": {"type": "int", "min": 1, "max": 20}}, "default": {"max_nbrs": 20}}))
    main([*root, "tune", "--metric", "NDCG", "--max-points", "2", at("spec.json"), data, at("tuned")])
    assert json.loads((tmp_path / "tuned" / "task.json").read_text())["trials"] == 2 and (tmp_path / "tuned" / "best-config.json").exists()


def test_parzen_beats_random():
    """Mean best value of many searches on a function with a narrow optimum."""
    space = {"x": SearchParam("float", 1e-4, 10, "log"), "k": SearchParam("int", 1, 64, "pow2"), "c": SearchParam("choice", choices=["a", "b", "c"]), "f": SearchParam("bool")}
    value = lambda c: -((math.log10(c["x"]) + 2) ** 2) - (math.log2(c["k"]) - 4) ** 2 / 4 - (c["c"] != "b") - 0.5 * c["f"]
    best = {m: sum(PipelineTuner(space, value, method=m, max_points=50, seed=s).run().best().value for s in range(12)) / 12 for m in ("tpe", "random")}
    assert best["tpe"] > best["random"] + 0.05


def test_search_parts(tmp_path):
    rng = random.Random(1)
    p = SearchParam("int", 2, 9)
    assert all(2 <= parzen_proposal(p, [3, 4], [8, 9], rng) <= 9 for _ in range(50))
    for bad in ({"type": "int", "min": 3, "max": 1}, {"type": "choice"}, {"type": "float", "min": 0, "max": 1, "scale": "log"}, {"type": "other"}):
        with pytest.raises(ValueError):
            SearchParam(**bad)
    assert PlateauStopRule(2, 0.01).should_stop([1, 2, 2.001, 2.002]) and not PlateauStopRule(2, 0.01).should_stop([1, 2, 3, 4])
    assert median_prune([1], [[2], [3], [4], [5], [6]]) and not median_prune([5], [[2], [3], [4], [5], [6]])
    epochs = lambda c: iter([c["x"] * e for e in (0.1, 0.5, 0.4)])
    t = PipelineTuner({"x": SearchParam("float", 0, 1)}, epochs, {"x": 2.0}, max_points=4).run()
    assert t.best_config() == {"x": 2.0, "epochs": 2}
    t.save(str(tmp_path), pipeline=lambda c: {"scorer": c})
    assert json.loads((tmp_path / "best-pipeline.json").read_text()) == {"scorer": {"x": 2.0, "epochs": 2}}

    def broken(c):
        raise KeyError("x")

    with pytest.raises(RuntimeError, match="all 2 trials failed"):
        PipelineTuner({}, broken, max_points=2).run()
