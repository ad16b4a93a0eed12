"""Command line: python -m recmill.cli COMMAND ..."""

from __future__ import annotations

import argparse
import csv
import json
import logging
import statistics
import sys
from collections import defaultdict
from collections.abc import Sequence
from importlib.metadata import PackageNotFoundError, entry_points, version
from pathlib import Path

from pyspark.sql import SparkSession

from recmill.settings import Settings, load_settings

log = logging.getLogger("recmill")
#: Entry points of this group are functions that get the subparsers and add commands of their own.
PLUGINS = "recmill.commands"


def _dataset(spark: SparkSession, path: str, settings: Settings):
    from recmill.data.dataset import Dataset

    return Dataset.load(spark, settings.datasets.get(path, path))


# -- data


def convert(spark: SparkSession, a: argparse.Namespace, settings: Settings) -> None:
    from recmill.sources import movielens, others

    if a.item_lists:
        from recmill.operators.lists import ListCollection

        df = spark.read.parquet(a.src) if not a.src.endswith(".csv") else spark.read.option("header", True).option("inferSchema", True).csv(a.src)
        ListCollection(df, [c for c in df.columns if c.endswith("_id") and c != "item_id"]).save_parquet(a.dst)
        return
    load = {"movielens": movielens.load_movielens, "amazon": others.load_amazon, "msweb": others.load_msweb, "steam": others.load_steam}[a.format]
    load(spark, a.src).save(a.dst, summary=not a.no_summary)


def describe(spark: SparkSession, a: argparse.Namespace, settings: Settings) -> None:
    print(_dataset(spark, a.data, settings).summary())


def split(spark: SparkSession, a: argparse.Namespace, settings: Settings) -> None:
    from recmill.operators import splitting as sp

    rows = _dataset(spark, a.data, settings).interactions().log
    seed = a.seed if a.seed is not None else settings.random.seed or 0
    if a.fraction is not None:
        parts = [sp.split_temporal_fraction(rows, a.fraction)]
    elif a.time is not None:
        parts = [sp.split_global_time(rows, a.time)]
    else:
        parts = list(sp.crossfold_users(rows, a.folds, sp.sample_n(a.test_rows, seed=seed), seed=seed))
    for i, s in enumerate(parts):
        at = a.out if len(parts) == 1 else f"{a.out}/{i}"
        s.train.write.mode("overwrite").parquet(f"{at}/train.parquet")
        s.test.write.mode("overwrite").parquet(f"{at}/test.parquet")
        log.info("split %s: %s test rows", i, s.test_size())


def subset(spark: SparkSession, a: argparse.Namespace, settings: Settings) -> None:
    from recmill.operators.lists import ListCollection

    ListCollection.load_parquet(spark, a.lists).sample(a.n, a.seed or 0).save_parquet(a.out)


# -- models


def _pipeline(path: str):
    from recmill.plans.pipeline import PipelineBuilder
    from recmill.sources.frames import load_config

    return PipelineBuilder.from_config(load_config(path))


def train(spark: SparkSession, a: argparse.Namespace, settings: Settings) -> None:
    from recmill.models.base import TrainingOptions
    from recmill.plans.store import save_pipeline
    from recmill.tasks import Task

    p = _pipeline(a.pipeline).build()
    with Task("train", spark, a.task_file, pipeline=a.pipeline, data=a.data):
        p.train(_dataset(spark, a.data, settings).interactions().log, TrainingOptions(seed=settings.random.seed or 0))
        save_pipeline(p, spark, a.out)


def recommend(spark: SparkSession, a: argparse.Namespace, settings: Settings) -> None:
    from recmill.plans.pipeline import recommend as run
    from recmill.plans.store import load_pipeline

    p = load_pipeline(spark, a.pipeline)
    if a.users_file:
        users = spark.read.parquet(a.users_file).select("user_id").distinct()
    else:
        users = [int(u) if u.lstrip("-").isdigit() else u for u in a.users]
    out = run(p, spark, users, a.n)
    if a.out:
        out.write.mode("overwrite").parquet(a.out)
    else:
        for r in out.orderBy("user_id", "rank").limit(a.show).collect():
            print(*r.asDict().values(), sep="\t")


def tune(spark: SparkSession, a: argparse.Namespace, settings: Settings) -> None:
    from recmill.metrics.quick import mean_of, quick_measure_model
    from recmill.plans.pipeline import from_path
    from recmill.plans.tuning import PipelineTuner, SearchParam
    from recmill.sources.frames import load_config

    spec = load_config(a.spec)
    rows, made = _dataset(spark, a.data, settings).interactions().log, from_path(spec["model"])
    metric = a.metric or spec.get("metric", settings.tuning.metric)

    def measure(config: dict) -> float:
        value = mean_of(quick_measure_model(made(**{**spec.get("config", {}), **config}), rows, metric in ("RMSE", "MAE")), metric)
        if value is None:
            raise ValueError(f"{metric} is undefined")
        return value

    space = {k: SearchParam(**v) for k, v in spec["space"].items()}
    PipelineTuner(space, measure, spec.get("default"), metric, spec.get("method", "tpe"), a.max_points or settings.tuning.max_points, settings.tuning.jobs, settings.random.seed or 0).run().save(a.out, task={"spec": spec, "data": a.data})


# -- looking at things


def pipeline(spark: SparkSession | None, a: argparse.Namespace, settings: Settings) -> None:
    b = _pipeline(a.pipeline)
    text = b.build().mermaid() if a.what == "diagram" else json.dumps(b.build_config(), indent=2, default=str)
    Path(a.out).write_text(text) if a.out else print(text)


def config(spark: SparkSession | None, a: argparse.Namespace, settings: Settings) -> None:
    print(json.dumps(settings.to_dict(), indent=2))


def doctor(spark: SparkSession, a: argparse.Namespace, settings: Settings) -> None:
    for name in ("pyspark", "pyarrow", "pandas", "numpy", "scipy", "torch", "yaml"):
        try:
            print(f"{name}: {version('PyYAML' if name == 'yaml' else name)}")
        except PackageNotFoundError:
            print(f"{name}: not installed")
    sc = spark.sparkContext
    print(f"master: {sc.master}\nparallelism: {sc.defaultParallelism}\nshuffle partitions: {spark.conf.get('spark.sql.shuffle.partitions')}\nshared folder: {spark.conf.get('spark.checkpoint.dir', None) or 'not set'}")


def task(spark: SparkSession | None, a: argparse.Namespace, settings: Settings) -> None:
    def show(t: dict, depth: int) -> None:
        seconds = f"{t['seconds']:.2f} s" if t["seconds"] is not None else "-"
        print(f"{'  ' * depth}{t['label']}: {t['status']}, {seconds}, {t['jobs']} jobs")
        for s in t["subtasks"]:
            show(s, depth + 1)

    show(json.loads(Path(a.file).read_text()), 0)


def profile(spark: SparkSession | None, a: argparse.Namespace, settings: Settings) -> None:
    times = defaultdict(list)
    with open(a.file, newline="") as f:
        for row in csv.DictReader(f):
            times[row["node"]].append(int(row["ns"]) / 1e6)
    print("node\truns\tmean ms\tmedian ms\ttotal ms")
    for node, ms in sorted(times.items(), key=lambda x: -sum(x[1])):
        print(f"{node}\t{len(ms)}\t{statistics.mean(ms):.3f}\t{statistics.median(ms):.3f}\t{sum(ms):.3f}")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="recmill", description="Recommender analytics on Spark.")
    top.add_argument("-v", "--verbose", action="count", default=0)
    top.add_argument("--root", default=".", help="folder with settings files")
    commands = top.add_subparsers(dest="command", required=True)

    def add(to, name, f, needs_spark=True, **options):
        p = to.add_parser(name, help=(f.__doc__ or name), **options)
        p.set_defaults(run=f, needs_spark=needs_spark)
        return p

    data = commands.add_parser("data", help="datasets and lists").add_subparsers(dest="data_command", required=True)
    p = add(data, "convert", convert)
    p.add_argument("--format", choices=["movielens", "amazon", "msweb", "steam"], default="movielens")
    p.add_argument("--no-summary", action="store_true")
    p.add_argument("--item-lists", action="store_true", help="src is a flat table of item lists")
    p.add_argument("src")
    p.add_argument("dst")
    p = add(data, "describe", describe)
    p.add_argument("data")
    p = add(data, "split", split)
    how = p.add_mutually_exclusive_group()
    how.add_argument("--fraction", type=float, help="the latest rows, as a share")
    how.add_argument("--time", help="rows from this time on")
    p.add_argument("--folds", type=int, default=5, help="folds of users (without --fraction and --time)")
    p.add_argument("--test-rows", type=int, default=5, help="test rows of each user of a fold")
    p.add_argument("--seed", type=int)
    p.add_argument("data")
    p.add_argument("out")
    p = add(data, "subset", subset)
    p.add_argument("-n", type=int, default=100)
    p.add_argument("--seed", type=int)
    p.add_argument("lists")
    p.add_argument("out")

    p = add(commands, "train", train)
    p.add_argument("--task-file")
    p.add_argument("pipeline")
    p.add_argument("data")
    p.add_argument("out")
    p = add(commands, "recommend", recommend)
    p.add_argument("-n", type=int, default=10)
    p.add_argument("--users-file", help="parquet with user_id")
    p.add_argument("--out")
    p.add_argument("--show", type=int, default=1000, help="rows that are printed without --out")
    p.add_argument("pipeline")
    p.add_argument("users", nargs="*")
    p = add(commands, "tune", tune)
    p.add_argument("--metric")
    p.add_argument("--max-points", type=int)
    p.add_argument("spec")
    p.add_argument("data")
    p.add_argument("out")

    p = add(commands, "pipeline", pipeline, needs_spark=False)
    p.add_argument("what", choices=["diagram", "expand"])
    p.add_argument("pipeline")
    p.add_argument("-o", "--out")
    add(commands, "config", config, needs_spark=False)
    add(commands, "doctor", doctor)
    p = add(commands, "task", task, needs_spark=False)
    p.add_argument("file")
    p = add(commands, "profile", profile, needs_spark=False)
    p.add_argument("file")
    for plugin in entry_points(group=PLUGINS):
        plugin.load()(commands)
    return top


def main(argv: Sequence[str] | None = None) -> int:
    a = parser().parse_args(argv)
    logging.basicConfig(level=[logging.WARNING, logging.INFO, logging.DEBUG][min(a.verbose, 2)], format="%(asctime)s %(levelname)s %(message)s")
    settings = load_settings(directory=a.root)
    a.run(settings.session() if a.needs_spark else None, a, settings)
    return 0


if __name__ == "__main__":
    sys.exit(main())
