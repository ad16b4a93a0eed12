"""Trained pipelines as folders: the configuration and simple values as text, every table as parquet."""

from __future__ import annotations

import json
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from recmill.models.base import Scorer
from recmill.plans.pipeline import Component, Pipeline, PipelineBuilder


def write_text(spark: SparkSession, path: str, text: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").option("lineSep", "\0").text(path)


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.option("wholetext", True).text(path).first()[0].rstrip("\0")


def _save(value: Any, path: str) -> Any:
    """What stands for a value in the text; tables are written below ``path``."""
    if isinstance(value, DataFrame):
        value.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return {"table": True}
    if isinstance(value, Scorer):
        return {"scorer": {k: _save(v, f"{path}/{k}") for k, v in vars(value).items() if k not in ("config", "_held")}, "class": f"{type(value).__module__}:{type(value).__qualname__}", "config": _plain(vars(value.config))}
    if isinstance(value, dict) and any(isinstance(v, DataFrame | Scorer) for v in value.values()):
        return {"each": {k: _save(v, f"{path}/{k}") for k, v in value.items()}}
    return {"value": _plain(value)}


def _plain(x: Any) -> Any:
    if isinstance(x, np.ndarray):
        return x.tolist()
    if isinstance(x, np.generic):
        return x.item()
    if isinstance(x, dict):
        return {k: _plain(v) for k, v in x.items()}
    if isinstance(x, list | tuple | set | frozenset):
        return [_plain(v) for v in (sorted(x) if isinstance(x, set | frozenset) else x)]
    return x


def _load(spark: SparkSession, saved: dict, path: str) -> Any:
    if "table" in saved:
        return spark.read.parquet(path)
    if "each" in saved:
        return {k: _load(spark, v, f"{path}/{k}") for k, v in saved["each"].items()}
    if "scorer" in saved:
        from recmill.plans.pipeline import from_path

        made = from_path(saved["class"])(**saved["config"])
        for k, v in saved["scorer"].items():
            setattr(made, k, _load(spark, v, f"{path}/{k}"))
        return made
    return saved["value"]


def save_pipeline(pipeline: Pipeline, spark: SparkSession, path: str) -> None:
    """Write a pipeline, trained or not, so that :func:`load_pipeline` gives one with the same results."""
    config, state = pipeline.builder.build_config(), {}
    for name in pipeline.component_names():
        c = pipeline.nodes[name].value
        if isinstance(c, Component):
            state[name] = {k: _save(v, f"{path}/tables/{name}/{k}") for k, v in vars(c).items() if k != "config" and not (k == "scorer" and "reach" in c.config)}
    write_text(spark, f"{path}/pipeline.json", json.dumps({"config": config, "state": state}, default=str))


def load_pipeline(spark: SparkSession, path: str) -> Pipeline:
    saved = json.loads(read_text(spark, f"{path}/pipeline.json"))
    builder = PipelineBuilder.from_config(saved["config"])
    for name, state in saved["state"].items():
        for k, v in state.items():
            setattr(builder.nodes[name].value, k, _load(spark, v, f"{path}/tables/{name}/{k}"))
    return builder.build()
