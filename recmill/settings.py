"""Settings in layers: defaults, TOML files (later ones win), environment variables, values given in code."""

from __future__ import annotations

import os
import tomllib
import types
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field, fields, is_dataclass
from pathlib import Path
from typing import Any, get_args, get_origin, get_type_hints

from pyspark.sql import SparkSession

from recmill.errors import ConfigError

#: Environment variables are PREFIX and the setting's path, in capitals, levels parted by two underscores.
PREFIX = "RECMILL_"
#: Files that are read where they exist, in this order.
FILES = ("recmill.toml", "recmill.local.toml")


@dataclass
class RandomSettings:
    seed: int | None = None


@dataclass
class ClusterSettings:
    """What a session is made with; None leaves Spark's own setting."""

    master: str | None = None
    shuffle_partitions: int | None = None
    shared_dir: str | None = None
    driver_memory: str | None = None


@dataclass
class TuneSettings:
    max_points: int = 60
    jobs: int = 1
    metric: str = "RBP"


@dataclass
class Settings:
    random: RandomSettings = field(default_factory=RandomSettings)
    cluster: ClusterSettings = field(default_factory=ClusterSettings)
    tuning: TuneSettings = field(default_factory=TuneSettings)
    #: Paths of known datasets by name.
    datasets: dict[str, str] = field(default_factory=dict)

    def to_dict(self) -> dict:
        return asdict(self)

    def session(self, app: str = "recmill") -> SparkSession:
        """A session with these settings; one that is running keeps its own."""
        b, c = SparkSession.builder.appName(app), self.cluster
        if c.master:
            b = b.master(c.master)
        for key, value in {"spark.sql.shuffle.partitions": c.shuffle_partitions, "spark.checkpoint.dir": c.shared_dir, "spark.driver.memory": c.driver_memory, "spark.sql.session.timeZone": "UTC"}.items():
            if value is not None:
                b = b.config(key, str(value))
        return b.getOrCreate()


def _convert(kind: Any, value: Any, at: str) -> Any:
    if get_origin(kind) in (types.UnionType,) or type(None) in get_args(kind):
        kind = next(k for k in get_args(kind) if k is not type(None))
        if value in (None, ""):
            return None
    try:
        if kind is int and not isinstance(value, bool):
            return int(value)
        if kind is str:
            return str(value)
        if get_origin(kind) is dict and isinstance(value, Mapping):
            return dict(value)
    except ValueError as e:
        raise ConfigError(f"{at}: {value!r} is no {kind.__name__}") from e
    raise ConfigError(f"{at}: {value!r} cannot be used")


def _put(target: Any, values: Mapping, at: str = "") -> None:
    kinds, known = get_type_hints(type(target)), {f.name for f in fields(target)}
    for k, v in values.items():
        if k not in known:
            raise ConfigError(f"unknown setting {at}{k}")
        now = getattr(target, k)
        if is_dataclass(now):
            if not isinstance(v, Mapping):
                raise ConfigError(f"{at}{k} is a table")
            _put(now, v, f"{at}{k}.")
        elif isinstance(now, dict) and isinstance(v, Mapping):
            setattr(target, k, {**now, **v})
        else:
            setattr(target, k, _convert(kinds[k], v, at + k))


def load_settings(files: Sequence[str | Path] | None = None, environ: Mapping[str, str] | None = None, directory: str | Path = ".", **given: Any) -> Settings:
    """Settings from the files (default: FILES in ``directory``), the environment and ``given`` (tables as mappings)."""
    out = Settings()
    for f in files if files is not None else [p for p in (Path(directory) / name for name in FILES) if p.exists()]:
        _put(out, tomllib.loads(Path(f).read_text()))
    for name, value in sorted((os.environ if environ is None else environ).items()):
        if name.startswith(PREFIX):
            *path, last = name.removeprefix(PREFIX).lower().split("__")
            table: dict = {last: value}
            for part in reversed(path):
                table = {part: table}
            _put(out, table)
    _put(out, given)
    return out
