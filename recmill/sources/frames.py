"""Interaction frames and configuration files."""

from __future__ import annotations

import json
import tomllib
import warnings
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recmill.data.builder import DatasetBuilder
from recmill.data.dataset import Dataset
from recmill.errors import DataWarning, FieldError

# Column names that are taken for users, items, ratings and times, first match first.
KNOWN = {
    "user_id": ["user_id", "user", "USER", "userId", "UserId", "User"],
    "item_id": ["item_id", "item", "ITEM", "itemId", "ItemId", "Item", "movieId"],
    "rating": ["rating", "RATING", "Rating"],
    "timestamp": ["timestamp", "TIMESTAMP", "Timestamp", "ts", "time"],
}


def normalize_columns(df: DataFrame, *columns: str) -> DataFrame:
    """Give the named columns their standard names, with a warning where an old name is used."""
    for c in columns:
        if c in df.columns:
            continue
        old = next((x for x in KNOWN.get(c, []) if x in df.columns), None)
        if old is None:
            raise FieldError(f"no column {c}")
        warnings.warn(f"column {old} is taken for {c}", DataWarning, stacklevel=2)
        df = df.withColumnRenamed(old, c)
    return df


def normalize_interactions(df: DataFrame, user_col: str | None = None, item_col: str | None = None, rating_col: str | None = None, timestamp_col: str | None = None) -> DataFrame:
    """Standard names for users, items, ratings and times, which come first; other columns stay."""
    chosen = dict(zip(KNOWN, (user_col, item_col, rating_col, timestamp_col), strict=True))
    order = []
    for name, given in chosen.items():
        at = given or next((x for x in KNOWN[name] if x in df.columns), None)
        if at is None or at not in df.columns:
            if name in ("user_id", "item_id") or given:
                raise FieldError(f"no column for {name}")
            continue
        df = df.withColumnRenamed(at, name)
        order.append(name)
    return df.select(*order, *[c for c in df.columns if c not in order])


def from_interactions(df: DataFrame, users: DataFrame | None = None, items: DataFrame | None = None, class_name: str = "rating", **columns: str) -> Dataset:
    """A dataset from one frame. With given users or items, rows of others are left out; repeats are forbidden."""
    df = normalize_interactions(df, **columns)
    b = DatasetBuilder(df.sparkSession)
    given = {"user": users, "item": items}
    for e, f in given.items():
        if f is not None:
            b.add_entities(e, f)
            df = df.join(f.select(f"{e}_id"), f"{e}_id", "left_semi")
    b.add_interactions(class_name, df, entities=["user", "item"], missing="insert", allow_repeats=False, default=True)
    return b.build()


def load_config(path: str) -> dict:
    """JSON, TOML or YAML by suffix."""
    p = Path(path)
    text = p.read_text()
    if p.suffix == ".json":
        return json.loads(text)
    if p.suffix == ".toml":
        return tomllib.loads(text)
    if p.suffix in (".yaml", ".yml"):
        import yaml

        return yaml.safe_load(text)
    raise ValueError(f"unknown configuration format {p.suffix}")


def flatten(data: dict, prefix: str = "") -> dict:
    out: dict = {}
    for k, v in data.items():
        out |= flatten(v, f"{prefix}{k}.") if isinstance(v, dict) else {f"{prefix}{k}": v}
    return out


def unflatten(data: dict) -> dict:
    """The nested form of dotted keys: keys with the same first part become one table under it."""
    tables = {k.partition(".")[0]: {} for k in data if "." in k}
    for k, v in data.items():
        first, dot, rest = k.partition(".")
        if dot:
            tables[first][rest] = v
    return {k: v for k, v in data.items() if "." not in k} | {k: unflatten(t) for k, t in tables.items()}


def epoch(column: str, unit: str = "s"):
    """Epoch seconds or milliseconds as a zone-less UTC timestamp."""
    c = F.timestamp_millis(F.col(column)) if unit == "ms" else F.timestamp_seconds(F.col(column))
    return c.cast("timestamp_ntz")
