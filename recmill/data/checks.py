"""Checks of frames before they are used."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = {"integer": ("tinyint", "smallint", "int", "bigint"), "number": ("tinyint", "smallint", "int", "bigint", "float", "double"), "string": ("string",), "id": ("tinyint", "smallint", "int", "bigint", "string"), "time": ("timestamp", "timestamp_ntz", "date")}


def _result(problems: Sequence[str], error: str) -> bool:
    if problems and error == "raise":
        raise TypeError("; ".join(problems))
    return not problems


def check_columns(df: DataFrame, columns: Mapping[str, str | Sequence[str]], error: str = "raise") -> bool:
    """Whether ``df`` has the columns with types of the kind named (of KINDS, or type names). ``error`` "return" gives
    False where "raise" raises a TypeError."""
    have, problems = dict(df.dtypes), []
    for name, kind in columns.items():
        allowed = KINDS.get(kind, (kind,)) if isinstance(kind, str) else tuple(kind)
        if name not in have:
            problems.append(f"no column {name}")
        elif have[name] not in allowed and not any(a == "array" and have[name].startswith("array") for a in allowed):
            problems.append(f"{name} is {have[name]}, not {kind}")
    return _result(problems, error)


def check_lengths(df: DataFrame, column: str, size: int, error: str = "raise") -> bool:
    """Whether all arrays of a column that are not null have ``size`` members."""
    bad = df.where(F.col(column).isNotNull() & (F.size(column) != size)).select(F.size(column).alias("n")).first()
    return _result([] if bad is None else [f"{column} has {bad['n']} members, not {size}"], error)


#: Arrow and other names of Spark types.
NAMES = {"tinyint": "int8", "smallint": "int16", "int": "int32", "bigint": "int64", "float": "float32", "double": "float64", "string": "utf8", "boolean": "bool", "binary": "binary", "date": "date32", "timestamp": "timestamp[us, UTC]", "timestamp_ntz": "timestamp[us]"}


def arrow_names(df: DataFrame) -> dict[str, str]:
    """Arrow's name of every column's type; nested types keep Spark's."""
    return {c: NAMES.get(t, t) for c, t in df.dtypes}
