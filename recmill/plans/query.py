"""Queries as frames: who asks, and what is known of them beside the training data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recmill.errors import DataError

#: Item columns of a query, the first that a query has being what it asks with.
SOURCES = ("context_items", "session_items", "history_items")


class Queries:
    """``frame(user_id, [query_id], [context_items], [session_items], [history_items])``, one row per query. Items are
    arrays of ids or of structs with item_id and further fields."""

    def __init__(self, frame: DataFrame):
        if "user_id" not in frame.columns and "query_id" not in frame.columns:
            raise DataError("queries need user_id or query_id")
        self.frame = frame if "user_id" in frame.columns else frame.withColumn("user_id", F.col("query_id"))

    @classmethod
    def create(cls, spark: SparkSession, data: Any) -> Queries:
        """From queries, a frame, ids, an id, or a mapping from ids to items of their history; None is one query
        of an unknown user."""
        if isinstance(data, Queries):
            return data
        if isinstance(data, DataFrame):
            return cls(data)
        if data is None:
            return cls(spark.createDataFrame([(None,)], "user_id long"))
        if isinstance(data, Mapping):
            kind = lambda x: "string" if isinstance(x, str) else "long"
            users, items = list(data), [i for v in data.values() for i in v]
            return cls(spark.createDataFrame([(u, list(v)) for u, v in data.items()], f"user_id {kind(users[0]) if users else 'long'}, history_items array<{kind(items[0]) if items else 'long'}>"))
        ids = list(data) if isinstance(data, Sequence) and not isinstance(data, str) else [data]
        return cls(spark.createDataFrame([(x,) for x in ids], f"user_id {'string' if ids and isinstance(ids[0], str) else 'long'}"))

    def with_items(self, source: str | Sequence[str] | None = None, name: str = "items") -> DataFrame:
        """The queries with the items that they ask with: context, else session, else history, or those of ``source``; null
        where there are none."""
        wanted = SOURCES if source is None else [source] if isinstance(source, str) else list(source)
        wanted = [w if w.endswith("_items") else f"{w}_items" for w in wanted]
        for w in wanted:
            if w not in SOURCES:
                raise ValueError(f"unknown source {w}")
        have = [F.col(w) for w in wanted if w in self.frame.columns]
        return self.frame.withColumn(name, F.coalesce(*have) if have else F.lit(None))

    def past(self, source: str | Sequence[str] | None = None) -> DataFrame | None:
        """(user_id, item_id, ...): the items, one row each, as pipelines take them; None where no query has any."""
        found = self.with_items(source, "_items")
        kind = dict(found.dtypes)["_items"]
        if kind == "void":
            return None
        rows = found.where("user_id is not null").select("user_id", F.explode("_items").alias("_i"))
        return rows.select("user_id", "_i.*") if "struct" in kind else rows.select("user_id", F.col("_i").alias("item_id"))


@dataclass
class Invocation:
    """Which nodes a batch runs, under which names their results go, and with which items."""

    name: str
    components: dict[str, str]
    #: "candidates": what the pipeline selects; "test-items": the items of the test data.
    items: str = "candidates"
    inputs: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self):
        if self.items not in ("candidates", "test-items"):
            raise ValueError("items must be candidates or test-items")


def invoke(pipeline, spark: SparkSession, queries: Any, invocations: Sequence[Invocation], test: DataFrame | None = None) -> dict[str, DataFrame]:
    """Results of all invocations by output name."""
    q = Queries.create(spark, queries)
    out = {}
    for i in invocations:
        given = {"query": q.frame, **i.inputs}
        past = q.past()
        if past is not None:
            given["past"] = past
        if i.items == "test-items":
            if test is None:
                raise DataError(f"{i.name} needs test items")
            given["items"] = test.join(q.frame.select("user_id").distinct(), "user_id", "left_semi").select("user_id", "item_id").distinct()
        got = pipeline.run_all(*i.components, **given)
        for node, name in i.components.items():
            if name in out:
                raise ValueError(f"two results named {name}")
            out[name] = got[node]
    return out
