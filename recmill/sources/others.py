"""Amazon ratings, MSWeb visits, Steam play records."""

from __future__ import annotations

import ast
import gzip
import json
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recmill.data.builder import DatasetBuilder
from recmill.data.dataset import Dataset
from recmill.errors import DataError
from recmill.operators.order import carry_forward
from recmill.session import cut
from recmill.sources.frames import epoch


def _head(path: str, size: int = 4096) -> str:
    with (gzip.open if path.endswith(".gz") else open)(path, "rb") as f:
        return f.read(size).decode("utf-8", "replace")


def _amazon_2014(spark, path):
    return spark.read.schema("user_id string, item_id string, rating float, ts long").csv(path).select("user_id", "item_id", "rating", epoch("ts").alias("timestamp"))


def _amazon_2018(spark, path):
    return spark.read.schema("item_id string, user_id string, rating float, ts long").csv(path).select("user_id", "item_id", "rating", epoch("ts").alias("timestamp"))


def _amazon_2023(spark, path):
    df = spark.read.option("header", True).csv(path)
    return df.select("user_id", F.col("parent_asin").alias("item_id"), F.col("rating").cast("float"), F.col("timestamp").cast("long").alias("ts")).select("user_id", "item_id", "rating", epoch("ts", "ms").alias("timestamp"))


def amazon_layout(path: str) -> str:
    """2023 files have a heading; 2014 ones begin their names with "ratings_" or their rows with a user id."""
    line = _head(path).split("\n", 1)[0].strip()
    if line.startswith("user_id,"):
        return "2023"
    if Path(path).name.startswith("ratings_"):
        return "2014"
    first, second, *_ = line.split(",")
    return "2018" if len(first) <= 10 and len(second) > 10 else "2014"


def load_amazon(spark: SparkSession, *paths: str) -> Dataset:
    if not paths:
        raise ValueError("no files")
    readers = {"2014": _amazon_2014, "2018": _amazon_2018, "2023": _amazon_2023}
    b = DatasetBuilder(spark, re.sub(r"^ratings_|\.csv(\.gz)?$", "", Path(paths[0]).name))
    df = None
    for p in paths:
        part = readers[amazon_layout(p)](spark, p)
        df = part if df is None else df.unionByName(part)
    b.add_interactions("rating", df, entities=["user", "item"], missing="insert", allow_repeats=False, default=True)
    return b.build()


def msweb_visits(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(pages, visits): A rows are pages; each V row belongs to the C row before it in the file.

    A gzip file is one split whose lines arrive in order, so line numbers are those of the file.
    """
    text = spark.read.text(path).withColumn("line", F.monotonically_increasing_id())
    f = F.from_csv(F.col("value"), F.lit("code string, a string, b string, c string, d string"))
    rows = text.select("line", f.alias("r")).select("line", "r.*")
    pages = rows.where("code = 'A'").select(F.col("a").cast("int").alias("item_id"), F.col("c").alias("title"), F.col("d").alias("url"))
    marked = rows.where("code in ('C', 'V')")
    cases = marked.select("line", "code", "a", F.when(F.col("code") == "C", F.col("b").cast("int")).alias("case"))
    visits = carry_forward(cases, "line", value="case", name="session_id").where("code = 'V'").select("session_id", F.col("a").cast("int").alias("item_id"))
    return pages, visits


def load_msweb(spark: SparkSession, path: str, format: str = "dataset"):
    pages, visits = msweb_visits(spark, path)
    if format != "dataset":
        from recmill.operators.lists import ListCollection

        return ListCollection(visits, ["session_id"])
    b = DatasetBuilder(spark, "msweb")
    b.add_entities("item", pages)
    b.add_interactions("visit", visits, entities=["session", "item"], missing="insert", default=True)
    return b.build()


def pyon_loads(text: str):
    """The value of a Python literal, as some "JSON" files hold them."""
    return ast.literal_eval(text.strip())


def _parse(skip: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column("value").to_pylist():
                try:
                    out.append(json.dumps(ast.literal_eval(t.strip())) if t.strip() else None)
                except (ValueError, SyntaxError) as e:
                    if not skip:
                        raise DataError(f"no Python literal: {t[:200]!r}") from e
                    out.append(None)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["json"])

    return run


def pyon_to_json(lines: DataFrame, errors: str = "raise") -> DataFrame:
    """``lines(value)`` of Python literals as ``json``. A line that is none ends the query with a DataError, or (errors =
    "null") gives null; so does an empty line."""
    if errors not in ("raise", "null"):
        raise ValueError("errors must be raise or null")
    return lines.select("value").mapInArrow(_parse(errors == "null"), "json string")


def load_steam(spark: SparkSession, *paths: str, errors: str = "raise") -> Dataset:
    """Players and what they own. A steam_id counts once, with its first line; an item has the name that it has first."""
    if not paths:
        raise ValueError("no files")
    schema = "user_id string, items_count int, steam_id string, user_url string, items array<struct<item_id: string, item_name: string, playtime_2weeks: double, playtime_forever: double>>"
    lines = pyon_to_json(spark.read.text(list(paths)), errors).where("json is not null").withColumn("_o", F.monotonically_increasing_id())
    raw = cut(lines.select("_o", F.from_json("json", schema).alias("r")).select("_o", "r.*").where("steam_id is not null"), "steam")
    users = raw.groupBy("steam_id").agg(F.min_by(F.struct("_o", "user_id", "items"), "_o").alias("u")).select(F.col("steam_id").cast("long").alias("user_id"), "u._o", F.col("u.user_id").alias("handle"), "u.items")
    owned = users.select("user_id", "_o", F.posexplode("items").alias("_p", "i")).select("user_id", "_o", "_p", F.col("i.item_id").cast("long").alias("item_id"), "i.item_name", "i.playtime_2weeks", "i.playtime_forever").where("item_id is not null")
    plays = owned.groupBy("user_id", "item_id").agg(F.min_by(F.struct("_o", "_p", "item_name", "playtime_2weeks", "playtime_forever"), F.struct("_o", "_p")).alias("x")).select("user_id", "item_id", "x.*")
    b = DatasetBuilder(spark, "steam")
    b.add_entities("item", plays.groupBy("item_id").agg(F.min_by("item_name", F.struct("_o", "_p")).alias("name")))
    b.add_entities("user", users.select("user_id", "handle"))
    b.add_interactions("play", plays.drop("item_name", "_o", "_p"), entities=["user", "item"], missing="filter", default=True)
    return b.build()


def load_steam_all(*_, **__) -> Dataset:
    raise NotImplementedError("only the files of players and their items can be loaded")
