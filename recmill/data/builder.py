"""Builds datasets: entity tables, relationship tables, attributes. Everything stays a lazy DataFrame; only
checks that must fail at once (duplicates, unknown ids) run a small query."""

from __future__ import annotations

import datetime as dt
import warnings
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recmill.data.dataset import Dataset
from recmill.data.schema import ADDED, Attribute, EntityClass, RelationshipClass, Schema, check_name, id_col
from recmill.errors import DataError, DataWarning


def as_time(value, kind: str) -> Column:
    """A point in time (datetime, ISO string or epoch seconds) as a literal comparable with a column of ``kind``."""
    if isinstance(value, str):
        value = dt.datetime.fromisoformat(value)
    if isinstance(value, int | float):
        value = dt.datetime.fromtimestamp(value, dt.UTC)
    if value.tzinfo is None:
        warnings.warn("time without a zone is taken as UTC", DataWarning, stacklevel=3)
        value = value.replace(tzinfo=dt.UTC)
    if not kind.startswith("timestamp"):
        return F.lit(value.timestamp())
    naive = value.astimezone(dt.UTC).replace(tzinfo=None).isoformat(sep=" ")
    return F.lit(naive).cast("timestamp_ntz") if kind == "timestamp_ntz" else F.to_timestamp(F.lit(naive + "+00:00"))


class DatasetBuilder:
    """Collects entities, relationships and attributes; :meth:`build` gives the dataset.

    Starts with an empty ``item`` class, or from an existing dataset.
    """

    def __init__(self, spark: SparkSession, name: str | None = None, start: Dataset | None = None):
        self.spark = spark
        self.schema = Schema.from_json(start.schema.to_json()) if start else Schema(name)
        self.entities: dict[str, DataFrame] = dict(start.entity_tables) if start else {}
        self.relations: dict[str, DataFrame] = dict(start.relation_tables) if start else {}
        # ids that are added later are numbered after all earlier ones: each addition has a number of its own
        self._added = 0
        for e, df in self.entities.items():
            if ADDED in df.columns:
                self._added = max(self._added, 1 + (df.agg(F.max(ADDED)).first()[0] or 0))
            else:
                self.entities[e] = df.withColumn(ADDED, F.lit(0))
                self._added = max(self._added, 1)

    # -- classes

    def add_entity_class(self, name: str) -> None:
        check_name(name)
        self.schema.entities.setdefault(name, EntityClass())

    def add_relationship_class(self, name: str, entities: Sequence[str] | Mapping[str, str], allow_repeats: bool = True, interaction: bool | str = False) -> None:
        check_name(name)
        if name in self.schema.relationships:
            raise ValueError(f"relationship class {name} exists")
        roles = dict(entities) if isinstance(entities, Mapping) else {e: e for e in entities}
        for e in roles.values():
            self.add_entity_class(e)
        if interaction and list(roles.values())[-1] != "item":
            warnings.warn("item is not the last entity of an interaction", DataWarning, stacklevel=2)
        self.schema.relationships[name] = RelationshipClass(roles, bool(interaction), "allowed" if allow_repeats else "forbidden")
        if interaction == "default":
            self.schema.default_interaction = name

    # -- rows

    def _as_frame(self, source, column: str) -> DataFrame:
        if isinstance(source, DataFrame):
            return source
        if hasattr(source, "columns"):
            return self.spark.createDataFrame(source)
        kind = "string" if source and isinstance(source[0], str) else "long"
        return self.spark.createDataFrame([(x,) for x in source], f"{column} {kind}")

    def _append(self, cls: str, fresh: DataFrame) -> None:
        fresh, have = fresh.withColumn(ADDED, F.lit(self._added)), self.entities.get(cls)
        self._added += 1
        self.entities[cls] = fresh if have is None else have.unionByName(fresh, allowMissingColumns=True)

    def add_entities(self, cls: str, source, duplicates: str = "error") -> None:
        """Ids must be integers or strings. Twice the same id in one input is always an error; ids that are
        already there are one unless ``duplicates`` is "update". Other columns become attributes."""
        self.add_entity_class(cls)
        key = id_col(cls)
        df = self._as_frame(source, key)
        kind = dict(df.dtypes)[key]
        if kind not in ("tinyint", "smallint", "int", "bigint", "string"):
            raise DataError(f"{key} must be integers or strings, not {kind}")
        df = df.where(F.col(key).isNotNull())
        if not df.groupBy(key).count().where("count > 1").isEmpty():
            raise DataError(f"repeated {key} in one input")
        for c in df.columns:
            if c != key:
                check_name(c, True)
                self.schema.entities[cls].attributes.setdefault(c, Attribute())
        have = self.entities.get(cls)
        if have is None:
            self._append(cls, df)
            return
        if duplicates == "error" and not df.join(have, key, "left_semi").isEmpty():
            raise DataError(f"{key} exists already")
        fresh = df.join(have.select(key), key, "left_anti")
        shared = [c for c in df.columns if c != key]
        if shared:  # update the rows that are there
            new = df.select(key, F.lit(True).alias("_new"), *[F.col(c).alias(f"_n_{c}") for c in shared])
            have = have.join(new, key, "left").select(key, *[F.when(F.col("_new"), F.col(f"_n_{c}")).otherwise(have[c] if c in have.columns else F.lit(None)).alias(c) if c in shared else have[c] for c in dict.fromkeys([*have.columns[0:], *shared]) if c != key])
        self.entities[cls] = have
        self._append(cls, fresh)

    def add_relationships(self, cls: str, data: DataFrame, entities: Sequence[str] | Mapping[str, str] | None = None, missing: str = "error", allow_repeats: bool = True, interaction: bool | str = False, remove_repeats: bool | str = False) -> None:
        """Append rows with ``<role>_id`` columns and attributes.

        missing: "error" for ids that no entity has, "insert" them, or "filter" the rows out. Rows with a
        null id are always left out. remove_repeats: True keeps the last row (by timestamp, else input
        order) of each entity combination, "exact" drops rows equal in every column.
        """
        data = self._as_frame(data, "")
        if cls not in self.schema.relationships:
            roles = entities or [c[:-3] for c in data.columns if c.endswith("_id")]
            self.add_relationship_class(cls, roles, allow_repeats, interaction)
        rel = self.schema.relationships[cls]
        keys = [id_col(r) for r in rel.entities]
        for k in keys:
            data = data.where(F.col(k).isNotNull())
        for role, e in rel.entities.items():
            ids = data.select(F.col(id_col(role)).alias(id_col(e))).distinct()
            known = self.entities.get(e)
            if missing == "insert":
                fresh = ids if known is None else ids.join(known, id_col(e), "left_anti")
                self._append(e, fresh)
            elif missing == "filter":
                data = data.limit(0) if known is None else data.join(known.select(F.col(id_col(e)).alias(id_col(role))), id_col(role), "left_semi")
            elif known is None or not ids.join(known, id_col(e), "left_anti").isEmpty():
                raise DataError(f"unknown ids of {e} in {cls}")
        for c in data.columns:
            if c not in keys and c != "_ord":
                check_name(c, True)
                rel.attributes.setdefault(c, Attribute())
        have = self.relations.get(cls)
        # input order, needed by "last": later additions come after all earlier rows
        batch = getattr(self, "_batches", 0)
        self._batches = batch + 1
        data = data.drop("_ord").withColumn("_ord", F.struct(F.lit(batch).alias("batch"), F.monotonically_increasing_id().alias("row")))
        out = data if have is None else have.unionByName(data, allowMissingColumns=True)
        if remove_repeats == "exact":
            out = drop_exact(out)
        elif remove_repeats:
            out = keep_last(out, keys)
        repeated = remove_repeats is not True and rel.repeats != "present" and self._repeats(data, have, out if remove_repeats else None, keys)
        if repeated and rel.repeats == "forbidden":
            raise DataError(f"repeated entity combinations in {cls}")
        if repeated:
            rel.repeats = "present"
        self.relations[cls] = out

    @staticmethod
    def _repeats(data: DataFrame, have: DataFrame | None, cleaned: DataFrame | None, keys: list[str]) -> bool:
        """Whether combinations of ``keys`` repeat: rows that came before are only asked for those of the new rows."""
        twice = lambda df: not df.groupBy(*keys).count().where("count > 1").isEmpty()
        if cleaned is not None:
            return twice(cleaned)
        return twice(data) or (have is not None and not data.join(have.select(*keys), keys, "left_semi").isEmpty())

    def add_interactions(self, cls: str, data: DataFrame, default: bool = False, **options) -> None:
        self.add_relationships(cls, data, interaction="default" if default else True, **options)

    # -- changes

    def filter_interactions(self, cls: str, min_time=None, max_time=None, remove: DataFrame | None = None) -> None:
        """Keep min_time <= timestamp < max_time, and drop the listed combinations of any id columns."""
        df = self.relations[cls]
        kind = dict(df.dtypes).get("timestamp", "")
        if min_time is not None:
            df = df.where(F.col("timestamp") >= as_time(min_time, kind))
        if max_time is not None:
            df = df.where(F.col("timestamp") < as_time(max_time, kind))
        if remove is not None:
            df = df.join(remove.select(*[c for c in remove.columns if c.endswith("_id")]).distinct(), [c for c in remove.columns if c.endswith("_id")], "left_anti")
        self.relations[cls] = df

    def binarize_ratings(self, cls: str = "rating", min_pos_rating: float = 3.0, method: str = "remove") -> None:
        df = self.relations[cls]
        lo, hi = df.agg(F.min("rating"), F.max("rating")).first()
        if lo is None or not lo <= min_pos_rating <= hi:
            raise ValueError(f"min_pos_rating must lie in [{lo}, {hi}]")
        good = F.col("rating") >= min_pos_rating
        self.relations[cls] = df.where(good) if method == "remove" else df.withColumn("rating", F.when(good, 1.0).otherwise(0.0))

    def clear_relationships(self, cls: str) -> None:
        self.relations[cls] = self.relations[cls].where(F.lit(False))

    def _attach(self, cls: str, name: str, values: DataFrame, attribute: Attribute) -> None:
        check_name(name, True)
        if name in self.schema.entities[cls].attributes:
            raise NotImplementedError(f"attribute {name} exists")
        key = id_col(cls)
        values = values.select(key, F.col([c for c in values.columns if c != key][0] if name not in values.columns else name).alias(name))
        if not values.join(self.entities[cls], key, "left_anti").isEmpty():
            raise DataError(f"{name} has values for unknown ids")
        self.entities[cls] = self.entities[cls].join(values, key, "left")
        self.schema.entities[cls].attributes[name] = attribute

    def add_scalar_attribute(self, cls: str, name: str, values: DataFrame) -> None:
        self._attach(cls, name, values, Attribute("scalar"))

    def add_list_attribute(self, cls: str, name: str, values: DataFrame) -> None:
        self._attach(cls, name, values, Attribute("list"))

    def add_vector_attribute(self, cls: str, name: str, values: DataFrame, size: int, dim_names: list[str] | None = None, sparse: bool = False) -> None:
        """Dense vectors are arrays of ``size``; sparse ones arrays of (index, value) structs."""
        if dim_names is not None and len(dim_names) != size:
            raise ValueError("as many names as dimensions are needed")
        if not sparse:
            c = name if name in values.columns else [c for c in values.columns if c != id_col(cls)][0]
            if not values.where(F.col(c).isNotNull() & (F.size(c) != size)).isEmpty():
                raise DataError(f"vectors of {name} must have {size} members")
        self._attach(cls, name, values, Attribute("sparse" if sparse else "vector", dim_names, size))

    def record_count(self, cls: str) -> int:
        t = self.entities.get(cls) if cls in self.schema.entities else self.relations.get(cls)
        return 0 if t is None else t.count()

    def id_type(self, cls: str) -> str | None:
        t = self.entities.get(cls)
        return None if t is None else dict(t.dtypes)[id_col(cls)]

    def build(self) -> Dataset:
        for e in self.schema.entities:
            if e not in self.entities:
                self.entities[e] = self.spark.createDataFrame([], f"{id_col(e)} long, {ADDED} int")
        return Dataset(self.schema, dict(self.entities), dict(self.relations))

    def save(self, path: str, summary: bool = True) -> None:
        self.build().save(path, summary)


def keep_last(df: DataFrame, keys: Sequence[str], time: str = "timestamp", order: str = "_ord") -> DataFrame:
    """The last row of each combination of ``keys``: by ``time`` where there is one (nulls first), then by ``order``."""
    by = [F.desc_nulls_last(c) for c in (time, order) if c in df.columns]
    by = by or [F.desc_nulls_last(c) for c in df.columns if c not in keys]
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where("_k = 1").drop("_k")


def drop_exact(df: DataFrame) -> DataFrame:
    """Rows equal in every column but the input order, once."""
    cols = [c for c in df.columns if c != "_ord"]
    return df.groupBy(*cols).agg(F.min("_ord").alias("_ord")) if "_ord" in df.columns else df.distinct()
