"""Datasets: entities, relationships, interactions and what is derived from them, as lazy DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recmill.data.schema import ADDED, Schema, id_col, num_col
from recmill.errors import DataError, FieldError
from recmill.operators import stats
from recmill.operators.order import number_rows


class EntitySet:
    """Entities of a class; numbers, where asked for, are those of the whole class even in a selection."""

    def __init__(self, ds: Dataset, name: str, df: DataFrame):
        self.ds, self.name, self.df, self.key = ds, name, df, id_col(name)

    def ids(self) -> DataFrame:
        return self.df.select(self.key)

    def numbers(self) -> DataFrame:
        return self.ds.numbering(self.name).join(self.df.select(self.key), self.key, "left_semi")

    def count(self) -> int:
        return self.df.count()

    def select(self, ids: DataFrame) -> EntitySet:
        return EntitySet(self.ds, self.name, self.df.join(ids.select(self.key).distinct(), self.key, "left_semi"))

    def attribute(self, name: str) -> AttributeSet:
        spec = self.ds.schema.entities[self.name].attributes.get(name)
        if spec is None:
            raise FieldError(f"{self.name} has no attribute {name}")
        return AttributeSet(self, name, spec, self.df.select(self.key, name))


class AttributeSet:
    def __init__(self, entities: EntitySet, name: str, spec, df: DataFrame):
        self.entities, self.name, self.spec, self.df = entities, name, spec, df

    def drop_null(self) -> AttributeSet:
        return AttributeSet(self.entities, self.name, self.spec, self.df.where(F.col(self.name).isNotNull()))

    def value(self):
        rows = self.df.limit(2).collect()
        if len(rows) != 1:
            raise ValueError("value() needs exactly one entity")
        return rows[0][self.name]

    def category_matrix(self, normalize: str | None = None) -> DataFrame:
        return stats.category_matrix(self.df, self.entities.key, self.name, self.spec.layout, self.spec.names, normalize)


class RelationshipSet:
    """The log of a relationship class, repeats kept."""

    def __init__(self, ds: Dataset, name: str):
        self.ds, self.name, self.spec, self.log = ds, name, ds.schema.relationships[name], ds.relation_tables[name]

    def table(self, attributes: list[str] | None = None, numbers: bool = False) -> DataFrame:
        keys = [id_col(r) for r in self.spec.entities]
        fields = [c for c in self.log.columns if c not in keys and c != "_ord"] if attributes is None else attributes
        for a in fields:
            if a not in self.log.columns:
                raise FieldError(f"{self.name} has no attribute {a}")
        df = self.log.select(*keys, *fields)
        if numbers:
            for role, e in self.spec.entities.items():
                n = self.ds.numbering(e).select(F.col(id_col(e)).alias(id_col(role)), F.col(num_col(e)).alias(num_col(role)))
                df = df.join(n, id_col(role))
            df = df.select(*[num_col(r) for r in self.spec.entities], *fields)
        return df

    def count(self) -> int:
        return stats.interaction_count(self.log).first()["count"]

    def matrix(self, row: str = "user", col: str = "item") -> DataFrame:
        """Coalesced: one row per (row, col). Swapped roles give the transposed matrix."""
        return stats.coalesce_repeats(self.log, id_col(row), id_col(col))

    def coo(self, attribute: str | None = None, row: str = "user", col: str = "item"):
        """(rows, cols, values, shape) as NumPy arrays; see :mod:`recmill.data.export`."""
        from recmill.data.export import coordinates

        return coordinates(self, attribute, row, col)

    def structure(self, row: str = "user", col: str = "item") -> DataFrame:
        return self.log.select(id_col(row), id_col(col)).distinct()

    def row(self, value, row: str = "user", col: str = "item") -> DataFrame:
        mine = self.log.where(F.col(id_col(row)) == F.lit(value))  # before anything is grouped
        return stats.coalesce_repeats(mine, id_col(row), id_col(col)).drop(id_col(row))

    def item_lists(self, row: str = "user", col: str = "item") -> DataFrame:
        """Every row entity with its sorted list, also an empty one."""
        e = self.spec.entities[row]
        have = self.structure(row, col).groupBy(id_col(row)).agg(F.array_sort(F.collect_list(id_col(col))).alias("items"))
        return self.ds.entity_tables[e].select(F.col(id_col(e)).alias(id_col(row))).join(have, id_col(row), "left").withColumn("items", F.coalesce("items", F.array()))

    def stats(self, of: str, other: str) -> DataFrame:
        e = self.spec.entities[of]
        ids = self.ds.entity_tables[e].select(F.col(id_col(e)).alias(id_col(of)))
        return stats.entity_stats(ids, self.matrix(of, other), id_col(of), id_col(other))

    def cooccurrences(self, item: str = "item", group: str | None = None, order: list[str] | None = None, diagonal: bool = False) -> DataFrame:
        groups = [group] if group else [r for r in self.spec.entities if r != item]
        if len(groups) != 1:
            raise NotImplementedError("co-occurrence needs one grouping entity")
        if order:
            return stats.ordered_cooccurrence(self.log, id_col(groups[0]), id_col(item), order)
        return stats.cooccurrence(self.log, id_col(groups[0]), id_col(item), diagonal)


class Dataset:
    """Immutable: a schema and one DataFrame per class. Nothing is read before it is asked for."""

    def __init__(self, schema: Schema, entity_tables: dict[str, DataFrame], relation_tables: dict[str, DataFrame]):
        self.schema, self.entity_tables, self.relation_tables = schema, entity_tables, relation_tables
        self._numbers: dict[str, DataFrame] = {}

    @property
    def name(self) -> str | None:
        return self.schema.name

    def entities(self, name: str) -> EntitySet:
        if name not in self.entity_tables:
            raise DataError(f"no entity class {name}")
        return EntitySet(self, name, self.entity_tables[name])

    def relationships(self, name: str) -> RelationshipSet:
        if name not in self.relation_tables:
            raise DataError(f"no relationship class {name}")
        return RelationshipSet(self, name)

    def default_interaction(self) -> str:
        if self.schema.default_interaction:
            return self.schema.default_interaction
        found = [k for k, v in self.schema.relationships.items() if v.interaction]
        if len(found) != 1:
            raise RuntimeError("no default interaction class")
        return found[0]

    def interactions(self, name: str | None = None) -> RelationshipSet:
        return self.relationships(name or self.default_interaction())

    def interaction_table(self, fields: list[str] | None = None, numbers: bool = False) -> DataFrame:
        return self.interactions().table(fields, numbers)

    def interaction_matrix(self, field: str | None = None) -> DataFrame:
        """(user_id, item_id, value): one attribute of the coalesced log, nulls left out, or 1 for every cell."""
        m = self.interactions().matrix()
        return m.select("user_id", "item_id", (F.col(field) if field else F.lit(1.0)).alias("value")).where("value is not null")

    def user_row(self, user) -> DataFrame:
        return self.interactions().row(user)

    def item_stats(self) -> DataFrame:
        self._user_item()
        return self.interactions().stats("item", "user")

    def user_stats(self) -> DataFrame:
        self._user_item()
        return self.interactions().stats("user", "item")

    def _user_item(self) -> None:
        if not {"user", "item"} <= set(self.interactions().spec.entities):
            raise RuntimeError("default interactions are not between users and items")

    def numbering(self, entity: str) -> DataFrame:
        """(id, num) with dense numbers in id order; ids that were added later come after all earlier ones, so numbers
        stay what they are when a dataset is extended."""
        if entity not in self._numbers:
            key, df = id_col(entity), self.entity_tables[entity]
            order = [ADDED, key] if ADDED in df.columns else [key]
            self._numbers[entity] = number_rows(df.select(*order), *order, name=num_col(entity)).select(key, F.col(num_col(entity)).cast("int").alias(num_col(entity)))
        return self._numbers[entity]

    # -- storage

    def save(self, path: str, summary: bool = True) -> None:
        """schema.json and one zstd parquet table per class, replaced; with a summary.md beside them."""
        for name, df in {**self.entity_tables, **self.relation_tables}.items():
            df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}.parquet")
        spark = next(iter(self.entity_tables.values())).sparkSession
        _write_text(spark, f"{path}/schema.json", self.schema.to_json())
        if summary:
            _write_text(spark, f"{path}/summary.md", self.summary())

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Dataset:
        schema = Schema.from_json(_read_text(spark, f"{path}/schema.json"))
        read = lambda names: {n: spark.read.parquet(f"{path}/{n}.parquet") for n in names}
        return cls(schema, read(schema.entities), read(schema.relationships))

    def summary(self) -> str:
        """Markdown: rows, distinct entities per role and values per attribute."""
        out = [f"# {self.name or 'dataset'}", ""]
        for n, df in self.entity_tables.items():
            attributes = [c for c in df.columns if c not in (id_col(n), ADDED)]
            r = df.agg(F.count("*").alias("_n"), *[F.count(c).alias(c) for c in attributes]).first()
            out += [f"## entity {n}", f"- {r['_n']} entities", *[f"- {c}: {r[c]} values" for c in attributes], ""]
        for n, df in self.relation_tables.items():
            roles = list(self.schema.relationships[n].entities)
            attributes = [c for c in df.columns if c != "_ord" and c not in [id_col(r) for r in roles]]
            r = df.agg(F.count("*").alias("_n"), *[F.count_distinct(id_col(x)).alias(f"_d_{x}") for x in roles], *[F.count(c).alias(c) for c in attributes]).first()
            out += [f"## relationship {n}", f"- {r['_n']} rows", *[f"- {x}: {r[f'_d_{x}']} distinct" for x in roles], *[f"- {c}: {r[c]} values" for c in attributes], ""]
        return "\n".join(out)


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _path(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def _read_text(spark: SparkSession, path: str) -> str:
    fs, p = _path(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()
