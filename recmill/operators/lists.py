"""Item lists in long form: (keys, item_id, rank?, score?, fields) with a key frame beside it for empty lists."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recmill.errors import DataWarning, FieldError
from recmill.operators.splitting import hash_order


def missing_to_null(c: Column) -> Column:
    return F.nanvl(c.cast("double"), F.lit(None))


def rank_lists(df: DataFrame, keys: Sequence[str], score: str = "score", n: int | None = None, item: str = "item_id") -> DataFrame:
    """Ordered lists: the best ``n`` by score (null or negative n: all), ties to the smaller item; items without a
    score are left out."""
    known = df.where(missing_to_null(F.col(score)).isNotNull())
    ranked = known.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), item)))
    return ranked if n is None or n < 0 else ranked.where(F.col("rank") <= n)


def argsort_descending(df: DataFrame, keys: Sequence[str], score: str = "score", item: str = "item_id") -> DataFrame:
    return rank_lists(df, keys, score, None, item)


def truncate(df: DataFrame, n: int | None) -> DataFrame:
    if n is None:
        return df
    if "rank" not in df.columns:
        raise ValueError("only ordered lists can be cut")
    return df.where(F.col("rank") <= n)


def slice_lists(df: DataFrame, keys: Sequence[str], start: int | None = None, stop: int | None = None) -> DataFrame:
    """List slice without a step, from 0; negative places count from the end."""
    w = Window.partitionBy(*keys)
    d = df.withColumn("_n", F.count("*").over(w)).withColumn("_p", F.row_number().over(w.orderBy("rank")) - 1)
    at = lambda x, other: F.lit(other) if x is None else F.lit(x) if x >= 0 else F.col("_n") + x
    lo = at(start, 0)
    hi = F.col("_n") if stop is None else at(stop, None)
    return d.where((F.col("_p") >= lo) & (F.col("_p") < hi)).drop("_n", "_p")


def is_in(df: DataFrame, other: DataFrame, keys: Sequence[str], item: str = "item_id", name: str = "isin") -> DataFrame:
    o = other.select(*keys, item).distinct().withColumn(name, F.lit(True))
    return df.join(o, [*keys, item], "left").withColumn(name, F.coalesce(name, F.lit(False)))


def remove_items(df: DataFrame, other: DataFrame, keys: Sequence[str] = (), item: str = "item_id") -> DataFrame:
    """Lists without the items of ``other`` (of the same key, where keys are given); unknown items don't matter."""
    return df.join(other.select(*keys, item).distinct(), [*keys, item], "left_anti")


def update_lists(df: DataFrame, other: DataFrame, keys: Sequence[str], item: str = "item_id") -> DataFrame:
    """Fields of ``other`` replace those of the same item, also with null; its further items are ignored, its new
    fields are null elsewhere."""
    on = [*keys, item]
    fields = [c for c in other.columns if c not in on]
    o = other.dropDuplicates(on).select(*on, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_o_{c}") for c in fields])
    j = df.join(o, on, "left")
    put = [F.when(F.col("_hit"), F.col(f"_o_{c}")).otherwise(F.col(c) if c in df.columns else F.lit(None)).alias(c) for c in fields]
    return j.select(*on, *[c for c in df.columns if c not in on and c not in fields], *put)


def concat_lists(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """b after a, repeats kept; ordered only if both are."""
    if "rank" in a.columns and "rank" in b.columns:
        ends = a.groupBy(*keys).agg(F.max("rank").alias("_end"))
        b = b.join(ends, list(keys), "left").withColumn("rank", (F.col("rank") + F.coalesce("_end", F.lit(0))).cast("int")).drop("_end")
        return a.withColumn("rank", F.col("rank").cast("int")).unionByName(b, allowMissingColumns=True)
    return a.drop("rank").unionByName(b.drop("rank"), allowMissingColumns=True)


def fill_scores(primary: DataFrame, fallback: DataFrame, keys: Sequence[str], item: str = "item_id") -> DataFrame:
    """The primary score where there is one, else the fallback's; the primary's items."""
    f = fallback.select(*keys, item, missing_to_null(F.col("score")).alias("_f"))
    return primary.join(f, [*keys, item], "left").withColumn("score", F.coalesce(missing_to_null(F.col("score")), "_f")).drop("_f")


class ListCollection:
    """Lists with their keys; empty lists are keys without rows. Of lists with the same key the last one counts."""

    def __init__(self, rows: DataFrame, keys: Sequence[str], key_frame: DataFrame | None = None):
        self.keys, self.rows = list(keys), rows
        self.key_frame = (key_frame if key_frame is not None else rows).select(*self.keys).distinct()

    @classmethod
    def from_df(cls, df: DataFrame, keys: Sequence[str] | None = None) -> ListCollection:
        if keys is None:
            keys = [c for c in df.columns if c.endswith("_id") and c != "item_id"]
            warnings.warn(f"no key given, taking {keys}", DataWarning, stacklevel=2)
        if "item_id" not in df.columns and "item_num" not in df.columns:
            raise FieldError("lists need item_id or item_num")
        return cls(df, keys)

    @classmethod
    def from_dict(cls, spark: SparkSession, data: Mapping, keys: Sequence[str], item_type: str = "long") -> ListCollection:
        tup = lambda k: k if isinstance(k, tuple) else (k,)
        kinds = ", ".join(f"{n} {'string' if isinstance(v, str) else 'long'}" for n, v in zip(keys, tup(next(iter(data))), strict=True))
        rows = [(*tup(k), x, i + 1) for k, xs in data.items() for i, x in enumerate(xs)]
        return cls(spark.createDataFrame(rows, f"{kinds}, item_id {item_type}, rank int"), keys, spark.createDataFrame([tup(k) for k in data], kinds))

    def __len__(self) -> int:
        return self.key_frame.count()

    def total_items(self) -> int:
        return self.rows.count()

    def lookup(self, **key) -> DataFrame:
        df = self.rows
        for k, v in key.items():
            df = df.where(F.col(k) == F.lit(v))
        return df.drop(*key)

    def lookup_projected(self, other: ListCollection) -> DataFrame:
        """Rows of this collection for the keys of ``other``, by the key fields that both have."""
        for k in self.keys:
            if k not in other.keys:
                raise TypeError(f"key field {k} is missing")
        return other.key_frame.join(self.rows, self.keys)

    def add_from(self, other: ListCollection, **fields) -> ListCollection:
        rows, kf = other.rows, other.key_frame
        for k, v in fields.items():
            rows, kf = rows.withColumn(k, F.lit(v)), kf.withColumn(k, F.lit(v))
        new = kf.select(*self.keys)
        return ListCollection(self.rows.join(new, self.keys, "left_anti").unionByName(rows, allowMissingColumns=True), self.keys, self.key_frame.unionByName(new))

    def rename_key(self, **names: str) -> ListCollection:
        r = lambda df: df.withColumnsRenamed(names)
        return ListCollection(r(self.rows), [names.get(k, k) for k in self.keys], r(self.key_frame))

    def nested(self) -> DataFrame:
        """(keys, items array<struct>), empty lists included; the array keeps the order of ranks."""
        fields = [c for c in self.rows.columns if c not in self.keys]
        first = [c for c in ("rank", "item_id") if c in fields]
        packed = self.rows.groupBy(*self.keys).agg(F.array_sort(F.collect_list(F.struct(*first, *[c for c in fields if c not in first]))).alias("items"))
        return self.key_frame.join(packed, self.keys, "left").withColumn("items", F.coalesce("items", F.array()))

    def save_parquet(self, path: str, layout: str = "native", compression: str = "zstd") -> None:
        (self.nested() if layout == "native" else self.rows).write.mode("overwrite").option("compression", compression).parquet(path)

    @classmethod
    def load_parquet(cls, spark: SparkSession, path: str | Sequence[str], keys: Sequence[str] | None = None, layout: str = "native") -> ListCollection:
        df = spark.read.parquet(*([path] if isinstance(path, str) else path))
        if layout == "flat":
            if keys is None:
                raise ValueError("flat lists need a key")
            return cls(df, keys)
        keys = [c for c in df.columns if c != "items"]
        return cls(df.select(*keys, F.explode("items").alias("x")).select(*keys, "x.*"), keys, df)

    def to_df(self) -> DataFrame:
        if not self.key_frame.join(self.rows, self.keys, "left_anti").isEmpty():
            warnings.warn("empty lists are dropped", DataWarning, stacklevel=2)
        return self.rows

    def to_json(self) -> DataFrame:
        return self.nested().select(F.to_json(F.struct("*")).alias("json"))

    def record_batches(self, batch_size: int = 5000, columns: Sequence[str] | None = None, layout: str = "native"):
        """Arrow batches, one partition at a time: never all lists at once."""
        import pyarrow as pa

        df = self.nested() if layout == "native" else self.rows
        df = df.select(*columns) if columns else df
        schema, held = None, []
        for row in df.toLocalIterator(prefetchPartitions=True):
            held.append(row.asDict(recursive=True))
            if len(held) == batch_size:
                batch = pa.RecordBatch.from_pylist(held, schema)
                schema, held = batch.schema if schema is None else schema, []
                yield batch
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    def to_arrow(self, layout: str = "native"):
        """Everything as one Arrow table, for collections that fit on the driver."""
        return (self.nested() if layout == "native" else self.rows).toArrow()

    @classmethod
    def from_arrow(cls, spark: SparkSession, table, keys: Sequence[str] | None = None) -> ListCollection:
        """From an Arrow table of nested lists (a column ``items``) or of flat rows."""
        df = spark.createDataFrame(table)
        if "items" not in df.columns:
            return cls.from_df(df, keys)
        keys = list(keys or [c for c in df.columns if c != "items"])
        return cls(df.select(*keys, F.explode("items").alias("x")).select(*keys, "x.*"), keys, df)

    def columns_or_null(self, columns: Sequence[str]) -> DataFrame:
        """The named columns of the rows; unknown ones are null, with a warning."""
        unknown = [c for c in columns if c not in self.rows.columns]
        if unknown:
            warnings.warn(f"no columns {unknown}: null", DataWarning, stacklevel=2)
        return self.rows.select(*[F.lit(None).alias(c) if c in unknown else F.col(c) for c in columns])

    def to_dataset(self, cls: str = "interaction"):
        from recmill.data.builder import DatasetBuilder

        b = DatasetBuilder(self.rows.sparkSession)
        ids = [k for k in self.keys if k.endswith("_id")]
        b.add_interactions(cls, self.rows.select(*ids, *[c for c in self.rows.columns if c not in self.keys]).drop("rank"), entities=[k[:-3] for k in ids] + ["item"], missing="insert")
        return b.build()

    def sample(self, n: int, seed=0) -> ListCollection:
        """n lists drawn with replacement, exactly n draws; all lists if there are no more than n. The column ``draw`` tells
        draws of the same list apart and becomes part of the key."""
        from recmill.operators.order import number_rows

        if len(self) <= n:
            return self
        numbered, size = number_rows(self.key_frame, *self.keys, name="_num"), len(self)
        draws = self.rows.sparkSession.range(n).select(F.col("id").cast("int").alias("draw")).withColumn("_num", F.conv(F.substring(F.md5(F.concat_ws("|", "draw", F.lit(str(seed)))), 1, 12), 16, 10).cast("long") % size)
        picked = draws.join(numbered, "_num").select(*self.keys, "draw")
        return ListCollection(self.rows.join(picked, self.keys), [*self.keys, "draw"], picked)


# -- candidates, random choices, reranking


def candidates(queries: DataFrame, items: DataFrame, seen: DataFrame | None, key: str = "user_id", item: str = "item_id") -> DataFrame:
    """Every item for every query but those in ``seen(key, item)``. The result is the product by its nature; score
    and cut it in the same plan, or use a scorer that makes only the candidates it can score."""
    every = queries.select(key).distinct().crossJoin(items.select(item).distinct())
    return every if seen is None else every.join(seen.select(key, item).distinct(), [key, item], "left_anti")


def candidate_counts(queries: DataFrame, items: DataFrame, seen: DataFrame | None, key: str = "user_id", item: str = "item_id") -> DataFrame:
    """(key, n): how many rows ``candidates`` has for each query, by counts alone; queries without any are left out."""
    every = items.select(item).distinct()
    asked = queries.select(key).distinct().crossJoin(F.broadcast(every.agg(F.count("*").alias("_all"))))
    if seen is None:
        return asked.where("_all > 0").select(key, F.col("_all").alias("n"))
    known = seen.select(key, item).distinct().join(every, item, "left_semi").groupBy(key).agg(F.count("*").alias("_k"))
    return asked.join(known, key, "left").select(key, (F.col("_all") - F.coalesce("_k", F.lit(0))).alias("n")).where("n > 0")


def random_items(df: DataFrame, keys: Sequence[str], n: int | None = None, seed=0, item: str = "item_id") -> DataFrame:
    """n items of each list without replacement, in random order; all without n."""
    d = df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(hash_order(seed, *keys, item), item)))
    return d if n is None or n < 0 else d.where(F.col("rank") <= n)


def uniform(seed, *keys: str) -> Column:
    """A number in (0, 1) from the hash of seed and keys, the same in any engine with md5."""
    return (F.conv(F.substring(hash_order(seed, *keys), 1, 12), 16, 10).cast("double") + 0.5) / float(16**12)


def rescale(df: DataFrame, keys: Sequence[str], transform: str | None = "softmax", scale: float = 1.0, score: str = "score", name: str = "weight") -> DataFrame:
    """Scores as weights: softmax, linear (min-max, then sum 1; equal scores are uniform) or None (negatives to 0)."""
    w = Window.partitionBy(*keys)
    s = F.col(score).cast("double") * scale
    if transform == "softmax":
        d = df.withColumn("_e", F.exp(s - F.max(s).over(w)))
        return d.withColumn(name, F.col("_e") / F.sum("_e").over(w)).drop("_e")
    if transform == "linear":
        lo, hi = F.min(s).over(w), F.max(s).over(w)
        d = df.withColumn("_e", F.when(hi > lo, (s - lo) / (hi - lo)).otherwise(1.0))
        return d.withColumn(name, F.col("_e") / F.sum("_e").over(w)).drop("_e")
    return df.withColumn(name, F.greatest(s, F.lit(0.0)))


def stochastic_top_n(df: DataFrame, keys: Sequence[str], n: int | None = None, transform: str | None = "softmax", scale: float = 1.0, seed=0, item: str = "item_id") -> DataFrame:
    """Sampling without replacement in proportion to the weights: the n greatest keys ln(U) / weight."""
    known = df.where(missing_to_null(F.col("score")).isNotNull() & (F.abs("score") < float("inf")))
    d = rescale(known, keys, transform, scale)
    d = d.withColumn("_key", F.log(uniform(seed, *keys, item)) / F.greatest("weight", F.lit(2.2250738585072014e-308)))
    d = d.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_key"), item))).drop("_key")
    return d if n is None or n < 0 else d.where(F.col("rank") <= n)


def sample_negatives(rows: DataFrame, observed: DataFrame, items: DataFrame, n: int = 1, attempts: int = 10, popular: bool = False, verify: bool = True, seed: int = 0, key: str = "user_id", item: str = "item_id") -> DataFrame:
    """(row columns, draw, item): n items per row that its key was not observed with.

    A draw is by hash (uniformly from ``items``, or by popularity: the item of a random observation). Where the
    first one hits an observed item, the further ``attempts`` are made at once and the first good one, or else
    the last, is kept.
    """
    from recmill.operators.order import number_rows
    from recmill.session import cut

    pool = cut(number_rows(observed.select(key, item) if popular else items.select(item).distinct(), *([key, item] if popular else [item]), name="_i"), "pool")
    size = pool.count()
    cases = number_rows(rows, *rows.columns, name="_case").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    seen = observed.select(key, item).distinct().withColumn("_bad", F.lit(True))

    def drawn(df: DataFrame) -> DataFrame:
        at = F.conv(F.substring(hash_order(seed, "_case", "draw", "_a"), 1, 12), 16, 10).cast("long") % F.lit(size)
        return df.withColumn("_i", at).join(pool.select("_i", item), "_i").drop("_i")

    first = drawn(cases.withColumn("_a", F.lit(0)))
    if not verify or attempts < 2:
        return first.drop("_case", "_a")
    first = cut(first.join(seen, [key, item], "left"), "drawn")
    again = drawn(first.where("_bad").drop(item, "_bad").withColumn("_a", F.explode(F.sequence(F.lit(1), F.lit(attempts - 1))))).join(seen, [key, item], "left")
    kept = Window.partitionBy("_case", "draw").orderBy(F.coalesce(F.col("_bad"), F.lit(False)) & (F.col("_a") < attempts - 1), "_a")
    again = again.withColumn("_k", F.row_number().over(kept)).where("_k = 1").drop("_k")
    return first.where("_bad is null").unionByName(again).drop("_case", "_a", "_bad")
