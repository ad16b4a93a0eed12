"""Per-key results when a few keys own most of the rows.

Rows are range-partitioned on (key, order), so a hot key is spread over as many partitions as its
size asks for. Keys are counted per partition, the counts become prefix-sum offsets, every row has
its exact number within its key, and each key is processed in chunks of equal size. A chunk leaves
one small state; the states of a key, in order, are merged into its result, with what happens at the
seams (here: the step from one chunk's last value to the next one's first).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recmill.session import cut, drop_cut

#: Rows of one key that are processed together.
CHUNK_ROWS = 50_000
#: Keys above one chunk that the driver may hold; beyond about ``CHUNK_ROWS`` times as many rows, chunks grow.
MAX_LONG_KEYS = 200_000

_STATE = (
    "key_field string, key_value bigint, chunk bigint, seq bigint, n bigint, n_values bigint, total double, "
    "rises bigint, first_value double, last_value double, first_order bigint, last_order bigint"
)


def _stretches(long_keys: dict[tuple[int, int, int], tuple[int, int]], chunk_rows: int):
    """Arrow function: sorted rows with their place in their part in; one state for each stretch of a key
    within a chunk out, as far as a batch reaches.

    ``long_keys`` has, for each (part, field, key) of a key above one chunk, its first row in the part and
    how many of its rows lie in earlier parts: with them the number of any row within its key follows from
    its place alone, wherever a task begins to read. Keys of one chunk need no number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            col = {name: b.column(i) for i, name in enumerate(b.schema.names)}
            part, row, field, key = (col[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("part", "row", "field", "key"))
            order = col["o"].fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
            value = col["v"].fill_null(np.nan).to_numpy(zero_copy_only=False)
            new = np.append(True, (part[1:] != part[:-1]) | (field[1:] != field[:-1]) | (key[1:] != key[:-1]))
            first = np.flatnonzero(new)
            chunk = np.zeros(len(key), np.int64)
            for a, z in zip(first, np.append(first[1:], len(key)), strict=True) if long_keys else ():
                at = long_keys.get((int(part[a]), int(field[a]), int(key[a])))
                if at is not None:
                    chunk[a:z] = (row[a:z] - at[0] + at[1]) // chunk_rows
            new[1:] |= chunk[1:] != chunk[:-1]
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(key)) - 1
            piece = np.cumsum(new) - 1
            known = np.flatnonzero(~np.isnan(value))
            of, v = piece[known], value[known]
            n_known = np.bincount(of, minlength=len(first))
            rises = np.bincount(of[1:], weights=(of[1:] == of[:-1]) & (v[1:] > v[:-1]), minlength=len(first)).astype(np.int64) if len(v) else np.zeros(len(first), np.int64)
            total = np.bincount(of, weights=v, minlength=len(first))
            end = np.cumsum(n_known)
            some = n_known > 0
            first_value, last_value = (np.where(some, np.append(v, 0.0)[np.where(some, at, len(v))], np.nan) for at in (end - n_known, end - 1))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(field[first].astype(str)),
                    *(pa.array(x, pa.int64()) for x in (key[first], chunk[first], (part[first] << 40) | row[first], last - first + 1, n_known)),
                    pa.array(total, pa.float64()),
                    pa.array(rises, pa.int64()),
                    *(pa.array(x, pa.float64(), from_pandas=True) for x in (first_value, last_value)),
                    *(pa.array(order[x], pa.int64()) for x in (first, last)),
                ],
                names=[x.split()[0] for x in _STATE.split(", ")],
            )

    return run


def chunk_states(df: DataFrame, keys: Sequence[str], value: str, order: str, ties: Sequence[str] = (), chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One state per (key field, key, chunk stretch) of ``df``; see :func:`key_summaries` for the arguments."""
    spark = df.sparkSession
    ts = F.col(order)
    if dict(df.dtypes)[order].startswith("timestamp"):
        ts = F.unix_micros(ts.cast("timestamp"))
    parts = [
        df.select(F.lit(i).alias("field"), F.col(k).cast("long").alias("key"), ts.cast("long").alias("o"), *[F.col(c).cast("long").alias(f"t{j}") for j, c in enumerate(ties)], F.col(value).cast("double").alias("v")).where(F.col("key").isNotNull())
        for i, k in enumerate(keys)
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    sort = ["field", "key", "o", *[f"t{j}" for j in range(len(ties))], "v"]
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = cut(rows.repartitionByRange(n, *sort).sortWithinPartitions(*sort).select("field", "key", "o", "v"), "ordered")
    # a row's part is in the name of its file and its place in the part is its index there, however the
    # file is later split into tasks
    placed = ordered.select(F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)-", 1).cast("int").alias("part"), F.col("_metadata.row_index").alias("row"), "field", "key", "o", "v")
    counts = cut(placed.groupBy("part", "field", "key").agg(F.count("*").alias("n"), F.min("row").alias("at")), "counts")
    every = counts.agg(F.sum("n")).first()[0] or 0
    chunk_rows = max(chunk_rows, -(-every // MAX_LONG_KEYS))
    whole = Window.partitionBy("field", "key")
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # keys above one chunk: at most rows / chunk_rows of them, so MAX_LONG_KEYS, and one entry more for each part
    long_keys = counts.withColumn("of", F.sum("n").over(whole)).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).where(F.col("of") > chunk_rows)
    found = {(r["part"], r["field"], r["key"]): (r["at"], r["start"]) for r in long_keys.select("part", "field", "key", "at", "start").collect()}
    drop_cut(counts)
    states = placed.mapInArrow(_stretches(found, chunk_rows), _STATE)
    names = F.create_map(*[x for i, k in enumerate(keys) for x in (F.lit(str(i)), F.lit(k))])
    return states.withColumn("key_field", names[F.col("key_field")])


def key_summaries(df: DataFrame, keys: Sequence[str], value: str, order: str, ties: Sequence[str] = (), chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Per key of each field in ``keys``: rows, values, mean, first and last value and time, and how often
    the value rose from one row to the next, in the order of (``order``, ``ties``, ``value``).

    No task handles more than one partition's share, whatever a key's size: the only rows that meet per
    key are its chunk states.

    Nulls: rows with a null key belong to no key; null or NaN values count as rows, not as values; null
    order values come first. Repeated rows count as often as they are stored. An empty table gives no
    rows. Other columns of ``df`` are not read, so their names don't matter.
    """
    states = chunk_states(df, keys, value, order, ties, chunk_rows)
    seq = Window.partitionBy("key_field", "key_value").orderBy("seq")
    # a stretch without a value passes the last known one on
    prior = F.last("last_value", ignorenulls=True).over(seq.rowsBetween(Window.unboundedPreceding, -1))
    low = F.lit(np.iinfo(np.int64).min)
    return (
        states.withColumn("seam", F.when(F.col("first_value") > prior, 1).otherwise(0))
        .groupBy("key_field", "key_value")
        .agg(
            F.sum("n").alias("n_rows"),
            F.sum("n_values").alias("n_values"),
            F.try_divide(F.sum("total"), F.sum("n_values")).alias("mean_value"),
            F.sum(F.col("rises") + F.col("seam")).alias("rises"),
            F.max_by("last_value", F.when(F.col("last_value").isNotNull(), F.col("seq"))).alias("last_value"),
            F.max(F.when(F.col("last_order") != low, F.col("last_order"))).alias("last_order"),
            F.max("chunk").alias("last_chunk"),
        )
    )


def prefix_sum(df: DataFrame, keys: Sequence[str], order: Column, value: str, name: str, buckets: int = 256) -> DataFrame:
    """Exclusive running sum of ``value`` within ``keys`` in hash order of ``order``, in two levels.

    A key's rows are spread over ``buckets`` by hash; bucket totals give each bucket its offset and only
    one bucket's rows meet in a task, so a key with a third of all rows stays divided.
    """
    h = df.withColumn("_h", F.xxhash64(order)).withColumn("_b", F.pmod(F.shiftright("_h", 20), F.lit(buckets)))
    totals = h.groupBy(*keys, "_b").agg(F.sum(value).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*keys, "_b").orderBy("_h", order).rowsBetween(Window.unboundedPreceding, -1)
    return h.join(offsets, [*keys, "_b"]).withColumn(name, F.col("_off") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("_h", "_b", "_off")
