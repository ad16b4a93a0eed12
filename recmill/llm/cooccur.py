"""Problem 5: items that appear together, by external sort of packed pair codes.

Baskets become 64-bit codes of item pairs. Tasks sort the codes of a bounded buffer and write the run
out as (code, count); Spark's shuffle spills and merges the runs, so that equal codes lie beside each
other, and a run-length pass adds them up. Large baskets are cut into blocks; every pair of blocks is a
join key of its own, so the pairs of one basket are made in as many tasks as it has pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recmill.operators.pairs import small_side
from recmill.session import cut, drop_cut

#: Items in a block of a basket; a piece of work makes at most about the square of it pairs.
BLOCK = 512
#: Codes in a task's buffer before it is sorted and written out as a run.
BUFFER = 2_000_000


def pair_code(a: Column, b: Column) -> Column:
    """Two int32 ids as one int64, the smaller first."""
    return F.shiftleft(F.least(a, b).cast("long"), 32).bitwiseOR(F.greatest(a, b).cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))


def code_pair(code: Column) -> tuple[Column, Column]:
    return F.shiftright(code, 32).cast("int"), F.shiftright(F.shiftleft(code, 32), 32).cast("int")


def _emit(codes: np.ndarray, weights: np.ndarray | None) -> pa.RecordBatch:
    order = np.argsort(codes, kind="stable") if weights is not None else None
    c = np.sort(codes) if order is None else codes[order]
    first = np.flatnonzero(np.append(True, c[1:] != c[:-1])) if len(c) else np.zeros(0, int)
    n = np.diff(np.append(first, len(c))) if order is None else np.add.reduceat(weights[order], first) if len(c) else np.zeros(0, int)
    return pa.RecordBatch.from_arrays([pa.array(c[first], pa.int64()), pa.array(n, pa.int64())], names=["code", "n"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted runs of the pairs between two blocks (or within one, where they are the same)."""
    held, size = [], 0
    for batch in batches:
        left, right, same = batch.column("left"), batch.column("right"), batch.column("same").to_numpy(zero_copy_only=False)
        for i in range(batch.num_rows):
            x = left[i].values.to_numpy(zero_copy_only=False).astype(np.int64)
            if same[i]:
                p, q = np.triu_indices(len(x), 1)
                a, b = x[p], x[q]
            else:
                y = right[i].values.to_numpy(zero_copy_only=False).astype(np.int64)
                a, b = np.repeat(x, len(y)), np.tile(y, len(x))
            held.append((np.minimum(a, b) << 32) | (np.maximum(a, b) & 0xFFFFFFFF))
            size += len(a)
            if size >= BUFFER:
                yield _emit(np.concatenate(held), None)
                held, size = [], 0
    if held:
        yield _emit(np.concatenate(held), None)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Run lengths over codes in order; a code that goes on in the next batch is carried there."""
    code, n = None, 0
    for b in batches:
        if not b.num_rows:
            continue
        c, w = b.column("code").to_numpy(), b.column("n").to_numpy()
        first = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
        sums, codes = np.add.reduceat(w, first), c[first]
        if code is not None and codes[0] == code:
            sums[0] += n
        elif code is not None:
            yield pa.RecordBatch.from_arrays([pa.array([code], pa.int64()), pa.array([n], pa.int64())], names=["code", "n"])
        code, n = int(codes[-1]), int(sums[-1])
        yield pa.RecordBatch.from_arrays([pa.array(codes[:-1], pa.int64()), pa.array(sums[:-1], pa.int64())], names=["code", "n"])
    if code is not None:
        yield pa.RecordBatch.from_arrays([pa.array([code], pa.int64()), pa.array([n], pa.int64())], names=["code", "n"])


def merge_runs(runs: DataFrame) -> DataFrame:
    """Add up ``runs(code, n)`` by code: hash exchange, external sort, run-length count."""
    return runs.repartition("code").sortWithinPartitions("code").mapInArrow(_merged, "code long, n long")


def basket_pairs(pairs: DataFrame, basket: str, item: str, min_count: int = 1, min_lift: float = 0.0) -> DataFrame:
    """(item_a, item_b, n_both, n_a, n_b, n_baskets, lift, log_odds) for item_a < item_b in ``min_count`` or more baskets.

    lift is n_both * n_baskets / (n_a * n_b); log_odds is the logarithm of the odds ratio with half a
    basket added to each cell (continuity correction). An item in fewer than ``min_count`` baskets, or in
    so many that no pair with it can reach ``min_lift``, is left out before pairs are made; both bounds
    are exact. Rows with a null basket or item don't count; repeated rows count once; ids are int32.
    """
    rows = pairs.where(F.col(basket).isNotNull() & F.col(item).isNotNull()).select(F.col(basket).alias("g"), F.col(item).cast("int").alias("i")).distinct()
    rows = cut(rows, "baskets")
    n_baskets = rows.agg(F.count_distinct("g")).first()[0]
    sizes = rows.groupBy("i").agg(F.count("*").alias("n"))
    usable = cut(sizes.where((F.col("n") >= min_count) & (F.col("n") * min_lift <= n_baskets)), "items")
    kept = rows.join(small_side(usable.select("i")), "i", "left_semi")
    # pieces of a basket by hash, so that no basket has to be brought together to be divided
    pieces = kept.groupBy("g").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("k")).where("k > 1")
    cutup = kept.join(small_side(pieces), "g", "left").select("g", "i", F.coalesce(F.pmod(F.xxhash64("i"), F.col("k").cast("long")).cast("int"), F.lit(0)).alias("b"), F.coalesce("k", F.lit(1)).alias("k"))
    blocks = cut(cutup.groupBy("g", "b").agg(F.collect_list("i").alias("x"), F.first("k").alias("k")), "blocks")
    drop_cut(rows)
    inside = blocks.select(F.col("x").alias("left"), F.array().cast("array<int>").alias("right"), F.lit(True).alias("same"))
    many = blocks.where("k > 1")
    left = many.where("b < k - 1").select("g", F.col("b").alias("b1"), F.explode(F.sequence(F.col("b") + 1, F.col("k") - 1)).alias("b2"), F.col("x").alias("left"))
    right = many.where("b > 0").select("g", F.explode(F.sequence(F.lit(0), F.col("b") - 1)).alias("b1"), F.col("b").alias("b2"), F.col("x").alias("right"))
    across = left.join(right, ["g", "b1", "b2"])
    work = inside.unionByName(across.select("left", "right", F.lit(False).alias("same")))
    a, b = code_pair(F.col("code"))
    both = merge_runs(work.mapInArrow(_runs, "code long, n long")).where(F.col("n") >= min_count).select(a.alias("item_a"), b.alias("item_b"), F.col("n").alias("n_both"))
    out = both.join(usable.select(F.col("i").alias("item_a"), F.col("n").alias("n_a")), "item_a").join(usable.select(F.col("i").alias("item_b"), F.col("n").alias("n_b")), "item_b")
    out = out.withColumn("n_baskets", F.lit(n_baskets).cast("long"))
    return _measures(out, "n_both", "n_a", "n_b", "n_baskets").where(F.col("n_both") * F.col("n_baskets") >= F.col("n_a") * F.col("n_b") * min_lift)


def _measures(df: DataFrame, both: str, a: str, b: str, of: str) -> DataFrame:
    c, na, nb, n = (F.col(x).cast("double") for x in (both, a, b, of))
    rest = F.greatest(n - na - nb + c, F.lit(0.0))
    odds = ((c + 0.5) * (rest + 0.5)) / ((F.greatest(na - c, F.lit(0.0)) + 0.5) * (F.greatest(nb - c, F.lit(0.0)) + 0.5))
    return df.withColumn("lift", c * n / (na * nb)).withColumn("log_odds", F.log(odds))


def counter_pairs(entries: DataFrame, row: str, col: str, hits: str, min_hits: int = 1, min_lift: float = 0.0) -> DataFrame:
    """(item_a, item_b, hits, hits_a, hits_b, hits_all, lift, log_odds) from the entries of pair counters.

    Whole rows that are stored twice count once; both directions of a pair are added; null hits are 1;
    entries with a null item or of an item with itself are left out, also from the totals.
    """
    e = entries.distinct().where(f"`{row}` is not null and `{col}` is not null and `{row}` <> `{col}`").select(F.col(row).cast("int").alias("r"), F.col(col).cast("int").alias("c"), F.coalesce(F.col(hits).cast("long"), F.lit(1)).alias("h"))
    e = cut(e, "entries")
    all_hits = e.agg(F.sum("h")).first()[0] or 0
    runs = e.groupBy(pair_code(F.col("r"), F.col("c")).alias("code")).agg(F.sum("h").alias("n"))
    a, b = code_pair(F.col("code"))
    both = merge_runs(runs).where(F.col("n") >= min_hits).select(a.alias("item_a"), b.alias("item_b"), F.col("n").alias("hits"))
    one = e.select(F.explode(F.array("r", "c")).alias("i"), "h").groupBy("i").agg(F.sum("h").alias("m"))
    out = both.join(one.select(F.col("i").alias("item_a"), F.col("m").alias("hits_a")), "item_a").join(one.select(F.col("i").alias("item_b"), F.col("m").alias("hits_b")), "item_b")
    out = out.withColumn("hits_all", F.lit(all_hits).cast("long"))
    return _measures(out, "hits", "hits_a", "hits_b", "hits_all").where(F.col("hits") * F.col("hits_all") >= F.col("hits_a") * F.col("hits_b") * min_lift)
