"""Problem 4: all pairs of records whose sets overlap at least so much, by sorted sketch forests.

A forest has many independent trees. In each, a set's minhash signature is a sequence of levels, and the
sets are ordered lexicographically by it; sets with a common prefix lie beside each other. A pair of
similarity s shares the first d levels of a tree with probability s ** d. Neighbourhoods begin at a depth
that the threshold sets (``plan_forest``). One that holds more than CROWD sets deepens: it is divided by
the next level, and again, down to DEEPER levels below its start. A set keeps account of the depths at which
its neighbours were compared with it, that is of the chance that a partner exactly at the threshold was missed
by all trees so far; sets for which it is still above 1 - target, because their neighbourhoods were crowded, go
through further trees, among themselves, until none is left. A neighbourhood that is crowded at its deepest
is compared whole, in blocks over many tasks. All neighbours are verified on the sets themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recmill.operators.pairs import group_pairs, join_groups
from recmill.session import cut, drop_cut

#: Chance that a pair exactly at the threshold is found.
TARGET_RECALL = 0.9995
#: Chance that an unrelated pair of similarity UNRELATED meets in a tree, at most; sets the depth.
UNRELATED, MEETS = 0.1, 1e-4
#: Sets in a neighbourhood above which it deepens, and the levels that it can deepen by.
CROWD, DEEPER = 64, 2
#: Bits of a level in a key; what they leave of 63 bits holds the number of a tree.
LEVEL_BITS = 9
#: Share of trees above the least number, so that a few crowded neighbourhoods don't call for another round.
SPARE = 0.05
#: Base in which an account packs a depth and a number of neighbours.
SEEN = 1 << 40
#: Rows of one neighbourhood that a task holds before it deepens without having seen its end.
HELD = 1_000_000


def plan_forest(min_sim: float, target: float = TARGET_RECALL) -> tuple[int, int]:
    """(depth at which neighbourhoods begin, trees) for a threshold."""
    depth = max(1, math.ceil(math.log(MEETS) / math.log(UNRELATED)))
    while depth > 1 and min_sim**depth < 0.05:
        depth -= 1
    p = min_sim**depth
    return depth, 1 if p >= 1 else max(1, math.ceil((1 + SPARE) * math.log(1 - target) / math.log(1 - p)))


def _log_miss(min_sim: float, depth: int) -> float:
    """Logarithm of the chance that a pair at the threshold doesn't share ``depth`` levels of a tree."""
    return math.log1p(-min(min_sim**depth, 1 - 1e-12))


def _mix(x: np.ndarray) -> np.ndarray:
    """32-bit finaliser."""
    with np.errstate(over="ignore"):
        z = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
        z = (z ^ (z >> np.uint32(15))) * np.uint32(0x846CA68B)
        return z ^ (z >> np.uint32(16))


def _sketches(first: int, trees: int, start: int, deepest: int, pieces: int, slots: int):
    """Arrow function: (id, n, members) in; (slot, key, id, n) for every tree out.

    A key holds the tree's number in this round in its highest bits, then the levels, so that keys order trees
    and signatures at once. Slots are ranges of (tree, first ``start``
    levels): whole trees, or ``pieces`` equal ranges of a tree, as levels are evenly spread hashes.
    """
    draw = np.random.default_rng([7, first])
    factor = draw.integers(0, 2**32, (trees, deepest), dtype=np.uint32) | np.uint32(1)
    shift = draw.integers(0, 2**32, (trees, deepest), dtype=np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            members = b.column("members")
            starts = members.offsets.to_numpy()[:-1] - members.offsets.to_numpy()[0]
            m = members.flatten().to_numpy(zero_copy_only=False).astype(np.uint64)
            base = _mix(_mix((m & np.uint64(0xFFFFFFFF)).astype(np.uint32)) ^ (m >> np.uint64(32)).astype(np.uint32))
            ids, n = b.column("id"), b.column("n")
            for t in range(trees):
                key = np.full(len(starts), t, np.int64)
                for level in range(deepest):
                    with np.errstate(over="ignore"):
                        least = np.minimum.reduceat((base ^ shift[t, level]) * factor[t, level], starts)
                    key = (key << LEVEL_BITS) | (_mix(least) >> np.uint32(32 - LEVEL_BITS)).astype(np.int64)
                head = (key >> (LEVEL_BITS * (deepest - start))) & ((1 << (LEVEL_BITS * start)) - 1)
                slot = np.full(len(starts), t * slots // trees) if pieces == 1 else t * pieces + head * pieces // (1 << (LEVEL_BITS * start))
                yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int32()), pa.array(key), ids, n], names=["slot", "key", "id", "n"])

    return run


def _same(key: np.ndarray, drop_levels: int) -> np.ndarray:
    """Where a row shares tree and all but ``drop_levels`` levels with the row before it."""
    k = key >> (LEVEL_BITS * drop_levels)
    return np.append(False, k[1:] == k[:-1])


def _neighbours(min_sim: float, start: int, deepest: int):
    """Arrow function: rows ordered by key in; (what, a, b) out.

    what 0: a pair of neighbours whose sizes permit min_sim. what 1: set a shared the start of a tree with
    b % SEEN others, and was compared at depth b // SEEN. what -1: set a is in the crowd that shares the whole key b.
    """
    levels = range(start, deepest + 1)

    def compared(key, ids, n, floors: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
        """``floors`` (prefix, depth): rows that continue a crowded prefix begin at no less than that depth."""
        size = len(key)
        depth, run_of = np.zeros(size, np.int64), np.zeros(size, np.int64)
        low = np.zeros(size, np.int64)
        for prefix, d in floors:
            on = key >> (LEVEL_BITS * (deepest - d + 1)) == prefix
            low[on] = np.maximum(low[on], d)
        for d in levels:
            run = np.cumsum(~_same(key, deepest - d)) - 1
            many = np.bincount(run)[run]
            if d == start:
                others = many - 1
            now = (depth == 0) & (many <= CROWD) & (d >= low)
            depth[now], run_of[now] = d, run[now] * (deepest + 2) + d
        crowd = depth == 0
        out = []
        if crowd.any():
            out.append((np.full(crowd.sum(), -1, np.int64), ids[crowd], key[crowd]))
            depth[crowd] = deepest
        shared = others > 0
        if shared.any():
            out.append((np.ones(shared.sum(), np.int64), ids[shared], depth[shared] * SEEN + others[shared]))
        at = np.flatnonzero(~crowd)
        run = run_of[at]
        k = 1
        left = np.arange(len(at))
        while True:
            left = left[left + k < len(at)]
            left = left[run[left] == run[left + k]]
            if not len(left):
                break
            x, y = at[left], at[left + k]
            fit = np.minimum(n[x], n[y]) >= np.maximum(n[x], n[y]) * min_sim
            x, y = x[fit], y[fit]
            out.append((np.zeros(len(x), np.int64), np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y])))
            k += 1
        for what, a, b in out:
            yield pa.RecordBatch.from_arrays([pa.array(what), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["what", "a", "b"])

    def continued(key: int, to: int) -> list[tuple[int, int]]:
        """Floors for rows that go on after a cut at a change of level ``to``: all shorter prefixes are crowded."""
        return [(key >> (LEVEL_BITS * (deepest - d + 1)), d) for d in range(start + 1, to + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, floors = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "id", "n")]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            # the last neighbourhood may go on in the next batch; a very long one is cut where a deeper level changes
            for d in levels if len(held[0]) > HELD else (start,):
                edge = np.flatnonzero(~_same(held[0], deepest - d))[-1]
                if edge > 0:
                    yield from compared(*[x[:edge] for x in held], floors)
                    held = [x[edge:] for x in held]
                    floors = [f for f in floors if held[0][0] >> (LEVEL_BITS * (deepest - f[1] + 1)) == f[0]] + continued(int(held[0][0]), d)
                    break
            else:
                if len(held[0]) > HELD:  # one crowd down to the deepest level
                    floors = floors + continued(int(held[0][0]), deepest + 1)
                    yield from compared(*held, floors)
                    held = None
        if held is not None:
            yield from compared(*held, floors)

    return run


def distinct_sets(df: DataFrame, record: str, members: str) -> tuple[DataFrame, DataFrame]:
    """(sets, copies): ``sets(id, n, members)`` has each distinct non-empty set once, under the least id of its
    records; ``copies(id, record)`` has the records of every set. Sets are equal if the SHA-256 of their
    sorted members is."""
    m = F.array_sort(F.array_distinct(F.filter(F.col(members).cast("array<bigint>"), lambda x: x.isNotNull())))
    rows = df.where(F.col(record).isNotNull() & F.col(members).isNotNull()).select(F.col(record).cast("long").alias("record"), m.alias("members")).where(F.size("members") > 0)
    keyed = cut(rows.withColumn("h", F.unhex(F.sha2(F.array_join(F.col("members").cast("array<string>"), ","), 256))), "hashed")
    first = cut(keyed.groupBy("h").agg(F.min("record").alias("id"), F.count("*").alias("c")), "first")
    named = cut(join_groups(keyed, first, ["h"], "c").select("id", "record", F.when(F.col("record") == F.col("id"), F.col("members")).alias("members")), "sets")
    drop_cut(keyed)
    drop_cut(first)
    # a record that is stored twice with the same set is one copy
    sets = named.where("record = id").dropDuplicates(["id"]).select("id", F.size("members").alias("n"), "members")
    return sets, named.select("id", "record").distinct()


def _forest(sets: DataFrame, min_sim: float, first: int, trees: int, start: int, deepest: int) -> DataFrame:
    """What the trees from number ``first`` on find: (what, a, b) as of :func:`_neighbours`."""
    parts = max(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    pieces = max(1, parts // trees)
    slots = trees * pieces if pieces > 1 else min(parts, trees)
    # minhash is worth spreading out even where the input is one small file
    rows = sets.repartition(parts, "id").select("id", "n", "members").mapInArrow(_sketches(first, trees, start, deepest, pieces, slots), "slot int, key long, id long, n int")
    # one 64-bit sort key: Spark sorts it by radix
    ordered = rows.repartitionById(slots, "slot").sortWithinPartitions("key")
    return ordered.select("key", "id", "n").mapInArrow(_neighbours(min_sim, start, deepest), "what long, a long, b long")


def similar_sets(sets: DataFrame, min_sim: float, target: float = TARGET_RECALL) -> DataFrame:
    """(a, b, sim) for a < b, the pairs of different sets with Jaccard similarity >= ``min_sim``.

    Every pair at the threshold is found with probability ``target``, those above it with a higher one;
    no pair below it is returned. ``sets`` comes from :func:`distinct_sets`.
    """
    if not 0 < min_sim <= 1:
        raise ValueError("min_sim must be above 0 and at most 1")
    start, trees = plan_forest(min_sim, target)
    most = 1 << (63 - LEVEL_BITS * (start + DEEPER))  # trees of a round: what is left of a key's bits
    if trees > most:
        raise ValueError(f"a threshold of {min_sim} needs more than {most} trees")
    deepest, goal, first, todo, before, found = start + DEEPER, math.log(1 - target) + 1e-9, 0, sets, None, None
    while True:
        got = cut(_forest(todo, min_sim, first, trees, start, deepest), "forest")
        crowds = group_pairs(got.where("what < 0").select(F.col("b").alias("g"), F.col("a").alias("i")), "g", ["i"])
        near = got.where("what = 0").select("a", "b").unionByName(crowds.select(F.least("i_l", "i_r").alias("a"), F.greatest("i_l", "i_r").alias("b")))
        found = near if found is None else found.unionByName(near)
        # how a set's neighbours, each counting alike, were compared says how a partner would be: at depth d with
        # chance min_sim ** d in a tree; the logarithms of missing it add up over the rounds
        depth, others = F.expr(f"b div {SEEN}"), F.expr(f"b % {SEEN}")
        told = got.where("what = 1").groupBy(F.col("a").alias("id")).agg(F.max(depth).alias("deepest"), (F.sum(others * F.pow(F.lit(min_sim), depth)) / F.sum(others)).alias("p"))
        p = F.coalesce("p", F.lit(min_sim**start)) if before is not None else F.col("p")
        told = told.join(before, "id", "right") if before is not None else told.where(F.col("deepest") > start).withColumn("miss", F.lit(0.0))
        miss = told.select("id", (F.col("miss") + trees * F.log1p(-F.least(p, F.lit(1 - 1e-12)))).alias("miss"))
        before = cut(miss.where(F.col("miss") > goal), "open")
        worst = before.agg(F.max("miss")).first()[0]
        if worst is None:
            break
        first, trees = first + trees, min(most, max(1, math.ceil((worst - goal) / -_log_miss(min_sim, deepest))))
        todo = sets.join(before.select("id"), "id", "left_semi")
    close = found.distinct()
    x, y = sets.select(F.col("id").alias("a"), F.col("members").alias("x")), sets.select(F.col("id").alias("b"), F.col("members").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    checked = close.join(x, "a").join(y, "b").select("a", "b", both.alias("both"), (F.size("x") + F.size("y") - both).alias("all"))
    return checked.select("a", "b", (F.col("both") / F.col("all")).alias("sim")).where(F.col("sim") >= min_sim)


def similar_records(df: DataFrame, record: str, members: str, min_sim: float) -> tuple[DataFrame, DataFrame]:
    """All similar pairs in compact form: (pairs of class representatives, membership).

    Records with equal sets are one class, whose copies are not expanded into pairs. Null and empty sets
    are in no class; null members and repeated members don't count; an empty table gives no rows.
    """
    sets, copies = distinct_sets(df, record, members)
    return similar_sets(sets, min_sim), copies


def expand_pairs(pairs: DataFrame, copies: DataFrame) -> DataFrame:
    """(record_a, record_b, sim), record_a < record_b: every pair of records behind pairs of classes, and those
    within a class (similarity 1)."""
    l, r = copies.select(F.col("id").alias("a"), F.col("record").alias("ra")), copies.select(F.col("id").alias("b"), F.col("record").alias("rb"))
    across = pairs.join(l, "a").join(r, "b").select(F.least("ra", "rb").alias("record_a"), F.greatest("ra", "rb").alias("record_b"), "sim")
    inside = group_pairs(copies, "id", ["record"]).select(F.least("record_l", "record_r").alias("record_a"), F.greatest("record_l", "record_r").alias("record_b"), F.lit(1.0).alias("sim"))
    return across.unionByName(inside)


def least_threshold(thresholds: Sequence[float]) -> float | None:
    known = [x for x in thresholds if x is not None and not math.isnan(x)]
    return min(known) if known else None
