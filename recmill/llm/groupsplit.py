"""Problem 1: splits that keep all records of one person together.

Records and the entities they share form a bipartite graph. Every record starts with its own id as
label; each round an entity takes the least label of its records and a record the least label of its
entities, until nothing changes. The groups that result are then spread over the splits so that each
split has its share of every period of time: a stratified first assignment, then rounds in which groups move
where that lowers the squared deviation of the splits' label counts from their targets.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recmill.operators.pairs import group_pairs, join_groups
from recmill.operators.skew import prefix_sum
from recmill.session import cut, drop_cut

# Handles that mean "no handle", as they are after case, space and punctuation are gone.
STAND_INS = ["", "none", "null", "nil", "na", "nan", "unknown", "undefined", "missing", "anonymous", "anon", "empty", "nohandle", "notavailable", "notset", "unset", "tbd"]

#: Two users with this many equal events are one person.
MIN_SHARED_EVENTS = 5
#: Groups above this share of all rows are placed one by one (there are fewer than its inverse of them).
LARGE_GROUP_SHARE = 0.001
#: Rounds of moves at most, and the shares of the movers that each round tries at once.
MOVE_ROUNDS, MOVE_SHARES = 16, (0.5, 0.15, 0.05, 0.015, 0.005, 0.0015, 0.0005)
#: Distinct labels that splits are stratified by, at most; more are refused. Every task returns that many counts.
MAX_LABELS = 1_000


def plain_handle(c: Column) -> Column:
    """The handle without letter case, spaces, punctuation, invisible characters and character width; NULL for stand-ins."""
    wide = "".join(chr(x) for x in range(0xFF01, 0xFF5F))
    narrow = "".join(chr(x - 0xFEE0) for x in range(0xFF01, 0xFF5F))
    s = F.lower(F.regexp_replace(F.translate(c, wide, narrow), r"[^\p{L}\p{N}]", ""))
    return F.when(s.isin(STAND_INS) | s.rlike(r"^(.)\1*$"), None).otherwise(s)


def shared_event_pairs(events: DataFrame, user: str, event: Sequence[str], at_least: int = MIN_SHARED_EVENTS) -> DataFrame:
    """Pairs (a < b) of users with at least ``at_least`` distinct events in common; exact.

    Events are ordered by how many users have them. Two users with ``at_least`` events in common share
    one that is outside each one's ``at_least - 1`` most widespread events, so only the remaining,
    rarer events are joined; the widespread ones are then looked up for the pairs found, a bounded
    number of them for each pair. Events with a null in any column don't count.
    """
    e = _events(events, user, event)
    shared = e.repartition("k").dropDuplicates(["k", "u"]).withColumn("n", F.count("*").over(Window.partitionBy("k"))).where("n > 1")
    per_user = Window.partitionBy("u")
    ranked = shared.withColumn("m", F.count("*").over(per_user)).where(F.col("m") >= at_least).withColumn("r", F.row_number().over(per_user.orderBy(F.desc("n"), "k"))).select("u", "k", "r")
    ranked = cut(ranked, "shared")
    rare, wide = ranked.where(F.col("r") >= at_least), ranked.where(F.col("r") < at_least)
    # an event that many users share is a hot group, whose pairs are made in many tasks
    pairs = group_pairs(rare, "k", ["u"]).groupBy(F.least("u_l", "u_r").alias("a"), F.greatest("u_l", "u_r").alias("b")).agg(F.count("*").alias("c"))
    pairs = cut(pairs, "pairs")
    done, open_ = pairs.where(F.col("c") >= at_least).select("a", "b"), pairs.where(F.col("c") < at_least)
    wa, wb = wide.select(F.col("u").alias("a"), "k"), wide.select(F.col("u").alias("b"), "k")
    more = open_.join(wa, "a").join(ranked.select(F.col("u").alias("b"), "k"), ["b", "k"]).select("a", "b", "c")
    more = more.unionByName(open_.join(wb, "b").join(rare.select(F.col("u").alias("a"), "k"), ["a", "k"]).select("a", "b", "c"))
    late = more.groupBy("a", "b").agg((F.first("c") + F.count("*")).alias("c")).where(F.col("c") >= at_least).select("a", "b")
    return done.unionByName(late)


def _events(events: DataFrame, user: str, event: Sequence[str]) -> DataFrame:
    known = events
    for c in [user, *event]:
        known = known.where(F.col(c).isNotNull())
    return known.select(F.col(user).alias("u"), F.xxhash64(*event).alias("k"))


def min_labels(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(record, label) for the records of ``edges(record, entity)``: label is the least record of the component.

    Entities with a single record join nothing and are left out of the rounds. Labels also jump to the
    label of their label, so a chain of length n takes about log n rounds. Null records or entities and
    repeated edges are ignored; no edges give no rows.
    """
    e = edges.where("record is not null and entity is not null").distinct()
    lone = e.groupBy("entity").agg(F.min("record").alias("x"), F.max("record").alias("y")).where("x = y")
    e = cut(e.join(lone, "entity", "left_anti"), "edges")
    labels = cut(e.groupBy("record").agg(F.min("record").alias("label"), F.count("*").alias("d")), "labels")
    for _ in range(max_rounds):
        # an entity with very many records, or a record with very many entities, is never brought into one task
        least = cut(join_groups(e, labels, ["record"], "d").groupBy("entity").agg(F.min("label").alias("l"), F.count("*").alias("n")), "least")
        near = join_groups(e, least, ["entity"], "n").groupBy("record").agg(F.min("l").alias("l"), F.count("*").alias("d"))
        far = labels.select(F.col("record").alias("l"), F.col("label").alias("jump"))
        new = cut(near.join(far, "l", "left").select("record", F.least("l", F.coalesce("jump", "l")).alias("label"), "d"), "labels")
        changed = not new.join(labels, "record").where(new.label != labels.label).isEmpty()
        drop_cut(labels)
        drop_cut(least)
        labels = new
        if not changed:
            return labels.select("record", "label")
    raise RuntimeError(f"labels still change after {max_rounds} rounds")


def people(accounts: DataFrame, log: DataFrame) -> DataFrame:
    """(user_id, group_id) of every user who shares a person with another one; group_id is the person's least user_id.

    Users are joined by an equal handle (:func:`plain_handle`), by ``MIN_SHARED_EVENTS`` equal events,
    and through further users. Null user ids take no part.
    """
    by_handle = accounts.select(F.col("user_id").alias("record"), plain_handle(F.col("steam_id")).alias("h")).where("h is not null").select("record", F.xxhash64(F.lit("handle"), "h").alias("entity"))
    twins = shared_event_pairs(log, "user_id", ["item_id", "rating", "timestamp"])
    twin = F.xxhash64(F.lit("twins"), "a", "b").alias("entity")
    by_events = twins.select(F.explode(F.array("a", "b")).alias("record"), twin)
    return min_labels(by_handle.unionByName(by_events)).select(F.col("record").alias("user_id"), F.col("label").alias("group_id"))


def _place_large(sizes: np.ndarray, target: np.ndarray) -> list[int]:
    """Split of each large group (rows: groups by label), largest first, where the squared deviation grows least."""
    have, to = np.zeros_like(target), [0] * len(sizes)
    for i in np.argsort(-sizes.sum(1), kind="stable"):
        cost = [(((have[s] + sizes[i] - target[s]) ** 2).sum() - ((have[s] - target[s]) ** 2).sum()) / max(target[s].sum(), 1) for s in range(len(target))]
        to[i] = int(np.argmin(cost))
        have[to[i]] += sizes[i]
    return to


def _wishes(off: np.ndarray, weight: np.ndarray, at: np.ndarray, idx: np.ndarray, n: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The split of every group to which its move lowers the weighted squared deviation ``off`` most; its own if none does.

    Group i, now in split ``at[i]``, has ``n`` rows of label ``idx`` where ``owner`` is i.
    """
    w, many = weight[idx], len(at)
    leave = np.bincount(owner, w * n * (n - 2 * off[at[owner], idx]), many)
    change = np.stack([leave + np.bincount(owner, w * n * (n + 2 * off[s][idx]), many) for s in range(len(off))])
    change[at, np.arange(many)] = 0
    return change.argmin(0)


def _movers(h: np.ndarray, step: int, share: float) -> np.ndarray:
    """Which groups move in a step, by their hash."""
    with np.errstate(over="ignore"):
        z = (h.view(np.uint64) ^ np.uint64(step + 1)) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (z >> np.uint64(11)) < share * 2.0**53


def _after(steps: list[tuple[np.ndarray, float]], weight: np.ndarray, h: np.ndarray, at: np.ndarray, *cells: np.ndarray) -> np.ndarray:
    """Splits of groups after ``steps`` of (deviation of every split and label, share of the movers that move)."""
    for k, (off, share) in enumerate(steps):
        at = np.where(_movers(h, k, share), _wishes(off, weight, at, *cells), at)
    return at


_PACK = "h binary, split binary, l binary, n binary, many binary"


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, h, split, cells) in; one row of packed arrays for every batch of groups out, which rounds read at little cost."""
    for b in batches:
        if b.num_rows:
            cells = b.column("cells")
            flat = cells.flatten()
            parts = (b.column("h").to_numpy().astype("<i8"), b.column("split").to_numpy().astype("<i4"), flat.field("l").to_numpy().astype("<i4"), flat.field("n").to_numpy().astype("<f8"), np.diff(cells.offsets.to_numpy()).astype("<i4"))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column("g")), *(pa.array([x.tobytes()], pa.binary()) for x in parts)], names=["g", "h", "split", "l", "n", "many"])


def _read_packs(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    kinds = {"h": "<i8", "split": "<i4", "l": "<i4", "n": "<f8", "many": "<i4"}
    for i in range(b.num_rows):
        h, at, idx, n, many = (np.frombuffer(b.column(c)[i].as_py(), k) for c, k in kinds.items())
        yield h, at.astype(np.int64), idx.astype(np.int64), n, np.repeat(np.arange(len(h)), many)


def _refined(groups: DataFrame, target: np.ndarray) -> DataFrame:
    """``groups(g, h, split, cells)``, cells being (label number, rows), with splits moved to lower the deviation."""
    kind = dict(groups.dtypes)["g"]
    groups = cut(groups.mapInArrow(_packed, f"g array<{kind}>, {_PACK}"), "assigned")
    weight = 1 / np.maximum(target.sum(0), 1)
    steps: list[tuple[np.ndarray, float]] = []
    splits, labels = target.shape

    def counted(off: np.ndarray | None) -> np.ndarray:
        """Counts of (share tried, split, label) after the steps so far and, where ``off`` is given, one more."""
        shares = MOVE_SHARES if off is not None else (0.0,)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            have = np.zeros((len(shares), splits * labels))
            for b in batches:
                for h, at, idx, n, owner in _read_packs(b):
                    at = _after(steps, weight, h, at, idx, n, owner)
                    to = at if off is None else _wishes(off, weight, at, idx, n, owner)
                    for k, share in enumerate(shares):
                        there = np.where(_movers(h, len(steps), share), to, at)
                        have[k] += np.bincount(there[owner] * labels + idx, n, splits * labels)
            yield pa.RecordBatch.from_arrays([pa.array([have.tobytes()], pa.binary())], names=["have"])

        # one row for each task, of a size that MAX_LABELS bounds
        rows = groups.drop("g").mapInArrow(run, "have binary").collect()
        return sum((np.frombuffer(r["have"]) for r in rows), np.zeros(len(shares) * splits * labels)).reshape(len(shares), splits, labels)

    def cost(off: np.ndarray) -> float:
        return float((weight * off**2).sum())

    off = counted(None)[0] - target
    while len(steps) < MOVE_ROUNDS and cost(off) > 0:
        tried = counted(off) - target
        best = min(range(len(tried)), key=lambda k: cost(tried[k]))
        if cost(tried[best]) >= cost(off) * (1 - 1e-3):
            break
        steps, off = [*steps, (off, MOVE_SHARES[best])], tried[best]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, pack in enumerate(_read_packs(b)):
                at = _after(steps, weight, *pack)
                yield pa.RecordBatch.from_arrays([b.column("g")[i].values, pa.array(at.astype(np.int32))], names=["g", "split"])

    return groups.mapInArrow(run, f"g {kind}, split int")


def assign_splits(rows: DataFrame, group: str, label: str, shares: dict[str, float], seed: int = 0) -> DataFrame:
    """(group, split): every group whole in one split, each split with its share of every label's rows.

    The few groups above ``LARGE_GROUP_SHARE`` of all rows (a bounded number, whatever the data) are
    placed greedily, least growth of the squared deviation first. The others are laid out, per main
    label and size class, in hash order along a line of their rows (a two-level prefix sum, so no
    stratum meets in one task) which is cut where the shares that are left say. From there all groups move,
    in rounds, to lower the deviation (:func:`_refined`). Rows with a null group are not assigned; null labels
    form a label of their own; an empty table gives no rows.
    """
    names, want = list(shares), np.array(list(shares.values()), float)
    want = want / want.sum()
    known = rows.where(F.col(group).isNotNull()).select(F.col(group).alias("g"), F.coalesce(F.col(label).cast("string"), F.lit("")).alias("l"))
    cells = cut(known.groupBy("g", "l").agg(F.count("*").alias("n")), "cells")
    groups = cut(cells.groupBy("g").agg(F.sum("n").alias("size"), F.max_by("l", F.struct("n", "l")).alias("main")), "groups")
    total = groups.agg(F.sum("size")).first()[0] or 0
    large = groups.where(F.col("size") > LARGE_GROUP_SHARE * total)
    found = cells.join(large.select("g"), "g", "left_semi").collect()  # at most 1 / LARGE_GROUP_SHARE groups by the labels
    labels = cells.groupBy("l").agg(F.sum("n").alias("n")).limit(MAX_LABELS + 1).collect()
    if len(labels) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels: stratify by fewer")
    at = {r["l"]: i for i, r in enumerate(labels)}
    per_label = np.array([r["n"] for r in labels], float)
    ids = sorted({r["g"] for r in found})
    sizes = np.zeros((len(ids), len(labels)))
    for r in found:
        sizes[ids.index(r["g"]), at[r["l"]]] = r["n"]
    target = want[:, None] * per_label[None, :]
    to = _place_large(sizes, target)
    have = np.zeros_like(target)
    for i, s in enumerate(to):
        have[s] += sizes[i]
    left = np.maximum(target - have, 0)
    spark = rows.sparkSession
    kind = dict(groups.dtypes)["g"]
    placed = spark.createDataFrame([(g, names[s]) for g, s in zip(ids, to, strict=True)], f"g {kind}, split string")
    # cut points of each label's line: what is still open of each split there
    cuts = spark.createDataFrame([(r["l"], [float(x) for x in np.cumsum(left[:, i] / max(left[:, i].sum(), 1e-9))[:-1]]) for r, i in ((r, at[r["l"]]) for r in labels)], "main string, cuts array<double>")
    small = groups.join(placed, "g", "left_anti").withColumn("class", F.floor(F.log2(F.col("size"))).cast("int"))
    laid = prefix_sum(small, ["main", "class"], F.concat_ws("|", F.col("g").cast("string"), F.lit(str(seed))), "size", "before")
    whole = small.groupBy("main", "class").agg(F.sum("size").alias("of"))
    where = (F.col("before") + F.col("size") / 2) / F.col("of")
    split = F.element_at(F.array(*map(F.lit, names)), F.size(F.filter("cuts", lambda c: c <= where)) + 1)
    rest = laid.join(whole, ["main", "class"]).join(cuts, "main").select("g", split.alias("split"))
    number = F.create_map(*[x for i, name in enumerate(names) for x in (F.lit(name), F.lit(i))])
    label_number = spark.createDataFrame([(x, i) for x, i in at.items()], "l string, li int")
    packed = cells.join(F.broadcast(label_number), "l").groupBy("g").agg(F.collect_list(F.struct(F.col("li").alias("l"), "n")).alias("cells"))
    first = placed.unionByName(rest).select("g", number[F.col("split")].alias("split"))
    moved = _refined(packed.join(first, "g").select("g", F.xxhash64("g", F.lit(seed)).alias("h"), "split", "cells"), target)
    return moved.select(F.col("g").alias(group), F.element_at(F.array(*map(F.lit, names)), F.col("split") + 1).alias("split"))
