"""A log's cells as sparse matrices that every worker reads from the shared folder: neighbours of a user or an item
are then found in a task, and neither pairs of items nor pairs of users are shuffled or written."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells that a worker holds (about 30 bytes each); larger logs are joined instead.
MAX_HELD = 10_000_000
#: Bytes of rules that a task keeps for items it meets again.
ROW_BYTES = 128 << 20

_kept: dict[str, Cells] = {}


def held_path(df: DataFrame) -> str | None:
    """Where the workers read ``df``, a frame made by ``cut``; None if it has too many rows."""
    path = getattr(df, "_recmill_path", None)
    return path if path is not None and df.count() <= MAX_HELD else None


def cells_of(path: str, values: Sequence[str] = ()) -> Cells:
    """The cells at ``path``, read once by each worker, which keeps the last ones it read."""
    if path not in _kept:
        _kept.clear()
        fs, at = FileSystem.from_uri(path)
        _kept[path] = Cells(ds.dataset(at, filesystem=fs, format="parquet").to_table(columns=["user_id", "item_id", *values]), values)
    return _kept[path]


def ragged(start: np.ndarray, many: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (many[0] of them), start[1], ..."""
    ends = np.cumsum(many)
    return np.repeat(start - (ends - many), many) + np.arange(ends[-1] if len(ends) else 0)


def _distinct(x: np.ndarray) -> np.ndarray:
    """Sorted; for some thousands of numbers faster than np.unique."""
    x = np.sort(x)
    return x[np.flatnonzero(np.append(len(x) > 0, x[1:] != x[:-1]))]


def find(names: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Places of ``ids`` in the sorted ``names``, -1 for those that are not there."""
    if not len(names):
        return np.full(len(ids), -1)
    at = np.minimum(np.searchsorted(names, ids), len(names) - 1)
    return np.where(names[at] == ids, at, -1)


class Cells:
    """Users, items and values, by user (items ascending) and by item (users ascending). ``user`` and ``item`` are
    (start, many, the other side's numbers, values by name)."""

    def __init__(self, t: pa.Table, values: Sequence[str]):
        self.users, u = np.unique(t.column("user_id").to_numpy(), return_inverse=True)
        self.items, i = np.unique(t.column("item_id").to_numpy(), return_inverse=True)
        u, i = u.astype(np.int32), i.astype(np.int32)
        by = np.lexsort((i, u))
        u, i, vals = u[by], i[by], {v: t.column(v).to_numpy()[by] for v in values}
        self.user = self._side(u, i, len(self.users), vals)
        by = np.argsort(i, kind="stable")
        self.item = self._side(i[by], u[by], len(self.items), {v: x[by] for v, x in vals.items()})

    @staticmethod
    def _side(key, other, size, vals):
        many = np.bincount(key, minlength=size)
        return np.cumsum(many) - many, many, other, vals

    def codes(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return tuple(find(names, batch.column(c).to_numpy(zero_copy_only=False)) for names, c in ((self.users, "user_id"), (self.items, "item_id")))


def by_key(todo: DataFrame, key: str, made: str, run: Callable[[np.ndarray, np.ndarray, int], dict[str, np.ndarray]], path: str, values: Sequence[str] = ()) -> DataFrame:
    """``run(cells)(k, others)`` for the pairs (user_id, item_id) of ``todo`` whose user and item are known, one ``key`` at a
    time with the numbers of its others: (which of the others have a result, its columns as ``made`` names and types them)."""
    kinds, other = dict(todo.dtypes), {"user_id": "item_id", "item_id": "user_id"}[key]
    names = [x.split()[0] for x in made.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = None
        for b in batches:
            if not b.num_rows:
                continue
            cells = cells_of(path, values)
            one = one or run(cells)
            k, o = cells.codes(b) if key == "user_id" else cells.codes(b)[::-1]
            known = np.flatnonzero((k >= 0) & (o >= 0))
            k, o = k[known], o[known]
            edges = np.append(np.flatnonzero(np.append(len(k) > 0, k[1:] != k[:-1])), len(k))
            at, cols = [], []
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                some, got = one(k[s], o[s:e])
                at.append(known[s:e][some])
                cols.append(got)
            if at:
                rows = b.take(pa.array(np.concatenate(at)))
                yield pa.RecordBatch.from_arrays([rows.column("user_id"), rows.column("item_id"), *[pa.array(np.concatenate(c)) for c in zip(*cols, strict=True)]], names=["user_id", "item_id", *names])

    return todo.select("user_id", "item_id").repartition(key).sortWithinPartitions(key, other).mapInArrow(work, f"user_id {kinds['user_id']}, item_id {kinds['item_id']}, {made}")


def over_keys(keys: DataFrame, made: str, run: Callable, path: str) -> DataFrame:
    """The rows, as ``made`` names and types them, that ``run(cells)(ids)`` gives (a list of columns) for the ids of the one
    column of ``keys``, a batch at a time."""
    names = [x.split()[0] for x in made.split(", ")]
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = None
        for b in batches:
            if b.num_rows:
                rows = rows or run(cells_of(path))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in rows(b.column(0).to_numpy(zero_copy_only=False))], names=names)

    # by a hash of its own and a number of parts: parts by the ids themselves may be there already, and are then made
    # few by size, which puts a few ids that stand for much work into one task
    key = F.col(keys.columns[0])
    return keys.where(key.isNotNull()).distinct().repartition(parts, F.xxhash64(key)).mapInArrow(work, made)


class BestByRules:
    """For users by id, the ``n`` items they don't have whose rules from their items add up to most (or, with ``top``, of
    which one is greatest), ties at the scores' float precision to the smaller item; the first n for unknown users.

    Rules of items that meet many others are dense rows. What the rules of a set of such items give is sorted once for
    the users who have just this set; a user's other items change it at few places.
    """

    #: Users of a batch with the same dense rows, from which on these are sorted.
    SHARED = 4

    def __init__(self, cells: Cells, n: int, damping: float, lift: bool, top: bool):
        self.cells, self.n, self.top = cells, n, top
        size, (ustart, umany, uitems, _), many = len(cells.items), cells.user, cells.item[1]
        self.each = 1 / (many + damping)
        self.by_item = len(cells.users) / (many + damping) if lift else None
        work = np.bincount(uitems, np.repeat(umany, umany), size)
        hot = np.argsort(-work, kind="stable")[: max(1, ROW_BYTES // (8 * max(size, 1)))]
        hot = np.sort(hot[work[hot] > size / 4])
        self.hot = np.full(size, -1)
        self.hot[hot] = np.arange(len(hot))
        together = Together(cells)
        self.rows = [together.at(i) / (many[i] + damping) for i in hot]
        self.sums, self.off = np.zeros(size), np.zeros(size, bool)
        self.sorted: dict[tuple, tuple] = {}

    def __call__(self, ids: np.ndarray) -> list[np.ndarray]:
        ustart, umany, uitems, _ = self.cells.user
        at, sets = find(self.cells.users, ids), {}
        for row, user in enumerate(at):
            hot = self.hot[uitems[ustart[user] : ustart[user] + umany[user]]] if user >= 0 else np.empty(0, int)
            sets.setdefault(tuple(hot[hot >= 0].tolist()), []).append(row)
        rows, found = [], []
        for hot, some in sets.items():
            base = order = None
            for row in some:
                if at[row] < 0:
                    best = np.arange(min(self.n, len(self.cells.items)))
                else:
                    if base is None:
                        base, order, falling = self._base(hot, len(some) >= self.SHARED)
                    best = self._best(at[row], base, order, falling)
                rows.append(np.full(len(best), row))
                found.append(best)
        return [ids[np.concatenate(rows)], self.cells.items[np.concatenate(found)]]

    def _base(self, hot: tuple, sort: bool):
        """(the sum or maximum of the rows, its falling order, its falling values), the latter two if sorted."""
        if hot in self.sorted:
            return self.sorted[hot]
        base = np.zeros(len(self.sums))
        for h in hot:
            base = np.maximum(base, self.rows[h]) if self.top else base + self.rows[h]
        if self.by_item is not None:
            base *= self.by_item
        if not sort:
            return base, None, None
        order = np.argsort(-base, kind="stable").astype(np.int32)
        if (len(self.sorted) + 1) * 20 * len(base) > ROW_BYTES:
            self.sorted.clear()
        self.sorted[hot] = base, order, -base[order]
        return self.sorted[hot]

    def _best(self, user: int, base: np.ndarray, order: np.ndarray | None, falling: np.ndarray | None) -> np.ndarray:
        (ustart, umany, uitems, _), (start, many, users, _) = self.cells.user, self.cells.item
        mine = uitems[ustart[user] : ustart[user] + umany[user]]
        few = mine[self.hot[mine] < 0]
        others = users[ragged(start[few], many[few])]
        met = uitems[ragged(ustart[others], umany[others])]
        if self.top:
            some, value = self._greatest(few, met, others)
        else:
            np.add.at(self.sums, met, np.repeat(np.repeat(self.each[few], many[few]), umany[others]))
            some = _distinct(met)
            value = self.sums[some]
            self.sums[some] = 0
        if self.by_item is not None:
            value = value * self.by_item[some]
        value = np.maximum(value, base[some]) if self.top else value + base[some]
        share = 1 if self.top else len(mine)
        if order is None:
            every = base.copy()
            every[some] = value
            self.off[mine] = True
            items = np.flatnonzero(~self.off)
            self.off[mine] = False
            return self._first(items, every[items] / share)
        self.off[some] = self.off[mine] = True
        head = self.n + len(some) + len(mine)
        rest = order[:head]
        rest = rest[~self.off[rest]]
        if len(rest) >= self.n > 0 and head < len(order):
            # scores that only differ beyond a float's precision go by item
            last = base[rest[self.n - 1]]
            near = order[max(head, np.searchsorted(falling, -last, "right")) : np.searchsorted(falling, -last * (1 - 2e-7), "right")] if last > 0 else order[:0]
            rest = np.concatenate([rest, near[~self.off[near]]])
        self.off[some] = self.off[mine] = False
        self.off[mine] = True
        new = ~self.off[some]
        self.off[mine] = False
        return self._first(np.concatenate([some[new], rest]), np.concatenate([value[new], base[rest]]) / share)

    def _greatest(self, few, met, others):
        """(items, the greatest rule that leads to each) of the users' items ``few``, which have ``others``, who have ``met``."""
        umany, many = self.cells.user[1], self.cells.item[1]
        ref = np.repeat(np.repeat(np.arange(len(few)), many[few]), umany[others])
        pair, count = np.unique(met.astype(np.int64) * max(len(few), 1) + ref, return_counts=True)
        item, ref = np.divmod(pair, max(len(few), 1))
        value = count * self.each[few][ref]
        first = np.flatnonzero(np.append(len(item) > 0, item[1:] != item[:-1]))
        return item[first], np.maximum.reduceat(value, first) if len(item) else value

    def _first(self, items: np.ndarray, value: np.ndarray) -> np.ndarray:
        score = value.astype(np.float32)
        if len(items) > self.n > 0:
            keep = np.flatnonzero(score >= np.partition(score, -self.n)[-self.n])
            items, score = items[keep], score[keep]
        return items[np.lexsort((items, -score))[: self.n]]


class Together:
    """For one item after the other, a sum over the users who have it, at every item that these have."""

    def __init__(self, cells: Cells, weight: str | None = None):
        self.cells, self.weight = cells, weight
        self.sums, self.last, self.touched = np.zeros(len(cells.items)), -1, None

    def at(self, item: int) -> np.ndarray:
        """The sums, valid until the next item; 0 at the item itself."""
        if item == self.last:
            return self.sums
        if self.touched is not None:
            self.sums[self.touched] = 0
        start, many, users, vals = self.cells.item
        cell = slice(start[item], start[item] + many[item])
        ustart, umany, items, uvals = self.cells.user
        mine = users[cell]
        flat = ragged(ustart[mine], umany[mine])
        self.touched, self.last = items[flat], item
        np.add.at(self.sums, self.touched, np.ones(len(flat)) if self.weight is None else np.repeat(vals[self.weight][cell], umany[mine]) * uvals[self.weight][flat])
        self.sums[item] = 0
        return self.sums


class UsersNear:
    """For a user and some items, the nearest users who have each: (place of the item, similarity, value of ``c``).

    Similarities are sums of products of ``u``. What the items with most users add is taken from dense columns, and only
    at users who are asked for; the few others who share an item are summed one by one.
    """

    #: Items with dense columns: the so many with most users, if they have more than so many.
    MOST, MANY = 8, 2_000
    #: Every so manieth user of such an item gives a bound for the nearest.
    STEP = 64

    def __init__(self, cells: Cells, least: float, most: int):
        self.cells, self.least, self.most = cells, least, most
        start, many, users, vals = cells.item
        hot = np.argsort(-many, kind="stable")[: self.MOST]
        hot = np.sort(hot[many[hot] > self.MANY])
        self.hot = np.full(len(many), -1)
        self.hot[hot] = np.arange(len(hot))
        self.columns, self.own = np.zeros((len(hot), len(cells.users))), []
        for h, i in enumerate(hot):
            cell = slice(start[i], start[i] + many[i])
            self.columns[h, users[cell]] = vals["u"][cell]
        for i in hot:
            self.own.append(self.columns[:, users[start[i] : start[i] + many[i]]])
        self.sums = np.zeros(len(cells.users))

    def __call__(self, user: int, items: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        (ustart, umany, uitems, uvals), (start, many, users, vals) = self.cells.user, self.cells.item
        cell = slice(ustart[user], ustart[user] + umany[user])
        mine, q = uitems[cell], uvals["u"][cell]
        hot = self.hot[mine]
        few = mine[hot < 0]
        near = ragged(start[few], many[few])
        touched = users[near]
        np.add.at(self.sums, touched, np.repeat(q[hot < 0], many[few]) * vals["u"][near])
        dense = [(h, x) for h, x in zip(hot[hot >= 0], q[hot >= 0], strict=True) if x]
        wide = self.hot[items]
        rest = np.flatnonzero(wide < 0)
        flat = ragged(start[items[rest]], many[items[rest]])
        parts = [(np.repeat(rest, many[items[rest]]), self._similar(user, users[flat], dense, self.columns[:, users[flat]]), flat)]
        for at in np.flatnonzero(wide >= 0):
            a = start[items[at]]
            sim = self._similar(user, users[a : a + many[items[at]]], dense, self.own[wide[at]])
            bound = self.least
            if len(some := sim[:: self.STEP]) > self.most:
                bound = max(bound, np.partition(some, -self.most)[-self.most])
            keep = np.flatnonzero(sim >= bound)
            parts.append((np.full(len(keep), at), sim[keep], a + keep))
        self.sums[touched] = 0
        seg, sim, flat = (np.concatenate(x) for x in zip(*parts, strict=True))
        best = nearest(seg, sim, users[flat], self.least, self.most)
        return seg[best], sim[best], vals["c"][flat[best]]

    def _similar(self, user: int, others: np.ndarray, dense: list, columns: np.ndarray) -> np.ndarray:
        sim = self.sums[others]
        for h, x in dense:
            sim += x * columns[h]
        sim[others == user] = 0
        return sim


def nearest(seg: np.ndarray, sim: np.ndarray, other: np.ndarray, least: float, most: int) -> np.ndarray:
    """Which rows are among the ``most`` of their segment with the greatest ``sim``, at least ``least``; ties to the smaller other."""
    keep = np.flatnonzero(sim >= least)
    keep = keep[np.lexsort((other[keep], -sim[keep], seg[keep]))]
    s = seg[keep]
    first = np.flatnonzero(np.append(len(s) > 0, s[1:] != s[:-1]))
    rank = np.arange(len(s)) - np.repeat(first, np.diff(np.append(first, len(s))))
    return keep[rank < most]


def voted(seg: np.ndarray, sim: np.ndarray, value: np.ndarray | None, size: int) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """(segments with a vote, (score, number of votes)): sum of sim, or the mean of value weighted by it."""
    n = np.bincount(seg, minlength=size)
    some = np.flatnonzero(n)
    total = np.bincount(seg, sim, size)[some]
    return some, (total if value is None else np.bincount(seg, sim * value, size)[some] / total, n[some])
