"""Train/test splits. Random choices are orders by hash of (seed, key): the same for any partitioning."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recmill.data.builder import as_time
from recmill.operators.order import exact_quantile, number_rows
from recmill.operators.stats import row_count

Holdout = Callable[[DataFrame, str], DataFrame]


def hash_order(seed, *keys: str) -> Column:
    """A random-looking order that any engine can repeat: md5 of the seed and the keys' text."""
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))


@dataclass
class TTSplit:
    train: DataFrame
    test: DataFrame
    name: str | None = None
    key: str = "user_id"

    def test_size(self) -> int:
        return self.test.count()

    def train_df(self) -> DataFrame:
        return self.train

    def test_df(self) -> DataFrame:
        return self.test

    def test_lists(self) -> DataFrame:
        """(key, items): the test rows as one list per key."""
        other = [c for c in self.test.columns if c != self.key]
        return self.test.groupBy(self.key).agg(F.array_sort(F.collect_list(F.struct(*other))).alias("items"))

    def test_requests(self) -> DataFrame:
        return self.test.select(self.key).distinct()


def _with(df: DataFrame, flag: Column, test_only: bool = False, name: str | None = None) -> TTSplit:
    marked = df.withColumn("_test", flag)
    train = df.where(F.lit(False)) if test_only else marked.where("not _test").drop("_test")
    return TTSplit(train, marked.where("_test").drop("_test"), name)


# -- records


def number_records(df: DataFrame, keys: Sequence[str], seed=0, name: str = "_place") -> DataFrame:
    """Records numbered from 0 in hash order of their keys."""
    return number_rows(df.withColumn("_h", hash_order(seed, *keys)), "_h", *keys, name=name).drop("_h")


def record_folds(df: DataFrame, partitions: int, keys: Sequence[str], seed=0, name: str = "fold") -> DataFrame:
    """Fold of every record; the first n mod k folds have one record more."""
    placed = number_records(df, keys, seed)
    return placed.withColumn(name, _fold_of(placed.count(), partitions, F.col("_place"))).drop("_place")


def _fold_of(n: int, k: int, place: Column) -> Column:
    size, more = divmod(n, k)
    if not size:
        return place.cast("int")
    edge = more * (size + 1)
    return F.when(place < edge, F.floor(place / (size + 1))).otherwise(more + F.floor((place - edge) / size)).cast("int")


def crossfold_records(df: DataFrame, partitions: int, keys: Sequence[str] = ("user_id", "item_id"), seed=0, test_only: bool = False) -> Iterator[TTSplit]:
    folds = record_folds(df, partitions, keys, seed, "_fold")
    for i in range(partitions):
        s = _with(folds, F.col("_fold") == i, test_only, str(i))
        yield TTSplit(s.train.drop("_fold"), s.test.drop("_fold"), s.name)


def sample_records(df: DataFrame, size: int, repeats: int | None = None, disjoint: bool = True, keys: Sequence[str] = ("user_id", "item_id"), seed=0, test_only: bool = False):
    """One split without ``repeats``, else an iterator of them; disjoint samples that need as many records as
    there are become a cross-fold."""
    if repeats is None:
        s = _with(number_records(df, keys, seed), F.col("_place") < size, test_only)
        return TTSplit(s.train.drop("_place"), s.test.drop("_place"))
    return _record_samples(df, size, repeats, disjoint, keys, seed, test_only)


def _record_samples(df, size, repeats, disjoint, keys, seed, test_only) -> Iterator[TTSplit]:
    if disjoint and repeats * size >= df.count():
        yield from crossfold_records(df, repeats, keys, seed, test_only)
        return
    for i in range(repeats):
        placed = number_records(df, keys, seed if disjoint else f"{seed}/{i}")
        lo = i * size if disjoint else 0
        s = _with(placed, F.col("_place").between(lo, lo + size - 1), test_only, str(i))
        yield TTSplit(s.train.drop("_place"), s.test.drop("_place"), s.name)


# -- holdouts: flags for each user's rows


def _numbered(df: DataFrame, key: str, *order) -> DataFrame:
    w = Window.partitionBy(key)
    return df.withColumn("_r", F.row_number().over(w.orderBy(*order))).withColumn("_n", F.count("*").over(w))


def sample_n(n: int, item: str = "item_id", seed=0) -> Holdout:
    """n random rows of each user, all of them where there are no more."""
    return lambda df, key: _numbered(df, key, hash_order(seed, key, item), item).withColumn("_test", F.col("_r") <= n).drop("_r", "_n")


def sample_frac(frac: float, item: str = "item_id", seed=0) -> Holdout:
    """A share of each user's rows, rounded half to even."""
    return lambda df, key: _numbered(df, key, hash_order(seed, key, item), item).withColumn("_test", F.col("_r") <= F.bround(F.col("_n") * F.lit(float(frac)))).drop("_r", "_n")


def last_n(n: int, field: str = "timestamp", item: str = "item_id") -> Holdout:
    def run(df: DataFrame, key: str) -> DataFrame:
        if field not in df.columns:
            raise TypeError(f"no field {field}")
        return _numbered(df, key, F.desc_nulls_last(field), F.desc(item)).withColumn("_test", F.col("_r") <= n).drop("_r", "_n")

    return run


def last_frac(frac: float, field: str = "timestamp", item: str = "item_id") -> Holdout:
    """The last share of each user's rows, rounded half to even; where that is 0, all of them."""

    def run(df: DataFrame, key: str) -> DataFrame:
        if field not in df.columns:
            raise TypeError(f"no field {field}")
        k = F.bround(F.col("_n") * F.lit(float(frac)))
        return _numbered(df, key, F.desc_nulls_last(field), F.desc(item)).withColumn("_test", (k == 0) | (F.col("_r") <= k)).drop("_r", "_n")

    return run


# -- users


def user_folds(df: DataFrame, partitions: int, user: str = "user_id", seed=0, name: str = "fold") -> DataFrame:
    users = number_records(df.where(F.col(user).isNotNull()).select(user).distinct(), [user], seed)
    return users.withColumn(name, _fold_of(users.count(), partitions, F.col("_place"))).drop("_place")


def _user_split(df: DataFrame, users: DataFrame, method: Holdout, user: str, test_only: bool, name=None) -> TTSplit:
    mine, rest = df.join(users.select(user), user, "left_semi"), df.join(users.select(user), user, "left_anti")
    flagged = method(mine, user)
    test = flagged.where("_test").drop("_test")
    train = df.where(F.lit(False)) if test_only else rest.unionByName(flagged.where("not _test").drop("_test"))
    return TTSplit(train, test, name, user)


def crossfold_users(df: DataFrame, partitions: int, method: Holdout, user: str = "user_id", seed=0, test_only: bool = False) -> Iterator[TTSplit]:
    """Each fold's users give test rows by ``method``; all other users stay whole in train."""
    folds = user_folds(df, partitions, user, seed)
    for i in range(partitions):
        yield _user_split(df, folds.where(F.col("fold") == i), method, user, test_only, str(i))


def sample_users(df: DataFrame, size: int, method: Holdout, repeats: int | None = None, disjoint: bool = True, user: str = "user_id", seed=0, test_only: bool = False):
    users = df.where(F.col(user).isNotNull()).select(user).distinct()
    if repeats is None:
        return _user_split(df, number_records(users, [user], seed).where(F.col("_place") < size), method, user, test_only)
    return _user_samples(df, users, size, method, repeats, disjoint, user, seed, test_only)


def _user_samples(df, users, size, method, repeats, disjoint, user, seed, test_only) -> Iterator[TTSplit]:
    if disjoint and repeats * size >= users.count():
        yield from crossfold_users(df, repeats, method, user, seed, test_only)
        return
    for i in range(repeats):
        placed, lo = number_records(users, [user], seed if disjoint else f"{seed}/{i}"), i * size if disjoint else 0
        yield _user_split(df, placed.where(F.col("_place").between(lo, lo + size - 1)), method, user, test_only, str(i))


def simple_test_pair(df: DataFrame, n_users: int = 200, n_rates: int = 5, f_rates: float | None = None, seed=0) -> TTSplit:
    return sample_users(df, n_users, sample_frac(f_rates, seed=seed) if f_rates is not None else sample_n(n_rates, seed=seed), seed=seed)


# -- time


def split_global_time(df: DataFrame, time, end=None, filter_test_users: bool | int = False, field: str = "timestamp", user: str = "user_id") -> TTSplit | list[TTSplit]:
    """train < time <= test (< the next time, or ``end``). A list of times gives a list of splits. Test rows of
    users with fewer than ``filter_test_users`` training interactions are left out."""
    many = isinstance(time, list | tuple)
    times = [as_time(t, dict(df.dtypes)[field]) for t in (time if many else [time])]
    stops = [*times[1:], None if end is None else as_time(end, dict(df.dtypes)[field])]
    out = []
    for i, (t, stop) in enumerate(zip(times, stops, strict=True)):
        train, test = df.where(F.col(field) < t), df.where(F.col(field) >= t)
        if stop is not None:
            test = test.where(F.col(field) < stop)
        if filter_test_users:
            enough = train.groupBy(user).agg(F.sum(row_count(train)).alias("_n")).where(F.col("_n") >= int(filter_test_users))
            test = test.join(enough, user, "left_semi")
        out.append(TTSplit(train, test, str(i), user))
    return out if many else out[0]


def split_temporal_fraction(df: DataFrame, test_fraction: float, filter_test_users: bool | int = False, field: str = "timestamp", user: str = "user_id") -> TTSplit:
    """The cut is the interpolated quantile of time at 1 - test_fraction, found by counting, not by sorting."""
    us = exact_quantile(df.select(F.unix_micros(F.col(field).cast("timestamp")).alias("us")), "us", 1 - test_fraction)
    cut = dt.datetime.fromtimestamp(0, dt.UTC) + dt.timedelta(microseconds=us or 0)
    return split_global_time(df, cut, None, filter_test_users, field, user)
