"""Recommending from one ranking for everybody without the product of users and items."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recmill.operators.order import number_rows
from recmill.operators.pairs import BROADCAST_ROWS, small_side
from recmill.session import cut

#: Bytes of item vectors that are sent to every worker for products with users; more are refused.
MAX_VECTOR_BYTES = 256 << 20


def best_unseen(scores: DataFrame, seen: DataFrame, users: DataFrame, n: int) -> DataFrame:
    """(user_id, item_id, score, rank): each user's best ``n`` items of one common ranking that it has not seen.

    A user who has seen k items finds its n among the first n + k places, so only those are looked at.
    """
    have = seen.select("user_id", "item_id").distinct()
    depth = users.select("user_id").distinct().join(have.groupBy("user_id").agg(F.count("*").alias("k")), "user_id", "left").withColumn("k", F.coalesce("k", F.lit(0)))
    depth = cut(depth, "depth")
    most = depth.agg(F.max("k")).first()[0]
    if most is None:
        return depth.select("user_id").join(scores.select("item_id", "score").limit(0)).withColumn("rank", F.lit(1))
    ranked = number_rows(scores.where("score is not null"), F.desc("score"), "item_id", name="place", start=1)
    places = depth.select("user_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("k") + n)).alias("place"))
    # every user asks for the first places: only the head that any user can reach takes part, as a broadcast if it is small
    head = ranked.where(F.col("place") <= most + n).select("place", "item_id", "score")
    fresh = places.join(small_side(cut(head, "head")) if most + n <= BROADCAST_ROWS else head, "place").join(have, ["user_id", "item_id"], "left_anti")
    return fresh.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy("place"))).where(F.col("rank") <= n).select("user_id", "item_id", "score", "rank")


def best_products(users: DataFrame, items: DataFrame, seen: DataFrame, n: int, dim: int) -> DataFrame | None:
    """(user_id, item_id): for ``users(user_id, vec)`` the items with the greatest dot products, as many as ``n`` and
    those that the user has seen together, without the seen ones. ``items(item_id, vec, b)``, b being added.

    Users stay where they are; the item vectors are counted first and sent to every worker. None above
    MAX_VECTOR_BYTES of them.
    """
    count = items.count()
    if count * (dim + 1) * 8 > MAX_VECTOR_BYTES:
        return None
    kind = dict(items.dtypes)["item_id"]
    got = items.select("item_id", "vec", "b").toPandas()
    order = np.argsort(got["item_id"].to_numpy(), kind="stable")
    ids = got["item_id"].to_numpy()[order]
    vectors = np.vstack(got["vec"].to_numpy()[order]) if count else np.zeros((0, dim))
    held = users.sparkSession.sparkContext.broadcast((ids, vectors, got["b"].to_numpy(float)[order]))
    have = seen.select("user_id", "item_id").distinct()
    asked = users.select("user_id", "vec").join(have.groupBy("user_id").agg(F.count("*").alias("_k")), "user_id", "left").withColumn("_k", F.coalesce("_k", F.lit(0)) + n)
    user_kind = dict(users.dtypes)["user_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, add = held.value
        for b in batches:
            u = b.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, dim)
            many = np.minimum(b.column("_k").to_numpy(), len(ids))
            for a in range(0, b.num_rows, 256):
                s = u[a : a + 256] @ vectors.T + add
                best = [np.argpartition(-r, k - 1)[:k] if 0 < k < len(ids) else np.arange(k) for r, k in zip(s, many[a : a + 256], strict=True)]
                at = np.repeat(np.arange(a, a + len(best)), [len(x) for x in best])
                yield pa.RecordBatch.from_arrays([b.column("user_id").take(pa.array(at)), pa.array(ids[np.concatenate(best)].tolist(), {"int": pa.int32(), "bigint": pa.int64()}.get(kind, pa.string()))], names=["user_id", "item_id"])

    return asked.mapInArrow(run, f"user_id {user_kind}, item_id {kind}").join(have, ["user_id", "item_id"], "left_anti")
