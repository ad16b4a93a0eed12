"""Problem 3: the most similar vectors by shifted space-filling curves.

Vectors that point the same way are one class, under its least id. The classes' unit vectors are projected
at random and ordered along many Hilbert curves, each with its own projection and shift. A curve is cut into
ranges of about RANGE_ROWS rows, whose bounds come from a bounded sample; each range also gets the rows just
beyond its bounds, so windows don't end there. On each curve a probe is compared with the window of its
neighbours by key, the best of all windows are merged, classes give way to their members with the least
ids, and what is left is reranked by the exact cosine. Work and shuffle grow with the number of vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recmill.operators.pairs import side_pairs
from recmill.session import cut

CURVES = 20
#: Neighbours by key on each side of a probe.
WINDOW = 640
#: Projected dimensions and bits of each; their product, the bits of a key, leaves 15 of 63 for the number of a range.
DIMS, BITS = 24, 2
#: Rows of a curve that are ordered together (more, where there would be more ranges than numbers for them), and
#: vectors that the bounds of such ranges are fitted on, at most.
RANGE_ROWS, SAMPLE = 50_000, 10_000
#: Classes kept for a probe beside the k that are asked for: windows compare vectors of 16-bit members.
SPARE = 4
#: Unit vectors that agree in all members to this many parts of 1 are one class.
SAME = 100_000


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of each row of integer coordinates below 2 ** bits."""
    x = cells.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(d):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(up, low, swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where(x[d - 1] & q, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def curve_keys(unit: np.ndarray, curve: int) -> np.ndarray:
    """Keys on one curve: a projection by its own random directions, evened out and shifted."""
    rng = np.random.default_rng([curve, unit.shape[1]])
    to = rng.standard_normal((unit.shape[1], DIMS))
    p = unit @ (to / np.sqrt((to * to).sum(0))) * math.sqrt(unit.shape[1])
    even = 1 / (1 + np.exp(-1.702 * p))
    return hilbert_key(np.minimum((even + rng.random(DIMS)) / 2 * (1 << BITS), (1 << BITS) - 1).astype(np.int64), BITS)


def _rows(col: pa.Array, dim: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _coded(dim: int):
    """(kind, id, probe, vec) in; with the class's code out."""
    mix = np.random.default_rng(dim).integers(1, 2**63, dim, dtype=np.uint64) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            cells = np.rint(_unit(_rows(b.column("vec"), dim)) * SAME).astype(np.int64).view(np.uint64)
            with np.errstate(over="ignore"):
                h = (cells * mix).sum(1, dtype=np.uint64)
                h = (h ^ (h >> np.uint64(29))) * mix[0]
                h = (h ^ (h >> np.uint64(32))) & ~np.uint64(1)  # the last bit is for marks
            yield pa.RecordBatch.from_arrays([b.column("kind"), b.column("id"), b.column("probe"), pa.array(h.view(np.int64)), b.column("vec")], names=["kind", "id", "probe", "code", "vec"])

    return run


class _Ranges:
    """Bounds of the ranges of every kind's curves, with the overlap beyond each, from a sample of vectors."""

    def __init__(self, counts: dict[str, int], sample: dict[str, np.ndarray], dim: int):
        self.first: dict[str, int] = {}
        self.many: dict[str, int] = {}
        self.bounds: dict[tuple[str, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.slots = 0
        rows = max(RANGE_ROWS, 2 * CURVES * sum(counts.values()) >> (63 - DIMS * BITS))
        for kind in sorted(counts):
            n, unit = counts[kind], sample.get(kind, np.zeros((0, dim)))
            many = max(1, min(-(-n // rows), len(unit)))
            self.first[kind], self.many[kind] = self.slots, many
            self.slots += many * CURVES
            # twice the window, as the sample only estimates where it ends
            beyond = 2 * WINDOW / max(n, 1) * len(unit) + 1
            at = np.arange(1, many) * len(unit) / many
            for c in range(CURVES):
                keys = np.sort(curve_keys(unit, c)) if many > 1 else np.zeros(1, np.int64)
                place = lambda x, keys=keys: keys[np.clip(x.astype(int), 0, len(keys) - 1)]
                self.bounds[kind, c] = place(at), place(at - beyond), place(at + beyond)


def _keys(dim: int, ranges: _Ranges):
    """(kind, code, probe, vec) in; for every curve the row in its range, and in a neighbouring one it is close to, out.

    ``place`` is range and key, ``code`` has the mark of a probe for its last bit: rows are many, and small.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            unit = _unit(_rows(b.column("vec"), dim))
            kinds, code, probe = b.column("kind").to_numpy(zero_copy_only=False), b.column("code").to_numpy(), b.column("probe").to_numpy(zero_copy_only=False)
            short = np.rint(unit * 32767).astype("<i2")
            vecs = pa.Array.from_buffers(pa.binary(), len(short), [None, pa.py_buffer((np.arange(len(short) + 1, dtype=np.int32) * 2 * dim).tobytes()), pa.py_buffer(short.tobytes())])
            for kind in np.unique(kinds):
                on = np.flatnonzero(kinds == kind)
                for c in range(CURVES):
                    key = curve_keys(unit[on], c)
                    bounds, low, high = ranges.bounds[kind, c]
                    own = np.searchsorted(bounds, key, side="right")
                    slots, rows, firsts = [own], [on], [np.ones(len(on), bool)]
                    if len(bounds):
                        after = (own > 0) & (key <= high[np.maximum(own - 1, 0)])
                        before = (own < len(bounds)) & (key >= low[np.minimum(own, len(bounds) - 1)])
                        for mask, step in ((after, -1), (before, 1)):
                            slots.append(own[mask] + step)
                            rows.append(on[mask])
                            firsts.append(np.zeros(mask.sum(), bool))
                        key = np.concatenate([key, key[after], key[before]])
                    at = np.concatenate(rows)
                    slot = ranges.first[kind] + c * ranges.many[kind] + np.concatenate(slots)
                    yield pa.RecordBatch.from_arrays([pa.array((slot << (DIMS * BITS)) | key), pa.array(code[at] | (probe[at] & np.concatenate(firsts))), vecs.take(pa.array(at))], names=["place", "code", "vec"])

    return run


def _window_hits(keep: int, dim: int, kind_of: list[tuple[int, str]]):
    """Sorted rows of ranges in; for every probe the ``keep`` best of its window out."""
    width = WINDOW
    begins, names = np.array([k[0] for k in kind_of]), np.array([k[1] for k in kind_of], object)

    def hits(slot, code, probe, vec, lo, hi):
        at = np.flatnonzero(probe[lo:hi]) + lo
        i = 0
        while i < len(at):
            # probes that lie close together share one block of rows
            n = int(np.searchsorted(at, at[i] + 2 * width, side="right"))
            p = at[i : min(n, i + 512)]
            i += len(p)
            a, z = max(0, p[0] - width), min(len(code), p[-1] + width + 1)
            rows = np.arange(a, z)
            off = np.abs(rows[None, :] - p[:, None])
            r = np.where((off > 0) & (off <= width) & (slot[a:z][None, :] == slot[p][:, None]), vec[p] @ vec[a:z].T, -9)
            best = np.argpartition(-r, min(keep, r.shape[1] - 1), axis=1)[:, :keep]
            found = np.take_along_axis(r, best, 1)
            ok = found > -9
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(names[np.searchsorted(begins, slot[p], side="right") - 1], ok.sum(1)), pa.string()), pa.array(np.repeat(code[p], ok.sum(1))), pa.array(code[a:z][best][ok]), pa.array(found[ok].astype(np.float32))],
                names=["kind", "probe", "code", "r"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, begin = None, 0  # rows from `begin` on have not had their turn; `width` rows before them are kept
        for b in batches:
            if not b.num_rows:
                continue
            vec = np.frombuffer(b"".join(b.column("vec").to_pylist()), "<i2").reshape(-1, dim).astype(np.float32) / 32767
            code = b.column("code").to_numpy()
            new = [b.column("place").to_numpy() >> (DIMS * BITS), code & ~1, (code & 1) == 1, vec]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            end = len(held[0]) - width
            if end > begin:
                yield from hits(*held, begin, end)
                cut_at = max(0, end - width)
                held, begin = [x[cut_at:] for x in held], end - cut_at
        if held is not None and len(held[0]) > begin:
            yield from hits(*held, begin, len(held[0]))

    return run


def _gathered(run, rows: int = 20_000):
    """The batches of ``run`` put together to larger ones."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in run(batches):
            held.append(b)
            n += b.num_rows
            if n >= rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return out


def _exact(dim: int):
    """(kind, probe, id, x, y) in; (kind, probe, id, r) with the cosine in millionths out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                r = np.rint((_unit(_rows(b.column("x"), dim)) * _unit(_rows(b.column("y"), dim))).sum(1) * 1e6).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column("kind"), b.column("probe"), b.column("id"), pa.array(r)], names=["kind", "probe", "id", "r"])

    return run


def usable_vectors(df: DataFrame, vec: str, dim: int) -> DataFrame:
    """Rows whose vector has ``dim`` finite members and is not all zero."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where(F.col(vec).isNotNull()).where((F.size(vec) == dim) & ~bad & F.exists(vec, lambda x: x != 0))


def _first(df: DataFrame, keys: list[str], order: list, n: int, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)


def nearest(vectors: DataFrame, probes: DataFrame, k: int = 10, dim: int = 48) -> DataFrame:
    """(kind, probe, id, cosine, rank): for every probe the ``k`` other vectors of its kind with the highest
    cosine, rounded to six decimals, ties to the smaller id.

    ``vectors(kind, id, vec)``, ids int32 and unique within a kind; ``probes(kind, id)``. Vectors that are
    null, all zero, of another length, or hold a null, NaN or infinity take no part, nor do probes without
    a vector; repeated probes count once. Fewer than ``k`` others give fewer rows. Copies and multiples of a
    vector are found whatever their number: only classes are ordered, and any class gives its k + 1 least ids.
    """
    spark = vectors.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    known = usable_vectors(vectors.select("kind", F.col("id").cast("int").alias("id"), F.col("vec").cast("array<float>").alias("vec")), "vec", dim).where("kind is not null and id is not null")
    wanted = probes.where("kind is not null and id is not null").select("kind", F.col("id").cast("int").alias("id")).distinct().withColumn("probe", F.lit(True))
    marked = known.join(wanted, ["kind", "id"], "left").select("kind", "id", F.coalesce("probe", F.lit(False)).alias("probe"), "vec")
    coded = cut(marked.mapInArrow(_coded(dim), "kind string, id int, probe boolean, code long, vec array<float>"), "vectors")
    classes = cut(coded.groupBy("kind", "code").agg(F.min(F.struct("id", "vec")).alias("m"), F.max("probe").alias("probe")).select("kind", "code", "probe", "m.vec"), "classes")
    counts = {r["kind"]: r["n"] for r in classes.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return _named(spark.createDataFrame([], "kind string, probe int, id int, r int, rank int"))
    sample: dict[str, list] = {x: [] for x in counts}
    if max(counts.values()) > RANGE_ROWS:  # bounded by SAMPLE; without a second range there is no bound to fit
        for r in classes.orderBy(F.xxhash64("kind", "code"), "kind", "code").limit(SAMPLE).select("kind", "vec").collect():
            sample[r["kind"]].append(r["vec"])
    ranges = _Ranges(counts, {x: _unit(np.array(v, np.float32)) for x, v in sample.items() if v}, dim)
    rows = classes.mapInArrow(_keys(dim, ranges), "place long, code long, vec binary")
    tasks = min(parts, ranges.slots)
    ordered = rows.repartitionById(tasks, F.pmod(F.shiftright("place", DIMS * BITS), F.lit(tasks)).cast("int")).sortWithinPartitions("place")
    keep = k + SPARE
    kind_of = sorted((n, x) for x, n in ranges.first.items())
    seen = ordered.mapInArrow(_gathered(_window_hits(keep, dim, kind_of)), "kind string, probe long, code long, r float")
    merged = seen.groupBy("kind", "probe", "code").agg(F.max("r").alias("r"))
    best = _first(merged, ["kind", "probe"], [F.desc("r"), "code"], keep).select("kind", F.col("probe").alias("of"), "code")
    own = classes.where("probe").select("kind", F.col("code").alias("of"), "code")
    # the least ids of every class that is in question, beside a probe of that class
    few = _first(coded.select("kind", "code", "id"), ["kind", "code"], ["id"], k + 1).drop("rank")
    offered = best.unionByName(own).join(few, ["kind", "code"]).select(F.struct("kind", F.col("of").alias("code")).alias("on"), "id")
    asked = coded.where("probe").select(F.struct("kind", "code").alias("on"), F.col("id").alias("probe"))
    pairs = side_pairs(cut(asked, "asked"), cut(offered, "offered"), "on", ["probe"], ["id"]).where("probe <> id").select("on.kind", "probe", "id")
    vec = coded.select("kind", "id", "vec")
    both = pairs.join(vec.withColumnRenamed("vec", "y"), ["kind", "id"]).join(vec.select("kind", F.col("id").alias("probe"), F.col("vec").alias("x")), ["kind", "probe"])
    exact = both.select("kind", "probe", "id", "x", "y").mapInArrow(_exact(dim), "kind string, probe int, id int, r int")
    return _named(_first(exact, ["kind", "probe"], [F.desc("r"), "id"], k))


def _named(top: DataFrame) -> DataFrame:
    return top.select("kind", "probe", "id", (F.col("r") / 1e6).alias("cosine"), "rank")
