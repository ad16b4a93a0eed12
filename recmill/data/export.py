"""Matrices for solvers on one machine, and checks of their order. What is collected is counted first."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recmill.data.schema import id_col, num_col
from recmill.operators.order import _in_files

#: Cells that are brought to the driver, at most.
MAX_CELLS = 50_000_000


def coordinates(relation, attribute: str | None = None, row: str = "user", col: str = "item", max_cells: int = MAX_CELLS) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[int, int]]:
    """(row numbers, column numbers, values, shape), sorted by row and column: one attribute of the coalesced log, whose
    nulls are left out, or ones. Times become seconds since 1970."""
    ds, m = relation.ds, relation.matrix(row, col)
    value = F.lit(1.0) if attribute is None else F.col(attribute)
    if attribute is not None and dict(m.dtypes)[attribute].startswith("timestamp"):
        value = F.unix_micros(F.col(attribute).cast("timestamp")) / 1e6
    cells = m.select(id_col(row), id_col(col), value.cast("double").alias("_v")).where("_v is not null")
    shape = []
    for role in (row, col):
        e = relation.spec.entities[role]
        n = ds.numbering(e).select(F.col(id_col(e)).alias(id_col(role)), F.col(num_col(e)).alias(f"_{role}"))
        cells = cells.join(n, id_col(role))
        shape.append(ds.entity_tables[e].count())
    got = cells.select(f"_{row}", f"_{col}", "_v").limit(max_cells + 1).toPandas()
    if len(got) > max_cells:
        raise ValueError(f"more than {max_cells} cells")
    r, c, v = (got[x].to_numpy() for x in (f"_{row}", f"_{col}", "_v"))
    order = np.lexsort((c, r))
    return r[order], c[order], v[order], (shape[0], shape[1])


def csr(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row pointers, columns, values) of sorted coordinates."""
    return np.searchsorted(rows, np.arange(shape[0] + 1)), cols, values


def to_scipy(relation, attribute: str | None = None, layout: str = "csr", legacy: bool = False, **roles):
    """A SciPy sparse array (or, with ``legacy``, matrix), where SciPy is installed."""
    try:
        from scipy import sparse
    except ImportError as e:
        raise ImportError("SciPy is not installed; coo() gives the same as NumPy arrays") from e
    r, c, v, shape = coordinates(relation, attribute, **roles)
    m = (sparse.coo_matrix if legacy else sparse.coo_array)((v, (r, c)), shape=shape)
    return m if layout == "coo" else m.asformat(layout)


def to_torch(relation, attribute: str | None = None, layout: str = "csr", **roles):
    """A Torch sparse tensor, where Torch is installed."""
    try:
        import torch
    except ImportError as e:
        raise ImportError("Torch is not installed; coo() gives the same as NumPy arrays") from e
    r, c, v, shape = coordinates(relation, attribute, **roles)
    if layout == "coo":
        return torch.sparse_coo_tensor(np.stack([r, c]), torch.from_numpy(v), size=shape)
    at, cols, values = csr(r, c, v, shape)
    return torch.sparse_csr_tensor(torch.from_numpy(at), torch.from_numpy(cols), torch.from_numpy(values), size=shape)


def is_sorted(df: DataFrame, *columns: str, order: str) -> bool:
    """Whether the rows, in the order of ``order``, strictly ascend by ``columns``. Neighbours are compared within range
    partitions, and the ends of partitions with each other."""
    key = F.struct(*columns)
    placed = _in_files(df.select(order, *[c for c in columns if c != order]), [F.col(order)])
    inside = placed.withColumn("_k", key).withColumn("_b", F.lag("_k").over(Window.partitionBy("_part").orderBy("_row")))
    if not inside.where(~F.coalesce(F.col("_b") < F.col("_k"), F.col("_b").isNull())).isEmpty():
        return False
    ends = placed.withColumn("_k", key).groupBy("_part").agg(F.min_by("_k", "_row").alias("lo"), F.max_by("_k", "_row").alias("hi")).orderBy("_part").collect()
    return all(tuple(a["hi"]) < tuple(b["lo"]) for a, b in zip(ends[:-1], ends[1:], strict=True))
