"""Ids and their numbers, as a frame that joins use in place of a hash table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recmill.errors import DataError
from recmill.operators.order import number_rows
from recmill.session import cut


class Vocabulary:
    """``table(id, num)``: distinct ids with dense numbers from 0. Numbers never change; new ids come after all others."""

    def __init__(self, table: DataFrame, size: int | None = None):
        self.table = table
        self.size = table.count() if size is None else size

    @classmethod
    def of(cls, ids: DataFrame, column: str | None = None) -> Vocabulary:
        """The distinct non-null ids of a column (default: the first one), numbered in their order."""
        return cls(cut(number_rows(_ids(ids, column), "id", name="num"), "vocabulary"))

    def __len__(self) -> int:
        return self.size

    def add(self, ids: DataFrame, column: str | None = None) -> Vocabulary:
        fresh = _ids(ids, column).join(self.table, "id", "left_anti")
        return Vocabulary(cut(self.table.unionByName(number_rows(fresh, "id", name="num", start=self.size)), "vocabulary"))

    def numbers(self, df: DataFrame, column: str, name: str = "num", missing: str = "error") -> DataFrame:
        """``df`` with the number of its ``column``. Unknown ids: an error when the row is used, or null, or left out
        ("error", "null", "filter")."""
        if missing not in ("error", "null", "filter"):
            raise ValueError("missing must be error, null or filter")
        out = df.join(self.table.select(F.col("id").alias(column), F.col("num").alias(name)), column, "inner" if missing == "filter" else "left")
        if missing == "error":
            out = out.withColumn(name, F.when(F.col(name).isNull() & F.col(column).isNotNull(), F.raise_error(F.concat(F.lit("unknown id "), F.col(column).cast("string"))).cast("bigint")).otherwise(F.col(name)))
        return out

    def ids(self, df: DataFrame, column: str, name: str = "id") -> DataFrame:
        """``df`` with the id of the number in ``column``; numbers out of range give null."""
        return df.join(self.table.select(F.col("num").alias(column), F.col("id").alias(name)), column, "left")

    def id(self, num: int):
        if not 0 <= num < self.size:
            raise DataError(f"no number {num}")
        return self.table.where(F.col("num") == num).first()["id"]

    def number(self, value) -> int | None:
        found = self.table.where(F.col("id") == F.lit(value)).first()
        return None if found is None else found["num"]

    def content_hash(self) -> str:
        """The same for equal vocabularies, whatever their partitioning: sum and exclusive or of the rows' hashes."""
        h = F.xxhash64("num", F.col("id").cast("string"))
        row = self.table.agg(F.sum(h.cast("decimal(38,0)")).alias("s"), F.bit_xor(h).alias("x"), F.count("*").alias("n")).select(F.sha1(F.concat_ws("|", *[F.col(c).cast("string") for c in ("s", "x", "n")])).alias("h"))
        return row.first()["h"]

    def __eq__(self, other) -> bool:
        return isinstance(other, Vocabulary) and self.size == other.size and self.content_hash() == other.content_hash()

    __hash__ = None


def _ids(df: DataFrame, column: str | None) -> DataFrame:
    c = column or df.columns[0]
    return df.where(F.col(c).isNotNull()).select(F.col(c).alias("id")).distinct()


def negative_mask(df: DataFrame, listed: DataFrame, on: list[str], name: str = "mask") -> DataFrame:
    """``df`` with a column that is true except for the rows listed."""
    return df.join(listed.select(*on).distinct().withColumn(name, F.lit(False)), on, "left").withColumn(name, F.coalesce(name, F.lit(True)))
