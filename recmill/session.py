"""Session helpers: table access, lineage cuts in the cluster's shared folder, small SQL helpers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from recmill.errors import ConfigError


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as named by ``spark.checkpoint.dir``.

    Only where the setting is empty and everything runs on one machine (tests) a temporary folder is made,
    which is removed when the process ends. On a cluster without the setting this is an error: executors
    would each write to a disk of their own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ConfigError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="recmill-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(f"file://{own}")
    return f"file://{own}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back: lineage ends there.

    The files outlive any executor, unlike a cached or locally checkpointed frame.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/recmill/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._recmill_path = path
    return back


def drop_cut(df: DataFrame) -> None:
    """Delete the files behind a frame made by :func:`cut`, once nothing reads them any more."""
    path = getattr(df, "_recmill_path", None)
    if path is None:
        return
    jvm = df.sparkSession._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def no_nan(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in every floating column: missing has one form inside the engine."""
    out = df
    for f in df.schema.fields:
        if isinstance(f.dataType, FloatType | DoubleType):
            out = out.withColumn(f.name, F.nanvl(F.col(f"`{f.name}`"), F.lit(None).cast(f.dataType)))
    return out


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where a small input is read as fewer pieces; a large scan stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
