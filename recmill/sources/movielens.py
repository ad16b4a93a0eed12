"""MovieLens editions: 100K, 1M / 10M, and the CSV editions, from a directory or a zip file."""

from __future__ import annotations

import uuid
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recmill.data.builder import DatasetBuilder
from recmill.data.dataset import Dataset
from recmill.data.vocabulary import Vocabulary
from recmill.session import shared_dir
from recmill.sources.frames import epoch


#: The ratings file of each edition.
FILES = {"u.data": "100k", "ratings.dat": "dat", "ratings.csv": "csv"}
#: Names of tags that a schema holds; more tags stay without names.
MAX_NAMES = 100_000


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _has(spark: SparkSession, directory: str, file: str) -> bool:
    fs, p = _fs(spark, f"{directory}/{file}")
    return fs.exists(p)


def _unpacked(spark: SparkSession, path: str) -> str:
    """Spark reads no zip: its files go to the shared folder, from wherever the zip is."""
    jvm, to = spark._jvm, f"{shared_dir(spark)}/recmill/zip-{uuid.uuid4().hex}"
    fs, p = _fs(spark, path)
    source = jvm.java.util.zip.ZipInputStream(fs.open(p))
    try:
        while (entry := source.getNextEntry()) is not None:
            if not entry.isDirectory():
                name = PurePosixPath(entry.getName())
                if name.is_absolute() or ".." in name.parts:
                    raise ValueError(f"unsafe name in {path}: {name}")
                out_fs, out = _fs(spark, f"{to}/{name}")
                stream = out_fs.create(out, True)
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, stream, 1 << 16, False)
                stream.close()
    finally:
        source.close()
    return to


def _directory(spark: SparkSession, path: str) -> str:
    """The folder with the files: ``path``, what a zip holds, or the only folder in either."""
    p = _unpacked(spark, str(path)) if str(path).endswith(".zip") else str(path).rstrip("/")
    if not any(_has(spark, p, f) for f in FILES):
        fs, at = _fs(spark, p)
        inner = [s.getPath().toString() for s in fs.listStatus(at) if s.isDirectory()] if fs.exists(at) else []
        if len(inner) == 1:
            return inner[0]
    return p


def edition(spark: SparkSession, path: str) -> str:
    """100k, dat or csv, by the files that are there."""
    for file, name in FILES.items():
        if _has(spark, path, file):
            return name
    raise FileNotFoundError(f"no MovieLens files in {path}")


def _colons(spark: SparkSession, path: str, *names: str) -> DataFrame:
    parts = F.split("value", "::")
    return spark.read.option("encoding", "ISO-8859-1").text(str(path)).select(*[parts[i].alias(n) for i, n in enumerate(names)])


def load_ratings(spark: SparkSession, path: str) -> DataFrame:
    """user_id, item_id, rating, timestamp."""
    p = _directory(spark, path)
    return _ratings(spark, p, edition(spark, p))


def _ratings(spark: SparkSession, p: str, kind: str) -> DataFrame:
    if kind == "100k":
        df = spark.read.schema("user_id int, item_id int, rating float, ts long").option("sep", "\t").csv(f"{p}/u.data")
    elif kind == "dat":
        df = _colons(spark, f"{p}/ratings.dat", "user_id", "item_id", "rating", "ts").select(F.col("user_id").cast("int"), F.col("item_id").cast("int"), F.col("rating").cast("float"), F.col("ts").cast("long"))
    else:
        df = spark.read.schema("user_id int, item_id int, rating float, ts long").option("header", True).csv(f"{p}/ratings.csv")
    return df.select("user_id", "item_id", "rating", epoch("ts").alias("timestamp"))


def split_genres(c):
    """A list of genres; null where none are listed."""
    return F.when(c == "(no genres listed)", None).otherwise(F.split(c, r"\|"))


def _movies(spark: SparkSession, p: str, kind: str) -> DataFrame:
    if kind == "100k":
        return spark.read.option("sep", "|").option("encoding", "ISO-8859-1").csv(f"{p}/u.item").select(F.col("_c0").cast("int").alias("item_id"), F.col("_c1").alias("title"))
    df = _colons(spark, f"{p}/movies.dat", "item_id", "title", "genres") if kind == "dat" else spark.read.option("header", True).option("escape", '"').csv(f"{p}/movies.csv").withColumnRenamed("movieId", "item_id")
    return df.select(F.col("item_id").cast("int").alias("item_id"), "title", split_genres(F.col("genres")).alias("genres"))


def tag_counts(tags: DataFrame) -> DataFrame:
    """(item_id, tag, n): how often an item has a tag, apart from letter case."""
    return tags.where("item_id is not null and tag is not null").groupBy("item_id", F.lower("tag").alias("tag")).agg(F.count("*").alias("n"))


def genome_vectors(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """(item_id, genome) with relevances in tag order, and the tags' names."""
    tags = spark.read.schema("tagId int, tag string").option("header", True).csv(f"{path}/genome-tags.csv").orderBy("tagId").collect()
    scores = spark.read.schema("movieId int, tagId int, relevance float").option("header", True).csv(f"{path}/genome-scores.csv")
    wide = scores.groupBy("movieId").pivot("tagId", [r["tagId"] for r in tags]).agg(F.first("relevance"))
    return wide.select(F.col("movieId").alias("item_id"), F.array(*[F.coalesce(F.col(f"`{r['tagId']}`"), F.lit(0.0)).cast("float") for r in tags]).alias("genome")), [r["tag"] for r in tags]


def load_movielens(spark: SparkSession, path: str) -> Dataset:
    p = _directory(spark, path)
    kind = edition(spark, p)
    b = DatasetBuilder(spark, PurePosixPath(p).name)
    has = lambda f: _has(spark, p, f)
    if (kind, True) in (("100k", has("u.item")), ("dat", has("movies.dat")), ("csv", has("movies.csv"))):
        b.add_entities("item", _movies(spark, p, kind))
    if kind == "100k" and has("u.user"):
        users = spark.read.option("sep", "|").csv(f"{p}/u.user").toDF("user_id", "age", "gender", "occupation", "zip_code")
        b.add_entities("user", users.select(F.col("user_id").cast("int"), F.col("age").cast("int"), "gender", "occupation", "zip_code"))
    b.add_interactions("rating", _ratings(spark, p, kind), entities=["user", "item"], missing="insert", allow_repeats=False, default=True)
    tags = None
    if has("tags.csv"):
        tags = spark.read.option("header", True).option("escape", '"').csv(f"{p}/tags.csv").select(F.col("movieId").cast("int").alias("item_id"), "tag")
    elif has("tags.dat"):
        line = r"^(\d+)::(\d+)::(.*)::(\d+)$"
        tags = spark.read.text(f"{p}/tags.dat").select(F.regexp_extract("value", line, 2).cast("int").alias("item_id"), F.regexp_extract("value", line, 3).alias("tag"))
    if tags is not None:
        n = tag_counts(tags)
        voc = Vocabulary.of(n, "tag")
        names = [r["id"] for r in voc.table.orderBy("num").collect()] if len(voc) <= MAX_NAMES else None
        vec = voc.numbers(n, "tag", "index").groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct(F.col("index").cast("int").alias("index"), F.col("n").cast("float").alias("value")))).alias("tag_counts"))
        known = b.entities["item"].select("item_id")
        b.add_vector_attribute("item", "tag_counts", vec.join(known, "item_id", "left_semi"), len(voc), names, sparse=True)
    if has("genome-scores.csv"):
        vec, names = genome_vectors(spark, p)
        b.add_vector_attribute("item", "genome", vec.join(b.entities["item"].select("item_id"), "item_id", "left_semi"), len(names), names)
    return b.build()
