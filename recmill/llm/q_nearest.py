from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recmill.llm.nearest import nearest
from recmill.session import table


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [table(spark, sf_dir, f"{kind}_embeddings").select(F.lit(kind).alias("kind"), F.col(f"{kind}_id").alias("id"), F.col("embedding").alias("vec")) for kind in ("item", "user")]
    return parts[0].unionByName(parts[1])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = table(spark, sf_dir, "vector_probes").select("kind", F.col("vec_id").alias("id"))
    return nearest(_vectors(spark, sf_dir), probes).select("kind", F.col("probe").alias("vec_id"), F.col("id").alias("neighbour_id"))


def p3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 50, against all vectors of its kind."""
    vectors = _vectors(spark, sf_dir)
    return nearest(vectors, vectors.where("id % 50 = 0").select("kind", "id")).select("kind", F.col("probe").alias("vec_id"), F.col("id").alias("neighbour_id"), F.round("cosine", 6).alias("cosine"), "rank")


QUERIES = {"p3_found": p3_found, "p3_neighbours": p3_neighbours}

_NEAR = """
with v as (
  select kind, id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) as e from (
    select 'item' as kind, item_id as id, embedding::double[] as e from item_embeddings
    union all select 'user', user_id, embedding::double[] from user_embeddings)
  where e is not null and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and list_dot_product(e, e) > 0
),
p as (select distinct {probes}),
s as (select p.kind, p.id as vec_id, w.id as neighbour_id, round(list_dot_product(u.e, w.e), 6) as cosine
      from p join v u on u.kind = p.kind and u.id = p.id join v w on w.kind = p.kind and w.id <> p.id),
r as (select *, row_number() over (partition by kind, vec_id order by cosine desc, neighbour_id)::int as rank from s)
"""
#: The search is approximate: equality shows that at this size nothing was missed, and recall is measured in the tests.
SQL = {
    "p3_neighbours": _NEAR.format(probes="kind, id from v where id % 50 = 0") + "select kind, vec_id, neighbour_id, cosine, rank from r where rank <= 10",
    "p3_found": _NEAR.format(probes="kind, vec_id as id from vector_probes") + "select kind, vec_id, neighbour_id from r where rank <= 10",
}
