from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recmill.llm.mixing import Mixture, mix
from recmill.session import table


def _mixture(spark: SparkSession, sf_dir: str) -> Mixture:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir).sources.where("falls_short").select("source")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target, fitted rate and the share that the copies reached, of each source."""
    out = _mixture(spark, sf_dir).sources
    return out.select("source", "weight", "max_repeats", "size", F.round("soft_size", 0).alias("soft_size"), F.round("rate", 4).alias("rate"), F.round("expected", 0).alias("expected"), F.round("reached", 0).alias("reached"), F.round("share", 4).alias("share"), "falls_short", "converged")


def p8_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is taken."""
    return _mixture(spark, sf_dir).documents.select("doc_id", "tokens", F.round("rate", 4).alias("rate"), "copies")


QUERIES = {"p8_found": p8_found, "p8_shares": p8_shares, "p8_copies": p8_copies}
SQL = {
    # characters stand for tokens: no case depends on the tokenizer
    "p8_found": """
with s as (select t.*, coalesce((select sum(length(text)) from documents d where lower(regexp_replace(d.source, '^\\s+|\\s+$', '', 'g')) = t.source), 0) as size from mix_targets t)
select source from s where max_repeats * size < weight * (select sum(size) from s)
""",
}
