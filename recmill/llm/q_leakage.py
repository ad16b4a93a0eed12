from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recmill.llm.leakage import leaked
from recmill.session import table


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_passages")).select("doc_id", F.col("test_id").cast("int").alias("test_id"))


def p7_leaks_by_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per test item: how many documents hold it, and how much of it at most."""
    tests = table(spark, sf_dir, "eval_passages").select("test_id", "benchmark")
    found = leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_passages"))
    per = found.groupBy(F.col("test_id").cast("int").alias("test_id")).agg(F.count("*").alias("n_documents"), F.round(F.max(F.col("held") / F.col("words")), 6).alias("most_held"))
    return tests.join(per, "test_id", "left").select("test_id", "benchmark", F.coalesce("n_documents", F.lit(0)).alias("n_documents"), F.coalesce("most_held", F.lit(0.0)).alias("most_held"))


QUERIES = {"p7_found": p7_found, "p7_leaks_by_test": p7_leaks_by_test}
#: No SQL: alignment of edited text is checked against brute force in the tests.
SQL: dict[str, str] = {}
