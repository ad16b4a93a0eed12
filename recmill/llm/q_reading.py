from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recmill.llm.reading import clear_levels, profile, reading_levels
from recmill.session import table


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_labels"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clear_levels(_levels(spark, sf_dir))


def p9_reading_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _levels(spark, sf_dir)
    return out.select("doc_id", "level", F.round("difficulty", 4).alias("difficulty"), "n_sentences", "n_words", "n_letters")


def p9_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus by language and reading level."""
    lang = table(spark, sf_dir, "documents").select("doc_id", F.lower(F.substring("lang", 1, 2)).alias("language"))
    return profile(_levels(spark, sf_dir).join(lang, "doc_id"), "language")


QUERIES = {"p9_found": p9_found, "p9_reading_levels": p9_reading_levels, "p9_profile": p9_profile}
#: No SQL: prose and models are checked on small articles and by held-out accuracy in the tests.
SQL: dict[str, str] = {}
