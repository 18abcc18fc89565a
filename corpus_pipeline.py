"""A corpus pipeline: each stage works on all rows that the one before it kept.

Each stage is written as Parquet in the shared folder and read again, so a lost executor costs at most
the stage that runs. All but the last return the columns of ``documents``; the last also numbers a
document's copies. Nulls, empty texts, ties, repeated rows, empty tables and extra columns are handled
as the operators say; extra columns do not pass the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zscape.llm import decontaminate, language_id, mixing, secret_scan, simhash
from zscape.llm.common import table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, and those that the trained classifiers reject (see ``predict``)."""
    rows = language_id.predict(docs.select(*COLUMNS), language_id.train(docs), COLUMNS)
    return rows.where("accepted").select(*COLUMNS)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    return simhash.representatives(docs, COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text are masked, and ``n_chars`` follows."""
    length, kind = F.coalesce(F.char_length("text"), F.lit(0)), docs.schema["n_chars"].dataType
    rest = docs.withColumn("n_chars", (F.col("n_chars") - length).cast(kind))
    return secret_scan.redacted(rest, COLUMNS).withColumn("n_chars", (F.col("n_chars") + length).cast(kind))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document once for every copy that the mix of sources takes."""
    return mixing.emitted(docs, COLUMNS)


STAGES = [
    ("language_id", language),
    ("simhash", dedup),
    ("decontaminate", decontaminated),
    ("secret_scan", secrets),
    ("mixing", mixed),
]

#: The language stage is a trained model, which SQL cannot express; tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
