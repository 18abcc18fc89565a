"""The registered query of each operator, with production parameters and over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import ann, decontaminate, fim, forest, importance, language_id, mixing, pii, secret_scan, simhash, toxicity, url_filter, warc
from .common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ann.usable(table(spark, sf_dir, "embeddings"))
    return ann.search(rows, rows.where("vec_id % 100 = 0"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.described(warc.read(spark, warc.write(table(spark, sf_dir, "pages"))))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), ["doc_id"]).drop("copies")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.find(docs, pii.train(docs))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.components(table(spark, sf_dir, "documents")).drop("place")


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.drawn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {
        "op1_language_id": op1_language_id,
        "op2_url_filter": op2_url_filter,
        "op3_decontaminate": op3_decontaminate,
        "op4_ann": op4_ann,
        "op5_warc": op5_warc,
        "op6_secret_scan": op6_secret_scan,
        "op7_mixing": op7_mixing,
        "op8_simhash": op8_simhash,
        "op9_pii": op9_pii,
        "op10_toxicity": op10_toxicity,
        "op11_minhash": op11_minhash,
        "op12_importance": op12_importance,
        "op13_fim": op13_fim,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_url_filter": url_filter.ORACLE_SQL,
        "op3_decontaminate": decontaminate.ORACLE_SQL,
        "op5_warc": warc.ORACLE_SQL,
        "op7_mixing": mixing.ORACLE_SQL,
        "op11_minhash": forest.ORACLE_SQL,
        "op12_importance": importance.ORACLE_SQL,
        "op13_fim": fim.ORACLE_SQL,
    }
