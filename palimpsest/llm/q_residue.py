"""Problem 10: records that hold template residue or a site message."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm.residue import residue_records
from palimpsest.plans.runtime import table


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue_records(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("doc", "doc_id")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_scores(spark, sf_dir).select("doc_id")


QUERIES = {"p10_found": p10_found, "p10_scores": p10_scores}
ORACLES: dict[str, str] = {}
