"""Problem 4: scan noise in the sentences of theses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from palimpsest.llm import scans
from palimpsest.plans.runtime import cut, table


def p4_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc, page = table(spark, sf_dir, "doc"), table(spark, sf_dir, "page")
    titles = doc.select(F.col("id").alias("doc_id"), "title", (F.col("no_text_pages") > 0).alias("scanned"))
    # pages whose text layer the first reader could not use were scanned
    pages = page.groupBy("doc_id").agg(F.max(F.coalesce("source", F.lit("none")) != "pdfplumber").alias("scanned"))
    titles = titles.unionByName(pages.select("doc_id", F.lit(None).cast("string").alias("title"), "scanned"))
    return scans.repair(table(spark, sf_dir, "sentences"), titles)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_repaired(spark, sf_dir).where(F.size("found") > 0).select("doc_id", "idx").distinct()


def p4_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.paragraphs(cut(p4_repaired(spark, sf_dir), "repaired"))


QUERIES = {"p4_found": p4_found, "p4_repaired": p4_repaired, "p4_paragraphs": p4_paragraphs}
ORACLES: dict[str, str] = {}
