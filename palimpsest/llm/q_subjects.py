"""Problem 5: the subject areas of every thesis."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from palimpsest.llm import subjects
from palimpsest.plans.runtime import table

COLUMNS = ("docid", "title", "abstract", "discipline", "discipline_conf")
MAX_SUBJECTS = 1000


def _subjects(spark: SparkSession, sf_dir: str) -> list[tuple[str, str]]:
    rows = table(spark, sf_dir, "subject").where(F.col("subject").isNotNull()).orderBy("subject").limit(MAX_SUBJECTS + 1).collect()  # a fixed list
    if len(rows) > MAX_SUBJECTS:
        raise ValueError(f"more than {MAX_SUBJECTS} subjects")
    once: dict[str, tuple[str, str]] = {}
    for r in rows:  # a subject listed twice counts once
        once.setdefault(r["subject"].strip().lower(), (r["subject"], r["descr"] or ""))
    return list(once.values())


def p5_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.subject_areas(table(spark, sf_dir, "docs"), _subjects(spark, sf_dir), COLUMNS).withColumnRenamed("doc", "docid")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_shares(spark, sf_dir).select("docid", "subject")


def p5_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Theses per subject, and their share of the corpus."""
    found = p5_shares(spark, sf_dir)
    n = table(spark, sf_dir, "docs").select("docid").distinct().count()
    return found.groupBy("subject").agg(F.count("*").alias("theses"), (F.count("*") / F.lit(max(n, 1))).alias("share"))


QUERIES = {"p5_found": p5_found, "p5_shares": p5_shares, "p5_composition": p5_composition}
ORACLES: dict[str, str] = {}
