"""Problem 1: results per (surname, year) over a skewed citation table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from palimpsest.operators.skew import balanced_group, balanced_join, plan_load
from palimpsest.plans.runtime import table

HOT_SHARE = 0.02  # a key is a case from this share of the rows on

NORM = "lower(trim(surname))"


def keyed_cites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cite rows with a usable key; the surname lower-cased and trimmed."""
    c = table(spark, sf_dir, "cite").withColumn("surname", F.lower(F.trim("surname")))
    return c.where((F.col("surname") != "") & F.col("year").isNotNull())


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = keyed_cites(spark, sf_dir).select("surname", "year")
    plan = plan_load(c.groupBy("surname", "year").agg(F.count("*").alias("rows")), ["surname", "year"])
    got = balanced_group(c, ["surname", "year"], {"n": F.count("*")}, {"n": F.sum("n")}, plan=plan)
    return got.where(F.col("n") >= HOT_SHARE * plan.total).select("surname", "year")


def p1_key_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, rows with a DOI, year range of loading and longest title of every key."""
    c = keyed_cites(spark, sf_dir).select("surname", "year", "doi", "title", "loaded_at")
    partial = {"n": F.count("*"), "dois": F.count("doi"), "first": F.min("loaded_at"), "last": F.max("loaded_at"), "longest": F.max(F.length("title"))}
    merge = {"n_rows": F.sum("n"), "n_doi": F.sum("dois"), "first_loaded": F.min("first"), "last_loaded": F.max("last"), "longest_title": F.max("longest")}
    return balanced_group(c, ["surname", "year"], partial, merge)


def p1_join_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cite row with each work of its (surname, year); counted per work and citing thesis."""
    c = keyed_cites(spark, sf_dir).select("src", "surname", "year")
    w = table(spark, sf_dir, "work").select(F.lower(F.trim("surname")).alias("surname"), "year", "key")
    return balanced_join(c, w, ["surname", "year"]).groupBy("key").agg(F.count("*").alias("n_rows"), F.min("src").alias("first_src"), F.max("src").alias("last_src"))


QUERIES = {"p1_found": p1_found, "p1_key_results": p1_key_results, "p1_join_works": p1_join_works}

_KEYED = f"(SELECT * REPLACE (lower(trim(surname)) AS surname) FROM cite WHERE trim(surname) <> '' AND year IS NOT NULL)"
ORACLES = {
    "p1_found": f"SELECT surname, year FROM {_KEYED} GROUP BY surname, year HAVING count(*) >= 0.02 * (SELECT count(*) FROM {_KEYED})",
    "p1_key_results": f"SELECT surname, year, count(*) AS n_rows, count(doi) AS n_doi, min(loaded_at) AS first_loaded, max(loaded_at) AS last_loaded, max(length(title)) AS longest_title FROM {_KEYED} GROUP BY surname, year",
    "p1_join_works": f"SELECT w.key, count(*) AS n_rows, min(c.src) AS first_src, max(c.src) AS last_src FROM {_KEYED} c JOIN (SELECT lower(trim(surname)) AS surname, year, key FROM work) w ON c.surname = w.surname AND c.year = w.year GROUP BY w.key",
}
