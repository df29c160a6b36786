"""Problem 6: works cited together in the same thesis."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from palimpsest.llm.cooccur import cooccurrence
from palimpsest.operators.skew_queries import keyed_cites


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cooccurrence(keyed_cites(spark, sf_dir).select("src", "surname", "year"), "src", ["surname", "year"], 6, 4.0)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("surname_1", "year_1", "surname_2", "year_2")


def p6_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir)


QUERIES = {"p6_found": p6_found, "p6_lift": p6_lift}

_SQL = """WITH k AS (SELECT DISTINCT src, lower(trim(surname)) AS surname, year FROM cite WHERE trim(surname) <> '' AND year IS NOT NULL AND src IS NOT NULL),
i AS (SELECT surname, year, count(*) AS n FROM k GROUP BY ALL), t AS (SELECT count(DISTINCT src) AS n FROM k),
c AS (SELECT a.surname AS surname_1, a.year AS year_1, b.surname AS surname_2, b.year AS year_2, count(*) AS n_ab
      FROM k a JOIN k b ON a.src = b.src AND (a.surname < b.surname OR (a.surname = b.surname AND a.year < b.year)) GROUP BY ALL HAVING count(*) >= 6)
SELECT {cols} FROM c JOIN i x ON x.surname = surname_1 AND x.year = year_1 JOIN i y ON y.surname = surname_2 AND y.year = year_2, t
WHERE n_ab * t.n >= 4 * x.n * y.n"""
ORACLES = {
    "p6_found": _SQL.format(cols="surname_1, year_1, surname_2, year_2"),
    "p6_lift": _SQL.format(cols="surname_1, year_1, surname_2, year_2, x.n AS n_1, y.n AS n_2, n_ab, t.n AS n_baskets, n_ab * t.n::DOUBLE / (x.n * y.n) AS lift"),
}
