"""Problem 7: spellings of doc.creator and cite.surname that belong together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from palimpsest.llm.names import person_pairs, surname_pairs
from palimpsest.plans.runtime import table


def _tidy(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"(?U)\s+", " "))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "doc").select(_tidy(F.split_part("creator", F.lit(";"), F.lit(1))).alias("name"))
    # evidence of a surname: year and the second and third word of the title, which survive most cuts (of a title of one word, that word);
    # and, as the year may be missing or wrong, the second to fifth word of longer titles
    words = F.filter(F.split(F.lower("title"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    dated = F.when(F.col("year").isNotNull() & (F.size(words) > 0), F.concat_ws(" ", F.col("year").cast("string"), F.when(F.size(words) > 1, F.array_join(F.slice(words, 2, 2), " ")).otherwise(words[0])))
    undated = F.when(F.size(words) >= 5, F.array_join(F.slice(words, 2, 4), " "))
    cites = table(spark, sf_dir, "cite").where(F.col("surname").isNotNull()).select(_tidy(F.col("surname")).alias("name"), F.array_compact(F.array(dated, undated)).alias("works")).distinct()
    uses = cites.select("name", F.explode_outer("works").alias("evidence"))
    a = person_pairs(people).select(F.lit("creator").alias("field"), "name_1", "name_2")
    return a.unionByName(surname_pairs(uses).select(F.lit("surname").alias("field"), "name_1", "name_2"))


QUERIES = {"p7_found": p7_found}
ORACLES: dict[str, str] = {}
