"""Checks before publication: column policy, size figures, verbatim runs, file and header differences, manifests."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from palimpsest.functions.text import match_tokens
from palimpsest.operators import streams as S


@dataclass(frozen=True)
class Policy:
    """What a column may hold: kind (id, int, float, bool, token, url, enum or text) and its limits."""

    kind: str
    max_chars: int = 10_000
    max_words: int = 10_000
    max_distinct: int | None = None


# fixed values: what a value of each kind looks like
KINDS = {"id": r"^[A-Za-z0-9:._/\-]+$", "int": r"^-?\d+$", "float": r"^-?\d+(\.\d+)?([eE][-+]?\d+)?$", "bool": r"^(0|1|true|false)$", "token": r"^[^\s]+$", "url": r"^https?://\S+$"}


def problem(c: Column, p: Policy) -> Column:
    """Why a value breaks its policy, or null; nulls and '' are missing, which is allowed."""
    s = c.cast("string")
    out = F.when(F.coalesce(s, F.lit("")) == "", F.lit(None).cast("string"))
    if p.kind in KINDS:
        out = out.when(~s.rlike(KINDS[p.kind]), f"not {p.kind}")
    return out.when(F.length(s) > p.max_chars, "too many characters").when(F.size(F.split(F.trim(s), r"\s+")) > p.max_words, "too many words")


def column_problems(df: DataFrame, policies: dict[str, Policy]) -> DataFrame:
    """(column, problem, n): broken values per column, and enums of too many values; one pass for all columns."""
    cells = F.array(*[F.struct(F.lit(k).alias("column"), problem(F.col(k), p).alias("problem")) for k, p in policies.items()])
    broken = df.select(F.explode(cells).alias("x")).select("x.column", "x.problem").where("problem is not null").groupBy("column", "problem").agg(F.count("*").alias("n"))
    enums = {k: p for k, p in policies.items() if p.max_distinct is not None}
    if not enums:
        return broken
    card = df.agg(*[F.count_distinct(k).alias(k) for k in enums])
    rows = F.array(*[F.struct(F.lit(k).alias("column"), F.lit("too many values").alias("problem"), F.when(F.col(k) > p.max_distinct, F.col(k)).alias("n")) for k, p in enums.items()])
    return broken.unionByName(card.select(F.explode(rows).alias("x")).select("x.column", "x.problem", "x.n").where("n is not null"))


def header_problems(columns: list[str], allowed: list[str], forbidden: list[str] = ()) -> list[str]:
    """Missing, unexpected and forbidden column names."""
    low = {c.lower() for c in columns}
    return [f"missing {c}" for c in allowed if c not in columns] + [f"unexpected {c}" for c in columns if c not in allowed] + [f"forbidden {c}" for c in forbidden if c.lower() in low]


def column_figures(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, filled, max_chars, max_words, distinct) in one pass."""
    s = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    words = lambda c: F.when(s(c) == "", 0).otherwise(F.size(F.split(F.trim(s(c)), r"\s+")))
    agg = df.agg(*[x for c in columns for x in (F.count_if(s(c) != "").alias(f"{c}__f"), F.coalesce(F.max(F.length(s(c))), F.lit(0)).alias(f"{c}__c"), F.coalesce(F.max(words(c)), F.lit(0)).alias(f"{c}__w"), F.count_distinct(F.nullif(s(c), F.lit(""))).alias(f"{c}__d"))])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}__f").alias("filled"), F.col(f"{c}__c").alias("max_chars"), F.col(f"{c}__w").alias("max_words"), F.col(f"{c}__d").alias("distinct")) for c in columns])
    return agg.select(F.explode(rows).alias("x")).select("x.*")


def seeded_runs(values: DataFrame, texts: DataFrame, least: int = 5) -> DataFrame:
    """(value_id, doc_id, run): longest common stretch of tokens of a value and a text, of ``least`` tokens or more, over whole texts.

    Grams of ``least`` tokens are joined instead of single tokens; those on one diagonal form islands.  Both sides are
    (doc_id, pos, tok) streams.
    """
    v, t = S.grams(values, least), S.grams(texts, least)
    m = v.select(F.col("doc_id").alias("value_id"), F.col("pos").alias("pv"), "g").join(t.select("doc_id", F.col("pos").alias("pt"), "g"), "g")
    w = Window.partitionBy("value_id", "doc_id", "d").orderBy("pt")
    isl = m.withColumn("d", F.col("pv") - F.col("pt")).withColumn("i", F.col("pt") - F.row_number().over(w))
    return isl.groupBy("value_id", "doc_id", "d", "i").agg((F.count("*") + least - 1).alias("run")).groupBy("value_id", "doc_id").agg(F.max("run").alias("run"))


def verbatim_grams(published: DataFrame, private: DataFrame, key: str, text: str, n: int = 8) -> DataFrame:
    """(key, shared): grams of a published text that stand in private rows; ``private`` is a sentences table.

    Grams go to the join as digests, without a copy of their words; of texts of one key the least counts.
    """
    texts = published.where(F.col(key).isNotNull()).select(key, match_tokens(F.col(text)).alias("toks"))
    if published.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").take(1):
        texts = texts.groupBy(key).agg(F.min("toks").alias("toks"))
    pub = texts.select(key, F.explode(S.array_grams(F.col("toks"), n)).alias("g"))
    shared = pub.join(S.row_grams(private, n), "g", "left_semi").groupBy(key).agg(F.count_distinct("g").alias("shared"))
    return shared.withColumn(key, F.col(key).cast("string"))


def compare_listing(listed: DataFrame, present: DataFrame) -> DataFrame:
    """(path, state): listed against present files by (path, sha256): missing, unlisted, mismatch or ok."""
    a, b = listed.select("path", F.col("sha256").alias("sa")), present.select("path", F.col("sha256").alias("sb"))
    state = F.when(F.col("sb").isNull(), "missing").when(F.col("sa").isNull(), "unlisted").when(F.col("sa") != F.col("sb"), "mismatch").otherwise("ok")
    return a.join(b, "path", "full_outer").select("path", state.alias("state"))


def manifest(spark, folder: str) -> DataFrame:
    """(path, sha256, bytes) of all files under a folder, paths relative to it."""
    root = folder.rstrip("/").split("://")[-1].lstrip("/")
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return f.select(F.substring_index("path", f"{root}/", -1).alias("path"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one side only, with the side's name; repeats count."""
    return reduce(DataFrame.unionByName, [a.exceptAll(b).withColumn("side", F.lit("left")), b.exceptAll(a).withColumn("side", F.lit("right"))])
