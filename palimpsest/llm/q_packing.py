"""Problem 8: texts packed into the containers."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from palimpsest.llm import packing
from palimpsest.plans.runtime import cut, table

TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
TOKENIZER = "byte_bpe_50k.json"


def _kinds(spark: SparkSession, sf_dir: str) -> dict[int, list[str]]:
    """Names of the container kinds by capacity; more than MAX_KINDS is an error, never a cut."""
    rows = table(spark, sf_dir, "container").select("container", "capacity").dropna().where("capacity > 0").distinct().limit(packing.MAX_KINDS + 1).collect()
    if len(rows) > packing.MAX_KINDS:
        raise ValueError(f"more than {packing.MAX_KINDS} kinds of containers")
    out: dict[int, list[str]] = {}
    for r in rows:
        out.setdefault(r["capacity"], []).append(r["container"])
    return {c: sorted(names) for c, names in out.items()}


def p8_pack(spark: SparkSession, sf_dir: str, tokenizer: str | None = None, per_cell: int = packing.PER_CELL) -> DataFrame:
    """Container and place (token offset in it) of every text or piece; kinds of one capacity share its bins by hash."""
    kinds = _kinds(spark, sf_dir)
    parts = packing.pieces(table(spark, sf_dir, "documents"), "doc_id", "text", tokenizer or f"{TOKENIZERS}/{TOKENIZER}", list(kinds))
    measured = cut(parts.withColumn("item", F.concat_ws("-", "doc", "piece", F.monotonically_increasing_id())), "pieces")
    out = packing.pack(packing.with_fillers(measured, list(kinds)), per_cell=per_cell)
    name = F.lit(None).cast("string")
    for c, names in kinds.items():
        name = F.when(F.col("capacity") == c, F.array(*[F.lit(x) for x in names])[F.pmod(F.xxhash64("bin"), F.lit(len(names))).cast("int")]).otherwise(name)
    w = Window.partitionBy("bin").orderBy(F.desc("tokens"), "item")  # a bin holds at most its capacity
    out = out.withColumn("place", F.coalesce(F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return out.select(F.col("doc").alias("doc_id"), "piece", "from_token", "tokens", "from_char", "to_char", name.alias("container"), "capacity", "bin", "place")


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers used and share of their room filled, by kind."""
    p = p8_pack(spark, sf_dir)
    per = p.groupBy("container", "capacity", "bin").agg(F.sum("tokens").alias("used"))
    return per.groupBy("container", "capacity").agg(F.count("*").alias("bins"), F.sum("used").alias("tokens"), (F.sum("used") / (F.count("*") * F.max("capacity"))).alias("fill"))


QUERIES = {"p8_pack": p8_pack, "p8_fill": p8_fill}
ORACLES: dict[str, str] = {}
