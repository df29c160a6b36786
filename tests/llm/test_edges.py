"""Queries over tables of nulls, empty and very long texts, repeated rows, further columns with likely names, and empty tables."""

import os

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
FURTHER = ["doc", "item", "bin", "cell", "rank", "n", "w", "seed", "g", "place", "field", "name", "evidence"]
QUERIES = ["p2_found", "p3_found", "p4_found", "p5_found", "p6_found", "p7_found", "p8_pack", "p9_found", "p10_found"]

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


def write(spark, folder, change):
    for t in os.listdir(DATA):
        if t.split(".")[0] in ("doc", "docs", "sentences", "page", "cite", "work", "documents", "authority", "eval_item", "subject", "container"):
            change(t.split(".")[0], spark.read.parquet(f"{DATA}/{t}")).write.parquet(f"{folder}/{t}")


@pytest.fixture(scope="module")
def messy(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("messy"))

    def change(name, df):
        df = df.limit(60) if name not in ("subject", "container", "eval_item") else df
        nulls = spark.createDataFrame([tuple(None for _ in df.columns)] * 2, df.schema) if name not in ("subject", "container") else df.limit(0)
        text = [c for c, k in df.dtypes if k == "string"]
        blank = df.limit(3).select(*[F.lit("").alias(c) if c in text else F.col(c) for c in df.columns]) if name not in ("subject", "container") else df.limit(0)
        long = df.limit(2).select(*[F.repeat(F.concat(F.col(c), F.lit(" ")), 3000).alias(c) if c in ("text", "abstract") else F.col(c) for c in df.columns])
        out = df.unionByName(nulls).unionByName(blank).unionByName(df.limit(5)).unionByName(long if name in ("documents", "docs", "sentences") else df.limit(0))
        return out.select("*", *[F.lit("x").alias(c) for c in FURTHER if c not in out.columns])

    write(spark, folder, change)
    return folder


@pytest.fixture(scope="module")
def bare(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("bare"))
    write(spark, folder, lambda name, df: df if name in ("subject", "container") else df.limit(0))
    return folder


@pytest.mark.parametrize("name", QUERIES)
def test_messy_tables(spark, messy, name):
    rows = registry.queries()[name](spark, messy).collect()
    if name.endswith("_found"):
        assert len(rows) == len(set(rows)) and not any(v is None for r in rows for v in r)


@pytest.mark.parametrize("name", QUERIES)
def test_empty_tables(spark, bare, name):
    assert registry.queries()[name](spark, bare).count() == 0
