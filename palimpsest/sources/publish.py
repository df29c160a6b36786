"""Publication: what is hidden in a payload, releases by staging and rename, and caches by content."""

from __future__ import annotations

import base64
import binascii
import html
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from palimpsest.operators import streams as S
from palimpsest.operators.release import manifest

DEPTH = 3
_PACKED = re.compile(r"[A-Za-z0-9+/=\s]{512,}")
_SCRIPT = re.compile(r"(?is)<script[^>]*>(.*?)</script>")


def _inflated(raw: bytes) -> bytes:
    """gzip, zlib or raw deflate, or the bytes as they are."""
    for window in (31, 15, -15):
        try:
            return zlib.decompress(raw, window)
        except zlib.error:
            continue
    return raw


def _strings(value) -> Iterator[str]:
    if isinstance(value, str):
        yield value
    elif isinstance(value, dict):
        for k, v in value.items():
            yield k
            yield from _strings(v)
    elif isinstance(value, list):
        for v in value:
            yield from _strings(v)


def layers(text: str, depth: int = DEPTH) -> Iterator[tuple[str, str]]:
    """(kind, text) of a payload and all it hides: entities, strings of JSON, scripts, packed stretches, to ``depth`` levels."""
    flat = lambda t: " ".join(t.split())
    yield "text", flat(text)
    plain = html.unescape(text)
    if plain != text:
        yield "entities", flat(plain)
    if text.lstrip()[:1] in ("{", "["):
        try:
            found = "\n".join(_strings(json.loads(text)))
        except ValueError:
            found = ""
        if found:
            yield "json", flat(found)
    if not depth:
        return
    inside = [("script", m.group(1)) for m in _SCRIPT.finditer(text)]
    for m in _PACKED.finditer(text):
        try:
            inside.append(("packed", _inflated(base64.b64decode("".join(m.group().split()), validate=True)).decode("utf-8")))
        except (binascii.Error, UnicodeDecodeError):
            continue
    for kind, t in inside:
        for sub, x in layers(t, depth - 1):
            yield f"{kind}/{sub}", x


def expanded(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(key, layer, kind, text): every layer of every payload (a binary column); text that is no UTF-8 is read as Latin-1. Null content has none."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, raw in zip(pdf["k"], pdf["c"]):
                raw = _inflated(raw) if raw[:2] == b"\x1f\x8b" else raw
                try:
                    text = raw.decode("utf-8")
                except UnicodeDecodeError:
                    text = raw.decode("latin-1")
                rows = [(k, i, kind, t) for i, (kind, t) in enumerate(layers(text))]
                yield pd.DataFrame(rows, columns=[key, "layer", "kind", "text"])

    x = files.where(F.col(content).isNotNull()).select(F.col(key).cast("string").alias("k"), F.col(content).alias("c"))
    return x.mapInPandas(each, f"`{key}` string, layer int, kind string, text string")


def leaked_runs(site: DataFrame, private: DataFrame, titles: DataFrame, n: int = 8) -> DataFrame:
    """(path, g, doc_id): runs of n words of private sentences in any layer of a site, without those that stand in a published title.

    ``site`` is (path, layer, text), ``private`` a sentences table, ``titles`` has a column title.  Runs do not cross sentences.
    """
    empty = F.array().cast("array<string>")
    rows = lambda df, key: S.token_rows(df.select(key.alias("doc_id"), F.lit(0).alias("idx"), F.col("text"), empty.alias("excl")))
    pub = S.grams(S.token_stream(rows(site, F.concat_ws("#", "path", "layer"))), n)
    own = private.where((F.coalesce(F.size("excl"), F.lit(0)) <= 0)).select(F.concat_ws("#", "doc_id", "idx").alias("place"), "text")
    own = S.grams(S.token_stream(rows(own, F.col("place"))), n)
    known = S.grams(S.token_stream(rows(titles.where("title is not null").select(F.col("title").alias("text"), F.xxhash64("title").cast("string").alias("k")), F.col("k"))), n).select("g").distinct()
    hit = pub.join(own.select("g", F.substring_index("doc_id", "#", 1).alias("private_id")).distinct(), "g").join(known, "g", "left_anti")
    return hit.select(F.substring_index("doc_id", "#", 1).alias("path"), "g", F.col("private_id").alias("doc_id")).distinct()


class NotARelease(RuntimeError):
    """A folder that a build may not replace."""


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def build_release(spark: SparkSession, tables: dict[str, DataFrame], folder: str, force: bool = False) -> DataFrame:
    """Writes tables and their list of digests to a folder beside ``folder`` and renames it in one step; returns the list.

    A folder that exists and is not empty is replaced only if it carries such a list (or with ``force``); until the rename
    the old release stays as it was.
    """
    fs, at = _fs(spark, folder)
    if fs.exists(at) and not force:
        held = [f.getPath().getName() for f in fs.listStatus(at)]
        if held and "manifest" not in held:
            raise NotARelease(f"{folder} holds {len(held)} entries and no manifest")
    staging = f"{folder.rstrip('/')}.staging-{uuid.uuid4().hex[:8]}"
    for name, df in tables.items():
        df.write.parquet(f"{staging}/{name}")
    manifest(spark, staging).where(~F.col("path").rlike(r"(^|/)[._]")).coalesce(1).write.json(f"{staging}/manifest")
    new = _fs(spark, staging)[1]
    if fs.exists(at):
        fs.delete(at, True)
    if not fs.rename(new, at):
        raise RuntimeError(f"{staging} could not be renamed to {folder}")
    return spark.read.json(f"{folder}/manifest")


def cached_extract(files: DataFrame, cache: str, extract, schema: str) -> DataFrame:
    """Results of ``extract(files)`` (rows with sha256) by content: what the cache holds is not extracted again, what is new is added to it."""
    spark = files.sparkSession
    fs, at = _fs(spark, cache)
    have = spark.read.schema(schema).parquet(cache) if fs.exists(at) else spark.createDataFrame([], schema)
    new = extract(files.join(have.select("sha256").distinct(), "sha256", "left_anti").dropDuplicates(["sha256"]))
    new.write.mode("append").parquet(cache)
    return spark.read.schema(schema).parquet(cache).join(files.select("sha256").distinct(), "sha256", "left_semi")
