"""Payload layers, leak scan, release folders, content cache, command line."""

import base64
import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.__main__ import main
from palimpsest.sources import publish as P

SECRET = "seven careful volunteers counted every single heron beside the quiet river"


def packed(text):
    rng = random.Random(0)
    return base64.b64encode(gzip.compress((text + " " + " ".join(str(rng.random()) for _ in range(80))).encode())).decode()


def test_layers_see_through_wrappings():
    page = f"<p>caf&eacute;</p><script>var d = {json.dumps(packed(SECRET))};</script>"
    got = list(P.layers(page))
    assert ("entities", "<p>café</p>" + page.split("</p>")[1]) in got
    assert any(k == "script/packed/text" and SECRET in t for k, t in got)
    assert ("json", "a b" + chr(34) + "c") in list(P.layers(json.dumps({"a": ["b" + chr(34) + "c"]})))
    assert list(P.layers("")) == [("text", "")]


def test_leak_scan(spark):
    files = spark.createDataFrame([("p1", bytearray(f"<script>{packed(SECRET)}</script>".encode())), ("p2", bytearray(b"nothing of note here")), ("p3", bytearray(gzip.compress(SECRET.encode()))), ("p4", None), ("p5", bytearray(b"\xff\xfe"))], "path string, content binary")
    site = P.expanded(files)
    private = spark.createDataFrame([("d", 0, SECRET, []), ("d", 1, "an unrelated row", [])], "doc_id string, idx int, text string, excl array<string>")
    titles = spark.createDataFrame([("A title",), (None,)], "title string")
    assert {r["path"] for r in P.leaked_runs(site, private, titles).collect()} == {"p1", "p3"}
    published = spark.createDataFrame([(SECRET,)], "title string")
    assert P.leaked_runs(site, private, published).count() == 0


def test_release_is_staged_and_guarded(spark, tmp_path):
    folder = str(tmp_path / "release")
    first = P.build_release(spark, {"a": spark.range(3)}, folder)
    assert first.count() >= 1 and all(r["path"].startswith("a/") for r in first.collect())
    P.build_release(spark, {"b": spark.range(5)}, folder)
    assert spark.read.parquet(f"{folder}/b").count() == 5 and not (tmp_path / "release" / "a").exists()
    assert [p.name for p in tmp_path.iterdir()] == ["release"]
    other = tmp_path / "mine"
    other.mkdir()
    (other / "letter.txt").write_text("keep me")
    with pytest.raises(P.NotARelease):
        P.build_release(spark, {"a": spark.range(1)}, str(other))
    assert (other / "letter.txt").read_text() == "keep me"


def test_cache_extracts_new_content_only(spark, tmp_path):
    seen = []

    def extract(df):
        seen.append(sorted(r["sha256"] for r in df.collect()))
        return df.select("sha256", F.upper("sha256").alias("text"))

    files = lambda *k: spark.createDataFrame([(f"/f{i}", s) for i, s in enumerate(k)], "path string, sha256 string")
    schema, cache = "sha256 string, text string", str(tmp_path / "cache")
    assert {r["text"] for r in P.cached_extract(files("a", "b", "b"), cache, extract, schema).collect()} == {"A", "B"}
    assert {r["text"] for r in P.cached_extract(files("b", "c"), cache, extract, schema).collect()} == {"B", "C"}
    assert seen == [["a", "b"], ["c"]]


def test_command_line(spark, capsys):
    assert main(["list"]) == 0 and "top_pairs" in capsys.readouterr().out
    assert main(["run", "top_pair", "/none"]) == 2 and "top_pairs" in capsys.readouterr().err
    assert main(["run", "top_pairs", "/none"]) == 1
    assert main([]) == 2 and main(["fly"]) == 2
