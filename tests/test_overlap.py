"""Streams, winnowing, runs and skew handling, against brute force on small fixtures."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import overlap as O, skew, streams as S

SCHEMA = "doc_id string, idx int, text string, page int, bucket string, heading string, excl array<string>"


def rows(spark, docs):
    return spark.createDataFrame([(d, i, t, 1, "x", None, e) for d, ts in docs.items() for i, t, e in ts], SCHEMA)


def vocabulary(rng, n):
    return [f"w{rng.randrange(400)}" for _ in range(n)]


def planted(seed):
    rng = random.Random(seed)
    shared = vocabulary(rng, 40)
    docs = {}
    for k in range(6):
        own = vocabulary(rng, 120)
        if k < 3:
            own[50:50] = shared[: 20 + 10 * (k % 2)]
        docs[f"d{k}"] = own
    return docs


def sentences(spark, docs, size=17):
    return rows(spark, {d: [(i, " ".join(w[i * size : (i + 1) * size]), []) for i in range(-(-len(w) // size))] for d, w in docs.items()})


@pytest.mark.parametrize("seed", [1, 2])
def test_winnowing_finds_every_long_passage(spark, seed):
    docs = planted(seed)
    g = S.grams(S.token_stream(S.token_rows(sentences(spark, docs))))
    f = S.winnow(g)
    a, b = f.where("doc_id = 'd0'").select("g"), f.where("doc_id = 'd2'").select("g")
    assert a.intersect(b).count() >= 1


def brute_runs(a, b, n=8):
    found = set()
    for i in range(len(a) - n + 1):
        for j in range(len(b) - n + 1):
            if a[i : i + n] == b[j : j + n] and not (i and j and a[i - 1] == b[j - 1]):
                k = n
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                    k += 1
                found.add((i, i + k, j, j + k))
    return {r for r in found if not any(o != r and o[0] <= r[0] and o[1] >= r[1] and o[2] <= r[2] and o[3] >= r[3] for o in found)}


def test_maximal_runs_equal_brute_force(spark):
    docs = planted(3)
    g = S.grams(S.token_stream(S.token_rows(sentences(spark, docs))))
    pairs = spark.createDataFrame([("d0", "d1"), ("d0", "d2"), ("d1", "d2"), ("d3", "d4")], "a string, b string")
    got = defaultdict(set)
    for r in O.maximal_runs(O.matches(pairs, g)).collect():
        got[r["a"], r["b"]].add((r["a0"], r["a1"], r["b0"], r["b1"]))
    for p in pairs.collect():
        assert got[p["a"], p["b"]] == brute_runs(docs[p["a"]], docs[p["b"]])


def test_barriers_stop_runs(spark):
    ts = [(0, "one two three four", []), (1, "hidden text", ["references"]), (2, "five six seven eight", [])]
    s = rows(spark, {"a": ts})
    assert S.grams(S.token_stream(S.token_rows(s)), 8).count() == 1
    assert S.grams(S.token_stream(S.token_rows(s, barriers=True)), 8).count() == 0


def test_positions_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 3)
    s = rows(spark, {"a": [(i, f"x{i} y{i}", []) for i in range(10)]})
    got = [(r["pos"], r["tok"]) for r in S.token_stream(S.token_rows(s)).orderBy("pos").collect()]
    assert got == [(2 * i + k, f"{c}{i}") for i in range(10) for k, c in enumerate("xy")]


def test_union_length_equals_exploded(spark):
    rng = random.Random(5)
    spans = [("p", s, s + rng.randrange(1, 12)) for s in (rng.randrange(60) for _ in range(40))]
    df = spark.createDataFrame(spans + [("q", 1, 5), ("q", 5, 7), ("q", 2, 3)], "k string, s int, e int")
    got = {r["k"]: r["covered"] for r in O.union_length(df, ["k"], "s", "e").collect()}
    assert got == {"p": len({x for _, s, e in spans for x in range(s, e)}), "q": 6}


def test_empty_tables(spark):
    s = rows(spark, {})
    g = S.grams(S.token_stream(S.token_rows(s)))
    assert g.count() == 0 and S.winnow(g).count() == 0


# ---- fragment-replicate


def test_pack_is_even():
    where, loads = skew.pack([9, 7, 6, 5, 4, 3, 2], 3)
    assert sum(loads) == 36 and max(loads) - min(loads) <= 2 and len(where) == 7


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    rng = random.Random(0)
    data = [("hot" if rng.random() < 0.4 else None if rng.random() < 0.05 else f"k{rng.randrange(200)}", i, i % 7) for i in range(6000)]
    p = str(tmp_path_factory.mktemp("skew") / "t")
    spark.createDataFrame(data, "k string, v int, note int").write.parquet(p)
    return spark.read.parquet(p)


def test_balanced_group_equals_group_by(spark, skewed):
    got = skew.balanced_group(skewed, ["k"], {"n": F.count("*"), "s": F.sum("v")}, {"n": F.sum("n"), "s": F.sum("s")}, tasks=8)
    want = skewed.groupBy("k").agg(F.count("*").alias("n"), F.sum("v").alias("s"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_balanced_join_equals_join(spark, skewed, how):
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k3", 3), ("zz", 4), (None, 5)], "k string, note int")
    got = skew.balanced_join(skewed, right, ["k"], how, tasks=8)
    want = skewed.join(right.withColumnRenamed("note", "right_note"), "k", how)
    assert sorted(got.columns) == sorted(want.columns)
    got = got.select(*want.columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_hot_key_is_spread(spark, skewed):
    plan = skew.plan_load(skewed.groupBy("k").agg(F.count("*").alias("rows")), ["k"], tasks=8)
    sizes = [r["n"] for r in skew.spread(skewed, plan).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 6000 and max(sizes) < 1.3 * 6000 / 8
    assert plan.balance() < 1.3


def test_balanced_on_empty(spark):
    e = spark.createDataFrame([], "k string, v int")
    assert skew.balanced_group(e, ["k"], {"n": F.count("*")}, {"n": F.sum("n")}).count() == 0
    assert skew.balanced_join(e, e, ["k"]).count() == 0
