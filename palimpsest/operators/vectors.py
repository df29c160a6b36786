"""Vector similarity: top-k, calibration, composition, threshold pairs, deterministic clustering.

Queries are a stated set (ids divisible by ``QUERY_STEP``) against all vectors, in blocks: the
query block is broadcast in slices of at most ``SLICE`` vectors, so its size is bounded, and each
partition answers with its own best k before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

QUERY_STEP, SLICE, DP = 20, 5000, 6


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def compose(title: Column, abstract: Column, w: float = 0.25) -> Column:
    """w * title + (1 - w) * abstract at unit length; the title alone where there is no abstract."""
    mix = F.zip_with(title, abstract, lambda t, a: w * t.cast("double") + (1 - w) * a.cast("double"))
    n = F.sqrt(F.aggregate(mix, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(abstract.isNull(), F.transform(title, lambda t: t.cast("double"))).otherwise(F.transform(mix, lambda x: x / F.nullif(n, F.lit(0.0))))


def _matrix(col) -> np.ndarray:
    return np.array([np.asarray(v, "float64") for v in col]).reshape(len(col), -1)


def moments(vecs: DataFrame, vec: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean, second-moment matrix and count over all vectors, by sums per partition: n squared pairs need not be formed."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s, m, n = 0.0, 0.0, 0
        for pdf in batches:
            if len(pdf):
                x = _matrix(pdf["v"])
                s, m, n = s + x.sum(axis=0), m + x.T @ x, n + len(x)
        if n:
            yield pd.DataFrame({"s": [np.asarray(s)], "m": [np.asarray(m).ravel()], "n": [n]})

    got = vecs.where(F.col(vec).isNotNull()).select(F.col(vec).alias("v")).mapInPandas(part, "s array<double>, m array<double>, n long").toPandas()  # a row per partition
    if not len(got):
        return np.zeros(0), np.zeros((0, 0)), 0
    n = int(got["n"].sum())
    s = np.sum([np.asarray(x) for x in got["s"]], axis=0) / n
    return s, np.sum([np.asarray(x) for x in got["m"]], axis=0).reshape(len(s), len(s)) / n, n


def top_k(queries: DataFrame, vecs: DataFrame, key: str, vec: str, k: int = 10, calibration: float = 0.0, against: DataFrame | None = None) -> DataFrame:
    """(query, hit, sim, adj, place): the k best others of each query, by adjusted similarity at six places, ties by id.

    With ``calibration`` s the similarity is centred and divided by sd^s * mean(sd)^(1-s) of the hit's
    similarities to all vectors.  The query set is cut in slices of SLICE.
    """
    spark = vecs.sparkSession
    whole = vecs if against is None else against
    mu, second, n = moments(whole, vec) if calibration else (None, None, 0)
    if calibration and n:
        def sd_part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                x = _matrix(pdf["v"]) if len(pdf) else np.zeros((0, len(mu)))
                yield pd.DataFrame({"sd": np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", x, second, x) - (x @ mu) ** 2, 1e-12))})

        mean_sd = whole.where(F.col(vec).isNotNull()).select(F.col(vec).alias("v")).mapInPandas(sd_part, "sd double").agg(F.avg("sd")).first()[0]
    q = queries.where(F.col(vec).isNotNull()).select(F.col(key).alias("q"), F.col(vec).alias("v"))
    total = q.count()
    out = None
    for i in range(max(1, -(-total // SLICE))):
        part = (q if total <= SLICE else q.where(F.pmod(F.xxhash64("q"), F.lit(-(-total // SLICE))) == i)).toPandas()
        sent = spark.sparkContext.broadcast((part["q"].to_numpy(), _matrix(part["v"]) if len(part) else None))

        def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, m = sent.value
            for pdf in batches:
                if m is None or not len(pdf):
                    continue
                x, h = _matrix(pdf["v"]), pdf["h"].to_numpy()
                sim = m @ x.T
                adj = sim
                if calibration:
                    c = x @ mu
                    sd = np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", x, second, x) - c**2, 1e-12))
                    adj = (sim - c) / (sd**calibration * mean_sd ** (1 - calibration))
                adj = np.round(adj, DP)
                for r in range(len(ids)):
                    o = np.lexsort((h, -adj[r]))[: k + 1]
                    o = o[h[o] != ids[r]][:k]
                    yield pd.DataFrame({"query": ids[r], "hit": h[o], "sim": np.round(sim[r, o], DP), "adj": adj[r, o]})

        t = dict(vecs.dtypes)[key]
        got = vecs.where(F.col(vec).isNotNull()).select(F.col(key).alias("h"), F.col(vec).alias("v")).mapInPandas(best, f"query {t}, hit {t}, sim double, adj double")
        out = got if out is None else out.unionByName(got)
    w = Window.partitionBy("query").orderBy(F.desc("adj"), "hit")
    return out.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def rank(queries: DataFrame, vecs: DataFrame, key: str, vec: str, k: int = 10, where: Column | None = None, exclude: list = (), least: float = -1.0, calibration: float = 0.0) -> DataFrame:
    """``top_k`` among the vectors that meet ``where`` (any condition on their columns), without the ids in ``exclude``, of at least similarity ``least``.

    Calibration is by all vectors, whatever the filters.
    """
    some = vecs if where is None else vecs.where(where)
    some = some.where(~F.col(key).isin(*exclude)) if exclude else some
    got = top_k(queries, some, key, vec, k, calibration, against=vecs)
    return got.where(F.col("sim") >= least)


def infer_home(neighbours: DataFrame, labels: DataFrame, probe: int = 25) -> DataFrame:
    """(query, label, votes): plurality label of the ``probe`` nearest, ties by label; ``labels`` is (hit, label)."""
    v = neighbours.where(F.col("place") <= probe).join(labels, "hit").groupBy("query", "label").agg(F.count("*").alias("votes"))
    return v.withColumn("rn", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("votes"), "label"))).where("rn = 1").drop("rn")


def _against(small: DataFrame, big: DataFrame, key: str, vec: str, fn, schema: str) -> DataFrame:
    """Rows of ``fn(ids, matrix, keys, vectors)`` for every batch of ``big`` and every slice of at most SLICE rows of ``small`` (id, v)."""
    spark = big.sparkSession
    small = small.where(F.col("v").isNotNull())
    slices = max(1, -(-small.count() // SLICE))
    rows = big.where(F.col(vec).isNotNull()).select(F.col(key).alias("k"), F.col(vec).alias("v"))
    out = None
    for i in range(slices):
        part = (small if slices == 1 else small.where(F.pmod(F.xxhash64("id"), F.lit(slices)) == i)).toPandas()
        sent = spark.sparkContext.broadcast((part["id"].to_numpy(), _matrix(part["v"]) if len(part) else None))

        def each(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            ids, m = sent.value
            for pdf in batches:
                for k in range(0, len(pdf) if m is not None else 0, 2048):
                    some = pdf.iloc[k : k + 2048]
                    yield fn(ids, m, some["k"].to_numpy(), _matrix(some["v"]))

        got = rows.mapInPandas(each, schema)
        out = got if out is None else out.unionByName(got)
    return out


def threshold_pairs(queries: DataFrame, vecs: DataFrame, key: str, vec: str, cutoff: float = 0.9) -> DataFrame:
    """(a, b, sim): pairs of a query and another vector with similarity of at least ``cutoff`` at four places, by block products."""
    def near(ids, m, keys, x):
        sim = np.round(m @ x.T, 4)
        i, j = np.nonzero(sim >= cutoff)
        keep = ids[i] != keys[j]
        return pd.DataFrame({"a": ids[i[keep]], "b": keys[j[keep]], "sim": sim[i[keep], j[keep]]})

    t = dict(vecs.dtypes)[key]
    return _against(queries.select(F.col(key).alias("id"), F.col(vec).alias("v")), vecs, key, vec, near, f"a {t}, b {t}, sim double")


def nearest_label(vecs: DataFrame, key: str, vec: str, anchors: DataFrame, label: str, anchor_vec: str) -> DataFrame:
    """(key, label, sim): the most similar anchor, lowest label of equals, by block products."""
    def best(ids, m, keys, x):
        order = np.argsort(ids, kind="stable")
        sim = np.round(x @ m[order].T, DP)
        at = sim.argmax(axis=1)
        return pd.DataFrame({"key": keys, "label": ids[order][at], "sim": sim[np.arange(len(keys)), at]})

    t, lt = dict(vecs.dtypes)[key], dict(anchors.dtypes)[label]
    got = _against(anchors.select(F.col(label).alias("id"), F.col(anchor_vec).alias("v")), vecs, key, vec, best, f"key {t}, label {lt}, sim double")
    return got.groupBy("key").agg(F.max("sim").alias("sim"), F.min_by("label", F.struct(-F.col("sim"), "label")).alias("label")).select(F.col("key").alias(key), "label", "sim")


def mean_vectors(vecs: DataFrame, by: str, vec: str) -> DataFrame:
    """(by, centre, n): unit-length mean of each group, by sums per dimension."""
    x = vecs.select(by, F.posexplode(vec).alias("i", "x")).groupBy(by, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    g = x.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("c"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    n = vecs.groupBy(by).agg(F.count("*").alias("n"))
    return g.join(n, by).select(by, F.transform("c", lambda s: s["x"] / F.nullif(F.col("norm"), F.lit(0.0))).alias("centre"), "n")


def spherical_kmeans(vecs: DataFrame, key: str, vec: str, k: int, rounds: int = 40, tolerance: float = 1e-6) -> DataFrame:
    """(key, cluster) by deterministic spherical k-means over all vectors.

    The first centre is the vector least like the mean, each next one the vector least like its
    nearest centre (ties by key); Lloyd steps sum per partition; an empty cluster keeps its centre.
    """
    base = vecs.where(F.col(vec).isNotNull()).select(F.col(key).alias("key"), F.col(vec).alias("v"))
    mu, _, n = moments(base, "v")
    if not n:
        return base.select("key", F.lit(0).alias("cluster"))
    kt = dict(base.dtypes)["key"]

    def farthest(centres: np.ndarray) -> np.ndarray:
        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best = None
            for pdf in batches:
                if len(pdf):
                    near = np.round((_matrix(pdf["v"]) @ centres.T).max(axis=1), 9)
                    i = np.lexsort((pdf["key"].to_numpy(), near))[0]
                    row = (near[i], pdf["key"].iloc[i], np.asarray(pdf["v"].iloc[i], "float64"))
                    best = row if best is None or row[:2] < best[:2] else best
            if best is not None:
                yield pd.DataFrame({"s": [best[0]], "key": [best[1]], "v": [best[2]]})

        r = base.mapInPandas(part, f"s double, key {kt}, v array<double>").orderBy("s", "key").first()
        return np.asarray(r["v"])

    centres = farthest(mu[None, :] / max(np.linalg.norm(mu), 1e-12))[None, :]
    while len(centres) < min(k, n):
        centres = np.vstack([centres, farthest(centres)])
    for _ in range(rounds):
        def sums(batches: Iterator[pd.DataFrame], c=centres) -> Iterator[pd.DataFrame]:
            s = np.zeros_like(c)
            for pdf in batches:
                if len(pdf):
                    x = _matrix(pdf["v"])
                    np.add.at(s, (x @ c.T).argmax(axis=1), x)
            yield pd.DataFrame({"s": [s.ravel()]})

        total = np.sum([np.asarray(r["s"]) for r in base.select("key", "v").mapInPandas(sums, "s array<double>").collect()], axis=0).reshape(centres.shape)  # a row per partition
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        fresh = np.where(norm > 0, total / np.maximum(norm, 1e-12), centres)
        done = np.allclose(fresh, centres, atol=tolerance)
        centres = fresh
        if done:
            break

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"key": pdf["key"], "cluster": (_matrix(pdf["v"]) @ centres.T).argmax(axis=1).astype("int32")})

    return base.mapInPandas(label, f"key {kt}, cluster int")
