"""Items that appear together: pair counts and lift by heavy-light decomposition.

Input is an incidence table (basket, item).  After removing repeats

* items of fewer baskets than ``min_count`` can be in no wanted pair and go (exact);
* *heavy* items are those in at least ``heavy_share`` of the baskets.  There are at most
  (mean basket size / heavy_share) of them, and the share is raised until no more than
  ``max_heavy`` remain, the others being counted as light.  Heavy x heavy pairs come from
  a dense bit matrix (item x basket) by AND and popcount in each partition;
* light x light pairs are counted by hash: a basket goes once to each of the groups its
  light items hash to, and a group counts the pairs whose smaller item it owns.  An item with more
  than a group's fair part of the incidences is owned by several groups, each for a share of
  the baskets, and their counts are added;
* heavy x light pairs come from the same visit: the group probes the basket's heavy list;
* baskets of more than ``giant`` light items would need too many pairs.  They are few (at
  most incidences / giant), so each light item gets a bit list of the giants it is in:
  known pairs add popcount(AND), and pairs that meet in giants only are found by
  block-against-block popcounts, which give out no pair below ``min_count``.

No pair is shuffled before it is counted; what is shuffled are baskets, once per group that owns one of their
items.  Only counts that can qualify leave a group (of a shared item all counts, to be added).

Nulls: a null basket or item is left out.  A basket with one item yields no pair; repeats
count once; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from palimpsest.plans.runtime import cut, partitions

HEAVY_SHARE, MAX_HEAVY, GIANT, PAIRS_PER_GROUP = 1 / 32, 1024, 4096, 3_000_000
_PAIR = "a bigint, b bigint, n bigint"


def _emit(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"a": a.astype("int64"), "b": b.astype("int64"), "n": n.astype("int64")})


def _popcounts(bits: np.ndarray) -> np.ndarray:
    """Pairwise popcount(AND) of the rows of a packed uint64 matrix."""
    n = len(bits)
    out = np.zeros((n, n), "int64")
    for i in range(n):
        out[i, i:] = np.bitwise_count(bits[i] & bits[i:]).sum(axis=1)
    return out


def _heavy_pairs(baskets: DataFrame) -> DataFrame:
    """(h array) -> counts of heavy pairs, summed over partitions."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple[int, int], int] = {}
        for pdf in batches:
            lists = [x for x in pdf["h"] if len(x) > 1]
            if not lists:
                continue
            items, inv = np.unique(np.concatenate(lists), return_inverse=True)
            rows = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
            words = -(-len(lists) // 64)
            bits = np.zeros((len(items), words), "uint64")
            np.bitwise_or.at(bits, (inv, rows // 64), np.left_shift(np.uint64(1), (rows % 64).astype("uint64")))
            m = np.triu(_popcounts(bits), 1)
            for i, j in zip(*np.nonzero(m)):
                k = (int(items[i]), int(items[j]))
                total[k] = total.get(k, 0) + int(m[i, j])
        if total:
            k = np.array(list(total), "int64")
            yield _emit(k[:, 0], k[:, 1], np.array(list(total.values())))

    return baskets.where(F.size("h") > 1).select("h").mapInPandas(count, _PAIR).groupBy("a", "b").agg(F.sum("n").alias("n"))


def _hash_counted(visits: DataFrame, groups: int, least: int, split: bool) -> DataFrame:
    """Visits (g, l, h), if items are split also (salt, s): counts of light pairs owned by the group, and of its light items with heavy ones."""

    def merge(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        c, n = np.concatenate(codes), np.concatenate(counts)
        u, inv = np.unique(c, return_inverse=True)
        return u, np.bincount(inv, weights=n, minlength=len(u)).astype("int64")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids: dict[int, int] = {}
        shared: set[int] = set()
        codes, counts, size = [], [], 0
        for pdf in batches:
            out = []
            for g, salt, light, splits, heavy in zip(pdf["g"].to_numpy(), pdf["salt"].to_numpy() if split else itertools.repeat(0), pdf["l"], pdf["s"] if split else itertools.repeat(None), pdf["h"]):
                if split:
                    order = np.argsort(light, kind="stable")
                    light, splits = np.asarray(light, "int64")[order], np.asarray(splits, "int64")[order]
                else:
                    light = np.sort(np.asarray(light, "int64"))
                heavy = np.asarray(heavy, "int64")
                local = np.fromiter((ids.setdefault(int(x), len(ids)) for x in (*light, *heavy)), "int64", len(light) + len(heavy))
                own = np.flatnonzero(_group_of(light, salt % splits if split else 0, groups) == g)
                n = len(light)
                if len(own):
                    if split and (splits[own] > 1).any():
                        shared.update(local[own][splits[own] > 1].tolist())
                    i = np.repeat(own, n - 1 - own)
                    if len(i):
                        j = np.concatenate([np.arange(x + 1, n) for x in own])
                        out.append((local[i] << 32) | local[j])
                    if len(heavy):
                        out.append((np.repeat(local[own], len(heavy)) << 32) | np.tile(local[n:], len(own)))
                if len(out) > 2000:
                    u, c = np.unique(np.concatenate(out), return_counts=True)
                    codes.append(u), counts.append(c)
                    size, out = size + len(u), []
            if out:
                u, c = np.unique(np.concatenate(out), return_counts=True)
                codes.append(u), counts.append(c)
                size += len(u)
            if size > 4_000_000:
                u, c = merge(codes, counts)
                codes, counts, size = [u], [c], 0
        if codes:
            names = np.array(list(ids), "int64")
            u, c = merge(codes, counts)
            part = np.isin(u >> 32, np.fromiter(shared, "int64", len(shared))) if shared else np.zeros(len(u), bool)
            keep = part | (c >= least)
            u, c, part = u[keep], c[keep], part[keep]
            yield _emit(names[u >> 32], names[u & 0xFFFFFFFF], c).assign(part=part)

    got = visits.mapInPandas(count, f"{_PAIR}, part boolean")
    if not split:
        return got.select("a", "b", "n")
    added = got.where("part").groupBy("a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return got.where(~F.col("part")).select("a", "b", "n").unionByName(added)


def _group_of(ids: np.ndarray, share: np.ndarray, groups: int) -> np.ndarray:
    """Group that owns an item for a share of the baskets: multiplicative hash, the same here and in ``_group_col``."""
    return (((ids % 1000003) * 40503 + share * 7919 + 12345) % 1000003) % groups


def _group_col(x, share, groups: int):
    return F.pmod(F.pmod(F.pmod(x, F.lit(1000003)) * 40503 + share * 7919 + 12345, F.lit(1000003)), F.lit(groups)).cast("int")


def _giant_counts(known: DataFrame, giants: DataFrame, least: int, blocks: int) -> DataFrame:
    """Adds the baskets in ``giants`` (item, basket) to ``known`` pairs and finds the pairs only they have."""
    lists = cut(giants.groupBy("id").agg(F.sort_array(F.collect_list("basket")).alias("g")), "giants")
    both = F.size(F.array_intersect("ga", "gb"))
    la, lb = lists.select(F.col("id").alias("a"), F.col("g").alias("ga")), lists.select(F.col("id").alias("b"), F.col("g").alias("gb"))
    none = F.array().cast("array<bigint>")
    known = known.join(la, "a", "left").join(lb, "b", "left").withColumn("ga", F.coalesce("ga", none)).withColumn("gb", F.coalesce("gb", none))
    known = known.select("a", "b", "n", both.cast("bigint").alias("extra"))
    # block against block: an item goes to the cells of its row and column
    base = lists.where(F.size("g") >= least).withColumn("k", _group_col(F.col("id"), F.lit(0), blocks))
    cells = base.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(F.least("k", "o").alias("x"), F.greatest("k", "o").alias("y"), "k", "id", "g")

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = int(pdf["x"].iloc[0]), int(pdf["y"].iloc[0])
        pdf = pdf.drop_duplicates("id")
        _, inv = np.unique(np.concatenate(list(pdf["g"])), return_inverse=True)
        rows = np.repeat(np.arange(len(pdf)), pdf["g"].map(len))
        k, ids = pdf["k"].to_numpy(), pdf["id"].to_numpy()
        ix, iy = np.flatnonzero(k == x), np.flatnonzero(k == y)
        n = np.zeros((len(ix), len(iy)))
        for c in range(0, inv.max() + 1, 4096):  # some giants at a time
            some = (inv >= c) & (inv < c + 4096)
            m = np.zeros((len(pdf), 4096), "float32")
            m[rows[some], inv[some] - c] = 1
            n += m[ix] @ m[iy].T
        i, j = np.nonzero(n >= least)
        a, b, c = ids[ix[i]], ids[iy[j]], n[i, j]
        keep = (a < b) if x == y else np.ones(len(a), bool)
        a, b, c = a[keep], b[keep], c[keep]
        return _emit(np.minimum(a, b), np.maximum(a, b), c)

    found = cells.groupBy("x", "y").applyInPandas(meet, _PAIR).select("a", "b", F.lit(0).cast("bigint").alias("s"), F.col("n").alias("extra"))
    every = known.select("a", "b", F.col("n").alias("s"), "extra").unionByName(found)
    return every.groupBy("a", "b").agg((F.max("s") + F.max("extra")).alias("n"))


def cooccurrence(
    incidence: DataFrame, basket: str, item: list[str], min_count: int = 6, min_lift: float = 4.0, heavy_share: float = HEAVY_SHARE, max_heavy: int = MAX_HEAVY, giant: int = GIANT, pairs_per_group: int = PAIRS_PER_GROUP, shares: int | None = None
) -> DataFrame:
    """Pairs with n_ab >= min_count and n_ab * N >= min_lift * n_a * n_b.

    ``shares`` is the number of parts a hot item may be cut into at most (four times the shuffle partitions).
    Result: the item columns with suffixes _1 and _2 (smaller item first), n_1, n_2, n_ab, n_baskets, lift.
    """
    spark = incidence.sparkSession
    names, item = item, [f"__{c}" for c in item]  # no clash with the columns made here
    inc = cut(incidence.select(F.col(basket).alias("basket"), *[F.col(c).alias(f"__{c}") for c in names]).dropna().distinct(), "incidence")
    baskets_n = inc.agg(F.count_distinct("basket")).first()[0]
    dictionary = cut(inc.groupBy(*item).agg(F.count("*").alias("cnt")).where(F.col("cnt") >= min_count).withColumn("id", F.monotonically_increasing_id()), "items")
    # a share that leaves at most max_heavy heavy items; everything else is light
    share = heavy_share
    while share < 1 and dictionary.where(F.col("cnt") >= share * baskets_n).count() > max_heavy:
        share *= 2
    heavy_if = F.col("cnt") >= max(share * baskets_n, min_count)
    heavy = dictionary.where(heavy_if).select(*item, F.col("id").alias("hid"))
    # an item with more than its part of the light incidences is shared by several groups
    fair = max(float(min_count), (dictionary.where(~heavy_if).agg(F.sum("cnt")).first()[0] or 0) / (shares or 4 * partitions(spark)))
    light = dictionary.where(~heavy_if).select(*item, "id", F.ceil(F.col("cnt") / fair).cast("long").alias("s"))
    split = (light.agg(F.max("s")).first()[0] or 1) > 1
    # hot items meet a small table in place; only light ones are shuffled by item
    tagged = inc.join(F.broadcast(heavy), item, "left")
    lights = tagged.where(F.col("hid").isNull()).drop("hid").join(light, item).select("basket", "id", "s", F.lit(False).alias("hot"))
    ids = cut(tagged.where(F.col("hid").isNotNull()).select("basket", F.col("hid").alias("id"), F.lit(1).cast("long").alias("s"), F.lit(True).alias("hot")).unionByName(lights), "coded")
    sizes = ids.where(~F.col("hot")).groupBy("basket").agg(F.count("*").alias("m"))
    big = cut(sizes.where(F.col("m") > giant).select("basket", F.monotonically_increasing_id().alias("gid")), "big")
    n_big = big.count()
    usual = ids.join(F.broadcast(big.select("basket")), "basket", "left_anti") if 0 < n_big <= 10_000 else ids.join(big.select("basket"), "basket", "left_anti") if n_big else ids
    baskets = usual.groupBy("basket").agg(F.collect_list(F.when(~F.col("hot"), F.struct("id", "s"))).alias("l"), F.collect_list(F.when(F.col("hot"), F.col("id"))).alias("h"))
    if n_big:  # a giant keeps its heavy items (few) and probes its light ones in one-item visits below
        hot_only = ids.where("hot").join(big, "basket", "left_semi").groupBy("basket").agg(F.array().cast("array<struct<id:bigint,s:bigint>>").alias("l"), F.collect_list("id").alias("h"))
        baskets = baskets.unionByName(hot_only)
    baskets = cut(baskets.select(F.pmod(F.xxhash64("basket"), F.lit(1 << 20)).alias("salt"), "l", F.sort_array("h").alias("h")), "baskets")
    pairs_n = baskets.agg(F.sum(F.size("l").cast("double") * (F.size("l") - 1) / 2 + F.size("l") * F.size("h"))).first()[0] or 0
    groups = max(partitions(spark), int(pairs_n // pairs_per_group) + 1)
    visits = baskets.where(F.size("l") > 0).withColumn("g", F.explode(F.array_distinct(F.transform("l", lambda x: _group_col(x["id"], F.pmod("salt", x["s"]), groups)))))
    shape = ["g", "salt", "l", "s", "h"] if split else ["g", "l", "h"]
    visits = visits.select("g", "salt", F.col("l.id").alias("l"), F.col("l.s").alias("s"), "h").select(*shape)
    if n_big:
        probe = ids.where(~F.col("hot")).join(big, "basket", "left_semi").join(hot_only.select("basket", "h"), "basket")
        salt = F.pmod(F.xxhash64("basket"), F.lit(1 << 20))
        visits = visits.unionByName(probe.select(_group_col(F.col("id"), F.pmod(salt, F.col("s")), groups).alias("g"), salt.alias("salt"), F.array("id").alias("l"), F.array("s").alias("s"), "h").select(*shape))
    least = min_count if not n_big else max(1, min_count - n_big)
    counted = _hash_counted(visits.repartitionById(groups, F.col("g")), groups, least, split)
    if n_big:
        counted = _giant_counts(counted, ids.where(~F.col("hot")).join(big, "basket").select("id", F.col("gid").alias("basket")), min_count, max(1, int((dictionary.count() // 2048)) + 1))
    pairs = _heavy_pairs(baskets).unionByName(counted).where(F.col("n") >= min_count)
    one = dictionary.select(F.col("id").alias("a"), F.struct(*item).alias("ka"), F.col("cnt").alias("na"))
    two = dictionary.select(F.col("id").alias("b"), F.struct(*item).alias("kb"), F.col("cnt").alias("nb"))
    x = pairs.join(one, "a").join(two, "b")
    x = x.where(F.col("n").cast("double") * baskets_n >= min_lift * F.col("na").cast("double") * F.col("nb"))
    first = F.col("ka") < F.col("kb")
    lo, hi = F.when(first, F.col("ka")).otherwise(F.col("kb")), F.when(first, F.col("kb")).otherwise(F.col("ka"))
    x = x.select(lo.alias("lo"), hi.alias("hi"), F.when(first, F.col("na")).otherwise(F.col("nb")).alias("n_1"), F.when(first, F.col("nb")).otherwise(F.col("na")).alias("n_2"), F.col("n").alias("n_ab"))
    return x.select(
        *[F.col(f"lo.__{c}").alias(f"{c}_1") for c in names], *[F.col(f"hi.__{c}").alias(f"{c}_2") for c in names],
        "n_1", "n_2", "n_ab", F.lit(baskets_n).alias("n_baskets"), (F.col("n_ab") * F.lit(float(baskets_n)) / (F.col("n_1") * F.col("n_2"))).alias("lift"),
    )
