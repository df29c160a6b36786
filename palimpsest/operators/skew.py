"""Fragment-replicate: per-key work spread by estimated load.

The plan is made from one map-side-combined count per key:

* a key whose rows exceed a task's fair share is *heavy*; it is cut into
  ``ceil(rows / share)`` shards.  There are at most ``tasks`` heavy keys, whatever
  the size of the input, since each holds more than ``total / tasks`` rows;
* all other keys fall into a fixed number of virtual buckets by hash;
* shards and buckets are packed on tasks by longest-processing-time first.

The plan thus has at most ``2 * tasks + buckets`` entries, a bound that depends on
the cluster and not on the data, so it may be collected and broadcast.  Rows are
then sent to their task directly (``repartitionById``), and the matching side of a
join is copied only to the shards of the keys that were cut.

Nulls: a null in a key column is a key value of its own for the aggregate (as in
GROUP BY) and matches nothing in the join.  Empty input gives an empty result.
Repeated rows count as often as they stand.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from palimpsest.plans.runtime import cut, partitions

BUCKETS_PER_TASK = 32
_TASK, _SHARD, _SHARDS, _FIRST = "__fr_task", "__fr_shard", "__fr_shards", "__fr_first"


@dataclass
class LoadPlan:
    """What goes where: ``heavy`` has key columns, shard count and first slot; ``tasks`` a task per slot."""

    keys: list[str]
    tasks: int
    buckets: int
    total: int
    heavy: DataFrame
    slots: list[int]
    loads: list[int]

    def balance(self) -> float:
        """Largest task load over the mean load."""
        mean = sum(self.loads) / max(1, len(self.loads))
        return max(self.loads, default=0) / mean if mean else 1.0


def pack(loads: Sequence[int], tasks: int) -> tuple[list[int], list[int]]:
    """Longest-processing-time-first: a task for each load, and the task totals."""
    heap = [(0, t) for t in range(tasks)]
    where = [0] * len(loads)
    for i in sorted(range(len(loads)), key=lambda i: (-loads[i], i)):
        total, t = heapq.heappop(heap)
        where[i] = t
        heapq.heappush(heap, (total + loads[i], t))
    return where, [x for x, _ in sorted(heap, key=lambda x: x[1])]


def _bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(buckets)).cast("int")


def plan_load(counts: DataFrame, keys: Sequence[str], rows: str = "rows", tasks: int | None = None) -> LoadPlan:
    """Plan from ``counts`` (one row per key with its load in column ``rows``)."""
    spark, keys = counts.sparkSession, list(keys)
    tasks = tasks or partitions(spark)
    buckets = tasks * BUCKETS_PER_TASK
    counts = cut(counts.select(*keys, rows), "counts")  # counted once, read three times
    total = counts.agg(F.sum(rows)).first()[0] or 0
    share = max(1, math.ceil(total / tasks))
    big = [r for r in counts.where(F.col(rows) > share).collect()]  # fewer than `tasks` keys can exceed total / tasks
    light = [0] * buckets
    for r in counts.where(F.col(rows) <= share).groupBy(_bucket(keys, buckets).alias("b")).agg(F.sum(rows).alias("n")).collect():
        light[r["b"]] = r["n"]
    loads, heavy = list(light), []
    for r in sorted(big, key=lambda r: (-r[rows], str([r[k] for k in keys]))):
        n = math.ceil(r[rows] / share)
        heavy.append(tuple(r[k] for k in keys) + (n, len(loads)))
        loads += [r[rows] // n + (i < r[rows] % n) for i in range(n)]
    slots, totals = pack(loads, tasks)
    kinds = {f.name: f.dataType for f in counts.schema}
    schema = T.StructType([T.StructField(k, kinds[k]) for k in keys] + [T.StructField(_SHARDS, T.IntegerType()), T.StructField(_FIRST, T.IntegerType())])
    return LoadPlan(keys, tasks, buckets, total, spark.createDataFrame(heavy, schema), slots, totals)


def _same(keys: Sequence[str], a: DataFrame, b: DataFrame) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & a[k].eqNullSafe(b[k])
    return cond


def _with_shards(df: DataFrame, plan: LoadPlan) -> DataFrame:
    h = plan.heavy.select(*[F.col(k).alias(f"__h_{k}") for k in plan.keys], _SHARDS, _FIRST)
    cond = F.lit(True)
    for k in plan.keys:
        cond = cond & df[k].eqNullSafe(F.col(f"__h_{k}"))
    return df.join(F.broadcast(h), cond, "left").drop(*[f"__h_{k}" for k in plan.keys])


def _to_task(df: DataFrame, plan: LoadPlan, slot: Column) -> DataFrame:
    where = F.array(*[F.lit(x) for x in plan.slots])
    return df.withColumn(_TASK, F.element_at(where, slot + 1)).repartitionById(plan.tasks, F.col(_TASK))


def spread(df: DataFrame, plan: LoadPlan) -> DataFrame:
    """Rows sent to the tasks of the plan; a heavy key's rows go round its shards.

    The shard of a row comes from its place in its input partition, so ``df`` must be
    a scan or a written table (a recomputed task then repeats its choice).
    """
    df = df.withColumn(_SHARD, F.monotonically_increasing_id())
    df = _with_shards(df, plan).withColumn(_SHARD, F.coalesce(F.pmod(F.col(_SHARD), F.col(_SHARDS)).cast("int"), F.lit(0)))
    return _to_task(df, plan, F.coalesce(F.col(_FIRST) + F.col(_SHARD), _bucket(plan.keys, plan.buckets)))


def replicate(df: DataFrame, plan: LoadPlan) -> DataFrame:
    """The matching side: one copy per shard of a heavy key, a single one otherwise."""
    df = _with_shards(df, plan)
    df = df.withColumn(_SHARD, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(_SHARDS), F.lit(1)) - 1)))
    return _to_task(df, plan, F.coalesce(F.col(_FIRST) + F.col(_SHARD), _bucket(plan.keys, plan.buckets)))


def join_loads(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, rows): what a key costs its tasks: its left rows, once per matching row; nulls and keys without a match cost their rows."""
    per = left.groupBy(*keys).agg(F.count("*").alias("__l"))
    other = right.dropna(subset=list(keys)).groupBy(*keys).agg(F.count("*").alias("__r"))
    return per.join(other, list(keys), "left").select(*keys, (F.col("__l") * F.greatest(F.coalesce("__r", F.lit(1)), F.lit(1))).alias("rows"))


def balanced_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", tasks: int | None = None, plan: LoadPlan | None = None) -> DataFrame:
    """``left`` join ``right`` on ``keys`` without a straggler; ``left`` is the side with hot keys.

    A key's load is its left rows times its matching rows, so a key with many matches is cut as well.
    ``how`` is inner, left, left_semi or left_anti (each left row meets all its matches in
    one shard, so these stay exact).  Columns of ``right`` other than the keys that clash
    with columns of ``left`` get the prefix ``right_``.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type {how}")
    keys = list(keys)
    plan = plan or plan_load(join_loads(left, right, keys), keys, tasks=tasks)
    clash = [c for c in right.columns if c not in keys and c in left.columns]
    for c in clash:
        right = right.withColumnRenamed(c, f"right_{c}")
    # a null key matches nothing: leave it on the left side only
    a = spread(left, plan).drop(_SHARDS, _FIRST)
    b = replicate(right.dropna(subset=keys), plan).drop(_SHARDS, _FIRST)
    out = a.join(b, [_TASK, _SHARD, *keys], how)
    return out.drop(_TASK, _SHARD)


def balanced_group(df: DataFrame, keys: Sequence[str], partial: dict[str, Column], merge: dict[str, Column], tasks: int | None = None, plan: LoadPlan | None = None) -> DataFrame:
    """Per-key aggregates in two steps: ``partial`` in each shard, ``merge`` over the shards.

    ``merge`` refers to the columns of ``partial`` by name.  Only one row a key and shard
    meets in the second step, so a key with a third of all rows costs it a few rows.
    """
    keys = list(keys)
    plan = plan or plan_load(df.groupBy(*keys).agg(F.count("*").alias("rows")), keys, tasks=tasks)
    parts = spread(df, plan).groupBy(*keys, _TASK, _SHARD).agg(*[c.alias(n) for n, c in partial.items()])
    return parts.groupBy(*keys).agg(*[c.alias(n) for n, c in merge.items()])
