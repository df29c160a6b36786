"""Long exact spans shared between records, by hashing units of text.

Unit: a window of ``size`` words of the normalised word stream.  To keep the global
grouping small it is done in two rounds:

1. content-defined units: of the grams of ``gram`` words, the least one in every window of
   ``size - gram + 1`` grams (winnowing) is kept, so that any span of ``size`` words holds a
   kept one.  Digests are grouped globally by algebraic aggregates (no group is collected);
   those of one record only are dropped;
2. only around the survivors are all windows of ``size`` words digested (128 bits) and
   grouped globally; a digest met in two records or more is shared text.

The earliest occurrence (by record and position) of a digest is the one to keep; every other
window is removable, and adjoining windows merge into spans that carry the row and word
offsets of the original.

Streams: words are maximal runs of a-z and 0-9 in the lower-cased text; repeated rows count
once; a row goes on into the row with the next ``idx``.  A record is cut into blocks of
rows, each with a tail of following rows, so no record is ever held as a whole.  A tail of
fewer words than needed (rows without any word) is detected and the block redone with a
longer tail.  Null or empty text gives a row without words; an empty table gives no spans.
Of rows of one (record, idx) with different text the one of least digest stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from palimpsest.plans.runtime import cut

SIZE, GRAM, BLOCK, TAIL, PER_BLOCK = 20, 12, 256, 32, 2000
_M1, _M2, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)


def _hashed(sentences: DataFrame) -> DataFrame:
    """(doc, idx, t, w): distinct retained rows, a digest of the text and the 32-bit hashes of its words."""
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z0-9]+"), 0)
    kept = sentences.where(F.col("doc_id").isNotNull() & F.col("idx").isNotNull() & (F.coalesce(F.size("excl"), F.lit(0)) <= 0))
    rows = kept.select(F.col("doc_id").alias("doc"), "idx", "text").distinct()  # hash aggregate: copies of a row meet in the map task
    return rows.select("doc", "idx", F.xxhash64("text").alias("t"), F.transform(words, lambda x: F.hash(x)).alias("w"))


def word_rows(sentences: DataFrame) -> DataFrame:
    """(doc, idx, w): one row per place."""
    return _hashed(sentences).groupBy("doc", "idx").agg(F.min(F.struct("t", "w")).alias("m")).select("doc", "idx", "m.w")


def _blocks(rows: DataFrame, tail: int) -> DataFrame:
    """Rows grouped by (doc, block) with the rows that follow as a tail."""
    b = F.floor(F.col("idx") / BLOCK).cast("int")
    own = rows.select("doc", b.alias("block"), "idx", "t", "w")
    reach = -(-tail // BLOCK)
    ahead = rows.withColumn("back", F.explode(F.sequence(F.lit(1), F.lit(reach))))
    ahead = ahead.select("doc", (b - F.col("back")).alias("block"), "idx", "t", "w").where((F.col("block") >= 0) & (F.col("idx") < (F.col("block") + 1) * BLOCK + tail))
    return own.unionByName(ahead).groupBy("doc", "block").agg(F.collect_list(F.struct("idx", "t", "w")).alias("rows"))


def _digest(h: np.ndarray, n: int, m: np.uint64) -> np.ndarray:
    """Rolling digests of n consecutive values."""
    out = np.zeros(len(h) - n + 1, "uint64")
    for i in range(n):
        x = (h[i : i + len(out)] + np.uint64(i + 1)) * m
        out = (out ^ (x ^ (x >> np.uint64(29)))) * _MIX
        out ^= out >> np.uint64(32)
    return out


class _Batch:
    """The rows of many blocks as flat arrays: words in order, with the run, row and block each belongs to.

    A *run* is a stretch of adjoining rows of one block and its tail; windows do not leave it.
    """

    def __init__(self, batch: pa.RecordBatch, tail: int):
        rows = batch.column("rows")
        if isinstance(rows, pa.ChunkedArray):
            rows = rows.combine_chunks()
        flat = rows.flatten()
        per = np.diff(rows.offsets.to_numpy())
        ordinal = np.repeat(np.arange(len(rows)), per)
        idx, t, w = flat.field("idx").to_numpy(zero_copy_only=False), flat.field("t").to_numpy(zero_copy_only=False), flat.field("w")
        at, words = w.offsets.to_numpy().astype("int64"), w.values.to_numpy(zero_copy_only=False)
        order = np.lexsort((t, idx, ordinal))
        keep = np.ones(len(order), bool)
        keep[1:] = (ordinal[order][1:] != ordinal[order][:-1]) | (idx[order][1:] != idx[order][:-1])
        order = order[keep]
        ordinal, idx = ordinal[order], idx[order].astype("int64")
        n, start = np.diff(at)[order], at[:-1][order]
        self.block = batch.column("block").to_numpy(zero_copy_only=False).astype("int64")
        end = (self.block[ordinal] + 1) * BLOCK
        new = np.ones(len(order), bool)
        new[1:] = (ordinal[1:] != ordinal[:-1]) | (idx[1:] != idx[:-1] + 1)
        run = np.cumsum(new) - 1
        total = int(n.sum())
        within = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
        self.h = words[np.repeat(start, n) + within].astype("int64").view("uint64") if total else np.zeros(0, "uint64")
        self.off, self.idx, self.run, self.ordinal = within, np.repeat(idx, n), np.repeat(run, n), np.repeat(ordinal, n)
        self.own = np.repeat(idx < end, n)
        # a run that ends with the tail although the tail has too few words
        runs = int(run[-1]) + 1 if len(run) else 0
        last = np.flatnonzero(np.append(new[1:], True)) if len(new) else np.zeros(0, "int64")
        tail_words = np.bincount(run, weights=np.where(idx >= end, n, 0), minlength=runs)
        begins = idx[np.flatnonzero(new)] < end[np.flatnonzero(new)]
        short = (idx[last] == end[last] + tail - 1) & (tail_words < SIZE - 1) & begins
        self.short = np.unique(ordinal[last][short])
        self.bad = np.isin(self.ordinal, self.short)

    def starts(self) -> np.ndarray:
        """Words where a window of SIZE words begins that is not a tail's own matter."""
        if len(self.h) < SIZE:
            return np.zeros(0, "int64")
        return np.flatnonzero((self.run[: -SIZE + 1] == self.run[SIZE - 1 :]) & self.own[: -SIZE + 1] & ~self.bad[: -SIZE + 1])

    def winnowed(self) -> tuple[np.ndarray, np.ndarray]:
        """Words and digests of the grams that winnowing keeps (the rightmost least of each window)."""
        at = self.starts()
        if not len(at):
            return at, np.zeros(0, "uint64")
        d = _digest(self.h, GRAM, _M1)
        w = SIZE - GRAM + 1
        best, value = at + w - 1, d[at + w - 1]
        for k in range(w - 2, -1, -1):
            less = d[at + k] < value
            best, value = np.where(less, at + k, best), np.where(less, d[at + k], value)
        best = np.unique(best)
        return best, d[best]


def _whole(rows: DataFrame, columns: str, fn, name: str, only: DataFrame | None = None) -> DataFrame:
    """``fn(batch)`` -> (word places, dict of arrays), over all blocks (or those in ``only``), as (doc, block, columns).

    Blocks whose tail was too short go again with a longer one.
    """
    kinds = [c.split() for c in columns.split(", ")]
    arrow = {"int": pa.int32(), "bigint": pa.int64()}

    def over(tail: int):
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                b = _Batch(batch, tail)
                at, cols = fn(b)
                o = np.concatenate([b.ordinal[at], b.short]).astype("int64")
                flags = np.concatenate([np.zeros(len(at), bool), np.ones(len(b.short), bool)])
                data = [batch.column("doc").take(pa.array(o)), pa.array(b.block[o].astype("int32")), pa.array(flags)]
                data += [pa.array(np.concatenate([cols[c], np.zeros(len(b.short), cols[c].dtype)]), type=arrow[k]) for c, k in kinds]
                yield pa.RecordBatch.from_arrays(data, names=["doc", "block", "short", *[c for c, _ in kinds]])

        return each

    done, todo, tail = None, only, TAIL
    while True:
        blocks = _blocks(rows, tail)
        if todo is not None:
            blocks = blocks.join(todo, ["doc", "block"], "left_semi")
        got = cut(blocks.mapInArrow(over(tail), f"doc string, block int, short boolean, {columns}"), name)
        todo = got.where("short").select("doc", "block").distinct()
        some = not todo.isEmpty()
        part = (got.join(todo, ["doc", "block"], "left_anti") if some else got).drop("short")
        done = part if done is None else done.unionByName(part)
        if not some:
            return done
        tail *= 8


def _in_many(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys met in two records or more; algebraic, so a hot key costs one row a task."""
    return df.groupBy(*key).agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where(F.col("lo") != F.col("hi")).drop("lo", "hi")


def shared_windows(sentences: DataFrame) -> DataFrame:
    """(doc, idx, off, last_idx, last_off, d1, d2): every window of SIZE words that two records or more share.

    ``idx`` and ``off`` are the row and the word in it where the window starts, ``last_idx`` and
    ``last_off`` those of its last word.
    """
    rows = _hashed(sentences)

    def anchors(b: _Batch):
        at, d = b.winnowed()
        return at, {"d": d.view("int64")}

    marks = _whole(rows, "d bigint", anchors, "anchors")
    common = _in_many(marks, ["d"])
    near = cut(marks.join(common, "d", "left_semi").select("doc", "block").distinct(), "near")

    def windows(b: _Batch):
        at = b.starts()
        e = at + SIZE - 1
        d1, d2 = (_digest(b.h, SIZE, m)[at] if len(at) else np.zeros(0, "uint64") for m in (_M1, _M2))
        return at, {"idx": b.idx[at], "off": b.off[at], "last_idx": b.idx[e], "last_off": b.off[e], "d1": d1.view("int64"), "d2": d2.view("int64")}

    every = _whole(rows, "idx int, off int, last_idx int, last_off int, d1 bigint, d2 bigint", windows, "windows", near)
    return every.join(_in_many(every, ["d1", "d2"]), ["d1", "d2"], "left_semi")


def meet(left: DataFrame, right: DataFrame, key: list[str], block: int = PER_BLOCK) -> DataFrame:
    """Equi-join in which the rows of a hot key meet block against block, so no task holds all pairs of one key."""
    size = right.groupBy(*key).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    if not (hot := size.where("blocks > 1")).take(1):
        return left.join(right, key)
    hot = cut(hot, "hot")
    cool = left.join(hot, key, "left_anti").join(right, key)
    each = lambda df, mine, other: df.join(hot, key).withColumn(mine, F.pmod(F.xxhash64(*df.columns), "blocks").cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    return cool.unionByName(each(left, "x", "y").join(each(right, "y", "x"), [*key, "x", "y"]).drop("x", "y"))


def sharing_pairs(windows: DataFrame) -> DataFrame:
    """(a, b): records that share a window.

    Windows met in the same set of records are alike for this: the set is signed by count and
    two sums of record hashes, and one window stands for all with its signature.
    """
    once = windows.select("doc", "d1", "d2").distinct()
    sign = once.groupBy("d1", "d2").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("doc")).alias("x"), F.sum(F.xxhash64("doc", F.lit(1)).cast("decimal(38,0)")).alias("s"))
    chosen = sign.groupBy("n", "x", "s").agg(F.min(F.struct("d1", "d2")).alias("d")).select("d.d1", "d.d2")
    members = cut(once.join(chosen, ["d1", "d2"], "left_semi"), "members")
    a, b = members.withColumnRenamed("doc", "a"), members.withColumnRenamed("doc", "b")
    return meet(a, b, ["d1", "d2"]).where(F.col("a") < F.col("b")).select("a", "b").distinct()


def removable_spans(windows: DataFrame) -> DataFrame:
    """(doc, from_idx, from_off, to_idx, to_off, n_windows): shared text that stands earlier elsewhere.

    Of each digest the occurrence of the least (doc, idx, off) stays; windows that overlap or
    adjoin in the rest merge into one span, with the offsets of the original rows.
    """
    first = windows.groupBy("d1", "d2").agg(F.min(F.struct("doc", "idx", "off")).alias("first"))
    later = windows.join(first, ["d1", "d2"]).where(F.struct("doc", "idx", "off") != F.col("first")).drop("first")
    start, end = F.struct("idx", "off"), F.struct(F.col("last_idx").alias("idx"), F.col("last_off").alias("off"))
    w = Window.partitionBy("doc").orderBy("idx", "off")
    later = later.withColumn("reach", F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    later = later.withColumn("new", (F.col("reach").isNull() | (start > F.col("reach"))).cast("int"))
    later = later.withColumn("island", F.sum("new").over(w))
    out = later.groupBy("doc", "island").agg(F.min(start).alias("s"), F.max(end).alias("e"), F.count("*").alias("n_windows"))
    return out.select("doc", F.col("s.idx").alias("from_idx"), F.col("s.off").alias("from_off"), F.col("e.idx").alias("to_idx"), F.col("e.off").alias("to_off"), "n_windows")


def row_offsets(rows: DataFrame) -> DataFrame:
    """(doc, idx, base): words before a row in its record, by a prefix sum in two levels."""
    n = rows.select("doc", F.floor(F.col("idx") / BLOCK).alias("block"), "idx", F.size("w").alias("n"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    inner = n.withColumn("inner", F.coalesce(F.sum("n").over(before(Window.partitionBy("doc", "block").orderBy("idx"))), F.lit(0)))
    outer = n.groupBy("doc", "block").agg(F.sum("n").alias("m")).withColumn("outer", F.coalesce(F.sum("m").over(before(Window.partitionBy("doc").orderBy("block"))), F.lit(0)))
    return inner.join(outer, ["doc", "block"]).select("doc", "idx", (F.col("inner") + F.col("outer")).alias("base"))


def placed(windows: DataFrame, rows: DataFrame) -> DataFrame:
    """Windows with ``pos``, the place of their first word in the record."""
    return windows.join(row_offsets(rows), ["doc", "idx"]).withColumn("pos", F.col("base") + F.col("off")).drop("base")


def union_words(starts: DataFrame, by: list[str], pos: str = "pos") -> DataFrame:
    """Words covered by the windows that start at the distinct places ``pos``, per ``by``."""
    w = Window.partitionBy(*by).orderBy(pos)
    gap = F.least(F.lit(SIZE), F.coalesce(F.lead(pos).over(w) - F.col(pos), F.lit(SIZE)))
    return starts.select(*by, pos).distinct().withColumn("gap", gap).groupBy(*by).agg(F.sum("gap").alias("matched_words"))


def shared_per_record(rows: DataFrame, at: DataFrame) -> DataFrame:
    """(doc, words, shared_words, share) for every record with retained rows."""
    total = rows.groupBy("doc").agg(F.sum(F.size("w")).alias("words"))
    out = total.join(union_words(at, ["doc"]), "doc", "left").withColumn("shared_words", F.coalesce("matched_words", F.lit(0)))
    return out.select("doc", "words", "shared_words", (F.col("shared_words") / F.greatest("words", F.lit(1))).alias("share"))


def pair_figures(rows: DataFrame, at: DataFrame) -> DataFrame:
    """(a, b, max_run, matched_words, share) of each sharing pair, a < b.

    A run is a maximal stretch of windows on one diagonal; matched words and share are those
    of b, against its retained words.
    """
    x = at.select("d1", "d2", F.col("doc").alias("a"), F.col("pos").alias("pa"))
    y = at.select("d1", "d2", F.col("doc").alias("b"), F.col("pos").alias("pb"))
    met = meet(x, y, ["d1", "d2"]).where(F.col("a") < F.col("b")).select("a", "b", "pa", "pb").withColumn("diag", F.col("pa") - F.col("pb"))
    w = Window.partitionBy("a", "b", "diag").orderBy("pb")
    runs = met.withColumn("island", F.col("pb") - F.row_number().over(w)).groupBy("a", "b", "diag", "island").agg((F.count("*") + SIZE - 1).alias("run"))
    longest = runs.groupBy("a", "b").agg(F.max("run").alias("max_run"))
    total = rows.groupBy(F.col("doc").alias("b")).agg(F.sum(F.size("w")).alias("words"))
    out = longest.join(union_words(met, ["a", "b"], "pb"), ["a", "b"]).join(total, "b")
    return out.select("a", "b", "max_run", "matched_words", (F.col("matched_words") / F.col("words")).alias("share"))
