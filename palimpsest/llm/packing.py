"""Filling containers of fixed capacity: hierarchical residual packing.

Every text is measured in tokens.  One longer than the largest capacity is split into pieces of at
most that capacity, at token places that are also character places; nothing else is split.  Then, per round,

1. items are hashed into cells of some ``per_cell`` items, and each cell is packed by best fit decreasing;
2. bins filled to ``full`` of the capacity are final, and so are those with less room than the smallest
   bin left: nothing can come into them;
3. the bins left become single items of their total size, in fewer cells (a tree of ``fan_in``).

After best fit a cell has at most one bin that is half full or less, and two bins more than half full never share a
container.  So with h such small bins left in all cells, at most h bins of each fill can still be of use; the rest
are final too.  The residual is therefore at most cells * (1 + capacity / 2) bins, whatever the items
were, and shrinks every round; no task ever holds more than one cell.  The last round has one cell a
capacity.  Members stay behind as (bin, parent) links.  Best fit runs over a table of free room by size (at most
``capacity`` entries), in constant memory per open bin.

Which capacity a text belongs to: the smallest container it fits in (texts of up to 512 tokens
go to the small ones, and so on), so that every container kind is used.  Texts that only just fit
leave room that none of their own kind fits, so a hashed share of the texts of the smallest kind
goes to the larger kinds as filling (``filler`` times the tokens there, at most a third of
the small ones each).

Null and empty texts have no tokens and are left out.  Repeated rows are packed each.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window, functions as F

from palimpsest.plans.runtime import cut, widen

FULL, FAN_IN, PER_CELL, FILLER, MAX_KINDS = 0.99, 4, 4096, 0.25, 10_000


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """A bin number per item, best fit over items by decreasing size (ties by position)."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    levels = 0  # bit r is set where a bin with r free tokens exists
    where, bins = np.zeros(len(sizes), "int64"), 0
    for i in np.argsort(-sizes, kind="stable"):
        s = int(sizes[i])
        fits = levels >> s
        if fits:
            r = s + ((fits & -fits).bit_length() - 1)  # the least room that suffices
            b = room[r].pop()
            if not room[r]:
                levels &= ~(1 << r)
        else:
            r, b, bins = capacity, bins, bins + 1
        where[i] = b
        left = r - s
        room[left].append(b)
        levels |= 1 << left
    return where


def pieces(docs: DataFrame, doc: str, text: str, tokenizer: str, capacities: list[int]) -> DataFrame:
    """(doc, piece, from_token, tokens, from_char, to_char, capacity): texts, or parts of those beyond the largest capacity.

    ``tokenizer`` is a file of byte-level BPE in the JSON form; it is sent to the executors.
    """
    top = max(capacities)
    docs.sparkSession.sparkContext.addFile(tokenizer)
    name = os.path.basename(tokenizer)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(SparkFiles.get(name))
        t.encode_special_tokens = True
        for pdf in batches:
            for k in range(0, len(pdf), 256):
                part = pdf.iloc[k : k + 256]
                out = []
                for d, x, e in zip(part["doc"], part["text"], t.encode_batch(list(part["text"]), add_special_tokens=False)):
                    n = len(e)
                    if n <= top:
                        out.append((d, 0, 0, n, 0, len(x)))
                        continue
                    spans = e.offsets
                    for i, (a, b) in enumerate(cuts(spans, top)):
                        out.append((d, i, a, b - a, spans[a][0] if a else 0, spans[b][0] if b < n else len(x)))
                yield pd.DataFrame(out, columns=["doc", "piece", "from_token", "tokens", "from_char", "to_char"])

    kept = docs.where(F.col(doc).isNotNull() & (F.length(text) > 0)).select(F.col(doc).cast("bigint").alias("doc"), F.col(text).alias("text"))
    out = widen(kept).mapInPandas(measure, "doc bigint, piece int, from_token int, tokens int, from_char int, to_char int")
    fit = F.lit(top)
    for c in sorted(capacities, reverse=True):
        fit = F.when(F.col("tokens") <= c, F.lit(c)).otherwise(fit)
    return out.where("tokens > 0").withColumn("capacity", fit)


def cuts(spans: list[tuple[int, int]], top: int) -> list[tuple[int, int]]:
    """Token ranges of at most ``top`` tokens that begin where a character begins (a character of more than ``top`` tokens is cut)."""
    out, a = [], 0
    while a < len(spans):
        b = min(a + top, len(spans))
        while b < len(spans) and b > a + 1 and spans[b][0] < spans[b - 1][1]:
            b -= 1
        if b < len(spans) and spans[b][0] < spans[b - 1][1]:
            b = a + top
        out.append((a, b))
        a = b
    return out


def with_fillers(parts: DataFrame, capacities: list[int], filler: float = FILLER) -> DataFrame:
    """Moves a hashed share of the smallest kind's texts to each larger kind."""
    total = {r["capacity"]: r["t"] for r in parts.groupBy("capacity").agg(F.sum("tokens").alias("t")).collect()}
    small = min(capacities)
    to, u, reached = F.lit(small), F.pmod(F.xxhash64("doc", "piece"), F.lit(1_000_000)), 0.0
    for c in sorted(set(capacities) - {small}):
        share = min(1 / 3, filler * total.get(c, 0) / max(1, total.get(small, 0)))
        to = F.when((u >= reached * 1e6) & (u < (reached + share) * 1e6), F.lit(c)).otherwise(to)
        reached += share
    return parts.withColumn("capacity", F.when(F.col("capacity") == small, to).otherwise(F.col("capacity")))


def _round(items: DataFrame, cells: dict[int, int], k: int) -> DataFrame:
    """The rows of ``items`` with their bin and what it holds, each cell on its own."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["tokens", "item"], ascending=[False, True])
        cap, cell = int(g["capacity"].iloc[0]), int(g["cell"].iloc[0])
        b = best_fit(g["tokens"].to_numpy(), cap)
        filled = np.bincount(b, weights=g["tokens"].to_numpy()).astype("int64")
        names = np.array([f"r{k}-{cap}-{cell}-{i}" for i in range(len(filled))])
        return g.drop(columns=["cell"]).assign(bin=names[b], filled=filled[b])

    n = F.lit(1)
    for c, v in cells.items():
        n = F.when(F.col("capacity") == c, F.lit(v)).otherwise(n)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema) + ", bin string, filled long"
    return items.withColumn("cell", F.pmod(F.xxhash64("item", F.lit(k)), n)).groupBy("capacity", "cell").applyInPandas(one, schema)


def _open(bins: DataFrame, full: float, salts: int = 64) -> DataFrame:
    """(item, capacity, tokens) of the bins that may still be joined with another."""
    left = bins.where(F.col("tokens") < full * F.col("capacity"))
    small = F.col("tokens") * 2 <= F.col("capacity")
    # one row a capacity
    state = {r["capacity"]: (r["least"], r["small"]) for r in left.groupBy("capacity").agg(F.min("tokens").alias("least"), F.count_if(small).alias("small")).collect()}
    least, halves = F.lit(None).cast("long"), F.lit(0)
    for c, (m, h) in state.items():
        least, halves = F.when(F.col("capacity") == c, F.lit(m)).otherwise(least), F.when(F.col("capacity") == c, F.lit(h)).otherwise(halves)
    left = left.where((F.col("capacity") - F.col("tokens") >= least) & (halves > 0)).withColumn("salt", F.pmod(F.xxhash64("item"), F.lit(salts)))
    for keys in (["capacity", "tokens", "salt"], ["capacity", "tokens"]):  # of one fill no more than could be of use; salted first, as one fill may be most of the bins
        left = left.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("item"))).where(small | (F.col("rank") <= halves))
    return left.select("item", "capacity", "tokens")


def pack(items: DataFrame, full: float = FULL, fan_in: int = FAN_IN, per_cell: int = PER_CELL) -> DataFrame:
    """(item, capacity, tokens, ...) with item unique -> the same rows with their bin, by repeated best fit."""
    rounds = pack_rounds(items, full, fan_in, per_cell)
    up = None  # (bin, root), from the last round down
    for got in reversed(rounds[1:]):
        level = got.select(F.col("item").alias("bin"), F.col("bin").alias("up"))
        up = level.withColumnRenamed("up", "root") if up is None else level.join(up.withColumnRenamed("bin", "up"), "up", "left").select("bin", F.coalesce("root", "up").alias("root"))
    first = rounds[0].drop("filled")
    return first if up is None else first.join(up, "bin", "left").withColumn("bin", F.coalesce("root", "bin")).drop("root")


def pack_rounds(items: DataFrame, full: float = FULL, fan_in: int = FAN_IN, per_cell: int = PER_CELL) -> list[DataFrame]:
    """The written rounds: every item of a round with its bin and what that holds; the first has all items, the next the bins left open."""
    todo, rounds, cells = items, [], None
    while True:
        sizes = {r["capacity"]: r["n"] for r in todo.groupBy("capacity").agg(F.count("*").alias("n")).collect()}
        if rounds and not sizes:
            return rounds
        need = {c: max(1, math.ceil(n / per_cell)) for c, n in sizes.items()}
        cells = need if cells is None else {c: max(n, math.ceil(cells[c] / fan_in)) for c, n in need.items()}
        got = cut(_round(todo, cells, len(rounds)), f"pack{len(rounds)}")
        rounds.append(got)
        more = [c for c, v in cells.items() if v > 1]
        if not more:
            return rounds
        bins = got.where(F.col("capacity").isin(more)).groupBy(F.col("bin").alias("item"), "capacity").agg(F.max("filled").cast("int").alias("tokens"))
        todo = cut(_open(bins, full), f"open{len(rounds)}")
