"""Token streams of records: positions by a prefix sum in two levels.

A record may hold a large share of all rows, so no step gathers a record: rows are numbered
inside blocks of ``BLOCK`` rows, blocks are summed, and the sums are added back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from palimpsest.functions.text import match_tokens

BLOCK = 512
GAP = 64  # positions left out where rows do not adjoin, if barriers are asked for


def kept(sentences: DataFrame) -> DataFrame:
    """Rows with an empty ``excl``, ids and order present."""
    return sentences.where(F.col("doc_id").isNotNull() & F.col("idx").isNotNull() & (F.coalesce(F.size("excl"), F.lit(0)) <= 0)).select("doc_id", "idx", "text")


def retained(sentences: DataFrame) -> DataFrame:
    """The distinct ones of these rows."""
    return kept(sentences).distinct()


def token_rows(sentences: DataFrame, barriers: bool = False) -> DataFrame:
    """(doc_id, idx, base, toks): the tokens of a row and the position of the first.

    With ``barriers`` a gap in ``idx`` moves the position on by GAP, so no gram or run bridges it.
    """
    rows = retained(sentences).select("doc_id", "idx", match_tokens(F.col("text")).alias("toks"))
    rows = rows.groupBy("doc_id", "idx").agg(F.min("toks").alias("toks")).withColumn("b", F.floor(F.col("idx") / BLOCK))
    inner = Window.partitionBy("doc_id", "b").orderBy("idx")
    step = F.size("toks") + (F.when(F.lag("idx").over(inner).isNotNull() & (F.lag("idx").over(inner) != F.col("idx") - 1), GAP).otherwise(0) if barriers else F.lit(0))
    rows = rows.withColumn("step", step)
    rows = rows.withColumn("upto", F.sum("step").over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    blocks = rows.groupBy("doc_id", "b").agg(F.sum("step").alias("m"), F.min("idx").alias("lo"), F.max("idx").alias("hi"))
    outer = Window.partitionBy("doc_id").orderBy("b")
    if barriers:
        blocks = blocks.withColumn("m0", F.when(F.lag("hi").over(outer).isNotNull() & (F.lag("hi").over(outer) != F.col("lo") - 1), GAP).otherwise(0))
    else:
        blocks = blocks.withColumn("m0", F.lit(0))
    blocks = blocks.withColumn("before", F.sum(F.col("m") + F.col("m0")).over(outer.rowsBetween(Window.unboundedPreceding, 0)) - F.col("m"))
    return rows.join(blocks.select("doc_id", "b", "before"), ["doc_id", "b"]).select("doc_id", "idx", (F.col("before") + F.col("upto") - F.size("toks")).cast("long").alias("base"), "toks")


def token_stream(rows: DataFrame) -> DataFrame:
    """(doc_id, pos, tok, idx)."""
    return rows.select("doc_id", "idx", "base", F.posexplode("toks").alias("k", "tok")).select("doc_id", (F.col("base") + F.col("k")).alias("pos"), "tok", "idx")


def grams(stream: DataFrame, n: int = 8, digest: str = "xxhash64") -> DataFrame:
    """(doc_id, pos, g): digests of n tokens at adjoining positions.

    Tokens go to cells of 4096 positions, those that begin a cell also to the one before, so the
    window never spans a whole record.
    """
    cell = F.floor(F.col("pos") / 4096)
    two = stream.withColumn("cell", F.explode(F.when((F.col("pos") % 4096 < n - 1) & (F.col("pos") >= 4096), F.array(cell, cell - 1)).otherwise(F.array(cell))))
    w = Window.partitionBy("doc_id", "cell").orderBy("pos")
    text = F.concat_ws(" ", "tok", *[F.lead("tok", i).over(w) for i in range(1, n)])
    two = two.withColumn("last", F.lead("pos", n - 1).over(w)).withColumn("g", F.md5(text) if digest == "md5" else F.xxhash64(text))
    return two.where((F.col("last") == F.col("pos") + n - 1) & (cell == F.col("cell"))).select("doc_id", "pos", "g")


def array_grams(toks: Column, n: int = 8) -> Column:
    """Digests of n adjoining tokens of an array, in order."""
    return F.transform(F.slice(toks, 1, F.greatest(F.size(toks) - (n - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(toks, i + k) for k in range(1, n)]))


def row_grams(sentences: DataFrame, n: int = 8) -> DataFrame:
    """(g): digests (``array_grams``) of n adjoining tokens of each record, over its retained rows; for large tables.

    Rows go once to the task of their record and BLOCK and meet there the first tokens of the next rows; what goes over the
    end of a block is made from the first and last tokens of the blocks, for records of more than one.
    """
    block = F.floor(F.col("idx") / BLOCK)
    rows = kept(sentences).select("doc_id", "idx", block.alias("b"), F.array_join(match_tokens(F.col("text")), " ").alias("s"))
    least, order = Window.partitionBy("doc_id", "b").orderBy("idx", "s"), Window.partitionBy("doc_id", "b").orderBy("idx")
    ahead = lambda c, w: F.slice(F.flatten(F.collect_list(c).over(w.rowsBetween(1, n - 1))), 1, n - 1)
    last = lambda c: F.slice(c, -F.least(F.size(c), F.lit(n - 1)), n - 1)

    def joined(x: DataFrame) -> DataFrame:
        """A row of an index once, the least one; rows without tokens left out, so n - 1 next rows hold n - 1 tokens."""
        x = x.withColumn("again", F.lag("idx").over(least).eqNullSafe(F.col("idx"))).where("NOT again AND s != ''").withColumn("toks", F.split("s", " ")).drop("again", "s")
        return x.withColumn("head", F.slice("toks", 1, n - 1)).withColumn("ahead", ahead("head", order))

    out = joined(rows).select(F.concat("toks", "ahead").alias("t")).select(F.explode(array_grams(F.col("t"), n)).alias("g"))
    long = kept(sentences).groupBy("doc_id").agg(F.min(block).alias("lo"), F.max(block).alias("hi")).where("lo < hi").select("doc_id")
    if not long.take(1):
        return out
    x = joined(rows.join(long, "doc_id", "left_semi")).withColumn("behind", F.flatten(F.collect_list(last(F.col("toks"))).over(order.rowsBetween(2 - n, 0))))
    x = x.withColumn("first", F.row_number().over(order) == 1).withColumn("end", F.lead("idx").over(order).isNull()).where("first OR end")
    ends = x.groupBy("doc_id", "b").agg(F.max(F.when(F.col("first"), F.slice(F.concat("toks", "ahead"), 1, n - 1))).alias("head"), F.max(F.when(F.col("end"), last(F.col("behind")))).alias("tail"))
    over = ends.withColumn("ahead", ahead("head", Window.partitionBy("doc_id").orderBy("b"))).select(F.concat("tail", "ahead").alias("t"))
    return out.unionByName(over.select(F.explode(array_grams(F.col("t"), n)).alias("g")))


def winnow(gram_rows: DataFrame, window: int = 13) -> DataFrame:
    """(doc_id, g): the least digest of every full window of grams, the rightmost of equals; distinct.

    Any passage of window + n - 1 tokens that two records share leaves a digest in both.
    """
    cell = F.floor(F.col("pos") / 4096)
    two = gram_rows.withColumn("cell", F.explode(F.when((F.col("pos") % 4096 < window - 1) & (F.col("pos") >= 4096), F.array(cell, cell - 1)).otherwise(F.array(cell))))
    w = Window.partitionBy("doc_id", "cell").orderBy("pos")
    m = F.min(F.struct("g", (-F.col("pos")).alias("p"))).over(w.rowsBetween(0, window - 1))
    two = two.withColumn("m", m).withColumn("last", F.lead("pos", window - 1).over(w))
    return two.where((F.col("last") == F.col("pos") + window - 1) & (cell == F.col("cell"))).select("doc_id", F.col("m.g").alias("g")).distinct()
