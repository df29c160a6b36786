"""Overlap screen: candidates from shared fingerprints, exact maximal runs, filters and verdicts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import IntegerType

from palimpsest.functions.text import author_key, is_prose
from palimpsest.operators.citations import token_set_ratio
from palimpsest.plans.runtime import cut

DF_SHARE, LEAST_SHARED, POSTING_CAP, LONG_RUN, GRAM, CELL = 0.004, 3, 40, 20, 8, 4096


def document_frequency_cap(n_docs: int, share: float = DF_SHARE) -> int:
    return max(3, int(n_docs * share))


def candidates(fingerprints: DataFrame, n_docs: int, share: float = DF_SHARE, least: int = LEAST_SHARED) -> DataFrame:
    """(a, b, shared), a < b: records with at least ``least`` fingerprints in common.

    Fingerprints of more than the document-frequency cap are common phrases and are dropped by
    definition of the screen before the self join, which bounds the pairs of any one of them.
    """
    df = fingerprints.groupBy("g").agg(F.count("*").alias("df")).where((F.col("df") >= 2) & (F.col("df") <= document_frequency_cap(n_docs, share)))
    kept = fingerprints.join(df.select("g"), "g")
    a, b = kept.select(F.col("doc_id").alias("a"), "g"), kept.select(F.col("doc_id").alias("b"), "g")
    return a.join(b, "g").where(F.col("a") < F.col("b")).groupBy("a", "b").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)


def query_candidates(queries: DataFrame, fingerprints: DataFrame, n_docs: int, share: float = DF_SHARE, least: int = LEAST_SHARED) -> DataFrame:
    """(q, doc_id, shared): records that share ``least`` fingerprints or more with a query record, common phrases left out as in ``candidates``."""
    mine = queries.select(F.col("doc_id").alias("q"), "g")
    near = fingerprints.join(mine.select("g").distinct(), "g", "left_semi")
    rare = near.groupBy("g").agg(F.count("*").alias("df")).where((F.col("df") >= 2) & (F.col("df") <= document_frequency_cap(n_docs, share))).select("g")
    hits = mine.join(near.join(rare, "g", "left_semi"), "g").where(F.col("q") != F.col("doc_id"))
    return hits.groupBy("q", "doc_id").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)


def matches(pairs: DataFrame, gram_rows: DataFrame, cap: int = POSTING_CAP) -> DataFrame:
    """(a, b, pa, pb, rank): equal grams of each pair on the diagonals that hold a seed; rank numbers a gram's places in a.

    Seeds are matches of a gram's first ``cap`` places in a.  Its other places meet b only on those diagonals, place by
    place, so a gram repeated over and over costs no product of its places.
    """
    w = Window.partitionBy("doc_id", "g").orderBy("pos")
    of = lambda side: gram_rows.join(pairs.select(F.col(side).alias("doc_id")).distinct(), "doc_id", "left_semi")
    ranked = of("a").withColumn("rank", F.row_number().over(w))
    a = ranked.select(F.col("doc_id").alias("a"), "g", F.col("pos").alias("pa"), "rank").join(pairs.select("a", "b"), "a")
    b = of("b").select(F.col("doc_id").alias("b"), "g", F.col("pos").alias("pb"))
    seeds = cut(a.where(F.col("rank") <= cap).join(b, ["b", "g"]).select("a", "b", "pa", "pb", "rank"), "seeds")
    diagonals = seeds.select("a", "b", (F.col("pa") - F.col("pb")).alias("d")).distinct()
    more = a.where(F.col("rank") > cap).join(diagonals, ["a", "b"]).withColumn("pb", F.col("pa") - F.col("d"))
    return seeds.unionByName(more.join(b, ["b", "pb", "g"], "left_semi").select("a", "b", "pa", "pb", "rank"))


def maximal_runs(found: DataFrame, gram: int = GRAM, cap: int = POSTING_CAP) -> DataFrame:
    """(a, b, a0, a1, b0, b1): half-open maximal runs, from islands on diagonals.

    Islands are built from all matches and kept if one of them is among a gram's first ``cap``
    places in a; runs inside another run on both sides are dropped.
    """
    diag = F.col("pa") - F.col("pb")
    w = Window.partitionBy("a", "b", "d").orderBy("pb")
    isl = found.withColumn("d", diag).withColumn("i", F.col("pb") - F.row_number().over(w))
    runs = isl.groupBy("a", "b", "d", "i").agg(F.min("pa").alias("a0"), F.max("pa").alias("am"), F.min("pb").alias("b0"), F.max("pb").alias("bm"), F.min("rank").alias("r"))
    runs = runs.where(F.col("r") <= cap).select("a", "b", "a0", (F.col("am") + gram).alias("a1"), "b0", (F.col("bm") + gram).alias("b1"))
    o = runs.select("a", "b", *[F.col(c).alias(f"o{c}") for c in ("a0", "a1", "b0", "b1")])
    inside = (F.col("oa0") <= F.col("a0")) & (F.col("oa1") >= F.col("a1")) & (F.col("ob0") <= F.col("b0")) & (F.col("ob1") >= F.col("b1"))
    longer = (F.col("oa1") - F.col("oa0")) > (F.col("a1") - F.col("a0"))
    return runs.alias("r").join(o, [runs.a == o.a, runs.b == o.b, inside & longer], "left_anti")


def union_length(spans: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """Positions covered by half-open intervals, per ``by``, as ``covered``."""
    w = Window.partitionBy(*by).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), F.col(end) - F.greatest(F.col(start), F.coalesce(reach, F.col(start))))
    return spans.withColumn("_n", new).groupBy(*by).agg(F.sum("_n").alias("covered"))


def pair_summary(runs: DataFrame, sizes: DataFrame, long_run: int = LONG_RUN) -> DataFrame:
    """(a, b, runs, long_runs, max_run, matched_words, share): share is against the words of b."""
    size = F.col("a1") - F.col("a0")
    agg = runs.groupBy("a", "b").agg(F.count("*").alias("runs"), F.count_if(size >= long_run).alias("long_runs"), F.max(size).alias("max_run"))
    cov = union_length(runs, ["a", "b"], "b0", "b1").withColumnRenamed("covered", "matched_words")
    n = sizes.select(F.col("doc_id").alias("b"), F.col("words").alias("_w"))
    return agg.join(cov, ["a", "b"]).join(n, "b").select("a", "b", "runs", "long_runs", "max_run", "matched_words", (F.col("matched_words") / F.greatest("_w", F.lit(1))).alias("share"))


def _cells(df: DataFrame, first: Column, last: Column) -> DataFrame:
    """A row per cell of CELL positions that [first, last] touches, so a range meets a stream by an equi-join."""
    return df.withColumn("cell", F.explode(F.sequence(F.floor(first / CELL), F.floor(last / CELL))))


def run_tokens(runs: DataFrame, stream: DataFrame) -> DataFrame:
    """Runs with ``toks``, their tokens read from b."""
    s = stream.select(F.col("doc_id").alias("b"), "pos", "tok", F.floor(F.col("pos") / CELL).alias("cell"))
    hit = _cells(runs, F.col("b0"), F.col("b1") - 1).join(s, ["b", "cell"]).where((F.col("pos") >= F.col("b0")) & (F.col("pos") < F.col("b1")))
    got = hit.groupBy("a", "b", "a0", "a1", "b0", "b1").agg(F.array_sort(F.collect_list(F.struct("pos", "tok"))).alias("t"))
    return got.withColumn("toks", F.transform("t", lambda x: x["tok"])).drop("t")


def prose_runs(runs: DataFrame, stream: DataFrame) -> DataFrame:
    """Runs that read as prose; the rest are tables, lists and artefacts."""
    return run_tokens(runs, stream).where(is_prose(F.col("toks"))).drop("toks")


def common_runs(runs: DataFrame, gram_rows: DataFrame, gram: int = GRAM) -> DataFrame:
    """Runs every gram of which stands in one third record (relational division), as (a, b, a0, b0).

    Third records are looked up by a run's rarest gram; only those are asked for the other grams.
    """
    run = ["a", "b", "a0", "b0"]
    g = gram_rows.select(F.col("doc_id").alias("b"), "pos", "g", F.floor(F.col("pos") / CELL).alias("cell"))
    need = _cells(runs, F.col("b0"), F.col("b1") - gram).join(g, ["b", "cell"]).where((F.col("pos") >= F.col("b0")) & (F.col("pos") <= F.col("b1") - gram)).select(*run, "g").distinct()
    need = cut(need, "need")
    other = gram_rows.join(need.select("g").distinct(), "g", "left_semi").select(F.col("doc_id").alias("c"), "g").distinct()
    other = cut(other, "postings")
    df = other.groupBy("g").agg(F.count("*").alias("df"))
    asked = need.join(df, "g").groupBy(*run).agg(F.count("*").alias("need"), F.min(F.struct("df", "g")).alias("m")).where(F.col("m.df") > 2)
    third = asked.select(*run, "need", F.col("m.g").alias("g")).join(other, "g").where((F.col("c") != F.col("a")) & (F.col("c") != F.col("b"))).drop("g")
    got = third.join(need, run).join(other, ["c", "g"]).groupBy(*run, "c").agg(F.count("*").alias("got"), F.max("need").alias("need"))
    return got.where(F.col("got") == F.col("need")).select(*run).distinct()


def verdict(same_author: Column, title_sim: Column, unique_runs: Column, max_run: Column) -> Column:
    """Why a pair shares text, the first that holds."""
    return F.when((same_author == 1) | (title_sim >= 95), "same_author_or_duplicate").when(unique_runs == 0, "fully_explained").when(max_run < LONG_RUN, "short_only").otherwise("residual")


@F.pandas_udf(IntegerType())
def title_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Token-set ratio of two titles, cut to a whole number; 0 if one is missing."""
    return pd.Series([int(token_set_ratio(x or "", y or "")) for x, y in zip(a, b)])


def same_people(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs with same_author, same_inst (0/1) and title_sim (0 to 100) from the records' creator, publisher and title."""
    m = docs.groupBy("id").agg(*[F.max_by(c, "harvested_at").alias(c) for c in ("creator", "publisher", "title")])
    for x in ("a", "b"):
        pairs = pairs.join(m.select(F.col("id").alias(x), author_key(F.col("creator")).alias(f"k{x}"), F.coalesce("publisher", F.lit("")).alias(f"p{x}"), F.col("title").alias(f"t{x}")), x, "left")
    same = lambda l, r: F.when((F.col(l) != "") & (F.col(l) == F.col(r)), 1).otherwise(0)
    return pairs.select("a", "b", same("ka", "kb").alias("same_author"), same("pa", "pb").alias("same_inst"), title_similarity("ta", "tb").alias("title_sim"))
