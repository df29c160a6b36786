"""Page geometry: lines from words, headings, folios, paragraphs and hyphen repair.

Inputs are exploded words or lines; grouping is by page or record page, never by corpus.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from palimpsest.functions import patterns as P

FOLIO = r"(?i)^\s*(?:page\s*)?(\d{1,4}|[ivxlcdm]{1,12})\s*$"


def lines_from_words(words: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """(doc_id, page, n, text, x0, top, bottom): words of a page whose tops lie within ``tolerance`` of a line's first word."""

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["top", "x0"]).reset_index(drop=True)
        n, anchor, nums = -1, None, []
        for t in pdf["top"]:
            if anchor is None or t - anchor > tolerance:
                n, anchor = n + 1, t
            nums.append(n)
        pdf["n"] = nums
        pdf = pdf.sort_values(["n", "x0"])
        g = pdf.groupby("n")
        return pd.DataFrame({"doc_id": pdf["doc_id"].iloc[0], "page": pdf["page"].iloc[0], "n": list(g.groups), "text": g["text"].agg(" ".join).to_numpy(), "x0": g["x0"].min().to_numpy(), "top": g["top"].min().to_numpy(), "bottom": g["bottom"].max().to_numpy()})

    return words.groupBy("doc_id", "page").applyInPandas(each, "doc_id string, page int, n int, text string, x0 double, top double, bottom double")


def modal_geometry(lines: DataFrame) -> DataFrame:
    """(doc_id, size, x0, leading): most used font size (half points, by characters), left edge, and upper median of the line distance."""
    sizes = lines.groupBy("doc_id", (F.round(F.col("size") * 2) / 2).alias("size")).agg(F.sum(F.length("text")).alias("c")).groupBy("doc_id").agg(F.min_by("size", F.struct((-F.col("c")).alias("c"), "size")).alias("size"))
    edges = lines.groupBy("doc_id", F.round("x0").alias("x0")).agg(F.count("*").alias("c")).groupBy("doc_id").agg(F.min_by("x0", F.struct((-F.col("c")).alias("c"), "x0")).alias("x0"))
    gap = lines.withColumn("gap", F.col("top") - F.lag("top").over(Window.partitionBy("doc_id", "page").orderBy("n"))).where("gap > 0")
    w = Window.partitionBy("doc_id")
    lead = gap.withColumn("rn", F.row_number().over(w.orderBy("gap"))).withColumn("k", F.count("*").over(w)).where(F.col("rn") == F.floor(F.col("k") / 2) + 1).select("doc_id", F.col("gap").alias("leading"))
    return sizes.join(edges, "doc_id").join(lead, "doc_id", "left")


def is_heading(text: Column, size: Column, bold: Column, modal: Column) -> Column:
    """Short, no sentence end, and larger than the body, bold, numbered or a known chapter word."""
    short = (F.length(text) <= 90) & (F.size(F.split(text, r"\s+")) <= 12) & ~text.rlike(r"[.;,]\s*$")
    known = text.rlike(r"(?i)^\s*(chapter\s+\d+|abstract|introduction|literature review|method(s|ology)?|results|findings|discussion|conclusions?|references|bibliography|appendix.*)\s*$")
    return F.coalesce(short & text.rlike("[A-Za-z]") & ((size >= modal + 0.6) | known | (bold & text.rlike(r"^(\d+(\.\d+)*\s+)?[A-Z]"))), F.lit(False))


def folios(lines: DataFrame, height: float = 842.0, band: float = 0.08) -> DataFrame:
    """(doc_id, page, printed): page labels from the top or bottom band, whichever labels more pages (bottom of equals)."""
    c = lines.where(F.col("text").rlike(FOLIO)).withColumn("band", F.when(F.col("top") <= height * band, "top").when(F.col("bottom") >= height * (1 - band), "bottom")).where("band is not null")
    first = c.groupBy("doc_id", "band", "page").agg(F.min_by("text", "n").alias("t"))
    w = Window.partitionBy("doc_id").orderBy(F.desc("k"), "band")
    best = first.groupBy("doc_id", "band").agg(F.count("*").alias("k")).withColumn("rn", F.row_number().over(w)).where("rn = 1").select("doc_id", "band")
    return first.join(best, ["doc_id", "band"]).select("doc_id", "page", F.lower(F.regexp_extract("t", FOLIO, 1)).alias("printed"))


def reference_state(lines: DataFrame) -> DataFrame:
    """Lines with ``in_refs``: on from a references heading to the next appendix, chapter, glossary or index."""
    w = Window.partitionBy("doc_id").orderBy("page", "n").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when(F.col("text").rlike(P.REFERENCE_HEADING), True).when(F.col("text").rlike(P.REFERENCE_END), False)
    return lines.withColumn("in_refs", F.coalesce(F.last(mark, ignorenulls=True).over(w), F.lit(False)))


def paragraphs(lines: DataFrame, leading: float, indent: float = 6.0) -> DataFrame:
    """(doc_id, page, para, text): breaks at a wide gap, an indent or after a short line that ends a sentence; hyphens at line ends repaired."""
    w = Window.partitionBy("doc_id", "page").orderBy("n")
    gap = F.col("top") - F.lag("bottom").over(w)
    edge = F.min("x0").over(Window.partitionBy("doc_id", "page"))
    ended = F.lag("text").over(w).rlike(r"[.!?][\"'”’)]*\s*$") & (F.length(F.lag("text").over(w)) < 40)
    x = lines.withColumn("new", F.coalesce((gap > 0.75 * leading) | (F.col("x0") - edge > indent) | ended, F.lit(True)).cast("int")).withColumn("para", F.sum("new").over(w))
    g = x.groupBy("doc_id", "page", "para").agg(F.array_sort(F.collect_list(F.struct("n", "text"))).alias("l"))
    return g.select("doc_id", "page", "para", join_lines(F.transform("l", lambda s: s["text"])).alias("text"))


def join_lines(parts: Column) -> Column:
    """Lines to one text: a hyphen before a small letter goes, one before a capital stays without a blank."""

    def step(acc: Column, x: Column) -> Column:
        low = acc.rlike(r"[^\W\d_]-$") & x.rlike(r"^\p{Ll}")
        cap = acc.rlike(r"[^\W\d_]-$") & x.rlike(r"^\p{Lu}")
        return F.when(acc == "", x).when(low, F.concat(F.regexp_replace(acc, "-$", ""), x)).when(cap, F.concat(acc, x)).otherwise(F.concat_ws(" ", acc, x))

    return F.aggregate(parts, F.lit(""), step)
