"""Match records of a pair of records: where a run stands, what surrounds it, and figures per pair.

Runs are (a, b, a0, a1, b0, b1) in token positions.  ``words`` is the display stream of the retained rows: one row per
token with the row and the display word it belongs to.  Ranges meet streams by cells of bounded length, so every join
has an equality to shuffle on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from palimpsest.functions import patterns as P, text as T
from palimpsest.operators.overlap import CELL, LONG_RUN

RUN = ["a", "b", "a0", "a1", "b0", "b1"]
CITATION_WINDOW, ATTRIBUTION_WINDOW, ROWS = 3, 2, 64
# fixed values: characters that open or close a quotation
QUOTES = "[\"'‘’“”]"
BANDS = [(8, 11), (12, 15), (16, 19), (20, 29), (30, 49), (50, None)]


def one_text(sentences: DataFrame) -> DataFrame:
    """(doc_id, idx, text, ...): one row per place, the least text of several; other columns with it."""
    rest = [c for c in ("page", "printed", "bucket", "heading") if c in sentences.columns]
    x = sentences.where(F.col("doc_id").isNotNull() & F.col("idx").isNotNull())
    return x.groupBy("doc_id", "idx").agg(F.min(F.struct(F.coalesce("text", F.lit("")).alias("text"), *rest)).alias("m")).select("doc_id", "idx", "m.*")


def display_words(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, pos, idx, k, word): tokens with the blank-separated word of the text each comes from."""
    w = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    each = F.flatten(F.transform(w, lambda x, i: F.array_repeat(F.struct(i.alias("k"), x.alias("word")), F.size(T.match_tokens(x)))))
    x = rows.select("doc_id", "idx", "base").join(texts.select("doc_id", "idx", "text"), ["doc_id", "idx"])
    x = x.select("doc_id", "idx", "base", F.posexplode(each).alias("t", "x"))
    return x.select("doc_id", (F.col("base") + F.col("t")).alias("pos"), "idx", "x.k", "x.word")


def covered_words(runs: DataFrame, words: DataFrame, side: str) -> DataFrame:
    """Runs with the words they cover on one side: (run, idx, k, word), a word once."""
    lo, hi = F.col(f"{side}0"), F.col(f"{side}1")
    s = words.withColumnRenamed("doc_id", side).withColumn("cell", F.floor(F.col("pos") / CELL))
    r = runs.select(*RUN).withColumn("cell", F.explode(F.sequence(F.floor(lo / CELL), F.floor((hi - 1) / CELL))))
    return r.join(s, [side, "cell"]).where((F.col("pos") >= lo) & (F.col("pos") < hi)).select(*RUN, "idx", "k", "word").distinct()


def sides(runs: DataFrame, words: DataFrame) -> DataFrame:
    """Runs with first and last row (sa0, sa1, sb0, sb1) and display text (text_a, text_b) of both sides; a run is short, so its words fit a row."""
    out = runs.select(*RUN)
    for x in ("a", "b"):
        g = covered_words(runs, words, x).groupBy(*RUN).agg(F.min("idx").alias(f"s{x}0"), F.max("idx").alias(f"s{x}1"), F.array_sort(F.collect_list(F.struct("idx", "k", "word"))).alias("w"))
        out = out.join(g.select(*RUN, f"s{x}0", f"s{x}1", F.array_join(F.transform("w", lambda y: y["word"]), " ").alias(f"text_{x}")), RUN)
    return out


def around(spans: DataFrame, texts: DataFrame, doc: str, first: str, last: str, reach: int) -> DataFrame:
    """Spans with the rows from ``reach`` before the first to ``reach`` after the last: adds (idx, text, inside). A band join on blocks of rows."""
    lo, hi = F.greatest(F.lit(0), F.col(first) - reach), F.col(last) + reach
    s = spans.withColumn("part", F.explode(F.sequence(F.floor(lo / ROWS), F.floor(hi / ROWS))))
    t = texts.select(F.col("doc_id").alias(doc), "idx", "text").withColumn("part", F.floor(F.col("idx") / ROWS))
    return s.join(t, [doc, "part"]).where((F.col("idx") >= lo) & (F.col("idx") <= hi)).withColumn("inside", F.col("idx").between(F.col(first), F.col(last))).drop("part")


def mentions(text: Column, surname: Column) -> Column:
    """A surname stands in a text as a word of its own; '' never does."""
    plain = F.regexp_replace(surname, r"[^\p{L}\p{N}'’-]", "")
    return (plain != "") & F.regexp_like(text, F.concat(F.lit(r"\b"), plain, F.lit(r"\b")))


def citation_classes(spans: DataFrame, texts: DataFrame, surnames: DataFrame) -> DataFrame:
    """(run, citation): is the author of a named in the matched rows of b, within three rows of them, or not at all."""
    x = around(spans, texts, "b", "sb0", "sb1", CITATION_WINDOW).join(surnames.select(F.col("doc_id").alias("a"), "surname"), "a", "left")
    hit = mentions(F.col("text"), F.coalesce("surname", F.lit("")))
    g = x.groupBy(*RUN).agg(F.max(hit & F.col("inside")).alias("inside"), F.max(hit).alias("near"))
    return g.select(*RUN, F.when(F.col("inside"), "attributed").when(F.col("near"), "adjacent-but-unattributed").otherwise("unattributed").alias("citation"))


def quoted_runs(spans: DataFrame, texts: DataFrame) -> DataFrame:
    """Runs that stand in quoted or attributed text on both sides: two quotation marks in a matched row, or an attribution within two rows."""
    out = None
    for x in ("a", "b"):
        near = around(spans, texts, x, f"s{x}0", f"s{x}1", ATTRIBUTION_WINDOW)
        yes = near.where((F.col("inside") & (F.regexp_count("text", F.lit(QUOTES)) >= 2)) | F.col("text").rlike(P.FLAGS["attribution"])).select(*RUN).distinct()
        out = yes if out is None else out.join(yes, RUN, "left_semi")
    return out


def records(spans: DataFrame, texts: DataFrame, surnames: DataFrame) -> DataFrame:
    """Match records: rows, pages, chapters and headings of both sides, citation class, what a says of itself, and errors carried over."""
    out = spans.join(citation_classes(spans, texts, surnames), RUN)
    for x in ("a", "b"):
        meta = texts.select(F.col("doc_id").alias(x), F.col("idx").alias(f"s{x}0"), F.coalesce("page", F.lit(-1)).alias(f"page_{x}"), F.coalesce("printed", F.lit("")).alias(f"printed_{x}"), F.coalesce("bucket", F.lit("unclassified")).alias(f"bucket_{x}"), F.coalesce("heading", F.lit("")).alias(f"heading_{x}"))
        last = texts.select(F.col("doc_id").alias(x), F.col("idx").alias(f"s{x}1"), F.coalesce("page", F.lit(-1)).alias(f"last_page_{x}"))
        out = out.join(meta, [x, f"s{x}0"], "left").join(last, [x, f"s{x}1"], "left")
    both = F.array_intersect(T.error_signatures(F.col("text_a")), T.error_signatures(F.col("text_b")))
    return out.withColumn("directions", F.array_join(T.directions(F.col("text_a")), ";")).withColumn("errors", F.array_join(both, ";"))


def pair_analysis(found: DataFrame, words: DataFrame, sizes: DataFrame) -> DataFrame:
    """Figures per (a, b) from match records: runs, longest and upper median, bands, chapters of b, distinct display words, shares, citation classes, directions and errors.

    ``sizes`` is (doc_id, included, every): words of retained and of all rows.
    """
    n = F.col("b1") - F.col("b0")
    per = [F.count_if((n >= lo) & (n <= hi if hi else F.lit(True))).alias(f"runs_{lo}_{hi or 'up'}") for lo, hi in BANDS]
    cite = [F.count_if(F.col("citation") == c).alias(name) for c, name in (("attributed", "attributed"), ("adjacent-but-unattributed", "adjacent"), ("unattributed", "unattributed"))]
    # upper median: the element at half the count, from the counts per length
    lengths = found.groupBy("a", "b", n.alias("len")).agg(F.count("*").alias("c"))
    w = Window.partitionBy("a", "b")
    upto = lengths.withColumn("upto", F.sum("c").over(w.orderBy("len"))).withColumn("all", F.sum("c").over(w))
    median = upto.where(F.col("upto") > F.floor(F.col("all") / 2)).groupBy("a", "b").agg(F.min("len").alias("median_run"))
    g = found.groupBy("a", "b").agg(F.count("*").alias("runs"), F.count_if(n >= LONG_RUN).alias("long_runs"), F.max(n).alias("max_run"), *per, *cite, F.count_if(F.col("directions") != "").alias("directed"), F.count_if(F.col("errors") != "").alias("with_errors"))
    shown = covered_words(found, words, "b").groupBy("a", "b").agg(F.count_distinct("idx", "k").alias("matched_words"))
    size = sizes.select(F.col("doc_id").alias("b"), "included", "every")
    out = g.join(median, ["a", "b"]).join(shown, ["a", "b"]).join(size, "b")
    return out.withColumn("share_included", F.round(F.col("matched_words") / F.greatest("included", F.lit(1)), 8)).withColumn("share_all", F.round(F.col("matched_words") / F.greatest("every", F.lit(1)), 8))


def pair_buckets(found: DataFrame) -> DataFrame:
    """(a, b, bucket, runs, words): matched runs and their words by the chapter of b they begin in."""
    return found.groupBy("a", "b", F.col("bucket_b").alias("bucket")).agg(F.count("*").alias("runs"), F.sum(F.col("b1") - F.col("b0")).alias("words"))


def per_million(figures: DataFrame, comparisons: DataFrame, columns: list[str]) -> DataFrame:
    """Counts per million sentence comparisons of a pair; (a, b, comparisons) may be missing or 0, which counts as 1."""
    x = figures.join(comparisons, ["a", "b"], "left")
    n = F.greatest(F.coalesce("comparisons", F.lit(1)), F.lit(1))
    return x.select("a", "b", *[F.round(F.col(c) * 1e6 / n, 6).alias(f"{c}_per_million") for c in columns])


def author_mentions(texts: DataFrame, pairs: DataFrame, surnames: DataFrame, references: Column) -> DataFrame:
    """(a, b, total, in_references, pages): how often rows of b name the author of a."""
    x = pairs.select("a", "b").join(surnames.select(F.col("doc_id").alias("a"), "surname"), "a").join(texts.withColumn("ref", references).withColumnRenamed("doc_id", "b"), "b")
    n = F.when(mentions(F.col("text"), F.col("surname")), F.regexp_count("text", F.concat(F.lit(r"\b"), F.regexp_replace("surname", r"[^\p{L}\p{N}'’-]", ""), F.lit(r"\b")))).otherwise(0)
    x = x.withColumn("n", n)
    return x.groupBy("a", "b").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("ref"), F.col("n")).otherwise(0)).alias("in_references"), F.count_distinct(F.when(F.col("n") > 0, F.col("page"))).alias("pages"))


def fates(runs: DataFrame, artefacts: DataFrame, common: DataFrame, quoted: DataFrame) -> DataFrame:
    """Runs with ``fate``: the first that holds of artefact, common, quoted, else kept."""
    key = ["a", "b", "a0", "b0"]
    tag = lambda df, n: df.select(*key).distinct().withColumn(n, F.lit(True))
    x = runs.join(tag(artefacts, "ar"), key, "left").join(tag(common, "co"), key, "left").join(tag(quoted, "qu"), key, "left")
    return x.withColumn("fate", F.when(F.col("ar"), "artefact").when(F.col("co"), "common").when(F.col("qu"), "quoted").otherwise("kept")).drop("ar", "co", "qu")


def distinct_passages(runs: DataFrame) -> DataFrame:
    """(a, b, passages): passages of b that runs cover, overlapping ones as one."""
    w = Window.partitionBy("a", "b").orderBy("b0", "b1")
    reach = F.max("b1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return runs.withColumn("new", (F.col("b0") >= F.coalesce(reach, F.lit(-1))).cast("int")).groupBy("a", "b").agg(F.sum("new").alias("passages"))


def shown_fragments(runs: DataFrame, most: int = 6) -> DataFrame:
    """Runs to show of each pair: the longest first (ties by place), none that overlaps one shown, at most ``most``."""
    spans = F.array_sort(F.collect_list(F.struct((F.col("b0") - F.col("b1")).alias("neg"), "b0", "b1", "a0", "a1")))
    free = lambda acc, x: ~F.exists(acc, lambda y: (x["b0"] < y["b1"]) & (y["b0"] < x["b1"])) & (F.size(acc) < most)
    kind = "array<struct<neg:bigint,b0:bigint,b1:bigint,a0:bigint,a1:bigint>>"
    pick = F.aggregate(F.col("l").cast(kind), F.array().cast(kind), lambda acc, x: F.when(free(acc, x), F.array_append(acc, x)).otherwise(acc))
    return runs.groupBy("a", "b").agg(spans.alias("l")).select("a", "b", F.posexplode(pick).alias("place", "x")).select("a", "b", (F.col("place") + 1).alias("place"), "x.a0", "x.a1", "x.b0", "x.b1")


def highlight_segments(spans: DataFrame, by: list[str]) -> DataFrame:
    """(by, start, end, ids): elementary stretches of overlapping (id, start, end) spans, with the ids that cover each; equal neighbours merge."""
    ends = spans.select(*by, F.col("start").alias("at")).unionByName(spans.select(*by, F.col("end").alias("at"))).distinct()
    w = Window.partitionBy(*by).orderBy("at")
    parts = ends.withColumn("to", F.lead("at").over(w)).where("to is not null")
    hit = parts.join(spans, by).where((F.col("start") <= F.col("at")) & (F.col("end") >= F.col("to")))
    seg = hit.groupBy(*by, "at", "to").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    v = Window.partitionBy(*by).orderBy("at")
    new = ~((F.lag("to").over(v) == F.col("at")) & (F.lag("ids").over(v) == F.col("ids")))
    seg = seg.withColumn("i", F.sum(F.coalesce(new, F.lit(True)).cast("int")).over(v))
    return seg.groupBy(*by, "i").agg(F.min("at").alias("start"), F.max("to").alias("end"), F.first("ids").alias("ids")).drop("i")


def without_self(pairs: DataFrame, digests: DataFrame) -> DataFrame:
    """Pairs of records whose files differ: a record deposited twice (equal digest) is no partner of itself."""
    d = digests.where(F.coalesce("sha256", F.lit("")) != "").groupBy("doc_id").agg(F.max("sha256").alias("sha"))
    x = pairs.join(d.select(F.col("doc_id").alias("a"), F.col("sha").alias("x")), "a", "left").join(d.select(F.col("doc_id").alias("b"), F.col("sha").alias("y")), "b", "left")
    return x.where(~F.coalesce(F.col("x") == F.col("y"), F.lit(False))).drop("x", "y")


def ranked_partners(runs: DataFrame, fate: str = "fate") -> DataFrame:
    """(a, b, long_kept, words_kept, place) both ways: partners of each record, most kept long runs first, then most words of the record covered by kept runs, then id."""
    turned = runs.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("b0").alias("a0"), F.col("b1").alias("a1"), F.col("a0").alias("b0"), F.col("a1").alias("b1"), fate)
    x = runs.select("a", "b", "a0", "a1", "b0", "b1", fate).unionByName(turned).where(F.col(fate) == "kept")
    w = Window.partitionBy("a", "b").orderBy("a0", "a1")
    reach = F.max("a1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    x = x.withColumn("fresh", F.greatest(F.lit(0), F.col("a1") - F.greatest(F.col("a0"), F.coalesce(reach, F.col("a0")))))
    g = x.groupBy("a", "b").agg(F.count_if(F.col("a1") - F.col("a0") >= LONG_RUN).alias("long_kept"), F.sum("fresh").alias("words_kept"))
    return g.withColumn("place", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("long_kept"), F.desc("words_kept"), "b")))
