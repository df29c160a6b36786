"""Per-record features, lexicon classification and corpus statistics."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from palimpsest.functions import patterns as P

MARGIN, STRONG, WEAK = 0.20, 3, 1
FIELD_WEIGHTS = {"title": 6.0, "abstract": 2.0, "body": 0.5}
MIN_WORDS = 2000

COUNTS = {"hedges": P.HEDGE, "boosters": P.BOOST, "first_sg": P.FIRST_SINGULAR, "first_pl": P.FIRST_PLURAL, "impersonal": P.IMPERSONAL, "passive": P.PASSIVE, "nominal": P.NOMINAL, "citations": P.CITATION, "questions": r"\?"}


def discourse(sentences: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Style measures of every record with at least ``min_words`` retained words.

    One pass over rows, sums per record; nothing is gathered.  Rates are per 1,000 words.
    """
    s = sentences.where((F.coalesce(F.size("excl"), F.lit(0)) <= 0) & F.col("text").isNotNull()).select("doc_id", "idx", "text").distinct()
    # a letter beyond ASCII is a letter, whatever a regex engine's word boundary makes of it
    s = s.withColumn("text", F.regexp_replace("text", r"[^\x00-\x7F\p{P}\p{S}\p{Z}\p{C}]", "x"))
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)
    s = s.withColumn("w", words)
    add = lambda c, n: F.sum(c).alias(n)
    g = s.groupBy("doc_id").agg(
        F.count("*").alias("sentences"), add(F.size("w"), "words"),
        add(F.size(F.filter("w", lambda x: F.length(x) >= 7)), "long_words"),
        add(F.size(F.filter("w", lambda x: x.isin(*P.STOPWORDS))), "stop_words"),
        add(F.aggregate("w", F.lit(0), lambda a, x: a + F.greatest(F.lit(1), F.regexp_count(x, F.lit("[aeiouy]+")))), "syllables"),
        *[add(F.regexp_count("text", F.lit(rx)), n) for n, rx in COUNTS.items()],
    ).where(F.col("words") >= min_words)
    w, n = F.col("words"), F.col("sentences")
    return g.select(
        "doc_id", "sentences", "words", F.round(w / n, 2).alias("mean_sentence_len"), F.round(100 * F.col("long_words") / w, 2).alias("long_word_pct"), F.round(100 * (1 - F.col("stop_words") / w), 2).alias("lexical_density"),
        F.round(206.835 - 1.015 * (w / n) - 84.6 * (F.col("syllables") / w), 1).alias("flesch"), *[F.round(1000 * F.col(c) / w, 2).alias(f"{c}_per1k") for c in COUNTS],
        F.round(F.col("hedges") / F.greatest("boosters", F.lit(1)), 2).alias("hedge_boost_ratio"),
    )


def method_features(sentences: DataFrame, labels: dict[str, str], buckets: list[str], least: int = 25) -> DataFrame:
    """(doc_id, label, n): matches of each label in a record's method rows, or in all rows if it has fewer than ``least`` of them."""
    s = sentences.where(F.col("text").isNotNull()).select("doc_id", "idx", "text", "bucket").distinct()
    m = F.col("bucket").isin(*buckets)
    hit = lambda rx, cond: F.sum(F.when(cond, F.regexp_count("text", F.lit(rx))).otherwise(0))
    g = s.groupBy("doc_id").agg(F.count_if(m).alias("method_rows"), *[x for k, (n, rx) in enumerate(labels.items()) for x in (hit(rx, m).alias(f"m{k}"), hit(rx, F.lit(True)).alias(f"a{k}"))])
    pick = F.array(*[F.struct(F.lit(n).alias("label"), F.when(F.col("method_rows") >= least, F.col(f"m{k}")).otherwise(F.col(f"a{k}")).alias("n")) for k, n in enumerate(labels)])
    return g.select("doc_id", F.explode(pick).alias("x")).select("doc_id", "x.label", "x.n")


def lexicon_scores(docs: DataFrame, key: str, fields: dict[str, float], lexicon: dict[str, tuple[list[str], list[str]]]) -> DataFrame:
    """(key, label, score): each term counts once a field, strong ones threefold, times the field's weight.

    A term ending in ``*`` is a stem; others take up to two more letters.
    """
    def rx(t: str) -> str:
        return rf"(?i)\b{t[:-1]}" if t.endswith("*") else rf"(?i)\b{t}[a-z0-9_]{{0,2}}\b"

    def score(strong: list[str], weak: list[str]) -> Column:
        out = F.lit(0.0)
        for f, w in fields.items():
            c = F.coalesce(F.col(f), F.lit(""))
            for terms, x in ((strong, STRONG), (weak, WEAK)):
                for t in terms:
                    out = out + F.when(c.rlike(rx(t)), w * x).otherwise(0.0)
        return out

    arr = F.array(*[F.struct(F.lit(n).alias("label"), score(s, w).alias("score")) for n, (s, w) in lexicon.items()])
    return docs.select(key, F.explode(arr).alias("x")).select(key, "x.label", "x.score").where("score > 0")


def classify(scores: DataFrame, key: str, margin: float = MARGIN) -> DataFrame:
    """(key, label, conf, method): the best label if it leads by ``margin`` of the total, else marked weak (ties by name)."""
    w = Window.partitionBy(key)
    o = w.orderBy(F.desc("score"), "label")
    x = scores.withColumn("total", F.sum("score").over(w)).withColumn("second", F.lead("score", 1, 0.0).over(o)).withColumn("rn", F.row_number().over(o)).where("rn = 1")
    lead = (F.col("score") - F.col("second")) / F.col("total")
    return x.select(key, "label", F.round(F.col("score") / F.col("total"), 4).alias("conf"), F.when(lead >= margin, "rules").otherwise("rules-weak").alias("method"))


def label_terms(docs: DataFrame, group: str, text: str, top: int = 3, least: int = 3, share: float = 0.07, damp: float = 0.004) -> DataFrame:
    """(group, term, df, place): terms that set a group's titles apart, ties by term."""
    t = docs.where(F.col(group).isNotNull()).select(F.col(group).alias("g"), F.monotonically_increasing_id().alias("r"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]{4,}"), 0))).alias("term"))
    total = docs.count()
    n = docs.groupBy(F.col(group).alias("g")).agg(F.count("*").alias("n"))
    df = t.groupBy("g", "term").agg(F.count("*").alias("df"))
    allc = t.groupBy("term").agg(F.count("*").alias("all"))
    x = df.join(allc, "term").join(n, "g").where((F.col("df") >= least) & (F.col("df") >= share * F.col("n")))
    x = x.withColumn("score", F.round((F.col("df") / F.col("n")) / (F.col("all") / F.lit(float(max(total, 1))) + damp), 9))
    return x.withColumn("place", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("score"), "term"))).where(F.col("place") <= top).select(F.col("g").alias("grp"), "term", "df", "place")


def line_digests(rows: DataFrame, by: str, order: str, line: str) -> DataFrame:
    """(by, signature, n): sha256 of a group's lines in order, joined by line ends; lines go by one at a time, no group is held."""
    import hashlib

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, digest, n = None, None, 0
        for pdf in batches:
            for g, x in zip(pdf["g"], pdf["line"]):
                if digest is None or g != now:
                    if digest is not None:
                        yield pd.DataFrame({by: [now], "signature": [digest.hexdigest()], "n": [n]})
                    now, digest, n = g, hashlib.sha256(), 0
                digest.update((("\n" if n else "") + x).encode())
                n += 1
        if digest is not None:
            yield pd.DataFrame({by: [now], "signature": [digest.hexdigest()], "n": [n]})

    x = rows.where(F.col(line).isNotNull()).select(F.col(by).alias("g"), F.col(order).alias("o"), F.col(line).alias("line"))
    return x.repartition("g").sortWithinPartitions("g", "o", "line").mapInPandas(each, f"`{by}` string, signature string, n long")
