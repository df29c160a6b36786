"""Ranked and boolean search over titles, creators and abstracts."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

FIELDS = {"title": 10.0, "creator": 5.0, "abstract": 1.0}
K1, B = 1.2, 0.75


def tokens(c: Column) -> Column:
    """Lower-case ASCII words."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), 0)


def postings(docs: DataFrame, key: str, fields: list[str] | None = None) -> DataFrame:
    """(field, term, key, pos)"""
    parts = [docs.select(F.lit(f).alias("field"), F.col(key), F.posexplode(tokens(F.col(f))).alias("pos", "term")) for f in fields or FIELDS]
    return reduce(DataFrame.unionByName, parts)


def bm25(docs: DataFrame, key: str, terms: list[str], weights: dict[str, float] | None = None) -> DataFrame:
    """(key, score), the best lowest (negative), for records with every term in some field.

    Term counts of the fields are weighted and summed, length is that of all fields.
    """
    weights = weights or FIELDS
    t = sorted(set(terms))
    p = postings(docs, key, list(weights))
    length = docs.select(key, reduce(lambda a, b: a + b, [F.size(tokens(F.col(f))) for f in weights]).alias("len"))
    n, avg = docs.count(), length.agg(F.avg("len")).first()[0] or 1.0
    w = F.coalesce(*[F.when(F.col("field") == f, F.lit(x)) for f, x in weights.items()])
    tf = p.where(F.col("term").isin(*t)).groupBy(key, "term").agg(F.sum(w).alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    x = tf.join(F.broadcast(df), "term").join(length, key)
    idf = F.greatest(F.log((F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    s = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.lit(float(avg))))
    return x.groupBy(key).agg(F.sum(s).alias("s"), F.count("*").alias("hits")).where(F.col("hits") == len(t)).select(key, F.round(-F.col("s"), 6).alias("score"))


class QueryError(ValueError):
    """A query that cannot be read."""


def parse_query(q: str) -> list[tuple[str, str | None, str, bool]]:
    """(connective, field, text, prefix) items: words, "phrases", -x or NOT x, OR, field:x, x*."""
    out, conn = [], "AND"
    for m in re.finditer(r'(-?)(?:(\w+):)?(?:"([^"]*)"|([^\s"]+))', q):
        neg, field, phrase, word = m.groups()
        if phrase is None and field is None and word in ("AND", "OR", "NOT"):
            conn = word if word != "NOT" or conn != "OR" else "NOT"
            continue
        if field is not None and field not in FIELDS:
            word, field = f"{field} {phrase if phrase is not None else word}", None
            phrase = None
        text = phrase if phrase is not None else word
        prefix = phrase is None and text.endswith("*")
        text = " ".join(re.findall(r"[a-z0-9]+", text.lower()))
        if not text:
            conn = "AND"
            continue
        if neg or conn == "NOT":
            if not out:
                raise QueryError("a query cannot begin with an exclusion")
            out.append(("NOT", field, text, prefix))
        else:
            out.append((conn, field, text, prefix))
        conn = "AND"
    if not out:
        raise QueryError("nothing to search for")
    return out


def boolean(docs: DataFrame, key: str, query: str) -> DataFrame:
    """Records a query selects: OR joins the item before, AND and NOT narrow; phrases are neighbours in one field."""
    def test(field: str | None, text: str, prefix: bool) -> Column:
        def one(f: str) -> Column:
            t = tokens(F.col(f))
            if prefix:
                return F.exists(t, lambda x: x.startswith(text))
            return F.concat(F.lit(" "), F.array_join(t, " "), F.lit(" ")).contains(f" {text} ")
        return reduce(lambda a, b: a | b, [one(f) for f in ([field] if field else FIELDS)])

    groups: list[Column] = []
    for conn, field, text, prefix in parse_query(query):
        c = test(field, text, prefix)
        if conn == "OR" and groups:
            groups[-1] = groups[-1] | c
        else:
            groups.append(~c if conn == "NOT" else c)
    return docs.where(reduce(lambda a, b: a & b, groups))


def resolve(values: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(value, match, tier): vocabulary words that fit best: equal, else beginning with it, else containing it; tier null for none."""
    v, m = F.lower("value"), F.lower("word")
    tier = F.when(m == v, 0).when(m.startswith(v), 1).when(m.contains(v), 2)
    # a word that holds a value holds its first three letters (or the whole of a shorter one)
    of = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(m) - n + 1, F.lit(1))), lambda i: F.substring(m, i, F.lit(n)))
    pieces = F.array_distinct(F.concat(of(1), of(2), of(3)))
    words = vocabulary.where(F.length("word") > 0).select("word").distinct().select("word", F.explode(pieces).alias("piece"))
    asked = values.select("value").distinct()
    hits = asked.where(F.length("value") > 0).withColumn("piece", F.substring(v, 1, 3)).join(words, "piece").withColumn("tier", tier).where(F.col("tier").isNotNull())
    best = hits.groupBy("value").agg(F.min("tier").alias("tier"))
    return asked.join(hits.join(best, ["value", "tier"], "left_semi").select("value", F.col("word").alias("match"), "tier").distinct(), "value", "left").select("value", "match", "tier")


def fragment(text: Column, term: str, width: int = 14) -> Column:
    """The first ``width`` words around the first use of a term, marked, with dots where text is left out."""
    w = F.split(F.coalesce(text, F.lit("")), r"\s+")
    low = F.transform(w, lambda x: F.regexp_replace(F.lower(x), "[^a-z0-9]", ""))
    at = F.array_position(low, term)
    start = F.greatest(F.lit(1), at.cast("int") - width // 2)
    cut = F.transform(F.slice(w, start, width), lambda x: F.when(F.regexp_replace(F.lower(x), "[^a-z0-9]", "") == term, F.concat(F.lit("["), x, F.lit("]"))).otherwise(x))
    return F.when(at > 0, F.concat(F.when(start > 1, F.lit("… ")).otherwise(""), F.array_join(cut, " "), F.when(start + width <= F.size(w), F.lit(" …")).otherwise("")))
