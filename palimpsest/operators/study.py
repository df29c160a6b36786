"""Filters, ranking, stemmed index, exclusions, subject trees and study tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from palimpsest.functions import patterns as P, text as T
from palimpsest.functions.stemming import plain_word, porter, stem
from palimpsest.operators import vectors as V


# ---- filters, orders, totals

class Contradiction(ValueError):
    """Filters that nothing can satisfy."""


def record_filter(docs: DataFrame, disciplines: list[str] = (), subfields: list[str] = (), years: tuple[int | None, int | None] = (None, None), not_years: list[int] = (), words: tuple[int | None, int | None] = (None, None), creator: str | None = None, repo: str | None = None, status: str | None = None) -> DataFrame:
    """Records that meet every filter given; contradictory ones are an error, not an empty result."""
    for name, (lo, hi) in (("year", years), ("words", words)):
        if lo is not None and hi is not None and lo > hi:
            raise Contradiction(f"{name} from {lo} to {hi}")
    if None not in years and all(y in not_years for y in range(years[0], years[1] + 1)):
        raise Contradiction("all years of the range are left out")
    tests: list[Column] = []
    low = lambda c: F.lower(F.trim(c))
    tests += [low("discipline").isin(*[x.strip().lower() for x in disciplines])] if disciplines else []
    tests += [low("subfield").isin(*[x.strip().lower() for x in subfields])] if subfields else []
    for c, (lo, hi) in (("year", years), ("words", words)):
        tests += [F.col(c) >= lo] if lo is not None else []
        tests += [F.col(c) <= hi] if hi is not None else []
    tests += [~F.col("year").isin(*not_years)] if not_years else []
    tests += [F.lower("creator").contains(creator.lower())] if creator else []
    tests += [F.col("repo") == repo] if repo is not None else []
    tests += [F.col("status") == status] if status is not None else []
    return docs.where(reduce(lambda a, b: a & b, tests)) if tests else docs


ORDERS = {
    "year": lambda k: [F.desc_nulls_last("year"), k], "oldest": lambda k: [F.asc_nulls_last("year"), k], "words": lambda k: [F.desc_nulls_last("words"), k],
    "title": lambda k: [F.asc_nulls_last("title"), k], "id": lambda k: [k], "relevance": lambda k: ["score", k],
}


def ordered(found: DataFrame, order: str, key: str, limit: int) -> DataFrame:
    """The first ``limit`` records in one of the six orders, with ``place``; relevance needs a score. A limit of 0 gives none (see ``totals``)."""
    if order not in ORDERS:
        raise ValueError(f"unknown order {order!r}, one of {sorted(ORDERS)}")
    if order == "relevance" and "score" not in found.columns:
        raise ValueError("no query, no relevance")
    by = ORDERS[order](key)
    return found.orderBy(*by).limit(limit).withColumn("place", F.row_number().over(Window.orderBy(*by)))


def totals(found: DataFrame) -> DataFrame:
    """(total, first_year, last_year, words) of what a search finds, without a row of it."""
    return found.agg(F.count("*").alias("total"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.coalesce(F.sum("words"), F.lit(0)).alias("words"))


# ---- stemmed index

def _words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0))


def stemmed_postings(docs: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(field, term, key, pos): words without diacritics, stemmed; every distinct word is stemmed once."""
    parts = reduce(DataFrame.unionByName, [docs.select(F.lit(f).alias("field"), F.col(key), F.posexplode(_words(F.col(f))).alias("pos", "word")) for f in fields])
    known = parts.select("word").distinct().withColumn("term", stem("word"))
    return parts.join(known, "word").select("field", "term", key, "pos")


def stemmed_search(postings: DataFrame, key: str, items: list[tuple[str, str | None, str, bool]]) -> DataFrame:
    """Keys a parsed query (see ``search.parse_query``) selects, over postings: phrases by adjoining places, prefixes by the beginning of a term.

    Only postings of the query's terms are read; a query without any inclusion is an error of the parser.
    """
    def hits(field: str | None, text: str, prefix: bool) -> DataFrame:
        p = postings if field is None else postings.where(F.col("field") == field)
        words = [plain_word(w) for w in text.split()]
        if prefix and len(words) == 1:
            return p.where(F.col("term").startswith(words[0])).select(key).distinct()
        terms = [porter(w) for w in words]
        at = [p.where(F.col("term") == t).select(key, "field", (F.col("pos") - i).alias("start")) for i, t in enumerate(terms)]
        return reduce(lambda a, b: a.join(b, [key, "field", "start"], "left_semi"), at).select(key).distinct()

    groups: list[tuple[str, DataFrame]] = []
    for conn, field, text, prefix in items:
        h = hits(field, text, prefix)
        if conn == "OR" and groups:
            groups[-1] = (groups[-1][0], groups[-1][1].unionByName(h).distinct())
        else:
            groups.append((conn, h))
    out = groups[0][1]
    for conn, h in groups[1:]:
        out = out.join(h, key, "left_anti" if conn == "NOT" else "left_semi")
    return out


# ---- sentences

def exclusions(sentences: DataFrame, page: str = "page") -> DataFrame:
    """(doc_id, idx, excl): every reason to leave a row out: references (by heading, or on a page dense with entries), caption, boilerplate (heading or sentence)."""
    x = sentences.where(F.col("doc_id").isNotNull() & F.col("idx").isNotNull()).groupBy("doc_id", "idx").agg(F.min(F.struct(F.coalesce("text", F.lit("")).alias("text"), page, "heading")).alias("m")).select("doc_id", "idx", "m.*")
    long = F.length("text") > 15
    w = Window.partitionBy("doc_id", page)
    rows, entries = F.sum(long.cast("int")).over(w), F.sum((long & F.col("text").rlike(P.FLAGS["ref_entry"])).cast("int")).over(w)
    dense = F.col(page).isNotNull() & (rows >= 6) & (entries >= 0.35 * rows)
    head = F.coalesce("heading", F.lit(""))
    why = F.array_compact(F.array(
        F.when(head.rlike(P.REFERENCE_HEADING) | dense, "references"), F.when(F.col("text").rlike(P.FLAGS["caption"]), "caption"),
        F.when(head.rlike(P.BOILERPLATE_HEADING) | F.col("text").rlike(P.FLAGS["boilerplate"]), "boilerplate"),
    ))
    return x.select("doc_id", "idx", why.alias("excl"))


# ---- neighbours by shared references

def shared_references(pairs: DataFrame, cites: DataFrame) -> DataFrame:
    """(q, h, shared, jaccard) of record pairs: works both cite, against the works either cites; 0 where nothing is known."""
    w = cites.select("src", "surname", "year").distinct()
    n = w.groupBy("src").agg(F.count("*").alias("n"))
    both = pairs.join(w.withColumnRenamed("src", "q"), "q").join(w.withColumnRenamed("src", "h"), ["h", "surname", "year"]).groupBy("q", "h").agg(F.count("*").alias("shared"))
    x = pairs.join(both, ["q", "h"], "left").join(n.select(F.col("src").alias("q"), F.col("n").alias("nq")), "q", "left").join(n.select(F.col("src").alias("h"), F.col("n").alias("nh")), "h", "left").fillna(0, ["shared", "nq", "nh"])
    return x.withColumn("jaccard", F.col("shared") / F.greatest(F.col("nq") + F.col("nh") - F.col("shared"), F.lit(1))).drop("nq", "nh")


def neighbour_scores(shared: DataFrame, by: list[str]) -> DataFrame:
    """Mean shared references, shares of pairs with one and with three or more, mean Jaccard."""
    rate = lambda c: F.round(F.avg(c.cast("double")), 6)
    return shared.groupBy(*by).agg(F.count("*").alias("pairs"), F.round(F.avg("shared"), 6).alias("mean_shared"), rate(F.col("shared") >= 1).alias("one_or_more"), rate(F.col("shared") >= 3).alias("three_or_more"), F.round(F.avg("jaccard"), 6).alias("mean_jaccard"))


def unrelated(sample: DataFrame, pool: DataFrame, top: int = 10) -> DataFrame:
    """(q, h): for the i-th query the pool's records at places (7919 i + 1327 j) mod n, j = 1 to ``top``: neighbours chosen by nothing; a query is no neighbour of itself.

    ``sample`` is (i, q), ``pool`` is (place, h), both numbered from 0.
    """
    n = pool.count()
    x = sample.withColumn("j", F.explode(F.sequence(F.lit(1), F.lit(top)))).withColumn("place", F.pmod(F.col("i") * 7919 + F.col("j") * 1327, F.lit(max(n, 1))))
    return x.join(pool, "place").where(F.col("q") != F.col("h")).select("q", "h")


# ---- subject trees

def tree(vecs: DataFrame, key: str, vec: str, split: int = 90, depth: int = 2, per_child: int = 110, least: int = 25) -> DataFrame:
    """(key, node): node path of every record in a tree of spherical k-means, level by level.

    A node of at least ``split`` records is cut in max(2, min(8, round(n / per_child))) clusters; children of fewer than
    ``least`` records stay with their parent, and a cut that leaves fewer than two is dropped.  Paths are "", "0", "0.1" ...
    """
    at = vecs.select(F.col(key).alias("key"), F.col(vec).alias("v")).where(F.col("v").isNotNull()).withColumn("node", F.lit("0"))
    open_nodes = ["0"]
    for _ in range(depth):
        sizes = {r["node"]: r["n"] for r in at.where(F.col("node").isin(*open_nodes)).groupBy("node").agg(F.count("*").alias("n")).collect()}  # at most 8 ** depth nodes
        moved, open_nodes = [], []
        for node in sorted(n for n, k in sizes.items() if k >= split):
            k = max(2, min(8, round(sizes[node] / per_child)))
            got = V.spherical_kmeans(at.where(F.col("node") == node), "key", "v", k)
            big = sorted(r["cluster"] for r in got.groupBy("cluster").agg(F.count("*").alias("n")).where(F.col("n") >= least).collect())
            if len(big) < 2:
                continue
            names = {c: f"{node}.{i}" for i, c in enumerate(big)}
            name = reduce(lambda e, c: F.when(F.col("cluster") == c, F.lit(names[c])).otherwise(e), big, F.lit(node))
            moved.append(got.select("key", name.alias("to")))
            open_nodes += list(names.values())
        if not moved:
            break
        at = at.join(reduce(DataFrame.unionByName, moved), "key", "left").withColumn("node", F.coalesce("to", "node")).drop("to")
    return at.select(F.col("key").alias(key), "node")


def ancestors(node: Column) -> Column:
    """A node path and all above it."""
    parts = F.split(node, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))


def node_works(placed: DataFrame, cites: DataFrame) -> DataFrame:
    """(node, records, works, citations): works of a node are those of all records in it and below, each once."""
    x = placed.select("src", F.explode(ancestors(F.col("node"))).alias("node"))
    n = x.groupBy("node").agg(F.count_distinct("src").alias("records"))
    w = x.join(cites.select("src", "surname", "year").distinct(), "src").groupBy("node", "surname", "year").agg(F.count("*").alias("c"))
    return n.join(w.groupBy("node").agg(F.count("*").alias("works"), F.sum("c").alias("citations")), "node", "left").fillna(0, ["works", "citations"])


def exemplars(placed: DataFrame, docs: DataFrame, most: int = 8) -> DataFrame:
    """(node, src, words, place): the longest records of each node; those without a page to show drop out after the limit."""
    x = placed.join(docs, "src")
    w = Window.partitionBy("node").orderBy(F.desc_nulls_last("words"), "src")
    return x.withColumn("place", F.row_number().over(w)).where((F.col("place") <= most) & (F.coalesce("url", F.lit("")) != "")).select("node", "src", "words", "place")


def subfield_count(n: int) -> int:
    """Clusters of a discipline of n records: one for about 260, three to fourteen."""
    return max(3, min(14, round(n / 260)))


def label_scores(in_node: DataFrame, in_parent: DataFrame, n: Column, parent_n: Column, least_share: float = 0.07) -> DataFrame:
    """(node, term, score) of terms in at least max(3, 7 %) of a node's titles: share in the node over the share in its parent, damped; ``in_node`` is (node, parent, term, v), ``in_parent`` (parent, term, pv)."""
    x = in_node.join(in_parent, ["parent", "term"]).where(F.col("v") >= F.greatest(F.lit(3.0), least_share * n))
    return x.withColumn("score", (F.col("v") / n) / (F.col("pv") / parent_n + 0.004))


# ---- lexicon, methods, bridges

def matched_terms(docs: DataFrame, key: str, fields: list[str], lexicon: dict[str, tuple[list[str], list[str]]]) -> DataFrame:
    """(key, label, terms): which terms of a lexicon a record holds in any field, for every label with one."""
    rx = lambda t: rf"(?i)\b{t[:-1]}" if t.endswith("*") else rf"(?i)\b{t}[a-z0-9_]{{0,2}}\b"
    text = F.concat_ws(" . ", *fields)
    hits = F.array(*[F.struct(F.lit(k).alias("label"), F.array_compact(F.array(*[F.when(text.rlike(rx(t)), F.lit(t)) for t in [*strong, *weak]])).alias("terms")) for k, (strong, weak) in lexicon.items()])
    return docs.select(key, F.explode(hits).alias("x")).select(key, "x.label", "x.terms").where(F.size("terms") > 0)


def bipartite(members: DataFrame, used: DataFrame, least: float = 0.02) -> DataFrame:
    """(group, label, weight): edges between groups and labels used by at least ``least`` of a group's records, in per cent; ``members`` is (src, group), ``used`` (src, label)."""
    n = members.groupBy("group").agg(F.count_distinct("src").alias("n"))
    k = members.join(used, "src").groupBy("group", "label").agg(F.count_distinct("src").alias("k"))
    return k.join(n, "group").where(F.col("k") / F.col("n") >= least).select("group", "label", F.round(100 * F.col("k") / F.col("n"), 1).alias("weight"))


def label_mix(labelled: DataFrame, by: list[str]) -> DataFrame:
    """(by, label, n, share): mix of labels in each group; ``labelled`` has by and label."""
    w = Window.partitionBy(*by) if by else Window.partitionBy()
    return labelled.groupBy(*by, "label").agg(F.count("*").alias("n")).withColumn("share", F.round(F.col("n") / F.sum("n").over(w), 6))


def pair_label_share(work_fields: DataFrame, label: str, least: int = 40) -> DataFrame:
    """(f, g, n, share): of the works two fields have in common, how many bear ``label``; ``work_fields`` is (work, label, fields), fields at most a few dozen."""
    fs = F.array_sort("fields")
    pairs = F.flatten(F.transform(fs, lambda x, i: F.transform(F.slice(fs, i + 2, F.size(fs)), lambda y: F.struct(x.alias("f"), y.alias("g")))))
    x = work_fields.select("label", F.explode(pairs).alias("p")).select("label", "p.f", "p.g")
    return x.groupBy("f", "g").agg(F.count("*").alias("n"), F.round(F.avg((F.col("label") == label).cast("double")), 6).alias("share")).where(F.col("n") >= least)
