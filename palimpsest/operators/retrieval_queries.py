"""Vector and search queries over embeddings and docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from palimpsest.operators import search as S, vectors as V
from palimpsest.plans.runtime import table


def _q(v: DataFrame) -> DataFrame:
    return v.where(F.col("vec_id") % V.QUERY_STEP == 0)


def vec_topk(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    return V.top_k(_q(v), v, "vec_id", "embedding", 10).select("query", "hit", F.round("sim", 4).alias("sim"), "place")


def vec_calibrated_topk(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    return V.top_k(_q(v), v, "vec_id", "embedding", 10, 0.5).select("query", "hit", F.round("adj", 4).alias("adj"), "place")


def vec_infer_home(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    return V.infer_home(V.top_k(_q(v), v, "vec_id", "embedding", 25), v.select(F.col("vec_id").alias("hit"), "label"))


def vec_pairs_threshold(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    return V.threshold_pairs(_q(v), v, "vec_id", "embedding", 0.3)


def vec_compose(spark: SparkSession, d: str) -> DataFrame:
    """Each vector mixed with the next id's as its abstract; the last has none."""
    v = table(spark, d, "embeddings")
    n = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("e2"))
    c = v.join(n, "vec_id", "left").select("vec_id", V.compose(F.col("embedding"), F.col("e2")).alias("c"))
    return c.select("vec_id", F.round(F.element_at("c", 1), 5).alias("first"), F.round(V.dot(F.col("c"), F.col("c")), 5).alias("norm2"))


def vec_mean_by_label(spark: SparkSession, d: str) -> DataFrame:
    return V.mean_vectors(table(spark, d, "embeddings"), "label", "embedding").select("label", "n", F.round(F.element_at("centre", 1), 5).alias("first"), F.round(F.element_at("centre", -1), 5).alias("last"))


def vec_nearest_label(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    x = V.nearest_label(v, "vec_id", "embedding", V.mean_vectors(v, "label", "embedding"), "label", "centre")
    return x.select("vec_id", F.col("label").cast("int").alias("label"), F.round("sim", 4).alias("sim"))


def vec_kmeans(spark: SparkSession, d: str) -> DataFrame:
    return V.spherical_kmeans(table(spark, d, "embeddings"), "vec_id", "embedding", 8)


def vec_evaluate(spark: SparkSession, d: str) -> DataFrame:
    """Share of neighbours with the query's label, plain and calibrated, and of a fixed unrelated pick."""
    v = table(spark, d, "embeddings")
    lab = v.select(F.col("vec_id").alias("hit"), "label")
    ql = v.select(F.col("vec_id").alias("query"), F.col("label").alias("ql"))
    out = None
    for name, s in (("plain", 0.0), ("calibrated", 0.5)):
        x = V.top_k(_q(v), v, "vec_id", "embedding", 10, s).join(lab, "hit").join(ql, "query").agg(F.avg((F.col("label") == F.col("ql")).cast("double")).alias("same_label")).select(F.lit(name).alias("variant"), "same_label")
        out = x if out is None else out.unionByName(x)
    return out


TERMS = ["quantum", "dots"]


def fts_bm25(spark: SparkSession, d: str) -> DataFrame:
    return S.bm25(table(spark, d, "docs"), "docid", TERMS)


def fts_boolean(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "docs")
    return S.boolean(x, "docid", '"labour markets" OR title:tribunal* -creator:vincent').select("docid", "title")


def fts_hidden(spark: SparkSession, d: str) -> DataFrame:
    """Hits shown and hits hidden by their status."""
    x = S.boolean(table(spark, d, "docs"), "docid", "school*")
    return x.agg(F.count_if(F.col("status") == "ok").alias("shown"), F.count_if(F.coalesce("status", F.lit("")) != "ok").alias("hidden"))


def fts_fresh(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "docs").agg(F.count("*").alias("indexed"))
    return a.join(F.broadcast(table(spark, d, "doc").agg(F.count_distinct("id").alias("live")))).withColumn("fresh", F.col("indexed") == F.col("live"))


def fts_resolve(spark: SparkSession, d: str) -> DataFrame:
    vals = spark.createDataFrame([("law",), ("phys",), ("ment",), ("xyzzy",)], "value string")
    return S.resolve(vals, table(spark, d, "subject").select(F.col("subject").alias("word")))


def fts_fragment(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "docs").select("docid", S.fragment(F.col("abstract"), "markets").alias("fragment")).where("fragment is not null")


def fts_postings(spark: SparkSession, d: str) -> DataFrame:
    return S.postings(table(spark, d, "docs"), "docid").groupBy("field", "term").agg(F.count_distinct("docid").alias("df"), F.count("*").alias("uses")).where("df >= 5")


def site_payload(spark: SparkSession, d: str) -> DataFrame:
    """Search payload: repositories and disciplines as numbers of sorted dictionaries."""
    x = table(spark, d, "docs").where(F.col("id").rlike(r"^oai:[^:]+:\d+$"))
    for c in ("repo", "discipline"):
        k = x.select(c).where(F.col(c).isNotNull()).distinct()
        x = x.join(k.withColumn(f"{c}_no", F.row_number().over(Window.orderBy(c)) - 1), c, "left")
    return x.select("docid", "repo_no", "discipline_no", "year")


def top_sorted(spark: SparkSession, d: str) -> DataFrame:
    """First 20 by words, newest of equals first."""
    return table(spark, d, "docs").where("words is not null").orderBy(F.desc("words"), F.desc_nulls_last("year"), "docid").limit(20).select("docid", "words", "year")


def stride_sample(spark: SparkSession, d: str) -> DataFrame:
    """Every n-th record of the ordered ids: twenty-five spread over all."""
    x = table(spark, d, "docs").select("docid")
    n = x.count()
    return x.withColumn("rn", F.row_number().over(Window.orderBy("docid")) - 1).where(F.col("rn") % F.lit(max(1, n // 25)) == 0).where(F.col("rn") < 25 * max(1, n // 25)).select("docid")


QUERIES = {f.__name__: f for f in (vec_topk, vec_calibrated_topk, vec_infer_home, vec_pairs_threshold, vec_compose, vec_mean_by_label, vec_nearest_label, vec_kmeans, vec_evaluate, fts_bm25, fts_boolean, fts_hidden, fts_fresh, fts_resolve, fts_fragment, fts_postings, site_payload, top_sorted, stride_sample)}

_V = "WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT a.vec_id AS query, b.vec_id AS hit, list_dot_product(a.e, b.e) AS sim FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0), t AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(sim, 6) DESC, hit) AS place FROM s)"
_TOKS = "regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9]+')"
_POST = " UNION ALL ".join(f"SELECT '{f}' AS field, docid, unnest({_TOKS.format(c=f)}) AS term FROM docs" for f in S.FIELDS)
_LEN = " + ".join(f"len({_TOKS.format(c=f)})" for f in S.FIELDS)
_PH = lambda f, t: f"contains(' ' || array_to_string({_TOKS.format(c=f)}, ' ') || ' ', ' {t} ')"
_PRE = lambda f, t: f"len(list_filter({_TOKS.format(c=f)}, lambda x: starts_with(x, '{t}'))) > 0"
_ANY = lambda fn, t: "(" + " OR ".join(fn(f, t) for f in S.FIELDS) + ")"
ORACLES = {
    "vec_topk": _V + " SELECT query, hit, round(round(sim, 6), 4) AS sim, place FROM t WHERE place <= 10",
    "vec_calibrated_topk": _V + ", c AS (SELECT b.vec_id AS hit, avg(list_dot_product(a.e, b.e)) AS mu, stddev_pop(list_dot_product(a.e, b.e)) AS sd FROM v a, v b GROUP BY b.vec_id), m AS (SELECT avg(sd) AS msd FROM c), j AS (SELECT query, s.hit, round((sim - mu) / (sqrt(sd) * sqrt(msd)), 6) AS adj FROM s JOIN c USING (hit), m), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY adj DESC, hit) AS place FROM j) SELECT query, hit, round(adj, 4) AS adj, place FROM r WHERE place <= 10",
    "vec_infer_home": _V + ", k AS (SELECT query, v.label, count(*) AS votes FROM t JOIN v ON v.vec_id = t.hit WHERE place <= 25 GROUP BY ALL) SELECT query, label, votes FROM k QUALIFY row_number() OVER (PARTITION BY query ORDER BY votes DESC, label) = 1",
    "vec_pairs_threshold": _V + " SELECT query AS a, hit AS b, round(sim, 4) AS sim FROM s WHERE round(sim, 4) >= 0.3",
    "vec_mean_by_label": "WITH x AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(x::DOUBLE) AS x FROM x GROUP BY ALL), n AS (SELECT label, sqrt(sum(x * x)) AS norm, max(i) AS hi FROM m GROUP BY label) SELECT label, (SELECT count(*) FROM embeddings e WHERE e.label = n.label) AS n, round((SELECT x FROM m WHERE m.label = n.label AND i = 1) / norm, 5) AS first, round((SELECT x FROM m WHERE m.label = n.label AND i = hi) / norm, 5) AS last FROM n",
    "vec_compose": "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), j AS (SELECT a.vec_id, a.e, b.e AS f, CASE WHEN b.e IS NULL THEN a.e ELSE list_transform(list_zip(a.e, b.e), lambda z: 0.25::DOUBLE * z[1] + 0.75::DOUBLE * z[2]) END AS m FROM v a LEFT JOIN v b ON b.vec_id = a.vec_id + 1), n AS (SELECT *, CASE WHEN f IS NULL THEN 1 ELSE sqrt(list_dot_product(m, m)) END AS k FROM j) SELECT vec_id, round(m[1] / k, 5) AS first, round(list_dot_product(m, m) / (k * k), 5) AS norm2 FROM n",
    "fts_bm25": f"WITH p AS ({_POST}), l AS (SELECT docid, {_LEN} AS len FROM docs), a AS (SELECT count(*) AS n, avg(len) AS avg FROM l), tf AS (SELECT docid, term, sum(CASE field WHEN 'title' THEN 10.0 WHEN 'creator' THEN 5.0 ELSE 1.0 END)::DOUBLE AS tf FROM p WHERE term IN ('quantum', 'dots') GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term) SELECT docid, round(-sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg))), 6) AS score FROM tf JOIN df USING (term) JOIN l USING (docid), a GROUP BY docid HAVING count(*) = 2",
    "fts_boolean": f"SELECT docid, title FROM docs WHERE ({_ANY(_PH, 'labour markets')} OR {_PRE('title', 'tribunal')}) AND NOT {_PH('creator', 'vincent')}",
    "fts_hidden": f"SELECT count(*) FILTER (status = 'ok') AS shown, count(*) FILTER (coalesce(status, '') <> 'ok') AS hidden FROM docs WHERE {_ANY(_PRE, 'school')}",
    "fts_fresh": "SELECT (SELECT count(*) FROM docs) AS indexed, (SELECT count(DISTINCT id) FROM doc) AS live, (SELECT count(*) FROM docs) = (SELECT count(DISTINCT id) FROM doc) AS fresh",
    "fts_resolve": "WITH q(value) AS (VALUES ('law'), ('phys'), ('ment'), ('xyzzy')), t AS (SELECT value, lower(subject) AS w, subject, CASE WHEN lower(subject) = value THEN 0 WHEN starts_with(lower(subject), value) THEN 1 WHEN contains(lower(subject), value) THEN 2 END AS tier FROM q, subject), b AS (SELECT value, min(tier) AS best FROM t GROUP BY value) SELECT value, subject AS match, tier FROM t JOIN b USING (value) WHERE tier = best UNION SELECT value, NULL, NULL FROM b WHERE best IS NULL",
    "fts_postings": f"WITH p AS ({_POST}) SELECT field, term, count(DISTINCT docid) AS df, count(*) AS uses FROM p GROUP BY ALL HAVING count(DISTINCT docid) >= 5",
    "site_payload": "WITH r AS (SELECT repo, row_number() OVER (ORDER BY repo) - 1 AS repo_no FROM (SELECT DISTINCT repo FROM docs WHERE repo IS NOT NULL)), f AS (SELECT discipline, row_number() OVER (ORDER BY discipline) - 1 AS discipline_no FROM (SELECT DISTINCT discipline FROM docs WHERE discipline IS NOT NULL)) SELECT docid, repo_no, discipline_no, year FROM docs LEFT JOIN r USING (repo) LEFT JOIN f USING (discipline)",
    "top_sorted": "SELECT docid, words, year FROM docs WHERE words IS NOT NULL ORDER BY words DESC, year DESC NULLS LAST, docid LIMIT 20",
    "stride_sample": "WITH r AS (SELECT docid, row_number() OVER (ORDER BY docid) - 1 AS rn, (SELECT greatest(1, count(*) // 25) FROM docs) AS s FROM docs) SELECT docid FROM r WHERE rn % s = 0 AND rn < 25 * s",
    "vec_nearest_label": "WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS x FROM x GROUP BY ALL), n AS (SELECT label, sqrt(sum(x * x)) AS norm FROM m GROUP BY label), c AS (SELECT label, list(x / norm ORDER BY i) AS c FROM m JOIN n USING (label) GROUP BY label), s AS (SELECT vec_id, c.label, round(list_dot_product(embedding::DOUBLE[], c.c), 6) AS sim FROM embeddings e, c) SELECT vec_id, label::INT AS label, round(sim, 4) AS sim FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, label) = 1",
    "fts_fragment": r"""WITH w AS (SELECT docid, string_split_regex(coalesce(abstract, ''), '\s+') AS w FROM docs), a AS (SELECT docid, w, list_position(list_transform(w, lambda x: regexp_replace(lower(x), '[^a-z0-9]', '', 'g')), 'markets') AS hit FROM w), s AS (SELECT *, greatest(1, hit - 7) AS s FROM a WHERE hit > 0)
 SELECT docid, CASE WHEN s > 1 THEN '… ' ELSE '' END || array_to_string(list_transform(w[s:s + 13], lambda x: CASE WHEN regexp_replace(lower(x), '[^a-z0-9]', '', 'g') = 'markets' THEN '[' || x || ']' ELSE x END), ' ') || CASE WHEN s + 14 <= len(w) THEN ' …' ELSE '' END AS fragment FROM s""",
}
