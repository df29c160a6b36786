"""Queries of filters, ranking, stemmed search, exclusions, shared references, trees and study tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from palimpsest.functions import text as T
from palimpsest.operators import features as X, graph as G, search as R, study as Y, vectors as V
from palimpsest.operators.features_queries import _DISC, _METH, LABELS, LEXICON, SHORT
from palimpsest.operators.graph_queries import _E, _docs, _edges, _fields
from palimpsest.operators.text_queries import _sq
from palimpsest.plans.runtime import cut, table


def txt_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of whole texts, numbered."""
    x = table(spark, d, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("k", "sentence"))
    return x.select("doc_id", (F.col("k") + 1).alias("k"), "sentence")


def txt_labels(spark: SparkSession, d: str) -> DataFrame:
    """Keys, numbers and literals of records as text."""
    x = table(spark, d, "docs")
    return x.select(
        "docid", T.document_key(F.col("id")).alias("key"), T.archive_number(F.col("id")).alias("number"), T.number_text(F.col("discipline_conf")).alias("conf"), T.ordinal(F.col("docid")).alias("nth"), T.plural(F.col("pages"), "page").alias("pages"),
        T.like_literal(F.col("title")).alias("like_title"), T.markdown_literal(F.col("title")).alias("md_title"), T.html_literal(F.col("title")).alias("html_title"),
    )


def txt_boilerplate_headings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sentences").select("heading").distinct().where("heading is not null").select("heading", T.heading_boilerplate(F.col("heading")).cast("int").alias("boilerplate"))


def flt_exclusions(spark: SparkSession, d: str) -> DataFrame:
    """Rows per reason of exclusion."""
    return Y.exclusions(table(spark, d, "sentences")).select("doc_id", F.explode("excl").alias("reason")).groupBy("doc_id", "reason").agg(F.count("*").alias("n"))


def flt_citations_usable(spark: SparkSession, d: str) -> DataFrame:
    """Citations per year whose normalised title is long enough to tell a work."""
    t = table(spark, d, "cite").select("year", T.norm_title(F.col("title")).alias("t"))
    return t.where((F.col("t") != "") & (F.length("t") > 12)).groupBy("year").agg(F.count("*").alias("n"), F.count_if(F.length("t") > 14).alias("n_longer"))


def flt_parameters(spark: SparkSession, d: str) -> DataFrame:
    return Y.record_filter(table(spark, d, "docs"), disciplines=["law", "medicine"], years=(1995, 2018), not_years=[2001], words=(100, None), status="ok").select("docid", "year", "words")


def _found(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "docs")
    return R.bm25(x, "docid", ["labour", "markets"]).join(x.select("docid", "title", "year", "words"), "docid")


def fts_join_docs(spark: SparkSession, d: str) -> DataFrame:
    """Hits of a search with their records, by relevance."""
    return Y.ordered(_found(spark, d), "relevance", "docid", 15).select("docid", "title", "score", "place")


def top_orders(spark: SparkSession, d: str) -> DataFrame:
    """The first ten records in each order that needs no query."""
    x = table(spark, d, "docs").select("docid", "title", "year", "words")
    out = None
    for o in sorted(set(Y.ORDERS) - {"relevance"}):
        part = Y.ordered(x, o, "docid", 10).select(F.lit(o).alias("ordering"), "place", "docid")
        out = part if out is None else out.unionByName(part)
    return out


def top_totals(spark: SparkSession, d: str) -> DataFrame:
    return Y.totals(_found(spark, d))


def fts_stemmed(spark: SparkSession, d: str) -> DataFrame:
    """Uses of every stem, words without diacritics."""
    p = Y.stemmed_postings(table(spark, d, "docs"), "docid", ["title", "abstract"])
    return p.groupBy("field", "term").agg(F.count_distinct("docid").alias("df"), F.count("*").alias("uses"))


def fts_stemmed_boolean(spark: SparkSession, d: str) -> DataFrame:
    """A boolean query over stemmed postings: a phrase, a prefix of a field, an exclusion."""
    x = table(spark, d, "docs")
    p = cut(Y.stemmed_postings(x, "docid", list(R.FIELDS)), "postings")
    return Y.stemmed_search(p, "docid", R.parse_query('"labour market" OR title:tribunal* -school')).join(x.select("docid", "title"), "docid")


def vec_rank_filtered(spark: SparkSession, d: str) -> DataFrame:
    """Ten nearest of other labels than 3, ids 50 to 450, similarity of at least 0.1, some ids left out."""
    v = table(spark, d, "embeddings")
    return V.rank(v.where(F.col("vec_id") % V.QUERY_STEP == 0), v, "vec_id", "embedding", 10, where=(F.col("label") != 3) & F.col("vec_id").between(50, 450), exclude=[60, 61, 62], least=0.1).select("query", "hit", F.round("sim", 4).alias("sim"), "place")


def vec_encode_long(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of records of several windows: here five neighbouring ids are the windows of one record."""
    v = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 5).alias("rec"), "embedding")
    return V.mean_vectors(v, "rec", "embedding").select("rec", "n", F.round(F.element_at("centre", 1), 5).alias("first"))


def _neighbours(spark: SparkSession, d: str):
    docs = table(spark, d, "docs").select(F.col("docid").alias("vec_id"), "id")
    v = table(spark, d, "embeddings").join(docs, "vec_id")
    q = v.where(F.col("vec_id") % V.QUERY_STEP == 0)
    return docs, q, v


def join_shared_references(spark: SparkSession, d: str) -> DataFrame:
    """Works that theses (numbers divisible by 20) and their nearest by vector both cite."""
    docs, q, v = _neighbours(spark, d)
    near = V.top_k(q, v, "vec_id", "embedding", 10).select("query", "hit")
    p = near.join(docs.select(F.col("vec_id").alias("query"), F.col("id").alias("q")), "query").join(docs.select(F.col("vec_id").alias("hit"), F.col("id").alias("h")), "hit").select("q", "h")
    return Y.shared_references(p, _edges(spark, d)).withColumn("jaccard", F.round("jaccard", 6))


def vec_evaluate_references(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours by vector, plain and calibrated, and neighbours by nothing, judged by shared references."""
    docs, q, v = _neighbours(spark, d)
    e = cut(_edges(spark, d), "edges")
    parts = []
    for name, s in (("plain", 0.0), ("calibrated", 0.5)):
        n = V.top_k(q, v, "vec_id", "embedding", 10, s).select("query", "hit")
        parts.append(n.join(docs.select(F.col("vec_id").alias("query"), F.col("id").alias("q")), "query").join(docs.select(F.col("vec_id").alias("hit"), F.col("id").alias("h")), "hit").select(F.lit(name).alias("variant"), "q", "h"))
    number = lambda df, c, n: df.select(F.col("id").alias(c)).distinct().withColumn(n, F.row_number().over(Window.orderBy(c)) - 1)
    parts.append(Y.unrelated(number(q, "q", "i"), number(v, "h", "place")).select(F.lit("(unrelated baseline)").alias("variant"), "q", "h"))
    pairs = cut(parts[0].unionByName(parts[1]).unionByName(parts[2]), "judged")
    shared = Y.shared_references(pairs.select("q", "h").distinct(), e)
    return Y.neighbour_scores(pairs.join(shared, ["q", "h"]), ["variant"])


def ml_tree(spark: SparkSession, d: str) -> DataFrame:
    return Y.tree(table(spark, d, "embeddings"), "vec_id", "embedding", least=10)


def _placed(spark: SparkSession, d: str) -> DataFrame:
    """Theses at (discipline, repository): a given tree of two levels."""
    x = table(spark, d, "docs").where("discipline <> '' and repo <> ''")
    return x.select(F.col("id").alias("src"), F.concat_ws(".", F.regexp_replace(F.lower(F.trim("discipline")), r"\.", ""), F.regexp_replace("repo", r"\.", "")).alias("node"))


def set_node_works(spark: SparkSession, d: str) -> DataFrame:
    return Y.node_works(_placed(spark, d), _edges(spark, d))


def top_node_exemplars(spark: SparkSession, d: str) -> DataFrame:
    return Y.exemplars(_placed(spark, d), table(spark, d, "docs").select(F.col("id").alias("src"), "words", "url"))


def ml_subfields(spark: SparkSession, d: str) -> DataFrame:
    """Records and number of clusters of each discipline that is large enough to be divided."""
    n = table(spark, d, "docs").where("discipline <> ''").groupBy(F.lower(F.trim("discipline")).alias("discipline")).agg(F.count("*").alias("n")).where("n >= 12")
    return n.withColumn("k", F.greatest(F.lit(3), F.least(F.lit(14), F.bround(F.col("n") / 260).cast("int"))))


def ml_matched_terms(spark: SparkSession, d: str) -> DataFrame:
    x = Y.matched_terms(table(spark, d, "docs"), "docid", ["title", "abstract"], LEXICON)
    return x.select("docid", "label", F.array_join("terms", ";").alias("terms"))


def graph_methods(spark: SparkSession, d: str) -> DataFrame:
    """Disciplines and the methods at least 2 % of their theses use."""
    m = X.method_features(table(spark, d, "sentences"), LABELS, ["method"], 5).where("n > 0").select(F.col("doc_id").alias("src"), "label")
    return Y.bipartite(_fields(spark, d).withColumnRenamed("field", "group"), m).withColumnRenamed("group", "field")


def agg_method_periods(spark: SparkSession, d: str) -> DataFrame:
    """Prevalence of each method by five-year period of at least twenty theses."""
    docs = _docs(spark, d).select(F.col("id").alias("doc_id"), (F.floor(F.col("year") / 5) * 5).alias("period"))
    m = X.method_features(table(spark, d, "sentences"), LABELS, ["method"], 5).join(docs, "doc_id").where("period is not null")
    return m.groupBy("label", "period").agg(F.count("*").alias("theses"), F.round(F.avg((F.col("n") > 0).cast("double")), 6).alias("prevalence")).where("theses >= 20")


def agg_discourse_fields(spark: SparkSession, d: str) -> DataFrame:
    """Style of each discipline of at least twenty theses."""
    x = X.discourse(table(spark, d, "sentences"), SHORT).join(_fields(spark, d).withColumnRenamed("src", "doc_id"), "doc_id")
    mean = lambda c: F.round(F.avg(c), 4).alias(c)
    return x.groupBy("field").agg(F.count("*").alias("n"), *[mean(c) for c in ("mean_sentence_len", "lexical_density", "flesch", "hedges_per1k", "boosters_per1k", "passive_per1k", "nominal_per1k")]).where("n >= 20")


def agg_corpus_tables(spark: SparkSession, d: str) -> DataFrame:
    """Theses and words by status, discipline, decade, route and verdict of the pairs they are in, each with its null group."""
    x = _docs(spark, d)
    parts = []
    for what, c in (("status", F.coalesce("status", F.lit("(none)"))), ("discipline", F.coalesce(F.nullif(F.lower(F.trim("discipline")), F.lit("")), F.lit("(none)"))), ("decade", F.coalesce(F.expr("string(year div 10 * 10)"), F.lit("(no year)"))), ("route", F.coalesce("discipline_method", F.lit("(none)")))):
        parts.append(x.groupBy(c.alias("value")).agg(F.count("*").alias("n"), F.coalesce(F.sum("words"), F.lit(0)).alias("words")).select(F.lit(what).alias("what"), "value", "n", "words"))
    p = table(spark, d, "pair").groupBy(F.coalesce("verdict", F.lit("(unjudged)")).alias("value")).agg(F.count("*").alias("n"), F.coalesce(F.sum("matched_words"), F.lit(0)).alias("words"))
    parts.append(p.select(F.lit("verdict").alias("what"), "value", "n", "words"))
    out = parts[0]
    for q in parts[1:]:
        out = out.unionByName(q)
    return out


def age_bands(spark: SparkSession, d: str) -> DataFrame:
    """Citation ages of five-year bands per discipline: edges, theses, median and mean age; bands before 2000 are marked."""
    a = G.age_edges(_edges(spark, d), _docs(spark, d)).where("reason is null").join(_fields(spark, d), "src")
    b = a.groupBy("field", (F.floor(F.col("doc_year") / 5) * 5).alias("band"))
    return b.agg(F.count("*").alias("n"), F.count_distinct("src").alias("theses"), F.percentile("age", F.lit(0.5)).alias("median_age"), F.round(F.avg("age"), 6).alias("mean_age")).withColumn("early", (F.col("band") < 2000).cast("int"))


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    """Works with their fields and a label: here the parity of a work's year stands in for a model's label."""
    fc = G.field_citers(_edges(spark, d), _fields(spark, d))
    g = fc.groupBy("surname", "year").agg(F.collect_set("field").alias("fields"))  # at most as many as there are fields
    return g.withColumn("label", F.when(F.col("year") % 2 == 0, "METHOD").otherwise("THEORY"))


def bridge_label_mix(spark: SparkSession, d: str) -> DataFrame:
    """Mix of labels among works cited in three fields or more, by reach."""
    n = F.size("fields")
    x = _labelled(spark, d).where(n >= 3).withColumn("reach", F.when(n <= 4, "3-4").when(n <= 8, "5-8").otherwise("9-16"))
    return Y.label_mix(x.select("reach", "label"), ["reach"])


def bridge_pair_labels(spark: SparkSession, d: str) -> DataFrame:
    return Y.pair_label_share(_labelled(spark, d).where(F.size("fields") >= 2).select("label", "fields"), "METHOD", 10)


QUERIES = {
    f.__name__: f
    for f in (
        txt_sentences, txt_labels, txt_boilerplate_headings, flt_exclusions, flt_citations_usable, flt_parameters, fts_join_docs, top_orders, top_totals, fts_stemmed, fts_stemmed_boolean, vec_rank_filtered, vec_encode_long, join_shared_references, vec_evaluate_references,
        ml_tree, set_node_works, top_node_exemplars, ml_subfields, ml_matched_terms, graph_methods, agg_method_periods, agg_discourse_fields, agg_corpus_tables, age_bands, bridge_label_mix, bridge_pair_labels,
    )
}

_ABBR = (
    "suppl|messrs|approx|assoc|repr|trans|prof|chaps|paras|ibid|ph\\.d|d\\.phil|b\\.ed|m\\.ed|ed\\.d|b\\.sc|m\\.sc|capt|univ|dept|corp|chap|secs|para|vols|figs|tabs|refs|e\\.g|i\\.e|u\\.s|u\\.k|a\\.m|p\\.m|m\\.a|b\\.a|n\\.d|c\\.f|etc|viz|cit|eds|edn|vol|nos|fig|tab|sec|mrs|rev|hon|gen|inc|ltd|est|min|max|ser|pts|ref|al|cf|vs|ca|op|ed|no|pp|ch|dr|mr|ms|st|jr|sr|co|pt|et|p"
)
_END = "([.!?]+[\"'')\\]’”]*)(\\s+)([\"''(\\[‘“]?[\\p{Lu}\\p{Nd}])"
_CLOSE = "(\\s*[.!?]+[\"'')\\]’”]*)\x01"
_MARKED = f"regexp_replace(regexp_replace(coalesce(text, ''), '{_END}', '\\1\x01\\2\\3', 'g'), '{_END}', '\\1\x01\\2\\3', 'g')"
_KEPT = f"regexp_replace({_MARKED}, '((?:^|[^A-Za-z.])(?:(?i:{_ABBR})|[A-Za-z](?:\\.[A-Za-z])?)){_CLOSE}', '\\1\\2', 'g')"
_LAT = lambda c: f"regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9 ]', ' ', 'g')"
_NT = "array_to_string(list_filter(string_split_regex(" + _LAT("title") + ", ' +'), lambda x: length(x) > 2)[1:8], ' ')"
_V2 = "WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)"
_AGG = lambda c, what: f"SELECT '{what}' AS what, {c} AS value, count(*) AS n, coalesce(sum(words), 0)::BIGINT AS words FROM dl GROUP BY ALL"
_TOKS = "regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9]+')"
_LF = " + ".join(f"len({_TOKS.format(c=f)})" for f in R.FIELDS)
_PF = " UNION ALL ".join(f"SELECT '{f}' AS field, docid, unnest({_TOKS.format(c=f)}) AS term FROM docs" for f in R.FIELDS)
_BM = f"""WITH p AS ({_PF}), l AS (SELECT docid, {_LF} AS len FROM docs), a AS (SELECT count(*) AS n, avg(len) AS avg FROM l),
tf AS (SELECT docid, term, sum(CASE field WHEN 'title' THEN 10.0 WHEN 'creator' THEN 5.0 ELSE 1.0 END)::DOUBLE AS tf FROM p WHERE term IN ('labour', 'markets') GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
h AS (SELECT docid, round(-sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg))), 6) AS score FROM tf JOIN df USING (term) JOIN l USING (docid), a GROUP BY docid HAVING count(*) = 2)"""
_ORD = {"year": "year DESC NULLS LAST, docid", "oldest": "year NULLS LAST, docid", "words": "words DESC NULLS LAST, docid", "title": "title NULLS LAST, docid", "id": "docid"}
_LEX = {"medicine": ["patient*", "disease", "surg*", "health", "clinic*"], "law": ["tribunal", "judicial", "statute", "claim", "appeal"], "software": ["compiler", "database", "software", "network", "code"], "education": ["school*", "teacher", "reading", "college"], "sport": ["sprint", "football", "throws", "training", "crew"]}
_RX = lambda t: f"(?i)\\b{t[:-1]}" if t.endswith("*") else f"(?i)\\b{t}[a-z0-9_]{{0,2}}\\b"
_HIT = lambda t: f"CASE WHEN regexp_matches(concat_ws(' . ', title, abstract), '{_RX(t)}') THEN '{t}' END"
_LB = "WITH lb AS (SELECT surname, year, list_sort(list(field)) AS fields, CASE WHEN year % 2 = 0 THEN 'METHOD' ELSE 'THEORY' END AS label FROM fc GROUP BY surname, year)"
_PLACED = "pl AS (SELECT id AS src, regexp_replace(lower(trim(discipline)), '\\.', '', 'g') AS top, regexp_replace(repo, '\\.', '', 'g') AS sub FROM docs WHERE discipline <> '' AND repo <> ''), nd AS (SELECT src, top AS node FROM pl UNION ALL SELECT src, top || '.' || sub FROM pl)"

ORACLES = {
    "txt_sentences": f"WITH m AS (SELECT doc_id, regexp_replace({_KEPT}, '((?:^|\\s)\\d{{1,3}}){_CLOSE}', '\\1\\2', 'g') AS t FROM documents), s AS (SELECT doc_id, list_filter(list_transform(string_split(t, '\x01'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS s FROM m) SELECT doc_id, generate_subscripts(s, 1) AS k, unnest(s) AS sentence FROM s",
    "txt_labels": """SELECT docid, substr(trim(regexp_replace(lower(coalesce(id, '')), '[^a-z0-9]+', ' ', 'g')), 1, 40) || '-' || substr(sha256(coalesce(id, '')), 1, 8) AS key, coalesce(regexp_extract(id, '^oai:[^:]+:(\\d+)$', 1), '') AS number, CASE WHEN discipline_conf IS NULL OR isnan(discipline_conf) THEN '' ELSE format('{:.10g}', discipline_conf) END AS conf,
 docid || CASE WHEN docid % 100 BETWEEN 11 AND 13 THEN 'th' WHEN docid % 10 = 1 THEN 'st' WHEN docid % 10 = 2 THEN 'nd' WHEN docid % 10 = 3 THEN 'rd' ELSE 'th' END AS nth, pages || CASE WHEN pages = 1 THEN ' page' ELSE ' pages' END AS pages, replace(replace(replace(title, '\\', '\\\\'), '%', '\\%'), '_', '\\_') AS like_title,
 regexp_replace(replace(coalesce(title, ''), '|', '\\|'), '[\\r\\n]+', ' ', 'g') AS md_title, replace(replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS html_title FROM docs""",
    "flt_citations_usable": f"SELECT year, count(*) AS n, count(*) FILTER (length(t) > 14) AS n_longer FROM (SELECT year, {_NT} AS t FROM cite) WHERE length(t) > 12 GROUP BY year",
    "flt_parameters": "SELECT docid, year, words FROM docs WHERE lower(trim(discipline)) IN ('law', 'medicine') AND year BETWEEN 1995 AND 2018 AND year <> 2001 AND words >= 100 AND status = 'ok'",
    "fts_join_docs": _BM + " SELECT docid, title, score, row_number() OVER (ORDER BY score, docid) AS place FROM h JOIN docs USING (docid) QUALIFY place <= 15",
    "top_totals": _BM + " SELECT count(*) AS total, min(year) AS first_year, max(year) AS last_year, coalesce(sum(words), 0)::BIGINT AS words FROM h JOIN docs USING (docid)",
    "top_orders": " UNION ALL ".join(f"SELECT '{n}' AS ordering, place, docid FROM (SELECT docid, row_number() OVER (ORDER BY {o}) AS place FROM docs) WHERE place <= 10" for n, o in _ORD.items()),
    "vec_rank_filtered": _V2 + ", s AS (SELECT a.vec_id AS query, b.vec_id AS hit, list_dot_product(a.e, b.e) AS sim FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 AND b.label <> 3 AND b.vec_id BETWEEN 50 AND 450 AND b.vec_id NOT IN (60, 61, 62)), t AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(sim, 6) DESC, hit) AS place FROM s) SELECT query, hit, round(round(sim, 6), 4) AS sim, place FROM t WHERE place <= 10 AND round(sim, 6) >= 0.1",
    "join_shared_references": _E + """, v AS (SELECT vec_id, embedding::DOUBLE[] AS e, id FROM embeddings JOIN docs ON docid = vec_id), s AS (SELECT a.id AS q, b.id AS h, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_dot_product(a.e, b.e), 6) DESC, b.vec_id) AS place FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
 n AS (SELECT src, count(*) AS n FROM e GROUP BY 1), sh AS (SELECT q, h, count(*) AS shared FROM s JOIN e x ON x.src = q JOIN e y ON y.src = h AND y.surname = x.surname AND y.year = x.year WHERE place <= 10 GROUP BY ALL)
 SELECT q, h, coalesce(shared, 0) AS shared, round(coalesce(shared, 0) / greatest(coalesce(a.n, 0) + coalesce(b.n, 0) - coalesce(shared, 0), 1), 6) AS jaccard FROM s LEFT JOIN sh USING (q, h) LEFT JOIN n a ON a.src = q LEFT JOIN n b ON b.src = h WHERE place <= 10""",
    "set_node_works": _E + f", {_PLACED}, w AS (SELECT node, surname, year, count(*) AS c FROM nd JOIN e USING (src) GROUP BY ALL), n AS (SELECT node, count(DISTINCT src) AS records FROM nd GROUP BY 1) SELECT node, any_value(records) AS records, count(c) AS works, coalesce(sum(c), 0)::BIGINT AS citations FROM n LEFT JOIN w USING (node) GROUP BY node",
    "top_node_exemplars": "WITH x AS (SELECT regexp_replace(lower(trim(discipline)), '\\.', '', 'g') || '.' || regexp_replace(repo, '\\.', '', 'g') AS node, id AS src, words, url FROM docs WHERE discipline <> '' AND repo <> ''), r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY words DESC NULLS LAST, src) AS place FROM x) SELECT node, src, words, place FROM r WHERE place <= 8 AND coalesce(url, '') <> ''",
    "ml_subfields": "SELECT lower(trim(discipline)) AS discipline, count(*) AS n, greatest(3, least(14, round_even(count(*) / 260, 0)::INT)) AS k FROM docs WHERE discipline <> '' GROUP BY 1 HAVING count(*) >= 12",
    "ml_matched_terms": " UNION ALL ".join(f"SELECT * FROM (SELECT docid, '{k}' AS label, concat_ws(';', {', '.join(_HIT(t) for t in ts)}) AS terms FROM docs) WHERE terms <> ''" for k, ts in _LEX.items()),
    "agg_corpus_tables": _E + " " + " UNION ALL ".join([_AGG("coalesce(status, '(none)')", "status"), _AGG("coalesce(nullif(lower(trim(discipline)), ''), '(none)')", "discipline"), _AGG("coalesce((year // 10 * 10)::VARCHAR, '(no year)')", "decade"), _AGG("coalesce(discipline_method, '(none)')", "route")]) + " UNION ALL SELECT 'verdict', coalesce(verdict, '(unjudged)'), count(*), coalesce(sum(matched_words), 0)::BIGINT FROM pair GROUP BY ALL",
    "age_bands": _E + " SELECT field, doc_year // 5 * 5 AS band, count(*) AS n, count(DISTINCT src) AS theses, median(age) AS median_age, round(avg(age), 6) AS mean_age, (doc_year // 5 * 5 < 2000)::INT AS early FROM ag JOIN fl USING (src) WHERE reason IS NULL GROUP BY field, doc_year // 5 * 5",
    "bridge_label_mix": _E + _LB.replace("WITH lb", ", lb") + ", r AS (SELECT label, CASE WHEN len(fields) <= 4 THEN '3-4' WHEN len(fields) <= 8 THEN '5-8' ELSE '9-16' END AS reach FROM lb WHERE len(fields) >= 3) SELECT reach, label, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY reach), 6) AS share FROM r GROUP BY reach, label",
    "bridge_pair_labels": _E + _LB.replace("WITH lb", ", lb") + " SELECT x.field AS f, y.field AS g, count(*) AS n, round(avg((x.year % 2 = 0)::INT), 6) AS share FROM fc x JOIN fc y ON x.surname = y.surname AND x.year = y.year AND x.field < y.field GROUP BY ALL HAVING count(*) >= 10",
    "flt_exclusions": r"""WITH s AS (SELECT doc_id, idx, (min({'t': coalesce(text, ''), 'p': page, 'h': heading})) AS m FROM sentences WHERE doc_id IS NOT NULL AND idx IS NOT NULL GROUP BY ALL), x AS (SELECT doc_id, m.t AS text, m.p AS page, coalesce(m.h, '') AS heading FROM s),
 e AS (SELECT *, length(text) > 15 AS long, regexp_matches(text, '^["''\(]?[A-Z][A-Za-z''’\-]{1,}\s*,\s*[A-Z]\.|^[A-Z][A-Za-z''’\-]{1,}\s*,\s*[A-Z][a-z]+\s*(?:\(|,)|\(\s*(?:19|20)\d{2}[a-z]?\s*\)') AS entry FROM x),
 d AS (SELECT *, page IS NOT NULL AND count(*) FILTER (long) OVER w >= 6 AND count(*) FILTER (long AND entry) OVER w >= 0.35 * count(*) FILTER (long) OVER w AS dense FROM e WINDOW w AS (PARTITION BY doc_id, page)),
 r AS (SELECT doc_id, 'references' AS reason FROM d WHERE dense OR regexp_matches(heading, '(?i)^\s*(?:\d{1,2}[\.\)]?\s*)?(references?|bibliography|reference list|works cited|list of references)\s*:?\s*$')
 UNION ALL SELECT doc_id, 'caption' FROM d WHERE regexp_matches(text, '(?i)^\s*(table|figure|fig\.?|chart|graph|diagram|box|plate|exhibit|image|map)\s*\.?\s*\d+([\.\-:]\d+)?\b|^\s*(source|notes?|key)\s*:')
 UNION ALL SELECT doc_id, 'boilerplate' FROM d WHERE regexp_matches(heading, '(?i)(declaration|acknowledgement|acknowledgment|dedication|copyright|statement of originality|intellectual property|table of contents|^\s*contents\s*$|list of (?:tables|figures|abbreviations|appendices|acronyms)|^\s*abbreviations\s*$|glossary|ethics statement|ethical approval|statement of ethics|ethical clearance|ethics form)') OR regexp_matches(text, '(?i)(i\s+(?:hereby\s+)?(?:declare|certify|confirm)\s+that|has not been submitted (?:in whole or in part )?(?:for|to)|in (?:partial )?fulfil?ment of the requirements? for the (?:degree|award)|submitted in accordance with the requirements|no portion of the work referred to|ethical approval (?:was|has been) (?:granted|obtained|sought)|approved by the (?:university )?(?:research )?ethics committee|copyright rests with the author|this (?:thesis|copy) has been supplied on condition)'))
 SELECT doc_id, reason, count(*) AS n FROM r GROUP BY ALL""",
    "txt_boilerplate_headings": r"SELECT DISTINCT heading, regexp_matches(heading, '(?i)(declaration|acknowledgement|acknowledgment|dedication|copyright|statement of originality|intellectual property|table of contents|^\s*contents\s*$|list of (?:tables|figures|abbreviations|appendices|acronyms)|^\s*abbreviations\s*$|glossary|ethics statement|ethical approval|statement of ethics|ethical clearance|ethics form)')::INT AS boilerplate FROM sentences WHERE heading IS NOT NULL",
}
_FL = "fl AS (SELECT id AS src, lower(trim(discipline)) AS field FROM docs WHERE trim(discipline) <> '' AND lower(trim(discipline)) <> 'unknown')"
_DL = "dl AS (SELECT * FROM doc WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY coalesce(harvested_at, TIMESTAMP '1970-01-01') DESC, coalesce(title, '') DESC) = 1)"
ORACLES |= {
    "graph_methods": _METH + f", {_FL}, n AS (SELECT field, count(DISTINCT src) AS n FROM fl GROUP BY 1), kk AS (SELECT field, label, count(DISTINCT src) AS k FROM fl JOIN mf ON mf.doc_id = fl.src WHERE n > 0 GROUP BY ALL) SELECT field, label, round(100 * k / n, 1) AS weight FROM kk JOIN n USING (field) WHERE k / n >= 0.02",
    "agg_method_periods": _METH + f", {_DL} SELECT label, year // 5 * 5 AS period, count(*) AS theses, round(avg((n > 0)::INT), 6) AS prevalence FROM mf JOIN dl ON dl.id = mf.doc_id WHERE year IS NOT NULL GROUP BY ALL HAVING count(*) >= 20",
    "agg_discourse_fields": _DISC + f", {_FL} SELECT field, count(*) AS n, " + ", ".join(f"round(avg({c}), 4) AS {c}" for c in ("mean_sentence_len", "lexical_density", "flesch", "hedges_per1k", "boosters_per1k", "passive_per1k", "nominal_per1k")) + " FROM disc JOIN fl ON fl.src = disc.doc_id GROUP BY field HAVING count(*) >= 20",
    "vec_encode_long": "WITH x AS (SELECT vec_id // 5 AS rec, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT rec, i, avg(x) AS x FROM x GROUP BY ALL), n AS (SELECT rec, sqrt(sum(x * x)) AS norm FROM m GROUP BY rec), c AS (SELECT vec_id // 5 AS rec, count(*) AS n FROM embeddings GROUP BY 1) SELECT rec, c.n AS n, round(x / norm, 5) AS first FROM m JOIN n USING (rec) JOIN c USING (rec) WHERE i = 1",
}
