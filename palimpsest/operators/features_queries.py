"""Feature, classification and statistics queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from palimpsest.operators import features as X
from palimpsest.operators.graph import latest
from palimpsest.operators.text_queries import _sq
from palimpsest.plans.runtime import table

# test theses are short; the operator's default is 2,000 words
SHORT = 150
LABELS = {"case study": r"(?i)\bcase stud(y|ies)\b", "survey": r"(?i)\bsurveys?\b", "interview": r"(?i)\binterviews?\b", "fieldwork": r"(?i)\bfieldworks?\b", "experiment": r"(?i)\bexperiments?\b", "estimate": r"(?i)\bestimates?\b", "comparison": r"(?i)\bcomparisons?\b"}
LEXICON = {"medicine": (["patient*", "disease", "surg*"], ["health", "clinic*"]), "law": (["tribunal", "judicial", "statute"], ["claim", "appeal"]), "software": (["compiler", "database", "software"], ["network", "code"]), "education": (["school*", "teacher"], ["reading", "college"]), "sport": (["sprint", "football", "throws"], ["training", "crew"])}


def agg_discourse(spark: SparkSession, d: str) -> DataFrame:
    return X.discourse(table(spark, d, "sentences"), SHORT)


def agg_discourse_trend(spark: SparkSession, d: str) -> DataFrame:
    x = agg_discourse(spark, d).join(latest(table(spark, d, "doc")).select(F.col("id").alias("doc_id"), "year"), "doc_id").where("year is not null")
    return x.groupBy((F.floor(F.col("year") / 5) * 5).alias("period")).agg(F.count("*").alias("n"), F.round(F.avg("hedges_per1k"), 4).alias("hedges"), F.round(F.avg("passive_per1k"), 4).alias("passive")).where("n >= 20")


def agg_method_features(spark: SparkSession, d: str) -> DataFrame:
    return X.method_features(table(spark, d, "sentences"), LABELS, ["method"], 5).where("n > 0")


def agg_method_prevalence(spark: SparkSession, d: str) -> DataFrame:
    m = X.method_features(table(spark, d, "sentences"), LABELS, ["method"], 5)
    return m.groupBy("label").agg(F.count("*").alias("theses"), F.round(F.avg((F.col("n") > 0).cast("double")), 6).alias("prevalence"))


def agg_method_diffusion(spark: SparkSession, d: str) -> DataFrame:
    """First year and prevalence of each method in each repository."""
    docs = latest(table(spark, d, "doc")).select(F.col("id").alias("doc_id"), "repo", "year")
    m = X.method_features(table(spark, d, "sentences"), LABELS, ["method"], 5).join(docs, "doc_id")
    return m.groupBy("repo", "label").agg(F.count("*").alias("theses"), F.count_if(F.col("n") > 0).alias("using"), F.min(F.when(F.col("n") > 0, F.col("year"))).alias("first_year")).where("using > 0")


def ml_lexicon_scores(spark: SparkSession, d: str) -> DataFrame:
    return X.lexicon_scores(table(spark, d, "docs"), "docid", {"title": 6.0, "abstract": 2.0}, LEXICON)


def ml_lexicon_classify(spark: SparkSession, d: str) -> DataFrame:
    return X.classify(ml_lexicon_scores(spark, d), "docid")


def ml_label_terms(spark: SparkSession, d: str) -> DataFrame:
    return X.label_terms(table(spark, d, "docs"), "repo", "title")


def agg_corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    """Counts and words by status and decade of the last harvests."""
    x = latest(table(spark, d, "doc"))
    return x.groupBy("status", F.expr("year div 10 * 10").alias("decade")).agg(F.count("*").alias("theses"), F.coalesce(F.sum("words"), F.lit(0)).alias("words"), F.count_if(F.coalesce("abstract", F.lit("")) == "").alias("no_abstract"))


def agg_verdict_mix(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pair").groupBy(F.coalesce("verdict", F.lit("(unjudged)")).alias("verdict")).agg(F.count("*").alias("pairs"), F.sum("matched_words").alias("words"))


def agg_provenance(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "doc")
    return x.groupBy(F.coalesce("discipline_method", F.lit("(none)")).alias("method")).agg(F.count("*").alias("n"), F.round(F.avg((F.col("discipline_conf") < 0.4).cast("double")), 6).alias("low_conf_share"))


def agg_signature(spark: SparkSession, d: str) -> DataFrame:
    """Digest per repository of its ordered (id, title length, abstract length) lines."""
    line = F.concat_ws("|", "id", F.coalesce(F.length("title"), F.lit(0)).cast("string"), F.coalesce(F.length("abstract"), F.lit(0)).cast("string"))
    return X.line_digests(table(spark, d, "docs").select("repo", "id", line.alias("line")), "repo", "id", "line")


def agg_route_shares(spark: SparkSession, d: str) -> DataFrame:
    c = ml_lexicon_classify(spark, d)
    return c.groupBy("method").agg(F.count("*").alias("n")).withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def ml_body_sample(spark: SparkSession, d: str) -> DataFrame:
    """First 12 rows of introduction, literature and method of each thesis; of any bucket where these are fewer than 4."""
    s = table(spark, d, "sentences").select("doc_id", "idx", "bucket", "text").distinct().withColumn("core", F.col("bucket").isin("introduction", "literature", "method").cast("int"))
    w = Window.partitionBy("doc_id")
    s = s.withColumn("n_core", F.sum("core").over(w)).withColumn("use", (F.col("core") == 1) | (F.col("n_core") < 4))
    x = s.where("use").withColumn("rn", F.row_number().over(w.orderBy("idx", "text"))).where("rn <= 12")
    return x.groupBy("doc_id").agg(F.count("*").alias("rows"), F.max("idx").alias("last_idx"))


QUERIES = {f.__name__: f for f in (agg_discourse, agg_discourse_trend, agg_method_features, agg_method_prevalence, agg_method_diffusion, ml_lexicon_scores, ml_lexicon_classify, ml_label_terms, agg_corpus_stats, agg_verdict_mix, agg_provenance, agg_signature, agg_route_shares, ml_body_sample)}

_DL = "dl AS (SELECT * FROM doc WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY coalesce(harvested_at, TIMESTAMP '1970-01-01') DESC, coalesce(title, '') DESC) = 1)"
_COUNT = lambda rx: f"len(regexp_extract_all(text, {_sq(rx)}))"
_STOP = "(" + ", ".join(f"'{w}'" for w in X.P.STOPWORDS) + ")"
_DISC = f"""WITH s0 AS (SELECT DISTINCT doc_id, idx, text FROM sentences WHERE len(excl) = 0 AND text IS NOT NULL), s AS (SELECT doc_id, idx, regexp_replace(text, '[^\\x00-\\x7F\\p{{P}}\\p{{S}}\\p{{Z}}\\p{{C}}]', 'x', 'g') AS text FROM s0), w AS (SELECT *, regexp_extract_all(lower(text), '[a-z]+') AS w FROM s),
g AS (SELECT doc_id, count(*) AS sentences, sum(len(w))::BIGINT AS words, sum(len(list_filter(w, lambda x: length(x) >= 7))) AS long_words, sum(len(list_filter(w, lambda x: x IN {_STOP}))) AS stop_words, sum(coalesce(list_sum(list_transform(w, lambda x: greatest(1, len(regexp_extract_all(x, '[aeiouy]+'))))), 0)) AS syllables, {', '.join(f'sum({_COUNT(rx)}) AS {n}' for n, rx in X.COUNTS.items())} FROM w GROUP BY doc_id HAVING sum(len(w)) >= {SHORT}),
disc AS (SELECT doc_id, sentences, words, round(words / sentences, 2) AS mean_sentence_len, round(100 * long_words / words, 2) AS long_word_pct, round(100 * (1 - stop_words / words), 2) AS lexical_density, round(206.835::DOUBLE - 1.015::DOUBLE * (words / sentences) - 84.6::DOUBLE * (syllables / words), 1) AS flesch, {', '.join(f'round(1000 * {n} / words, 2) AS {n}_per1k' for n in X.COUNTS)}, round(hedges / greatest(boosters, 1), 2) AS hedge_boost_ratio FROM g)"""
_METH = "WITH s AS (SELECT DISTINCT doc_id, idx, text, bucket FROM sentences WHERE text IS NOT NULL), k AS (SELECT doc_id, count(*) FILTER (bucket = 'method') AS m FROM s GROUP BY doc_id), mf AS (" + " UNION ALL ".join(f"SELECT doc_id, {_sq(n)} AS label, sum(CASE WHEN m < 5 OR bucket = 'method' THEN {_COUNT(rx)} ELSE 0 END)::BIGINT AS n FROM s JOIN k USING (doc_id) GROUP BY doc_id" for n, rx in LABELS.items()) + ")"


def _rx(t: str) -> str:
    return rf"(?i)\b{t[:-1]}" if t.endswith("*") else rf"(?i)\b{t}[a-z0-9_]{{0,2}}\b"


def _lex() -> str:
    out = []
    for n, (strong, weak) in LEXICON.items():
        parts = [f"CASE WHEN regexp_matches(coalesce({f}, ''), {_sq(_rx(t))}) THEN {w * x}::DOUBLE ELSE 0 END" for f, w in (("title", 6.0), ("abstract", 2.0)) for ts, x in ((strong, 3), (weak, 1)) for t in ts]
        out.append(f"SELECT docid, '{n}' AS label, {' + '.join(parts)} AS score FROM docs")
    return "WITH lx AS (SELECT * FROM (" + " UNION ALL ".join(out) + ") WHERE score > 0)"


_CLS = _lex() + ", cl AS (SELECT docid, label, round(score / sum(score) OVER (PARTITION BY docid), 4) AS conf, CASE WHEN (score - coalesce(lead(score) OVER w, 0)) / sum(score) OVER (PARTITION BY docid) >= 0.2 THEN 'rules' ELSE 'rules-weak' END AS method, row_number() OVER w AS rn FROM lx WINDOW w AS (PARTITION BY docid ORDER BY score DESC, label))"
ORACLES = {
    "agg_discourse": _DISC + " SELECT * FROM disc",
    "agg_discourse_trend": _DISC + f", {_DL} SELECT (floor(year / 5) * 5)::BIGINT AS period, count(*) AS n, round(avg(hedges_per1k), 4) AS hedges, round(avg(passive_per1k), 4) AS passive FROM disc JOIN dl ON dl.id = disc.doc_id WHERE year IS NOT NULL GROUP BY 1 HAVING count(*) >= 20",
    "agg_method_features": _METH + " SELECT * FROM mf WHERE n > 0",
    "agg_method_prevalence": _METH + " SELECT label, count(*) AS theses, round(avg((n > 0)::INT), 6) AS prevalence FROM mf GROUP BY label",
    "agg_method_diffusion": _METH + f", {_DL} SELECT repo, label, count(*) AS theses, count(*) FILTER (n > 0) AS using, min(year) FILTER (n > 0) AS first_year FROM mf JOIN dl ON dl.id = mf.doc_id GROUP BY ALL HAVING count(*) FILTER (n > 0) > 0",
    "ml_lexicon_scores": _lex() + " SELECT * FROM lx",
    "ml_lexicon_classify": _CLS + " SELECT docid, label, conf, method FROM cl WHERE rn = 1",
    "agg_route_shares": _CLS + " SELECT method, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM cl WHERE rn = 1 GROUP BY method",
    "ml_label_terms": "WITH t AS (SELECT repo AS g, docid, unnest(list_distinct(regexp_extract_all(lower(coalesce(title, '')), '[a-z]{4,}'))) AS term FROM docs WHERE repo IS NOT NULL), n AS (SELECT repo AS g, count(*) AS n FROM docs GROUP BY repo), df AS (SELECT g, term, count(*) AS df FROM t GROUP BY ALL), al AS (SELECT term, count(*) AS al FROM t GROUP BY term), r AS (SELECT g AS grp, term, df, row_number() OVER (PARTITION BY g ORDER BY round((df / n) / (al / (SELECT count(*) FROM docs) + 0.004::DOUBLE), 9) DESC, term) AS place FROM df JOIN al USING (term) JOIN n USING (g) WHERE df >= 3 AND df >= 0.07 * n) SELECT * FROM r WHERE place <= 3",
    "agg_corpus_stats": f"WITH {_DL} SELECT status, year // 10 * 10 AS decade, count(*) AS theses, coalesce(sum(words), 0)::BIGINT AS words, count(*) FILTER (coalesce(abstract, '') = '') AS no_abstract FROM dl GROUP BY 1, 2",
    "agg_verdict_mix": "SELECT coalesce(verdict, '(unjudged)') AS verdict, count(*) AS pairs, sum(matched_words)::BIGINT AS words FROM pair GROUP BY 1",
    "agg_provenance": "SELECT coalesce(discipline_method, '(none)') AS method, count(*) AS n, round(avg((discipline_conf < 0.4)::INT), 6) AS low_conf_share FROM doc GROUP BY 1",
    "agg_signature": "SELECT repo, sha256(string_agg(id || '|' || coalesce(length(title), 0) || '|' || coalesce(length(abstract), 0), chr(10) ORDER BY id)) AS signature, count(*) AS n FROM docs GROUP BY repo",
    "ml_body_sample": "WITH s AS (SELECT DISTINCT doc_id, idx, bucket, text FROM sentences), c AS (SELECT *, bucket IN ('introduction', 'literature', 'method') AS core, count(*) FILTER (bucket IN ('introduction', 'literature', 'method')) OVER (PARTITION BY doc_id) AS k FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idx, text NULLS FIRST) AS rn FROM c WHERE coalesce(core, false) OR k < 4) SELECT doc_id, count(*) AS rows, max(idx) AS last_idx FROM r WHERE rn <= 12 GROUP BY doc_id",
}
