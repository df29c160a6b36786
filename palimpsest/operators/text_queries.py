"""Queries over the scalar text functions, filters and record-level sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from palimpsest.functions import patterns as P, text as T
from palimpsest.plans.runtime import table

_TOK = "list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(replace(lower(coalesce({c}, '')), '–', ' '), '([a-z0-9])-([a-z0-9])', '\\1\\2', 'g'), '([a-z0-9])-([a-z0-9])', '\\1\\2', 'g'), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')"


def sql_tokens(c: str) -> str:
    return _TOK.format(c=c)


def _sq(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _lit(xs) -> str:
    return "(" + ", ".join(_sq(x) for x in xs) + ")"


def txt_tokens(spark: SparkSession, d: str) -> DataFrame:
    toks = T.match_tokens(F.col("text"))
    return table(spark, d, "sentences").select("doc_id", "idx", F.array_join(toks, " ").alias("tokens"), F.size(toks).alias("n")).distinct()


def txt_norm_title(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "docs").select("docid", T.norm_title(F.col("title")).alias("norm"))


def txt_flags(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sentences").select("doc_id", "idx", "text").distinct()
    f = T.flags(F.coalesce(F.col("text"), F.lit("")))
    return s.groupBy("doc_id").agg(*[F.count_if(c).alias(n) for n, c in f.items()])


def txt_directions(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sentences").select(F.explode(T.directions(F.coalesce("text", F.lit("")))).alias("direction"))
    return s.groupBy("direction").agg(F.count("*").alias("n"))


def txt_heading_bucket(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sentences").select("heading").distinct().where("heading is not null").select("heading", T.heading_bucket(F.col("heading")).alias("kind"))


def txt_error_signatures(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sentences").select("doc_id", "idx", "text").distinct().select("doc_id", F.explode(T.error_signatures(F.col("text"))).alias("signature"))
    return s.groupBy("doc_id", "signature").agg(F.count("*").alias("n"))


def txt_prose(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sentences").select("doc_id", "idx", "text").distinct()
    return s.groupBy("doc_id").agg(F.count_if(T.is_prose(T.match_tokens(F.col("text")))).alias("prose"), F.count("*").alias("n"))


def txt_author_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "docs").select("docid", T.author_key(F.col("creator")).alias("author"), T.surname_of(F.col("creator")).alias("surname"))


def txt_landing(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "doc").select("id", T.landing_url(F.col("id"), F.col("landing"), F.col("pdf_url")).alias("url")).distinct()


def txt_work_key(spark: SparkSession, d: str) -> DataFrame:
    k = T.work_key(F.col("doi"), F.lower(F.trim("surname")), F.col("year"), F.col("title"))
    return table(spark, d, "cite").groupBy(k.alias("work")).agg(F.count("*").alias("n"))


def txt_clip_snippet(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "docs").select("docid", T.clip(F.col("title"), 60).alias("clipped"), T.snippet(F.col("abstract")).alias("snippet"))


def txt_chunks(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").select("doc_id", F.posexplode(T.chunks(F.col("text"))).alias("k", "chunk"))
    return x.select("doc_id", "k", F.length("chunk").alias("chars"), T.word_count(F.col("chunk")).alias("words"))


def txt_title_jaccard(spark: SparkSession, d: str) -> DataFrame:
    w, a = table(spark, d, "work"), table(spark, d, "authority")
    j = w.where("openalex <> ''").select("key", "openalex", F.col("title").alias("t")).join(a.select("openalex", F.col("title").alias("u")), "openalex")
    return j.select("key", "openalex", F.round(T.jaccard(T.title_tokens(F.col("t")), T.title_tokens(F.col("u"))), 6).alias("sim"))


def reconcile_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Best candidate of every work that has some, first of equals, with its verdict."""
    w = table(spark, d, "work").where(F.size("candidates") > 0).select("key", "surname", "year", "title", F.posexplode("candidates").alias("ord", "c"))
    s, hit = T.candidate_score(F.col("title"), F.col("surname"), F.col("year"), F.col("c"))
    r = w.select("key", "ord", F.col("c.openalex").alias("openalex"), F.round(s, 6).alias("score"), hit.alias("hit"))
    best = r.groupBy("key").agg(F.max_by(F.struct("openalex", "score", "hit"), F.struct("score", -F.col("ord"))).alias("b"))
    return best.select("key", "b.openalex", "b.score", T.candidate_verdict(F.col("b.score"), F.col("b.hit")).alias("verdict"))


def reconcile_status(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "work").groupBy(F.coalesce("verdict", F.lit("(none)")).alias("verdict")).agg(F.count("*").alias("works"), F.sum("n_theses").alias("citers"), F.count_if(F.col("doi").isNotNull()).alias("with_doi"))


def src_doctoral_flags(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "doc")
    return x.select("id", "harvested_at", T.doctoral(F.col("title"), F.col("abstract"), F.col("dctype")).cast("int").alias("doctoral"), T.education(F.col("title"), F.col("abstract")).cast("int").alias("education"))


def src_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Harvests folded in order: a later abstract replaces (also by ''), the first title stays, nulls never overwrite."""
    o = "harvested_at"
    x = table(spark, d, "doc").where("id is not null")
    return x.groupBy("id").agg(F.max_by("abstract", F.when(F.col("abstract").isNotNull(), F.col(o))).alias("abstract"), F.min_by("title", F.when(F.col("title").isNotNull(), F.col(o))).alias("title"), F.count("*").alias("harvests"))


def src_resume(spark: SparkSession, d: str) -> DataFrame:
    """Usable records whose references are not parsed yet."""
    ok = table(spark, d, "doc").where("status = 'ok'").select("id").distinct()
    return ok.join(table(spark, d, "srcstat").select(F.col("src").alias("id")), "id", "left_anti")


def src_sample(spark: SparkSession, d: str) -> DataFrame:
    """A reproducible sample of 25 pending records: the least digests of the id."""
    return table(spark, d, "doc").where("status <> 'ok'").select("id").distinct().orderBy(F.md5("id"), "id").limit(25)


def flt_record_filter(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "docs")
    return x.where(F.lower(F.trim("discipline")).isin("law", "sport") & F.col("year").between(2000, 2015) & (F.col("words") >= 150) & F.lower("creator").contains("an")).select("docid", "year", "words")


def flt_rescore(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pair").where("clean_runs is null and (matched_words >= 20 or max_run >= 12 or long_runs >= 1)").select("a", "b", "matched_words")


def flt_dense_reference_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of which at least 35 % of six or more longer lines look like reference entries."""
    s = table(spark, d, "sentences").select("doc_id", "idx", "text", "page").distinct().where((F.length("text") > 15) & F.col("page").isNotNull())
    hit = T.flags(F.col("text"))["ref_entry"].cast("int")
    return s.groupBy("doc_id", "page").agg(F.count("*").alias("n"), F.sum(hit).alias("entries")).where("n >= 6 and entries >= 0.35 * n")


def win_attribution(spark: SparkSession, d: str) -> DataFrame:
    """Rows with an attribution within two rows before or after."""
    s = table(spark, d, "sentences").select("doc_id", "idx", "text").distinct()
    w = Window.partitionBy("doc_id").orderBy("idx", "text").rowsBetween(-2, 2)
    x = s.withColumn("near", F.max(T.flags(F.coalesce("text", F.lit("")))["attribution"].cast("int")).over(w))
    return x.groupBy("doc_id").agg(F.sum("near").alias("near_attribution"), F.count("*").alias("n"))


def win_segments(spark: SparkSession, d: str) -> DataFrame:
    """Stretches of adjoining retained rows."""
    s = table(spark, d, "sentences").where(F.size("excl") == 0).select("doc_id", "idx").distinct()
    w = Window.partitionBy("doc_id").orderBy("idx")
    x = s.withColumn("seg", F.col("idx") - F.row_number().over(w))
    return x.groupBy("doc_id", "seg").agg(F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.count("*").alias("n")).drop("seg")


def toc_headings(spark: SparkSession, d: str) -> DataFrame:
    """Contents list: first page of each heading, contents pages (4 headings or more) dropped, pages never falling."""
    s = table(spark, d, "sentences").select("doc_id", "idx", "page", F.trim("heading").alias("heading")).where("heading <> '' and page is not null")
    busy = s.groupBy("doc_id", "page").agg(F.count_distinct("heading").alias("k")).where("k >= 4").select("doc_id", "page")
    good = s.where(F.length("heading").between(4, 90) & ~F.col("heading").rlike(r"(?i)^\s*(\d+|[ivxlcdm]+|page\s*\d+|table|figure|appendix)\s*$") & ~F.substring("heading", 1, 1).rlike("[a-z]"))
    first = good.join(busy, ["doc_id", "page"], "left_anti").groupBy("doc_id", "heading").agg(F.min(F.struct("idx", "page")).alias("f")).select("doc_id", "heading", "f.idx", "f.page")
    w = Window.partitionBy("doc_id").orderBy("idx", "heading")
    x = first.withColumn("reach", F.max("page").over(w)).where(F.col("page") == F.col("reach")).withColumn("rn", F.row_number().over(w))
    return x.where("rn <= 28").select("doc_id", "heading", "page", "rn")


QUERIES = {f.__name__: f for f in (txt_tokens, txt_norm_title, txt_flags, txt_directions, txt_heading_bucket, txt_error_signatures, txt_prose, txt_author_key, txt_landing, txt_work_key, txt_clip_snippet, txt_chunks, txt_title_jaccard, reconcile_candidates, reconcile_status, src_doctoral_flags, src_upsert, src_resume, src_sample, flt_record_filter, flt_rescore, flt_dense_reference_pages, win_attribution, win_segments, toc_headings)}

_NORM = "trim(regexp_replace({c}, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))"
_WORDS = "list_filter(string_split_regex(coalesce({c}, ''), '\\s+'), lambda x: x <> '')"
_TT = "list_distinct(list_filter(string_split_regex(regexp_replace(lower(strip_accents(coalesce({c}, ''))), '[^a-z0-9_]+', ' ', 'g'), ' '), lambda x: length(x) > 1 AND x NOT IN " + _lit(P.TITLE_STOP) + "))"
_JAC = "CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) END"
_U = "(SELECT DISTINCT doc_id, idx, text FROM sentences)"
_FIRST = "regexp_replace(lower(split_part(coalesce(creator, ''), ';', 1)), '[^a-z,\\s''\\-]', ' ', 'g')"
_B = " ".join(f"WHEN regexp_matches(lower(heading), {_sq(rx)}) THEN {_sq(n)}" for n, rx in P.STRUCTURAL)
_FOLD = "trim(regexp_replace(lower(strip_accents(coalesce({c}, ''))), '[^a-z0-9_]+', ' ', 'g'))"

ORACLES = {
    "txt_tokens": f"SELECT DISTINCT doc_id, idx, array_to_string({sql_tokens('text')}, ' ') AS tokens, len({sql_tokens('text')}) AS n FROM sentences",
    "txt_norm_title": "SELECT docid, array_to_string(list_filter(string_split_regex(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9 ]', ' ', 'g'), ' +'), lambda x: length(x) > 2)[1:8], ' ') AS norm FROM docs",
    "txt_flags": "SELECT doc_id, " + ", ".join(f"count(*) FILTER (regexp_matches(coalesce(text, ''), {_sq(rx)})) AS {n}" for n, rx in P.FLAGS.items()) + f" FROM {_U} GROUP BY doc_id",
    "txt_directions": " UNION ALL ".join(f"SELECT {_sq(n)} AS direction, count(*) AS n FROM sentences WHERE regexp_matches(coalesce(text, ''), {_sq(rx)}) HAVING count(*) > 0" for n, rx in P.DIRECTIONS.items()),
    "txt_prose": f"WITH t AS (SELECT doc_id, {sql_tokens('text')} AS k FROM {_U}) SELECT doc_id, count(*) FILTER (len(k) > 0 AND len(list_filter(k, lambda x: length(x) = 1)) / greatest(len(k), 1) <= 0.30 AND len(list_filter(k, lambda x: length(x) >= 4)) >= least(5, greatest(2, round_even(len(k) * 5 / 20, 0)))) AS prose, count(*) AS n FROM t GROUP BY doc_id",
    "txt_landing": r"SELECT DISTINCT id, CASE WHEN regexp_matches(id, '^oai:([^:]+):(\d+)$') THEN 'https://' || regexp_extract(id, '^oai:([^:]+):(\d+)$', 1) || '/id/eprint/' || regexp_extract(id, '^oai:([^:]+):(\d+)$', 2) || '/' ELSE coalesce(nullif(landing, ''), nullif(pdf_url, ''), '') END AS url FROM doc",
    "txt_work_key": "SELECT CASE WHEN coalesce(doi, '') <> '' THEN doi ELSE coalesce(lower(trim(surname)), '') || '|' || coalesce(year::VARCHAR, '') || '|' || lower(substr(coalesce(title, ''), 1, 80)) END AS work, count(*) AS n FROM cite GROUP BY 1",
    "txt_clip_snippet": f"SELECT docid, CASE WHEN length(title) > 60 THEN rtrim(title[1:59]) || '…' ELSE title END AS clipped, array_to_string({_WORDS.format(c='abstract')}[1:38], ' ') || CASE WHEN len({_WORDS.format(c='abstract')}) > 38 THEN ' …' ELSE '' END AS snippet FROM docs",
    "txt_chunks": f"WITH w AS (SELECT doc_id, {_WORDS.format(c='text')} AS w FROM documents), c AS (SELECT doc_id, unnest(range(0, 6)) AS k, w FROM w), x AS (SELECT doc_id, k, w[k * 110 + 1 : k * 110 + 140] AS p FROM c WHERE k * 110 < len(w)) SELECT doc_id, k, length(array_to_string(p, ' ')) AS chars, len(p) AS words FROM x",
    "txt_title_jaccard": f"SELECT key, openalex, round({_JAC.format(a=_TT.format(c='w.title'), b=_TT.format(c='a.title'))}, 6) AS sim FROM work w JOIN authority a USING (openalex) WHERE openalex <> ''",
    "reconcile_candidates": f"""WITH k AS (SELECT key, w.surname, w.year, w.title AS t, unnest(candidates) AS cd, generate_subscripts(candidates, 1) AS ord FROM work w WHERE len(candidates) > 0),
 s AS (SELECT key, ord, cd.openalex AS openalex, {_JAC.format(a=_TT.format(c='t'), b=_TT.format(c='cd.title'))} + coalesce(CASE abs(cd.year - year) WHEN 0 THEN 0.12 WHEN 1 THEN 0.05 WHEN 2 THEN 0 WHEN 3 THEN 0 ELSE CASE WHEN abs(cd.year - year) > 3 THEN -0.10 ELSE 0 END END, 0) AS base,
  {_FOLD.format(c='surname')} <> '' AND len(list_filter(cd.authors[1:12], lambda a: contains({_FOLD.format(c='a')}, {_FOLD.format(c='surname')}))) > 0 AS hit FROM k),
 r AS (SELECT key, ord, openalex, round(greatest(0, least(1, base + CASE WHEN hit THEN 0.18 ELSE 0 END)), 6) AS score, coalesce(hit, false) AS hit FROM s)
 SELECT key, openalex, score, CASE WHEN score < 0.45 THEN 'reject' WHEN score >= 0.72 AND hit THEN 'accept' ELSE 'ambiguous' END AS verdict FROM r QUALIFY row_number() OVER (PARTITION BY key ORDER BY score DESC, ord) = 1""",
    "reconcile_status": "SELECT coalesce(verdict, '(none)') AS verdict, count(*) AS works, sum(n_theses) AS citers, count(doi) AS with_doi FROM work GROUP BY 1",
    "src_doctoral_flags": f"SELECT id, harvested_at, coalesce(regexp_matches(concat_ws(' ', title, abstract, dctype), {_sq(P.DOCTORAL)}) OR (NOT regexp_matches(concat_ws(' ', title, abstract, dctype), {_sq(P.MASTERS)}) AND contains(lower(dctype), 'thesis')), false)::INT AS doctoral, regexp_matches(concat_ws(' ', title, abstract), {_sq(P.EDUCATION)})::INT AS education FROM doc",
    "src_upsert": "SELECT id, arg_max(abstract, harvested_at) AS abstract, arg_min(title, harvested_at) AS title, count(*) AS harvests FROM doc WHERE id IS NOT NULL GROUP BY id",
    "src_resume": "SELECT DISTINCT id FROM doc WHERE status = 'ok' AND id NOT IN (SELECT src FROM srcstat WHERE src IS NOT NULL)",
    "src_sample": "SELECT id FROM (SELECT DISTINCT id FROM doc WHERE status <> 'ok') ORDER BY md5(id), id LIMIT 25",
    "flt_record_filter": "SELECT docid, year, words FROM docs WHERE lower(trim(discipline)) IN ('law', 'sport') AND year BETWEEN 2000 AND 2015 AND words >= 150 AND contains(lower(creator), 'an')",
    "flt_rescore": "SELECT a, b, matched_words FROM pair WHERE clean_runs IS NULL AND (matched_words >= 20 OR max_run >= 12 OR long_runs >= 1)",
    "flt_dense_reference_pages": f"SELECT doc_id, page, count(*) AS n, count(*) FILTER (regexp_matches(text, {_sq(P.FLAGS['ref_entry'])})) AS entries FROM (SELECT DISTINCT doc_id, idx, text, page FROM sentences) WHERE length(text) > 15 AND page IS NOT NULL GROUP BY ALL HAVING count(*) >= 6 AND entries >= 0.35 * count(*)",
    "win_attribution": f"WITH x AS (SELECT doc_id, max(regexp_matches(coalesce(text, ''), {_sq(P.FLAGS['attribution'])})::INT) OVER (PARTITION BY doc_id ORDER BY idx, text NULLS FIRST ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM {_U}) SELECT doc_id, sum(near) AS near_attribution, count(*) AS n FROM x GROUP BY doc_id",
    "win_segments": "WITH r AS (SELECT DISTINCT doc_id, idx FROM sentences WHERE len(excl) = 0), s AS (SELECT *, idx - row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS seg FROM r) SELECT doc_id, min(idx) AS first_idx, max(idx) AS last_idx, count(*) AS n FROM s GROUP BY doc_id, seg",
    "toc_headings": r"""WITH s AS (SELECT doc_id, idx, page, trim(heading) AS heading FROM sentences WHERE trim(heading) <> '' AND page IS NOT NULL),
 busy AS (SELECT doc_id, page FROM s GROUP BY ALL HAVING count(DISTINCT heading) >= 4),
 f AS (SELECT doc_id, heading, min(idx) AS idx, arg_min(page, idx) AS page FROM s WHERE length(heading) BETWEEN 4 AND 90 AND NOT regexp_matches(heading, '(?i)^\s*(\d+|[ivxlcdm]+|page\s*\d+|table|figure|appendix)\s*$') AND NOT regexp_matches(heading[1:1], '[a-z]') AND (doc_id, page) NOT IN (SELECT (doc_id, page) FROM busy) GROUP BY ALL),
 m AS (SELECT *, max(page) OVER (PARTITION BY doc_id ORDER BY idx, heading) AS reach FROM f),
 r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idx, heading) AS rn FROM m WHERE page = reach) SELECT doc_id, heading, page, rn FROM r WHERE rn <= 28""",
    "txt_author_key": f"WITH f AS (SELECT docid, trim(split_part(coalesce(creator, ''), ';', 1)) AS f, trim(regexp_replace({_FIRST.replace('creator', 'creator')}, '[ \\t]+', ' ', 'g')) AS s FROM docs), w AS (SELECT *, list_filter(string_split_regex(s, '\\s+'), lambda x: x <> '') AS w FROM f), k AS (SELECT *, contains(s, ',') AS c FROM w), p AS (SELECT *, CASE WHEN c THEN regexp_replace(split_part(s, ',', 1), '\\s+', '', 'g') ELSE coalesce(w[-1], '') END AS sur, CASE WHEN c THEN regexp_replace(s, '^[^,]*,', '') ELSE array_to_string(w[1:-2], ' ') END AS rest FROM k) SELECT docid, CASE WHEN sur <> '' THEN sur || '|' || substr(trim(rest), 1, 1) ELSE '' END AS author, regexp_replace(CASE WHEN contains(f, ',') THEN trim(split_part(f, ',', 1)) ELSE coalesce(list_filter(string_split_regex(f, '\\s+'), lambda x: x <> '')[-1], '') END, '[^A-Za-z''’-]', '', 'g') AS surname FROM p",
    "txt_heading_bucket": "WITH h AS (SELECT DISTINCT heading, lower(heading) AS l FROM sentences WHERE heading IS NOT NULL), e AS (SELECT heading, l, list_filter([" + ", ".join(f"CASE WHEN regexp_matches(l, {_sq(rx)}) THEN {{'at': length(regexp_extract(l, {_sq('^(.*?)(?:' + rx + ')')}, 1)), 'k': {k}, 'name': {_sq(n)}}} END" for k, (n, rx) in enumerate(P.CHAPTERS)) + "], lambda x: x IS NOT NULL) AS spots FROM h) SELECT heading, CASE " + " ".join(f"WHEN regexp_matches(l, {_sq(rx)}) THEN {_sq(n)}" for n, rx in P.STRUCTURAL) + " ELSE coalesce(list_sort(spots)[1].name, 'unclassified') END AS kind FROM e",
}
