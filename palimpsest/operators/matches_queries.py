"""Queries of match records and pair analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from palimpsest.functions import text as T
from palimpsest.operators import matches as M, overlap as O, streams as S
from palimpsest.operators.overlap_queries import _BANDS, _COMMON, _PROSE, _RUNS, _runs, QUERY_SET
from palimpsest.operators.graph import latest
from palimpsest.operators.text_queries import sql_tokens
from palimpsest.functions.text import run_band
from palimpsest.plans.runtime import cut, table


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """One text per place of the retained rows, as the token stream has it."""
    return cut(M.one_text(table(spark, d, "sentences").where(F.coalesce(F.size("excl"), F.lit(0)) <= 0)), "texts")


def _surnames(spark: SparkSession, d: str) -> DataFrame:
    return latest(table(spark, d, "doc")).select(F.col("id").alias("doc_id"), T.surname_of(F.col("creator")).alias("surname"))


def _spans(spark: SparkSession, d: str, whole: bool = False):
    rows, g, _, runs = _runs(spark, d, "md5", whole)
    texts = _texts(spark, d)
    met = runs.select(F.col("a").alias("doc_id")).unionByName(runs.select(F.col("b").alias("doc_id"))).distinct()
    words = cut(M.display_words(rows.join(met, "doc_id", "left_semi"), texts), "words")
    return rows, g, runs, texts, words, cut(M.sides(runs, words), "spans")


def match_spans(spark: SparkSession, d: str) -> DataFrame:
    """Rows and display text of both sides of every run."""
    return _spans(spark, d)[5]


def match_citations(spark: SparkSession, d: str) -> DataFrame:
    *_, texts, _, spans = _spans(spark, d)
    return M.citation_classes(spans, texts, _surnames(spark, d))


def match_quoted(spark: SparkSession, d: str) -> DataFrame:
    *_, texts, _, spans = _spans(spark, d)
    return M.quoted_runs(spans, texts)


def match_records(spark: SparkSession, d: str) -> DataFrame:
    *_, texts, _, spans = _spans(spark, d)
    return M.records(spans, texts, _surnames(spark, d))


def _sizes(spark: SparkSession, d: str, rows: DataFrame) -> DataFrame:
    every = M.one_text(table(spark, d, "sentences")).groupBy("doc_id").agg(F.sum(F.size(T.match_tokens(F.col("text")))).alias("every"))
    return rows.groupBy("doc_id").agg(F.sum(F.size("toks")).alias("included")).join(every, "doc_id")


def agg_pair_analysis(spark: SparkSession, d: str) -> DataFrame:
    """Figures of every screened pair."""
    rows, _, _, texts, words, spans = _spans(spark, d)
    return M.pair_analysis(cut(M.records(spans, texts, _surnames(spark, d)), "records"), words, _sizes(spark, d, rows))


def agg_pair_buckets(spark: SparkSession, d: str) -> DataFrame:
    return M.pair_buckets(match_records(spark, d))


def agg_author_mentions(spark: SparkSession, d: str) -> DataFrame:
    """How often the theses of stored pairs name each other's author."""
    texts = M.one_text(table(spark, d, "sentences"))
    return M.author_mentions(texts, table(spark, d, "pair"), _surnames(spark, d).where("surname <> ''"), F.coalesce(F.col("bucket") == "references", F.lit(False)))


def _fates(spark: SparkSession, d: str):
    rows, g, runs, texts, words, spans = _spans(spark, d, whole=True)
    prose = O.prose_runs(runs, S.token_stream(rows))
    return cut(M.fates(runs, runs.join(prose, ["a", "b", "a0", "b0"], "left_anti"), O.common_runs(runs, g), M.quoted_runs(spans, texts)), "fates")


def match_fates(spark: SparkSession, d: str) -> DataFrame:
    return _fates(spark, d)


def agg_filter_tally(spark: SparkSession, d: str) -> DataFrame:
    return _fates(spark, d).groupBy("fate").agg(F.count("*").alias("runs"), F.sum(F.col("b1") - F.col("b0")).alias("words"))


def win_distinct_passages(spark: SparkSession, d: str) -> DataFrame:
    return M.distinct_passages(_fates(spark, d).where("fate = 'kept'"))


def top_fragments(spark: SparkSession, d: str) -> DataFrame:
    """Fragments to show of each pair."""
    return M.shown_fragments(_fates(spark, d))


def top_partners(spark: SparkSession, d: str) -> DataFrame:
    """Partners in order of what is kept, for theses with an id number divisible by 20 and all others alike."""
    return M.ranked_partners(_fates(spark, d))


def win_highlights(spark: SparkSession, d: str) -> DataFrame:
    """Stretches of b that runs cover, with the records they are shared with."""
    r = _runs(spark, d, "md5")[3]
    return M.highlight_segments(r.select("b", F.col("a").alias("id"), F.col("b0").alias("start"), F.col("b1").alias("end")), ["b"]).withColumn("ids", F.array_join("ids", " "))


def join_without_self(spark: SparkSession, d: str) -> DataFrame:
    """Stored pairs of different files."""
    x = latest(table(spark, d, "doc")).select(F.col("id").alias("doc_id"), "sha256")
    return M.without_self(table(spark, d, "pair").select("a", "b"), x)


def pipe_focal(spark: SparkSession, d: str) -> DataFrame:
    """Runs of the theses with an id number divisible by 20, by band, and how many of them stand in a third thesis."""
    _, g, _, runs = _runs(spark, d, "md5", whole=True)
    mine = runs.withColumn("doc_id", F.col("a")).where(QUERY_SET).drop("doc_id").unionByName(runs.withColumn("doc_id", F.col("b")).where(QUERY_SET).drop("doc_id")).distinct()
    common = O.common_runs(mine, g).withColumn("third", F.lit(1))
    x = mine.join(common, ["a", "b", "a0", "b0"], "left")
    return x.groupBy(run_band(F.col("a1") - F.col("a0"), T.FOCAL_BANDS).alias("band")).agg(F.count("*").alias("runs"), F.count("third").alias("in_third"), F.count_distinct("a", "b").alias("pairs"))


def win_barrier_runs(spark: SparkSession, d: str) -> DataFrame:
    """Maximal runs that bridge no row left out: a gap in the rows parts the stream."""
    rows = cut(S.token_rows(table(spark, d, "sentences"), barriers=True), "rows")
    g = cut(S.grams(S.token_stream(rows), O.GRAM, "md5"), "grams")
    pairs = cut(O.candidates(cut(S.winnow(g), "fingerprints"), rows.select("doc_id").distinct().count()), "candidates")
    return O.maximal_runs(O.matches(pairs, g))


def txt_prose_runs(spark: SparkSession, d: str) -> DataFrame:
    """Rows per thesis that read as prose by the plain test."""
    s = table(spark, d, "sentences").select("doc_id", "idx", "text").distinct()
    return s.groupBy("doc_id").agg(F.count_if(T.is_prose_run(T.match_tokens(F.col("text")))).alias("prose"), F.count("*").alias("n"))


def txt_landings(spark: SparkSession, d: str) -> DataFrame:
    """Pages of theses as the search and the release name them."""
    x = latest(table(spark, d, "doc"))
    made = {"aldermoor": "https://aldermoor.example/{n}", "kestrelton": "https://kestrelton.example/item/{n}/"}
    return x.select("id", T.landing_of_search(F.col("id"), F.col("landing"), F.col("pdf_url")).alias("search"), T.landing_of_release(F.col("repo"), F.col("id"), made).alias("release"))


def pipe_verify(spark: SparkSession, d: str) -> DataFrame:
    """Every screened pair after all tests: runs by fate, figures of the kept ones, and the verdict."""
    f = _fates(spark, d)
    n = F.col("b1") - F.col("b0")
    kept = F.col("fate") == "kept"
    g = f.groupBy("a", "b").agg(*[F.count_if(F.col("fate") == x).alias(f"{x}_runs") for x in ("artefact", "common", "quoted")], F.count_if(kept).alias("unique_runs"), F.count_if(kept & (n >= O.LONG_RUN)).alias("unique_long_runs"), F.coalesce(F.max(F.when(kept, n)), F.lit(0)).alias("unique_max_run"))
    words = O.union_length(f.where(kept), ["a", "b"], "b0", "b1").withColumnRenamed("covered", "unique_words")
    x = g.join(words, ["a", "b"], "left").fillna(0, ["unique_words"]).join(O.same_people(g.select("a", "b"), table(spark, d, "doc")), ["a", "b"])
    return x.withColumn("verdict", O.verdict(F.col("same_author"), F.col("title_sim"), F.col("unique_runs"), F.col("unique_max_run")))


QUERIES = {f.__name__: f for f in (match_spans, match_citations, match_quoted, match_records, agg_pair_analysis, agg_pair_buckets, agg_author_mentions, match_fates, agg_filter_tally, win_distinct_passages, top_fragments, top_partners, win_highlights, join_without_self, pipe_focal, pipe_verify, win_barrier_runs, txt_prose_runs, txt_landings)}

_TEXT = ", tx AS (SELECT doc_id, idx, min(coalesce(text, '')) AS text FROM sentences WHERE len(excl) = 0 GROUP BY ALL)"
_WORDS = f"""{_TEXT}, w0 AS (SELECT p.doc_id, p.idx, p.base, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS ws FROM p JOIN tx USING (doc_id, idx)),
w1 AS (SELECT doc_id, idx, base, generate_subscripts(ws, 1) AS k, unnest(ws) AS word FROM w0), w2 AS (SELECT *, len({sql_tokens('word')}) AS m FROM w1),
wd AS (SELECT doc_id, idx, k, word, base + sum(m) OVER (PARTITION BY doc_id, idx ORDER BY k ROWS UNBOUNDED PRECEDING) - m AS p0, m FROM w2),
ca AS (SELECT n.*, wd.idx, wd.k, wd.word FROM n JOIN wd ON wd.doc_id = n.a AND wd.m > 0 AND wd.p0 < n.a1 AND wd.p0 + wd.m > n.a0), cb AS (SELECT n.*, wd.idx, wd.k, wd.word FROM n JOIN wd ON wd.doc_id = n.b AND wd.m > 0 AND wd.p0 < n.b1 AND wd.p0 + wd.m > n.b0),
sp AS (SELECT * FROM (SELECT a, b, a0, a1, b0, b1, min(idx) AS sa0, max(idx) AS sa1, string_agg(word, ' ' ORDER BY idx, k) AS text_a FROM ca GROUP BY a, b, a0, a1, b0, b1) JOIN (SELECT a, b, a0, a1, b0, b1, min(idx) AS sb0, max(idx) AS sb1, string_agg(word, ' ' ORDER BY idx, k) AS text_b FROM cb GROUP BY a, b, a0, a1, b0, b1) USING (a, b, a0, a1, b0, b1))"""
_SURNAME = """, ld AS (SELECT * FROM doc QUALIFY row_number() OVER (PARTITION BY id ORDER BY harvested_at DESC) = 1),
sn AS (SELECT id AS a, regexp_replace(CASE WHEN contains(f, ',') THEN trim(split_part(f, ',', 1)) ELSE coalesce(list_filter(string_split_regex(f, '\\s+'), lambda x: x <> '')[-1], '') END, '[^A-Za-z''’-]', '', 'g') AS surname FROM (SELECT id, trim(split_part(coalesce(creator, ''), ';', 1)) AS f FROM ld))"""
_CITED = """, nr AS (SELECT sp.a, sp.b, sp.a0, sp.a1, sp.b0, sp.b1, coalesce(surname, '') <> '' AND regexp_matches(tx.text, '\\b' || coalesce(surname, '') || '\\b') AS hit, tx.idx BETWEEN sb0 AND sb1 AS inside FROM sp JOIN tx ON tx.doc_id = sp.b AND tx.idx BETWEEN sb0 - 3 AND sb1 + 3 LEFT JOIN sn USING (a)),
ct AS (SELECT a, b, a0, a1, b0, b1, CASE WHEN bool_or(hit AND inside) THEN 'attributed' WHEN bool_or(hit) THEN 'adjacent-but-unattributed' ELSE 'unattributed' END AS citation FROM nr GROUP BY ALL)"""
_ATTR = r"\(\s*[A-Z][A-Za-z''’\-]+(?:[^)\n]{0,60})?\b(?:19|20)\d{2}[a-z]?\b[^)\n]{0,30}\)|\b[A-Z][A-Za-z''’\-]+(?:\s+(?:et\s+al\.?|and|&)\s+[A-Z][A-Za-z''’\-]+)?\s*\(\s*(?:19|20)\d{2}[a-z]?\b|\(\s*(?:ibid|op\.?\s*cit|loc\.?\s*cit)\b|\bcited in\b"
_Q = """SELECT DISTINCT sp.a, sp.b, sp.a0, sp.a1, sp.b0, sp.b1 FROM sp JOIN tx ON tx.doc_id = sp.{x} AND tx.idx BETWEEN s{x}0 - 2 AND s{x}1 + 2 WHERE (tx.idx BETWEEN s{x}0 AND s{x}1 AND len(regexp_extract_all(tx.text, '["''‘’“”]')) >= 2) OR regexp_matches(tx.text, '""" + _ATTR + "')"
_QUOTED = f", qu AS ({_Q.replace('{x}', 'a')} INTERSECT {_Q.replace('{x}', 'b')})"
_FATES = _PROSE + _COMMON.format(n="n") + _WORDS + _QUOTED + """, fa AS (SELECT n.a, n.b, n.a0, n.a1, n.b0, n.b1, CASE WHEN (n.a, n.b, n.a0, n.b0) NOT IN (SELECT (a, b, a0, b0) FROM pr) THEN 'artefact' WHEN (n.a, n.b, n.a0, n.b0) IN (SELECT (a, b, a0, b0) FROM com) THEN 'common' WHEN (n.a, n.b, n.a0, n.b0) IN (SELECT (a, b, a0, b0) FROM qu) THEN 'quoted' ELSE 'kept' END AS fate FROM n)"""

ORACLES = {
    "match_spans": _RUNS + _WORDS + " SELECT * FROM sp",
    "match_citations": _RUNS + _WORDS + _SURNAME + _CITED + " SELECT * FROM ct",
    "match_quoted": _RUNS + _WORDS + _QUOTED + " SELECT * FROM qu",
    "agg_pair_buckets": _RUNS + _WORDS + ", bk AS (SELECT doc_id, idx, (min({'t': coalesce(text, ''), 'p': page, 'q': printed, 'b': bucket})).b AS bucket FROM sentences WHERE len(excl) = 0 GROUP BY ALL) SELECT a, b, coalesce(bucket, 'unclassified') AS bucket, count(*) AS runs, sum(b1 - b0)::BIGINT AS words FROM sp LEFT JOIN bk ON bk.doc_id = sp.b AND bk.idx = sb0 GROUP BY ALL",
    "match_fates": _RUNS + _FATES + " SELECT * FROM fa",
    "agg_filter_tally": _RUNS + _FATES + " SELECT fate, count(*) AS runs, sum(b1 - b0)::BIGINT AS words FROM fa GROUP BY 1",
    "win_distinct_passages": _RUNS + _FATES + ", z AS (SELECT *, b0 >= coalesce(max(b1) OVER (PARTITION BY a, b ORDER BY b0, b1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS fresh FROM fa WHERE fate = 'kept') SELECT a, b, count(*) FILTER (fresh) AS passages FROM z GROUP BY ALL",
    "top_partners": _RUNS + _FATES + """, both_ways AS (SELECT a, b, a0, a1 FROM fa WHERE fate = 'kept' UNION ALL SELECT b, a, b0, b1 FROM fa WHERE fate = 'kept'), ex AS (SELECT a, b, count(DISTINCT w) AS words_kept FROM (SELECT a, b, unnest(range(a0::BIGINT, a1::BIGINT)) AS w FROM both_ways) GROUP BY ALL),
 pl AS (SELECT a, b, count(*) FILTER (a1 - a0 >= 20) AS long_kept, any_value(words_kept) AS words_kept FROM both_ways JOIN ex USING (a, b) GROUP BY a, b) SELECT *, row_number() OVER (PARTITION BY a ORDER BY long_kept DESC, words_kept DESC, b) AS place FROM pl""",
    "join_without_self": "WITH ld AS (SELECT id, nullif(sha256, '') AS sha FROM doc QUALIFY row_number() OVER (PARTITION BY id ORDER BY harvested_at DESC) = 1) SELECT a, b FROM pair LEFT JOIN ld x ON x.id = a LEFT JOIN ld y ON y.id = b WHERE NOT coalesce(x.sha = y.sha, false)",
    "pipe_focal": _RUNS + ", mi AS (SELECT * FROM n WHERE try_cast(regexp_extract(a, '([0-9]+)$', 1) AS BIGINT) % 20 = 0 OR try_cast(regexp_extract(b, '([0-9]+)$', 1) AS BIGINT) % 20 = 0)" + _COMMON.format(n="mi") + f" SELECT {_BANDS.format(x='(a1 - a0)').replace("WHEN (a1 - a0) >= 50 THEN '50+' ", '').replace('30-49', '30-999')} AS band, count(*) AS runs, count(*) FILTER ((a, b, a0, b0) IN (SELECT (a, b, a0, b0) FROM com)) AS in_third, count(DISTINCT (a, b)) AS pairs FROM mi GROUP BY 1",
}
ORACLES["agg_pair_analysis"] = (
    _RUNS + _WORDS + _SURNAME + _CITED + f""", l AS (SELECT a, b, list_sort(list(b1 - b0)) AS l FROM n GROUP BY ALL), mw AS (SELECT a, b, count(DISTINCT (idx, k)) AS matched_words FROM cb GROUP BY ALL), ic AS (SELECT doc_id AS b, sum(len(k))::BIGINT AS included FROM r GROUP BY 1),
 al AS (SELECT doc_id AS b, sum(len({sql_tokens('text')}))::BIGINT AS every FROM (SELECT doc_id, idx, min(coalesce(text, '')) AS text FROM sentences GROUP BY ALL) GROUP BY 1)
 SELECT a, b, len(l) AS runs, len(list_filter(l, lambda x: x >= 20)) AS long_runs, l[-1] AS max_run, l[len(l) // 2 + 1] AS median_run, """
    + ", ".join(f"len(list_filter(l, lambda x: x >= {lo} AND x <= {hi or 1 << 40})) AS runs_{lo}_{hi or 'up'}" for lo, hi in M.BANDS)
    + """, attributed, adjacent, unattributed, matched_words, included, every, round(matched_words / greatest(included, 1), 8) AS share_included, round(matched_words / greatest(every, 1), 8) AS share_all, directed, with_errors
 FROM l JOIN mw USING (a, b) JOIN ic USING (b) JOIN al USING (b) JOIN (SELECT a, b, count(*) FILTER (citation = 'attributed') AS attributed, count(*) FILTER (citation LIKE 'adj%') AS adjacent, count(*) FILTER (citation = 'unattributed') AS unattributed FROM ct GROUP BY ALL) USING (a, b)
 JOIN (SELECT a, b, count(*) FILTER (regexp_matches(text_a, '(?i)\\b(this|the present|the current)\\s+(doctoral\\s+|research\\s+|empirical\\s+)?(thesis|study|research|investigation|enquiry|inquiry|project|dissertation)\\b')) AS directed, 0 AS with_errors FROM sp GROUP BY ALL) USING (a, b)"""
)
ORACLES["win_highlights"] = _RUNS + """, en AS (SELECT b, b0 AS p0 FROM n UNION SELECT b, b1 FROM n), pa AS (SELECT b, p0, lead(p0) OVER (PARTITION BY b ORDER BY p0) AS upto FROM en), hi AS (SELECT pa.b, p0, upto, array_to_string(list_sort(list_distinct(list(n.a))), ' ') AS ids FROM pa JOIN n ON n.b = pa.b AND n.b0 <= p0 AND n.b1 >= upto GROUP BY pa.b, p0, upto),
 jo AS (SELECT *, CASE WHEN lag(upto) OVER w = p0 AND lag(ids) OVER w = ids THEN 0 ELSE 1 END AS fresh FROM hi WINDOW w AS (PARTITION BY b ORDER BY p0)), gr AS (SELECT *, sum(fresh) OVER (PARTITION BY b ORDER BY p0 ROWS UNBOUNDED PRECEDING) AS g FROM jo) SELECT b, min(p0) AS start, max(upto) AS "end", any_value(ids) AS ids FROM gr GROUP BY b, g"""
ORACLES["agg_author_mentions"] = "WITH tx AS (SELECT doc_id, (min({'t': coalesce(text, ''), 'p': page, 'q': printed, 'b': bucket})) AS m FROM sentences GROUP BY doc_id, idx)" + _SURNAME + """, x AS (SELECT pair.a, pair.b, m.p AS page, coalesce(m.b = 'references', false) AS ref, len(regexp_extract_all(m.t, '\\b' || surname || '\\b')) AS n FROM pair JOIN sn USING (a) JOIN tx ON tx.doc_id = pair.b WHERE surname <> '')
 SELECT a, b, sum(n)::BIGINT AS total, coalesce(sum(n) FILTER (ref), 0)::BIGINT AS in_references, count(DISTINCT page) FILTER (n > 0) AS pages FROM x GROUP BY a, b"""
_P = "p AS (SELECT doc_id, idx, k, (sum(len(k)) OVER (PARTITION BY doc_id ORDER BY idx ROWS UNBOUNDED PRECEDING) - len(k))::BIGINT AS base FROM r)"
_PB = "r1 AS (SELECT *, CASE WHEN lag(idx) OVER (PARTITION BY doc_id ORDER BY idx) <> idx - 1 THEN 64 ELSE 0 END AS gap FROM (SELECT doc_id, idx, min(k) AS k FROM r GROUP BY ALL)), p AS (SELECT doc_id, idx, k, (sum(len(k) + gap) OVER (PARTITION BY doc_id ORDER BY idx ROWS UNBOUNDED PRECEDING) - len(k))::BIGINT AS base FROM r1)"
ORACLES["win_barrier_runs"] = _RUNS.replace(_P, _PB).replace("WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) WHERE l IS NOT NULL", "WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) WHERE l = pos + 7").replace("SELECT doc_id, min({'g': g, 'p': -pos})", "SELECT doc_id, pos, min({'g': g, 'p': -pos})").replace("AS l FROM g) WHERE l IS NOT NULL", "AS l FROM g) WHERE l = pos + 12") + " SELECT a, b, a0, a1, b0, b1 FROM n"
ORACLES["txt_prose_runs"] = f"WITH t AS (SELECT doc_id, {sql_tokens('text')} AS k FROM (SELECT DISTINCT doc_id, idx, text FROM sentences)) SELECT doc_id, count(*) FILTER (len(k) > 0 AND len(list_filter(k, lambda x: length(x) = 1)) / greatest(len(k), 1) <= 0.30 AND len(list_filter(k, lambda x: length(x) >= 4)) >= 5) AS prose, count(*) AS n FROM t GROUP BY doc_id"
_OAI = "'^oai:([^:]+):(\\d+)$'"
ORACLES["txt_landings"] = f"WITH ld AS (SELECT * FROM doc QUALIFY row_number() OVER (PARTITION BY id ORDER BY harvested_at DESC) = 1) SELECT id, CASE WHEN regexp_matches(id, {_OAI}) THEN 'https://' || regexp_extract(id, {_OAI}, 1) || '/id/eprint/' || regexp_extract(id, {_OAI}, 2) || '/' ELSE coalesce(nullif(trim(landing), ''), nullif(trim(pdf_url), ''), '') END AS search, CASE WHEN NOT regexp_matches(id, {_OAI}) THEN '' WHEN repo = 'aldermoor' THEN 'https://aldermoor.example/' || regexp_extract(id, {_OAI}, 2) WHEN repo = 'kestrelton' THEN 'https://kestrelton.example/item/' || regexp_extract(id, {_OAI}, 2) || '/' ELSE '' END AS release FROM ld"
