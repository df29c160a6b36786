"""Queries of the overlap screen over sentences, pair and doc."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from palimpsest.functions.text import run_band
from palimpsest.operators import overlap as O, streams as S
from palimpsest.operators.text_queries import sql_tokens
from palimpsest.plans.runtime import cut, table


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return cut(S.token_rows(table(spark, d, "sentences")), "rows")


def _grams(rows: DataFrame, digest: str) -> DataFrame:
    return S.grams(S.token_stream(rows), O.GRAM, digest)


def _sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("doc_id").agg(F.sum(F.size("toks")).alias("words"))


def _count(rows: DataFrame) -> int:
    return rows.select("doc_id").distinct().count()


def _runs(spark: SparkSession, d: str, digest: str = "xxhash64", whole: bool = False):
    """(token rows, grams, candidates, runs).  Fingerprints, not grams, are written for all records; grams are kept for the
    records of some pair, and of all records only where third ones are asked for (``whole``)."""
    rows = _rows(spark, d)
    every = cut(_grams(rows, digest), "grams") if whole else _grams(rows, digest)
    pairs = cut(O.candidates(cut(S.winnow(every), "fingerprints"), _count(rows)), "candidates")
    met = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    g = every if whole else cut(_grams(rows.join(met, "doc_id", "left_semi"), digest), "grams")
    return rows, g, pairs, cut(O.maximal_runs(O.matches(pairs, g)), "runs")


def win_token_positions(spark: SparkSession, d: str) -> DataFrame:
    return S.token_rows(table(spark, d, "sentences")).select("doc_id", "idx", "base", F.size("toks").alias("n"))


def win_winnow_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return S.winnow(_grams(S.token_rows(table(spark, d, "sentences")), "md5")).groupBy("doc_id").agg(F.count("*").alias("fingerprints"), F.min("g").alias("least"), F.max("g").alias("most"))


def join_fp_candidates(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d)
    return O.candidates(cut(S.winnow(_grams(rows, "md5")), "fingerprints"), _count(rows))


QUERY_SET = r"try_cast(regexp_extract(doc_id, '([0-9]+)$', 1) AS BIGINT) % 20 = 0"


def join_query_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """One-to-many screen: theses with an id number divisible by 20 as queries against all, common phrases left out."""
    rows = _rows(spark, d)
    fp = cut(S.winnow(_grams(rows, "md5")), "fingerprints")
    return O.query_candidates(fp.where(QUERY_SET), fp, _count(rows))


def win_exact_runs(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d, "md5")[3]


def agg_pair_summary(spark: SparkSession, d: str) -> DataFrame:
    rows, _, _, runs = _runs(spark, d, "md5")
    return O.pair_summary(runs, _sizes(rows)).withColumn("share", F.round("share", 8))


def agg_run_bands(spark: SparkSession, d: str) -> DataFrame:
    runs = _runs(spark, d, "md5")[3]
    return runs.groupBy(run_band(F.col("a1") - F.col("a0")).alias("band")).agg(F.count("*").alias("runs"), F.max(F.col("a1") - F.col("a0")).alias("longest"))


def join_third_document(spark: SparkSession, d: str) -> DataFrame:
    _, g, _, runs = _runs(spark, d, "md5", whole=True)
    return O.common_runs(runs, g)


def pipe_rescore(spark: SparkSession, d: str) -> DataFrame:
    """Figures of the pairs again, over runs that read as prose."""
    rows, _, _, runs = _runs(spark, d, "md5")
    return O.pair_summary(O.prose_runs(runs, S.token_stream(rows)), _sizes(rows)).withColumn("share", F.round("share", 8))


def pipe_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Verdict of every screened pair: unique runs are those no third record explains."""
    rows, g, pairs, runs = _runs(spark, d, "md5", whole=True)
    prose = O.prose_runs(runs, S.token_stream(rows))
    uniq = prose.join(O.common_runs(prose, g), ["a", "b", "a0", "b0"], "left_anti")
    fig = uniq.groupBy("a", "b").agg(F.count("*").alias("unique_runs"), F.max(F.col("a1") - F.col("a0")).alias("unique_max_run"))
    x = O.same_people(pairs.select("a", "b"), table(spark, d, "doc")).join(fig, ["a", "b"], "left").fillna(0, ["unique_runs", "unique_max_run"])
    return x.withColumn("verdict", O.verdict(F.col("same_author"), F.col("title_sim"), F.col("unique_runs"), F.col("unique_max_run")))


def pipe_selfcheck(spark: SparkSession, d: str) -> DataFrame:
    """Partners of every thesis with an id number divisible by 20, most long runs and shared words first, with a fate per pair."""
    v = pipe_verdicts(spark, d)
    both = v.unionByName(v.select(F.col("b").alias("a"), F.col("a").alias("b"), *v.columns[2:]))
    mine = both.withColumn("doc_id", F.col("a")).where(QUERY_SET)
    w = Window.partitionBy("a").orderBy(F.desc("unique_max_run"), F.desc("unique_runs"), "b")
    return mine.select("a", "b", "unique_runs", "unique_max_run", "verdict", F.row_number().over(w).alias("place"))


def agg_screen_distribution(spark: SparkSession, d: str) -> DataFrame:
    """Stored pairs by band of their longest run, the zero-run remainder of all n(n-1)/2 included."""
    p = table(spark, d, "pair").where("max_run is not null")
    n = table(spark, d, "doc").where("status = 'ok'").select("id").distinct().count()
    bands = p.groupBy(run_band(F.col("max_run")).alias("band")).agg(F.count("*").alias("pairs"))
    rest = p.agg((F.lit(n * (n - 1) // 2) - F.count("*")).alias("pairs")).select(F.lit("(not stored)").alias("band"), "pairs")
    return bands.unionByName(rest)


def agg_partner_baseline(spark: SparkSession, d: str) -> DataFrame:
    """Partners per usable thesis, zeros included: mean and percentiles by index."""
    p = table(spark, d, "pair").where("max_run >= 8")
    ids = p.select(F.col("a").alias("id")).unionByName(p.select(F.col("b").alias("id")))
    n = table(spark, d, "doc").where("status = 'ok'").select("id").distinct().join(ids.groupBy("id").agg(F.count("*").alias("k")), "id", "left").fillna(0, ["k"])
    # how many theses have each count, then the running total: no global sort of theses
    hist = n.groupBy("k").agg(F.count("*").alias("c"))
    w = Window.orderBy("k")
    h = hist.withColumn("upto", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy()))
    pick = lambda q: F.min(F.when(F.col("upto") > F.least(F.col("n") - 1, F.floor(F.lit(q) * F.col("n"))), F.col("k"))).alias(f"p{int(q * 100)}")
    return h.agg(F.max("n").alias("theses"), F.round(F.sum(F.col("k") * F.col("c")) / F.max("n"), 6).alias("mean"), pick(0.5), pick(0.9), pick(0.99))


def agg_percentile_of(spark: SparkSession, d: str) -> DataFrame:
    """Share of stored pairs with at most this share, in per cent."""
    p = table(spark, d, "pair").where("share is not null")
    # counts per value, then running totals: within a cell, and over the 1,001 cells
    hist = p.groupBy("share").agg(F.count("*").alias("c")).withColumn("cell", F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), "share")) * 1000))
    inner = hist.withColumn("upto", F.sum("c").over(Window.partitionBy("cell").orderBy("share")))
    cells = hist.groupBy("cell").agg(F.sum("c").alias("m"))
    cells = cells.select("cell", (F.sum("m").over(Window.orderBy("cell")) - F.col("m")).alias("before"), F.sum("m").over(Window.partitionBy()).alias("n"))
    at = inner.join(F.broadcast(cells), "cell").select("share", F.round(100 * (F.col("before") + F.col("upto")) / F.col("n"), 6).alias("percentile"))
    return p.join(at, "share").select("a", "b", "percentile")


def top_pairs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pair").where("max_run is not null").orderBy(F.desc("max_run"), F.desc("runs"), "a", "b").limit(15).select("a", "b", "max_run", "runs")


def graph_reuse_edges(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pair").where("clean_max_run >= 9 and a_tokens >= 200 and b_tokens >= 200")
    return p.orderBy(F.desc("clean_max_run"), "a", "b").limit(600).select("a", "b", "clean_max_run")


def set_involved(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pair")
    return p.select(F.col("a").alias("id")).unionByName(p.select(F.col("b").alias("id"))).distinct()


def win_interval_union(spark: SparkSession, d: str) -> DataFrame:
    """Words of b covered by the runs of each pair."""
    return O.union_length(_runs(spark, d, "md5")[3], ["a", "b"], "b0", "b1")


QUERIES = {f.__name__: f for f in (win_token_positions, win_winnow_fingerprints, join_fp_candidates, join_query_fingerprints, win_exact_runs, agg_pair_summary, agg_run_bands, join_third_document, pipe_rescore, pipe_verdicts, pipe_selfcheck, agg_screen_distribution, agg_partner_baseline, agg_percentile_of, top_pairs, graph_reuse_edges, set_involved, win_interval_union)}

_CTE = f"""WITH r AS (SELECT DISTINCT doc_id, idx, {sql_tokens('text')} AS k FROM sentences WHERE len(excl) = 0),
p AS (SELECT doc_id, idx, k, (sum(len(k)) OVER (PARTITION BY doc_id ORDER BY idx ROWS UNBOUNDED PRECEDING) - len(k))::BIGINT AS base FROM r),
t AS (SELECT doc_id, base + generate_subscripts(k, 1) - 1 AS pos, unnest(k) AS tok FROM p),
g AS (SELECT * FROM (SELECT doc_id, pos, md5(concat_ws(' ', tok, {', '.join(f'lead(tok, {i}) OVER w' for i in range(1, 8))})) AS g, lead(pos, 7) OVER w AS l FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) WHERE l IS NOT NULL),
f AS (SELECT DISTINCT doc_id, m.g AS g FROM (SELECT doc_id, min({{'g': g, 'p': -pos}}) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS m, lead(pos, 12) OVER (PARTITION BY doc_id ORDER BY pos) AS l FROM g) WHERE l IS NOT NULL),
u AS (SELECT g FROM f GROUP BY g HAVING count(*) BETWEEN 2 AND greatest(3, floor((SELECT count(DISTINCT doc_id) FROM r) * 0.004))),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM f x JOIN u USING (g) JOIN f y USING (g) WHERE x.doc_id < y.doc_id GROUP BY ALL HAVING count(*) >= 3)"""
_RUNS = _CTE + """, ga AS (SELECT *, row_number() OVER (PARTITION BY doc_id, g ORDER BY pos) AS rank FROM g),
m AS (SELECT c.a, c.b, x.pos AS pa, y.pos AS pb, x.rank FROM c JOIN ga x ON x.doc_id = c.a JOIN g y ON y.doc_id = c.b AND y.g = x.g),
i AS (SELECT *, pb - row_number() OVER (PARTITION BY a, b, pa - pb ORDER BY pb) AS i FROM m),
q AS (SELECT a, b, min(pa) AS a0, max(pa) + 8 AS a1, min(pb) AS b0, max(pb) + 8 AS b1 FROM i GROUP BY a, b, pa - pb, i HAVING min(rank) <= 40),
n AS (SELECT * FROM q WHERE NOT EXISTS (SELECT 1 FROM q o WHERE o.a = q.a AND o.b = q.b AND o.a0 <= q.a0 AND o.a1 >= q.a1 AND o.b0 <= q.b0 AND o.b1 >= q.b1 AND o.a1 - o.a0 > q.a1 - q.a0))"""
_SUM = """, e AS (SELECT a, b, unnest(range(b0::BIGINT, b1::BIGINT)) AS w FROM {n}), v AS (SELECT a, b, count(DISTINCT w) AS matched_words FROM e GROUP BY ALL), z AS (SELECT doc_id AS b, sum(len(k)) AS words FROM r GROUP BY doc_id)"""
_COMMON = """, need AS (SELECT DISTINCT n.a, n.b, n.a0, n.b0, g.g FROM {n} n JOIN g ON g.doc_id = n.b AND g.pos BETWEEN n.b0 AND n.b1 - 8),
tot AS (SELECT a, b, a0, b0, count(*) AS need FROM need GROUP BY ALL), got AS (SELECT a, b, a0, b0, o.doc_id AS c, count(DISTINCT need.g) AS got FROM need JOIN g o ON o.g = need.g WHERE o.doc_id NOT IN (a, b) GROUP BY ALL),
com AS (SELECT DISTINCT a, b, a0, b0 FROM got JOIN tot USING (a, b, a0, b0) WHERE got = need)"""
_PROSE = """, pt AS (SELECT n.a, n.b, n.a0, n.a1, n.b0, n.b1, list(t.tok) AS k FROM n JOIN t ON t.doc_id = n.b AND t.pos >= n.b0 AND t.pos < n.b1 GROUP BY ALL),
pr AS (SELECT a, b, a0, a1, b0, b1 FROM pt WHERE len(list_filter(k, lambda x: length(x) = 1)) / len(k) <= 0.30 AND len(list_filter(k, lambda x: length(x) >= 4)) >= least(5, greatest(2, round_even(len(k) * 5 / 20, 0))))"""
_FIG = "SELECT a, b, count(*) AS runs, count(*) FILTER (a1 - a0 >= 20) AS long_runs, max(a1 - a0) AS max_run, any_value(matched_words) AS matched_words, round(any_value(matched_words) / greatest(any_value(words), 1), 8) AS share FROM {n} JOIN v USING (a, b) JOIN z USING (b) GROUP BY a, b"
_BANDS = "CASE WHEN {x} >= 50 THEN '50+' WHEN {x} >= 30 THEN '30-49' WHEN {x} >= 20 THEN '20-29' WHEN {x} >= 16 THEN '16-19' WHEN {x} >= 12 THEN '12-15' WHEN {x} >= 8 THEN '8-11' ELSE 'no match' END"

ORACLES = {
    "win_token_positions": _CTE + " SELECT doc_id, idx, base, len(k) AS n FROM p",
    "win_winnow_fingerprints": _CTE + " SELECT doc_id, count(*) AS fingerprints, min(g) AS least, max(g) AS most FROM f GROUP BY doc_id",
    "join_fp_candidates": _CTE + " SELECT a, b, shared FROM c",
    "join_query_fingerprints": _CTE + " SELECT x.doc_id AS q, y.doc_id AS doc_id, count(*) AS shared FROM f x JOIN f y USING (g) JOIN u USING (g) WHERE try_cast(regexp_extract(x.doc_id, '([0-9]+)$', 1) AS BIGINT) % 20 = 0 AND x.doc_id <> y.doc_id GROUP BY ALL HAVING count(*) >= 3",
    "win_exact_runs": _RUNS + " SELECT a, b, a0, a1, b0, b1 FROM n",
    "agg_pair_summary": _RUNS + _SUM.format(n="n") + " " + _FIG.format(n="n"),
    "win_interval_union": _RUNS + _SUM.format(n="n") + " SELECT a, b, matched_words AS covered FROM v",
    "agg_run_bands": _RUNS + f" SELECT {_BANDS.format(x='(a1 - a0)')} AS band, count(*) AS runs, max(a1 - a0) AS longest FROM n GROUP BY 1",
    "join_third_document": _RUNS + _COMMON.format(n="n") + " SELECT * FROM com",
    "pipe_rescore": _RUNS + _PROSE + _SUM.format(n="pr") + " " + _FIG.format(n="pr"),
    "agg_screen_distribution": f"SELECT {_BANDS.format(x='max_run')} AS band, count(*) AS pairs FROM pair WHERE max_run IS NOT NULL GROUP BY 1 UNION ALL SELECT '(not stored)', (SELECT count(DISTINCT id) * (count(DISTINCT id) - 1) // 2 FROM doc WHERE status = 'ok') - count(*) FROM pair WHERE max_run IS NOT NULL",
    "agg_partner_baseline": "WITH i AS (SELECT a AS id FROM pair WHERE max_run >= 8 UNION ALL SELECT b FROM pair WHERE max_run >= 8), k AS (SELECT d.id, count(i.id) AS k FROM (SELECT DISTINCT id FROM doc WHERE status = 'ok') d LEFT JOIN i USING (id) GROUP BY d.id), l AS (SELECT list_sort(list(k)) AS l, count(*) AS n, avg(k) AS m FROM k) SELECT n AS theses, round(m, 6) AS mean, l[least(n - 1, floor(0.5 * n))::INT + 1] AS p50, l[least(n - 1, floor(0.9 * n))::INT + 1] AS p90, l[least(n - 1, floor(0.99 * n))::INT + 1] AS p99 FROM l",
    "agg_percentile_of": "SELECT a, b, round(100 * cume_dist() OVER (ORDER BY share), 6) AS percentile FROM pair WHERE share IS NOT NULL",
    "top_pairs": "SELECT a, b, max_run, runs FROM pair WHERE max_run IS NOT NULL ORDER BY max_run DESC, runs DESC, a, b LIMIT 15",
    "graph_reuse_edges": "SELECT a, b, clean_max_run FROM pair WHERE clean_max_run >= 9 AND a_tokens >= 200 AND b_tokens >= 200 ORDER BY clean_max_run DESC, a, b LIMIT 600",
    "set_involved": "SELECT a AS id FROM pair UNION SELECT b FROM pair",
}
