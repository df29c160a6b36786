"""Queries of publication checks, sinks' ordering and the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from palimpsest.functions.text import match_tokens
from palimpsest.operators import release as R, streams as S
from palimpsest.plans.runtime import table
from palimpsest.streaming.ingest import event_counts

POLICY = {"id": R.Policy("id", 60), "repo": R.Policy("enum", 20, 1, 20), "title": R.Policy("text", 90, 11), "year": R.Policy("int"), "url": R.Policy("url", 200)}


def release_column_policy(spark: SparkSession, d: str) -> DataFrame:
    return R.column_problems(table(spark, d, "docs"), POLICY)


def release_column_figures(spark: SparkSession, d: str) -> DataFrame:
    return R.column_figures(table(spark, d, "docs"), ["id", "repo", "title", "year", "publisher"])


def release_longest_run(spark: SparkSession, d: str) -> DataFrame:
    """Longest stretch each work title shares with the title of each thesis, of five words or more."""
    words = lambda df, key: df.select(F.col(key).cast("string").alias("doc_id"), F.posexplode(match_tokens(F.col("title"))).alias("pos", "tok")).distinct()
    runs = R.seeded_runs(words(table(spark, d, "work"), "key"), words(table(spark, d, "docs"), "docid"))
    return runs.select("value_id", F.col("doc_id").cast("long").alias("doc_id"), "run")


def release_longest_run_text(spark: SparkSession, d: str) -> DataFrame:
    """Longest stretch each work title shares with the abstract or the sentences of each thesis, of five words or more."""
    v = table(spark, d, "work").select(F.col("key").alias("doc_id"), F.posexplode(match_tokens(F.col("title"))).alias("pos", "tok")).distinct()
    x = table(spark, d, "docs").select(F.col("id").alias("doc_id"), F.posexplode(match_tokens(F.col("abstract"))).alias("pos", "tok")).distinct()
    s = S.token_stream(S.token_rows(table(spark, d, "sentences"))).select("doc_id", "pos", "tok")
    runs = R.seeded_runs(v, x).unionByName(R.seeded_runs(v, s))
    return runs.groupBy("value_id", "doc_id").agg(F.max("run").alias("run"))


def release_verbatim(spark: SparkSession, d: str) -> DataFrame:
    """Published excerpts that repeat retained sentences of theses."""
    return R.verbatim_grams(table(spark, d, "documents"), table(spark, d, "sentences"), "doc_id", "text").select(F.col("doc_id").cast("bigint").alias("doc_id"), "shared")


def release_listing(spark: SparkSession, d: str) -> DataFrame:
    """Files listed by two harvests: missing, unlisted, changed."""
    x = table(spark, d, "doc").where("sha256 is not null")
    listed = x.groupBy(F.col("id").alias("path")).agg(F.min_by("sha256", "harvested_at").alias("sha256"))
    present = x.where("status = 'ok' and year >= 1990").groupBy(F.col("id").alias("path")).agg(F.max_by("sha256", "harvested_at").alias("sha256"))
    return R.compare_listing(listed, present).groupBy("state").agg(F.count("*").alias("n"))


def set_symmetric_difference(spark: SparkSession, d: str) -> DataFrame:
    a, b = table(spark, d, "docs").select("repo"), table(spark, d, "documents").select(F.col("source").alias("repo"))
    return R.set_difference(a.distinct(), b.distinct())


def stream_event_counts(spark: SparkSession, d: str) -> DataFrame:
    return event_counts(table(spark, d, "events")).withColumn("total", F.round("total", 4))


QUERIES = {f.__name__: f for f in (release_column_policy, release_column_figures, release_longest_run, release_longest_run_text, release_verbatim, release_listing, set_symmetric_difference, stream_event_counts)}


def _prob() -> str:
    out = []
    for k, p in POLICY.items():
        kind = f"WHEN NOT regexp_matches({k}::VARCHAR, '{R.KINDS[p.kind]}') THEN 'not {p.kind}' " if p.kind in R.KINDS else ""
        out.append(f"SELECT '{k}' AS \"column\", CASE WHEN coalesce({k}::VARCHAR, '') = '' THEN NULL {kind}WHEN length({k}::VARCHAR) > {p.max_chars} THEN 'too many characters' WHEN len(string_split_regex(trim({k}::VARCHAR), '\\s+')) > {p.max_words} THEN 'too many words' END AS problem FROM docs")
    enums = " UNION ALL ".join(f"SELECT '{k}', 'too many values', count(DISTINCT {k}) FROM docs HAVING count(DISTINCT {k}) > {p.max_distinct}" for k, p in POLICY.items() if p.max_distinct)
    return f'SELECT "column", problem, count(*) AS n FROM ({" UNION ALL ".join(out)}) WHERE problem IS NOT NULL GROUP BY ALL UNION ALL {enums}'


_FIG = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER (coalesce({c}::VARCHAR, '') <> '') AS filled, max(length(coalesce({c}::VARCHAR, ''))) AS max_chars, max(CASE WHEN coalesce({c}::VARCHAR, '') = '' THEN 0 ELSE len(string_split_regex(trim({c}::VARCHAR), '\\s+')) END) AS max_words, count(DISTINCT nullif({c}::VARCHAR, '')) AS \"distinct\" FROM docs" for c in ("id", "repo", "title", "year", "publisher"))
from palimpsest.operators.text_queries import sql_tokens  # noqa: E402

_L8 = ", ".join(f"lead(tok, {i}) OVER w" for i in range(1, 8))
ORACLES = {
    "release_column_policy": _prob(),
    "release_column_figures": _FIG,
    "release_longest_run": f"WITH v0 AS (SELECT key AS value_id, {sql_tokens('title')} AS k FROM work), t0 AS (SELECT docid AS doc_id, {sql_tokens('title')} AS k FROM docs), v AS (SELECT value_id, unnest(k) AS tok, generate_subscripts(k, 1) AS p FROM v0), t AS (SELECT doc_id, unnest(k) AS tok, generate_subscripts(k, 1) AS p FROM t0), m AS (SELECT value_id, doc_id, v.p - t.p AS d, t.p AS pt FROM v JOIN t USING (tok)), i AS (SELECT *, pt - row_number() OVER (PARTITION BY value_id, doc_id, d ORDER BY pt) AS i FROM m), r AS (SELECT value_id, doc_id, count(*) AS run FROM i GROUP BY value_id, doc_id, d, i) SELECT value_id, doc_id, max(run) AS run FROM r GROUP BY ALL HAVING max(run) >= 5",
    "release_verbatim": f"WITH r AS (SELECT DISTINCT doc_id, idx, {sql_tokens('text')} AS k FROM sentences WHERE len(excl) = 0), p AS (SELECT *, sum(len(k)) OVER (PARTITION BY doc_id ORDER BY idx) - len(k) AS base FROM r), t AS (SELECT doc_id, base + generate_subscripts(k, 1) AS pos, unnest(k) AS tok FROM p), g AS (SELECT concat_ws(' ', tok, {_L8}) AS g, lead(tok, 7) OVER w AS l FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY pos)), e0 AS (SELECT doc_id, {sql_tokens('text')} AS k FROM documents), e AS (SELECT doc_id, unnest(k) AS tok, generate_subscripts(k, 1) AS pos FROM e0), h AS (SELECT doc_id, concat_ws(' ', tok, {_L8}) AS g, lead(tok, 7) OVER w AS l FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) SELECT doc_id, count(DISTINCT g) AS shared FROM h WHERE l IS NOT NULL AND g IN (SELECT g FROM g WHERE l IS NOT NULL) GROUP BY doc_id",
    "release_listing": "WITH x AS (SELECT * FROM doc WHERE sha256 IS NOT NULL), a AS (SELECT id, arg_min(sha256, harvested_at) AS sa FROM x GROUP BY id), b AS (SELECT id, arg_max(sha256, harvested_at) AS sb FROM x WHERE status = 'ok' AND year >= 1990 GROUP BY id) SELECT CASE WHEN sb IS NULL THEN 'missing' WHEN sa IS NULL THEN 'unlisted' WHEN sa <> sb THEN 'mismatch' ELSE 'ok' END AS state, count(*) AS n FROM a FULL JOIN b USING (id) GROUP BY 1",
    "set_symmetric_difference": "SELECT repo, 'left' AS side FROM (SELECT repo FROM docs EXCEPT SELECT source FROM documents) UNION ALL SELECT source, 'right' FROM (SELECT source FROM documents EXCEPT SELECT repo FROM docs)",
    "stream_event_counts": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
}
