"""Citation graph queries over cite, doc, srcstat and docs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from palimpsest.operators import graph as G
from palimpsest.plans.runtime import cut, table


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return G.edges(table(spark, d, "cite"))


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return G.latest(table(spark, d, "doc"))


def _fields(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "docs").select(F.col("id").alias("src"), F.lower(F.trim("discipline")).alias("field"))
    return x.where("field <> '' and field <> 'unknown'")


def _fc(spark: SparkSession, d: str) -> DataFrame:
    return cut(G.field_citers(_edges(spark, d), _fields(spark, d)), "field_citers")


def agg_top_works(spark: SparkSession, d: str) -> DataFrame:
    return G.top_works(_edges(spark, d))


def join_cites_docs(spark: SparkSession, d: str) -> DataFrame:
    """Citations and distinct works per discipline, by inner join on the citing thesis."""
    x = _edges(spark, d).join(_docs(spark, d).select(F.col("id").alias("src"), "repo"), "src")
    return x.groupBy("repo").agg(F.count("*").alias("edges"), F.count_distinct("surname", "year").alias("works"))


def agg_age_histogram(spark: SparkSession, d: str) -> DataFrame:
    a = G.age_edges(_edges(spark, d), _docs(spark, d)).where("reason is null")
    band = F.when(F.col("age") <= 2, "0-2").when(F.col("age") <= 5, "3-5").when(F.col("age") <= 10, "6-10").when(F.col("age") <= 20, "11-20").when(F.col("age") <= 50, "21-50").otherwise("51+")
    h = a.groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.min("age").alias("from_age"))
    return h.withColumn("cum_pct", F.round(100 * F.sum("n").over(Window.orderBy("from_age")) / F.sum("n").over(Window.partitionBy()), 6)).drop("from_age")


def age_dropped(spark: SparkSession, d: str) -> DataFrame:
    return G.age_edges(_edges(spark, d), _docs(spark, d)).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def age_per_thesis(spark: SparkSession, d: str) -> DataFrame:
    a = G.age_edges(_edges(spark, d), _docs(spark, d)).where("reason is null")
    return a.groupBy("src").agg(F.count("*").alias("n"), F.percentile("age", F.lit(0.5)).alias("median_age"), F.round(100 * F.count_if(F.col("age") <= 5) / F.count("*"), 6).alias("price"), F.round(100 * F.count_if(F.col("age") > 20) / F.count("*"), 6).alias("old"))


def age_by_field(spark: SparkSession, d: str) -> DataFrame:
    a = G.age_edges(_edges(spark, d), _docs(spark, d)).where("reason is null").join(_fields(spark, d), "src")
    c = G.cumulative_ages(a, ["field"])
    return c.groupBy("field").agg(F.max("total").alias("n"), G.first_age_at(0.25).alias("p25"), G.first_age_at(0.5).alias("p50"), G.first_age_at(0.75).alias("p75"), G.first_age_at(0.9).alias("p90"), F.round(G.half_life(), 6).alias("half_life"))


def age_trend(spark: SparkSession, d: str) -> DataFrame:
    """Slope per decade of the mean age over five-year bands of thesis years, weighted by edges."""
    a = G.age_edges(_edges(spark, d), _docs(spark, d)).where("reason is null").join(_fields(spark, d), "src")
    b = a.groupBy("field", (F.floor(F.col("doc_year") / 5) * 5).alias("band")).agg(F.count("*").alias("n"), F.avg("age").alias("mean_age"))
    x, y, w = F.col("band").cast("double"), F.col("mean_age"), F.col("n").cast("double")
    return b.groupBy("field").agg(F.count("*").alias("bands"), F.round(10 * G.weighted_slope(x - 2000, y, w), 4).alias("slope_per_decade"))


def agg_parse_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Reference words, entries and parsed references by field; estimated recall at 30 words an entry."""
    s = table(spark, d, "srcstat").join(_fields(spark, d), "src", "left")
    g = s.groupBy(F.coalesce("field", F.lit("(none)")).alias("field")).agg(F.count("*").alias("theses"), F.count_if(F.col("ref_words") > 0).alias("with_refs"), F.sum("ref_words").alias("ref_words"), F.sum(F.coalesce("entries", F.lit(0))).alias("entries"), F.sum(F.coalesce("parsed", F.lit(0))).alias("parsed"))
    return g.withColumn("parse_pct", F.round(100 * F.col("parsed") / F.nullif("entries", F.lit(0)), 6)).withColumn("est_recall", F.round(F.col("parsed") / F.nullif(F.col("ref_words") / 30, F.lit(0.0)), 6))


def join_stat_left(spark: SparkSession, d: str) -> DataFrame:
    """Usable theses with their parse figures, zero where there are none."""
    x = _docs(spark, d).where("status = 'ok'").select("id", "repo").join(table(spark, d, "srcstat").withColumnRenamed("src", "id"), "id", "left")
    return x.groupBy("repo").agg(F.count("*").alias("theses"), F.coalesce(F.sum("parsed"), F.lit(0)).alias("parsed"), F.count_if(F.col("parsed").isNull()).alias("without"))


def canon_field_works(spark: SparkSession, d: str) -> DataFrame:
    """Ten most cited works of each field, with the share of the field's citing theses."""
    fc = _fc(spark, d)
    n = _edges(spark, d).select("src").distinct().join(_fields(spark, d), "src").groupBy("field").agg(F.count("*").alias("theses"))
    w = Window.partitionBy("field").orderBy(F.desc("n"), "surname", "year")
    x = fc.withColumn("place", F.row_number().over(w)).where("place <= 10").join(n, "field")
    return x.select("field", "place", "surname", "year", "n", F.round(100 * F.col("n") / F.col("theses"), 6).alias("pct"))


def canon_top_field(spark: SparkSession, d: str) -> DataFrame:
    return G.top_field(_fc(spark, d)).withColumn("share", F.round(F.col("n") / F.col("total"), 6))


def cite_distinct_counts(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d)
    return e.agg(F.count("*").alias("edges"), F.count_distinct("surname", "year").alias("works"), F.count_distinct("src").alias("citers"))


def graph_cocitation(spark: SparkSession, d: str) -> DataFrame:
    return G.cocitation(_edges(spark, d))


def graph_shared_literature(spark: SparkSession, d: str) -> DataFrame:
    fc = _fc(spark, d).select(F.col("field").alias("node"), "surname", "year")
    return G.shared_literature(fc, 20).withColumn("jaccard", F.round("jaccard", 4))


def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Node table of the field graph: theses and works per field."""
    e = _edges(spark, d).join(_fields(spark, d), "src")
    return e.groupBy("field").agg(F.count_distinct("src").alias("theses"), F.count_distinct("surname", "year").alias("works"))


def bridge_works(spark: SparkSession, d: str) -> DataFrame:
    return G.bridges(_fc(spark, d))


def bridge_field_lift(spark: SparkSession, d: str) -> DataFrame:
    x = G.field_pair_lift(_fc(spark, d))
    return x.select("f", "g", "works", F.round("expected", 4).alias("expected"), F.round("lift", 4).alias("lift"))


def bridge_reach_bands(spark: SparkSession, d: str) -> DataFrame:
    fc = _fc(spark, d).groupBy("surname", "year").agg(F.count("*").alias("reach"), F.sum("n").alias("citers"))
    band = F.when(F.col("reach") >= 9, "9-16").when(F.col("reach") >= 5, "5-8").when(F.col("reach") >= 3, "3-4").otherwise("1-2")
    return fc.groupBy(band.alias("band")).agg(F.count("*").alias("works"), F.sum("citers").alias("citers"))


def flow_matrix(spark: SparkSession, d: str) -> DataFrame:
    fc = _fc(spark, d)
    x = G.flow(fc, G.placements(fc))
    return x.select("citing", "home", "citers", "works", *[F.round(c, 4).alias(c) for c in ("expected", "lift", "lower")])


def flow_placements(spark: SparkSession, d: str) -> DataFrame:
    return G.placements(_fc(spark, d)).groupBy("kind").agg(F.count("*").alias("works"), F.sum("total").alias("citers"))


def flow_imports_stability(spark: SparkSession, d: str) -> DataFrame:
    """Fields imported from above chance, under four settings; how many settings agree."""
    fc = _fc(spark, d)
    each = []
    for k, (strict, least) in enumerate([(True, 3), (True, 5), (False, 3), (False, 5)]):
        f = G.flow(fc, G.placements(fc, strict, least)).where("lower > 1 and citing <> home")
        each.append(f.select("citing", "home", F.lit(k).alias("setting")))
    return reduce(DataFrame.unionByName, each).groupBy("citing", "home").agg(F.count("*").alias("settings"))


def top_exemplars(spark: SparkSession, d: str) -> DataFrame:
    """Eight longest theses of each discipline, of which those with a file are shown (limit before filter)."""
    x = _docs(spark, d).where("status = 'ok'").select("id", "repo", "words", "pdf_url")
    w = Window.partitionBy("repo").orderBy(F.desc_nulls_last("words"), "id")
    return x.withColumn("rn", F.row_number().over(w)).where("rn <= 8 and pdf_url <> ''").select("repo", "id", "words", "rn")


def set_citing_difference(spark: SparkSession, d: str) -> DataFrame:
    """Citing ids that are no thesis of the harvest."""
    return table(spark, d, "cite").select("src").where("src is not null").subtract(table(spark, d, "doc").select("id"))


QUERIES = {f.__name__: f for f in (agg_top_works, join_cites_docs, agg_age_histogram, age_dropped, age_per_thesis, age_by_field, age_trend, agg_parse_coverage, join_stat_left, canon_field_works, canon_top_field, cite_distinct_counts, graph_cocitation, graph_shared_literature, graph_nodes, bridge_works, bridge_field_lift, bridge_reach_bands, flow_matrix, flow_placements, flow_imports_stability, top_exemplars, set_citing_difference)}

_E = """WITH e AS (SELECT DISTINCT src, lower(trim(surname)) AS surname, year FROM cite WHERE src IS NOT NULL AND trim(surname) <> '' AND year IS NOT NULL),
dl AS (SELECT * FROM doc WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY coalesce(harvested_at, TIMESTAMP '1970-01-01') DESC, coalesce(title, '') DESC) = 1),
fl AS (SELECT id AS src, lower(trim(discipline)) AS field FROM docs WHERE trim(discipline) <> '' AND lower(trim(discipline)) <> 'unknown'),
fc AS (SELECT field, surname, year, count(*) AS n FROM e JOIN fl USING (src) GROUP BY ALL),
ag AS (SELECT e.*, dl.year AS doc_year, dl.year - e.year AS age, CASE WHEN dl.year IS NULL THEN 'no thesis year' WHEN dl.year NOT BETWEEN 1900 AND 2026 THEN 'thesis year out of range' WHEN dl.year - e.year < 0 THEN 'negative age' WHEN dl.year - e.year > 120 THEN 'too old' END AS reason FROM e JOIN dl ON dl.id = e.src)"""
_TOP = _E + ", tf AS (SELECT surname, year, field, n, sum(n) OVER w AS total, count(*) OVER w AS fields, row_number() OVER (PARTITION BY surname, year ORDER BY n DESC, field) AS rn FROM fc WINDOW w AS (PARTITION BY surname, year))"


def _pl(name: str, strict: bool, least: int) -> str:
    p = "(n - 1)::DOUBLE / greatest(total - 1, 1)" if strict else "n::DOUBLE / total"
    return f", {name} AS (SELECT *, CASE WHEN total < {least} THEN 'thin' WHEN {p} >= 0.5 THEN 'placed' WHEN fields >= 8 THEN 'universal' WHEN fields >= 3 THEN 'bridging' ELSE 'unplaced' END AS kind FROM tf WHERE rn = 1)"


def _fw(name: str, pl: str) -> str:
    return f""", {name}0 AS (SELECT fc.field AS citing, p.field AS home, sum(fc.n) AS citers, count(*) AS works FROM fc JOIN {pl} p USING (surname, year) WHERE kind = 'placed' GROUP BY ALL),
 {name}1 AS (SELECT *, (sum(citers) OVER (PARTITION BY citing) * sum(citers) OVER (PARTITION BY home))::DOUBLE / sum(citers) OVER () AS expected FROM {name}0),
 {name} AS (SELECT *, citers / expected AS lift, pow(1 - 1 / (9 * works::DOUBLE) - 1.96 / (3 * sqrt(works::DOUBLE)), 3) * (citers / expected) AS lower FROM {name}1)"""


_SETS = [("p0", True, 3), ("p1", True, 5), ("p2", False, 3), ("p3", False, 5)]
ORACLES = {
    "agg_top_works": _E + " SELECT surname, year, count(*) AS citers FROM e GROUP BY ALL HAVING count(*) > 1",
    "join_cites_docs": _E + " SELECT repo, count(*) AS edges, count(DISTINCT (surname, e.year)) AS works FROM e JOIN dl ON dl.id = e.src GROUP BY repo",
    "agg_age_histogram": _E + ", b AS (SELECT CASE WHEN age <= 2 THEN '0-2' WHEN age <= 5 THEN '3-5' WHEN age <= 10 THEN '6-10' WHEN age <= 20 THEN '11-20' WHEN age <= 50 THEN '21-50' ELSE '51+' END AS band, count(*) AS n, min(age) AS f FROM ag WHERE reason IS NULL GROUP BY 1) SELECT band, n, round(100 * sum(n) OVER (ORDER BY f) / sum(n) OVER (), 6) AS cum_pct FROM b",
    "age_dropped": _E + " SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM ag GROUP BY 1",
    "age_per_thesis": _E + " SELECT src, count(*) AS n, quantile_cont(age, 0.5) AS median_age, round(100 * count(*) FILTER (age <= 5) / count(*), 6) AS price, round(100 * count(*) FILTER (age > 20) / count(*), 6) AS old FROM ag WHERE reason IS NULL GROUP BY src",
    "age_by_field": _E + ", h AS (SELECT field, age, count(*) AS n FROM ag JOIN fl USING (src) WHERE reason IS NULL GROUP BY ALL), c AS (SELECT *, sum(n) OVER (PARTITION BY field ORDER BY age) AS upto, sum(n) OVER (PARTITION BY field) AS total FROM h) SELECT field, max(total)::BIGINT AS n, min(age) FILTER (upto >= 0.25 * total) AS p25, min(age) FILTER (upto >= 0.5 * total) AS p50, min(age) FILTER (upto >= 0.75 * total) AS p75, min(age) FILTER (upto >= 0.9 * total) AS p90, round(min(age + (total / 2 - (upto - n)) / n - 0.5) FILTER (upto >= total / 2 AND upto - n < total / 2), 6) AS half_life FROM c GROUP BY field",
    "age_trend": _E + ", b AS (SELECT field, floor(doc_year / 5) * 5 - 2000 AS x, count(*)::DOUBLE AS w, avg(age) AS y FROM ag JOIN fl USING (src) WHERE reason IS NULL GROUP BY ALL) SELECT field, count(*) AS bands, round(CASE WHEN count(*) >= 3 THEN 10 * (sum(w) * sum(w * x * y) - sum(w * x) * sum(w * y)) / nullif(sum(w) * sum(w * x * x) - sum(w * x) * sum(w * x), 0) END, 4) AS slope_per_decade FROM b GROUP BY field",
    "agg_parse_coverage": _E + ", g AS (SELECT coalesce(field, '(none)') AS field, count(*) AS theses, count(*) FILTER (ref_words > 0) AS with_refs, sum(ref_words)::BIGINT AS ref_words, sum(coalesce(entries, 0))::BIGINT AS entries, sum(coalesce(parsed, 0))::BIGINT AS parsed FROM srcstat LEFT JOIN fl USING (src) GROUP BY 1) SELECT *, round(100 * parsed / nullif(entries, 0), 6) AS parse_pct, round(parsed / nullif(ref_words / 30, 0), 6) AS est_recall FROM g",
    "join_stat_left": _E + " SELECT repo, count(*) AS theses, coalesce(sum(parsed), 0)::BIGINT AS parsed, count(*) FILTER (parsed IS NULL) AS without FROM dl LEFT JOIN srcstat ON srcstat.src = dl.id WHERE status = 'ok' GROUP BY repo",
    "canon_field_works": _E + ", t AS (SELECT field, count(*) AS theses FROM (SELECT DISTINCT src FROM e) JOIN fl USING (src) GROUP BY field), r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, surname, year) AS place FROM fc) SELECT field, place, surname, year, n, round(100 * n / theses, 6) AS pct FROM r JOIN t USING (field) WHERE place <= 10",
    "canon_top_field": _TOP + " SELECT surname, year, field, n, total::BIGINT AS total, fields, round(n / total, 6) AS share FROM tf WHERE rn = 1",
    "cite_distinct_counts": _E + " SELECT count(*) AS edges, count(DISTINCT (surname, year)) AS works, count(DISTINCT src) AS citers FROM e",
    "graph_cocitation": _E + ", b AS (SELECT surname, year FROM e GROUP BY ALL ORDER BY count(*) DESC, surname, year LIMIT 260), x AS (SELECT src, surname, year FROM e JOIN b USING (surname, year)) SELECT x.surname AS surname_1, x.year AS year_1, y.surname AS surname_2, y.year AS year_2, count(*) AS weight FROM x JOIN x y USING (src) WHERE (x.surname, x.year) < (y.surname, y.year) GROUP BY ALL HAVING count(*) >= 12",
    "graph_shared_literature": _E + ", z AS (SELECT field, count(*) AS k FROM fc GROUP BY field) SELECT a.field AS s, b.field AS t, count(*) AS shared, round(count(*) / (any_value(x.k) + any_value(y.k) - count(*)), 4) AS jaccard FROM fc a JOIN fc b USING (surname, year) JOIN z x ON x.field = a.field JOIN z y ON y.field = b.field WHERE a.field < b.field GROUP BY ALL HAVING count(*) >= 20",
    "graph_nodes": _E + " SELECT field, count(DISTINCT src) AS theses, count(DISTINCT (surname, year)) AS works FROM e JOIN fl USING (src) GROUP BY field",
    "bridge_works": _E + " SELECT surname, year, sum(n)::BIGINT AS citers, count(*) AS fields, count(*) FILTER (n >= 2) AS sides FROM fc GROUP BY ALL HAVING sum(n) <= 150 AND sides >= 2 AND fields <= 6",
    "bridge_field_lift": _E + ", z AS (SELECT field, count(*) AS k FROM fc GROUP BY field), w AS (SELECT count(DISTINCT (surname, year)) AS n FROM fc), q AS (SELECT a.field AS f, b.field AS g, count(*) AS works FROM fc a JOIN fc b USING (surname, year) WHERE a.field < b.field GROUP BY ALL) SELECT f, g, works, round(x.k * y.k / w.n, 4) AS expected, round(works / (x.k * y.k / w.n), 4) AS lift FROM q JOIN z x ON x.field = f JOIN z y ON y.field = g, w",
    "bridge_reach_bands": _E + ", r AS (SELECT surname, year, count(*) AS reach, sum(n) AS citers FROM fc GROUP BY ALL) SELECT CASE WHEN reach >= 9 THEN '9-16' WHEN reach >= 5 THEN '5-8' WHEN reach >= 3 THEN '3-4' ELSE '1-2' END AS band, count(*) AS works, sum(citers)::BIGINT AS citers FROM r GROUP BY 1",
    "flow_matrix": _TOP + _pl("p0", True, 3) + _fw("f0", "p0") + " SELECT citing, home, citers::BIGINT AS citers, works, round(expected, 4) AS expected, round(lift, 4) AS lift, round(lower, 4) AS lower FROM f0",
    "flow_placements": _TOP + _pl("p0", True, 3) + " SELECT kind, count(*) AS works, sum(total)::BIGINT AS citers FROM p0 GROUP BY kind",
    "flow_imports_stability": _TOP + "".join(_pl(*s) for s in _SETS) + "".join(_fw(f"f{i}", f"p{i}") for i in range(4)) + ", u AS (" + " UNION ALL ".join(f"SELECT citing, home FROM f{i} WHERE lower > 1 AND citing <> home" for i in range(4)) + ") SELECT citing, home, count(*) AS settings FROM u GROUP BY ALL",
    "top_exemplars": _E + " SELECT repo, id, words, rn FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY words DESC NULLS LAST, id) AS rn FROM dl WHERE status = 'ok') WHERE rn <= 8 AND pdf_url <> ''",
    "set_citing_difference": "SELECT src FROM cite WHERE src IS NOT NULL EXCEPT SELECT id FROM doc",
}
