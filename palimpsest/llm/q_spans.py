"""Problem 3: passages that theses repeat word for word."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import spans
from palimpsest.plans.runtime import cut, table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.sharing_pairs(cut(spans.shared_windows(table(spark, sf_dir, "sentences")), "shared"))


def _placed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sentences = table(spark, sf_dir, "sentences")
    rows = spans.word_rows(sentences)
    return rows, cut(spans.placed(spans.shared_windows(sentences), rows), "placed")


def p3_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.pair_figures(*_placed(spark, sf_dir))


def p3_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_per_record(*_placed(spark, sf_dir))


def p3_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.removable_spans(cut(spans.shared_windows(table(spark, sf_dir, "sentences")), "shared"))


QUERIES = {"p3_found": p3_found, "p3_pairs": p3_pairs, "p3_share": p3_share, "p3_spans": p3_spans}
_GRAM = ", ".join(f"lead(tok, {k}) OVER w" for k in range(1, 20))
ORACLES: dict[str, str] = {
    "p3_found": f"""WITH r AS (SELECT DISTINCT doc_id, idx, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS k FROM sentences WHERE doc_id IS NOT NULL AND idx IS NOT NULL AND coalesce(len(excl), 0) = 0),
 s AS (SELECT *, idx - row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS seg FROM r), t AS (SELECT doc_id, seg, idx, unnest(k) AS tok, generate_subscripts(k, 1) AS n FROM s),
 g AS (SELECT doc_id, lead(idx, 19) OVER w AS upto, concat_ws(' ', tok, {_GRAM}) AS g FROM t WINDOW w AS (PARTITION BY doc_id, seg ORDER BY idx, n)), d AS (SELECT DISTINCT doc_id, g FROM g WHERE upto IS NOT NULL),
 c AS (SELECT g FROM d GROUP BY g HAVING count(*) > 1), m AS (SELECT * FROM d JOIN c USING (g)) SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM m x JOIN m y ON x.g = y.g AND x.doc_id < y.doc_id"""
}
